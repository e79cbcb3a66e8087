"""ZIP archives and Office files read as binary files, one task per file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def decode_zip_name(raw: bytes | None, utf8: bool | None) -> str | None:
    """An entry's name: UTF-8 where flagged or valid, else code page 437 if a byte of 0x80 to 0x9F occurs, else Windows-1252."""
    if raw is None:
        return None
    if utf8:
        return raw.decode("utf-8", "replace")
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp437" if any(0x80 <= b <= 0x9F for b in raw) else "cp1252", "replace")


def decode_zip_names(df: DataFrame, raw_col: str, flag_col: str, out_col: str = "name") -> DataFrame:
    """Add the decoded names of raw entry names, batch by batch."""
    fields = [*df.schema.fields, T.StructField(out_col, T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [decode_zip_name(r, f) for r, f in zip(b.column(raw_col).to_pylist(), b.column(flag_col).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=names)

    return df.mapInArrow(run, T.StructType(fields))


def expand_zip(files: DataFrame, max_depth: int = 8, max_entries: int = 500_000, max_entry_bytes: int = 1 << 31) -> DataFrame:
    """Leaves of nested archives: ``archive, path, size, content, problem``.

    ``files`` has ``path`` and ``content``, as the binaryFile reader gives.  Entries
    are read one at a time; what cannot be read, is encrypted or breaks a limit
    gives a row with its problem and no content.  ``max_entries`` counts the leaves
    of an archive together with those of all archives inside it.
    """

    def walk(prefix: str, raw: bytes, depth: int, seen: list[int]):
        try:
            z = zipfile.ZipFile(io.BytesIO(raw))
        except zipfile.BadZipFile:
            yield prefix, None, "bad archive"
            return
        for info in sorted(z.infolist(), key=lambda i: i.filename):
            name = f"{prefix}/{info.filename}" if prefix else info.filename
            if info.is_dir():
                continue
            if seen[0] >= max_entries:
                yield name, None, "too many entries"
                return
            seen[0] += 1
            if info.filename.startswith("/") or ".." in info.filename.split("/"):
                yield name, None, "unsafe path"
            elif info.file_size > max_entry_bytes or info.file_size > 100 * max(1, info.compress_size) and info.file_size > 1 << 20:
                yield name, None, "too large"
            else:
                try:
                    data = z.read(info)
                except (RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
                    yield name, None, str(e)[:100]
                    continue
                if info.filename.lower().endswith(".zip") and depth < max_depth:
                    seen[0] -= 1
                    yield from walk(name, data, depth + 1, seen)
                else:
                    yield name, data, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                for name, data, problem in walk("", raw, 1, [0]):
                    size = None if data is None else len(data)
                    yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([size], pa.int64()), pa.array([data], pa.binary()), pa.array([problem], pa.string())], names=["archive", "path", "size", "content", "problem"])

    return files.select("path", "content").mapInArrow(run, "archive string, path string, size long, content binary, problem string")


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def office_text(raw: bytes) -> str:
    """Text of a docx, xlsx or pptx file: paragraphs, cells or slides in order."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    names = z.namelist()
    number = lambda n: int(re.sub(r"\D", "", n.rsplit("/", 1)[-1]) or 0)

    def paragraphs(part: str, unit: str) -> list[str]:
        out = []
        for p in (e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e.tag) == unit):
            out.append("".join((e.text or "") if _local(e.tag) == "t" else {"tab": "\t", "br": "\n"}.get(_local(e.tag), "") for e in p.iter()))
        return out

    if "word/document.xml" in names:
        return "\n".join(x for part in ["word/document.xml", *sorted(n for n in names if re.match(r"word/(header|footer)\d*\.xml", n))] for x in paragraphs(part, "p"))
    if any(n.startswith("ppt/slides/slide") for n in names):
        slides = sorted((n for n in names if re.match(r"ppt/slides/slide\d+\.xml", n)), key=number)
        return "\n".join(f"Slide {k}\n" + "\n".join(paragraphs(n, "p")) for k, n in enumerate(slides, 1))
    shared = paragraphs("xl/sharedStrings.xml", "si") if "xl/sharedStrings.xml" in names else []
    lines = []
    for n in sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
        lines.append(n.rsplit("/", 1)[-1][:-4])
        for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if _local(e.tag) == "row"):
            cells = []
            for c in row:
                value = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            lines.append("\t".join(cells))
    return "\n".join(lines)


def office_texts(files: DataFrame) -> DataFrame:
    """``path, text, problem`` of Office files (``path, content``, as the binaryFile reader gives); no text is a problem."""

    def read(raw: bytes | None) -> tuple[str | None, str | None]:
        try:
            text = office_text(raw or b"")
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError) as e:
            return None, f"{type(e).__name__}: {e}"[:200]
        return (text, None) if text.strip() else (None, "no text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [read(raw) for raw in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([t for t, _ in made], pa.string()), pa.array([p for _, p in made], pa.string())], names=["path", "text", "problem"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, problem string")
