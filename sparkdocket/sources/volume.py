"""Production volumes as files: ``VOLnnn/NATIVES``, ``TEXT`` and ``DATA`` with both load files.

A data source writer in two phases.  A task writes whole volumes (their size is
bounded by how they are numbered) into a folder of its own attempt; when all tasks
have committed, the driver renames one folder for each volume that the committed
attempts name and deletes the other attempts.  So a task that runs twice leaves no
file twice, and a job that fails leaves no volume.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructField, StructType

from sparkdocket.sources.loadfiles import read_dat

#: What a row of a volume is: its place, its files (null: none) and its line of each load file.
ROW = "volume string, seq long, control string, ext string, native binary, text string, line string, csv string"


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written: items and bytes of each volume."""

    attempt: str
    volumes: dict[str, list[int]]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.line, self.csv, self.readme = options["path"].rstrip("/"), options.get("line", ""), options.get("csv", ""), options.get("readme", "")
        self.overwrite = overwrite

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._at()
        attempt = f"_attempt-{uuid.uuid4().hex}"
        volumes: dict[str, list[int]] = {}
        files: list = []

        def put(where: str, content: bytes) -> None:
            with store.open_output_stream(f"{root}/{attempt}/{where}", compression=None) as out:
                out.write(content)

        def close() -> None:
            for f in files:
                f.close()
            files.clear()

        now = None
        for batch in iterator:
            for r in batch.to_pylist():
                if r["volume"] != now:
                    close()
                    now = r["volume"]
                    if now in volumes:
                        raise ValueError(f"the rows of {now} do not stand together")
                    volumes[now] = [0, 0]
                    for folder in ("DATA", "NATIVES", "TEXT"):
                        store.create_dir(f"{root}/{attempt}/{now}/{folder}")
                    for name, head in (("load.dat", self.line), ("load.csv", self.csv)):
                        files.append(store.open_output_stream(f"{root}/{attempt}/{now}/DATA/{name}", compression=None))
                        files[-1].write((head + "\r\n").encode())
                    put(f"{now}/DATA/readme.txt", self.readme.encode())
                if r["native"] is not None:
                    put(f"{now}/NATIVES/{r['control']}.{r['ext']}", r["native"])
                if r["text"] is not None:
                    put(f"{now}/TEXT/{r['control']}.txt", r["text"].encode())
                files[0].write((r["line"] + "\r\n").encode())
                files[1].write((r["csv"] + "\r\n").encode())
                volumes[now][0] += 1
                volumes[now][1] += len(r["native"] or b"") + len((r["text"] or "").encode())
        close()
        return Written(attempt, volumes)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._at()
        done = {v: (m.attempt, n) for m in messages if m is not None for v, n in m.volumes.items()}
        if sum(len(m.volumes) for m in messages if m is not None) != len(done):
            raise ValueError("a volume was written by two tasks")
        there = [v for v in done if store.get_file_info(f"{root}/{v}").type != fs.FileType.NotFound]
        if there and not self.overwrite:
            raise FileExistsError(f"{there[0]} is there already")
        for v in there:
            store.delete_dir(f"{root}/{v}")
        for v, (attempt, _) in done.items():
            store.move(f"{root}/{attempt}/{v}", f"{root}/{v}")
        self._drop_attempts(store, root)
        with store.open_output_stream(f"{root}/summary.json") as out:
            out.write(json.dumps({v: {"items": n[0], "bytes": n[1]} for v, (_, n) in sorted(done.items())}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_attempts(*self._at())

    def _drop_attempts(self, store: fs.FileSystem, root: str) -> None:
        for info in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("_attempt-"):
                store.delete_dir(info.path)


class VolumeSource(DataSource):
    """``df.write.format("production_volume").save(path)`` of rows as in ROW, each volume's together and in order."""

    @classmethod
    def name(cls) -> str:
        return "production_volume"

    def schema(self) -> str:
        return ROW

    def writer(self, schema: StructType, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def write_volumes(rows: DataFrame, path: str, *, line: str, csv: str, readme: str = "", overwrite: bool = False) -> None:
    """Write rows (as in ROW) as volumes; ``line`` and ``csv`` are the headers of the load files."""
    rows.sparkSession.dataSource.register(VolumeSource)
    told = rows.select(*[f.strip().split(" ")[0] for f in ROW.split(",")]).repartition("volume").sortWithinPartitions("volume", "seq")
    told.write.format("production_volume").option("line", line).option("csv", csv).option("readme", readme).mode("overwrite" if overwrite else "append").save(path)


#: Bytes of file contents in a batch, about (one larger file is taken whole).
_READ_BYTES = 2 << 20


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """Volumes read back: the load files' fields, ``volume``, ``native`` and ``text`` as bytes (null: none).

    Tasks open the files that their lines name.  The driver lists the load files alone, one a volume,
    and never the items' own files.
    """
    path = path.rstrip("/")
    out = read_dat(spark, f"{path}/VOL*/DATA/load.dat").withColumn("volume", F.regexp_extract(F.coalesce("NATIVE_PATH", "TEXT_PATH"), r"^(VOL[^/]*)/", 1))
    names = [*out.columns, "native", "text"]

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)

        def content(named: str | None) -> bytes | None:
            place = re.sub(r"[/\\]+", "/", named or "")
            if not re.fullmatch(r"VOL[^/]*/(?:NATIVES|TEXT)/[^/]*", place) or store.get_file_info(f"{root}/{place}").type != fs.FileType.File:
                return None
            with store.open_input_stream(f"{root}/{place}", compression=None) as f:
                return f.read()

        for b in batches:
            natives, texts, size, begin = [], [], 0, 0
            named = zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("NATIVE_PATH", "TEXT_PATH")], strict=True)
            for end, (native, text) in enumerate(named, 1):
                natives.append(content(native))
                texts.append(content(text))
                size += len(natives[-1] or b"") + len(texts[-1] or b"")
                if size >= _READ_BYTES or end == b.num_rows:
                    yield pa.RecordBatch.from_arrays([*b.slice(begin, end - begin).columns, pa.array(natives, pa.binary()), pa.array(texts, pa.binary())], names=names)
                    natives, texts, size, begin = [], [], 0, end

    return out.mapInArrow(contents, StructType([*out.schema.fields, StructField("native", BinaryType()), StructField("text", BinaryType())]))
