"""Which items a job has to work on, and reports of jobs as folders of CSV tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.functions import norm

# What can be no calendar, by the end of its path and by its MIME type.
_NO_CALENDAR = ["pdf", "docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "doc", "xls", "ppt", "eml", "msg", "pst", "ost", "png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp", "mp3", "wav", "m4a", "flac", "mp4", "mov", "avi"]
_NO_CALENDAR_MIME = "^(?:application/pdf|image/|audio/|video/)|wordprocessingml|spreadsheetml|presentationml|officedocument"
TAXONOMY = "taxonomy_v1"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _classify() -> Column:
    unknown = (F.trim(_text("file_category")) == "") | F.lower(_text("file_category")).isin("attachment", "other", "unrecognized")
    return unknown | (_text("category_taxonomy") != TAXONOMY)


def _calendar() -> Column:
    path, mime = F.lower(_text("path")), _text("mime_type")
    other = path.rlike(rf"\.(?:{'|'.join(_NO_CALENDAR)})$") | mime.rlike(_NO_CALENDAR_MIME) | F.lower(mime).startswith("message/rfc822")
    return F.col("native_sha256").isNotNull() & (path.rlike(r"\.(?:ics|ical)$") | mime.contains("text/calendar") | (path == "") | (mime == "") | ~other)


def _chat() -> Column:
    path, mime, kind = F.lower(_text("path")), _text("mime_type"), _text("message_class").contains("SkypeTeams")
    page = path.rlike(r"\.(?:html|htm|json)$|team chat|conversation history") | mime.rlike("text/html|application/json")
    return (page | kind) & ~((_text("role") == "chat_message") & ~kind)


def _text_ready() -> Column:
    return F.trim(_text("text_sha256")) != ""


def _index() -> Column:
    return F.coalesce(F.col("status").isin(norm.ANALYZABLE), F.lit(False)) & (F.col("text_sha256").isNotNull() | F.col("html_sha256").isNotNull())


#: Conditions by job; each names the columns that it needs.
JOBS = {
    "classify": _classify, "calendar": _calendar, "chat": _chat, "suggest": _text_ready, "index": _index,
    "embed": lambda: F.col("text_sha256").isNotNull() | F.col("embedded_sha256").isNotNull(),
    # What is in an index without a right to be there.
    "index_orphans": lambda: F.col("indexed_sha256").isNotNull() & ~_index(),
}


def candidates(items: DataFrame, job: str, *, in_review: bool = False, force: bool = False) -> DataFrame:
    """The items that a job works on, as a filter of the table; with ``force`` those that are done too (classify)."""
    if job not in JOBS:
        raise ValueError(f"no job {job!r}; there are {sorted(JOBS)}")
    rows = items.where(F.coalesce(F.col("in_review"), F.lit(False))) if in_review else items
    return rows if force and job == "classify" else rows.where(JOBS[job]())


def metrics(parts: dict[str, Column | str | int | bool], source: DataFrame) -> DataFrame:
    """``metric, value`` of one row of aggregates over ``source``; plain values stand as they are."""
    made = source.agg(*[(c if isinstance(c, Column) else F.lit(str(c))).cast("string").alias(k) for k, c in parts.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in parts])
    return made.select(F.explode(pairs).alias("p")).select("p.*")


def qc_report(findings: DataFrame, scope: str, pack: str, candidate_count: int, fingerprint: str) -> dict[str, DataFrame]:
    """The tables of a QC report: ``summary`` and ``findings`` (``rule, severity, item_id``)."""
    errors, warnings = (F.count_if(F.col("severity") == s) for s in ("error", "warn"))
    summary = metrics({"pack": pack, "scope": scope, "candidate_count": candidate_count, "error_count": errors, "warn_count": warnings, "passed": (errors == 0).cast("int"), "selection_fingerprint": fingerprint}, findings)
    return {"summary": summary, "findings": findings.select("rule", "severity", "item_id")}


def gap_report(roster: DataFrame, inventory: DataFrame, coverage: DataFrame, matched: DataFrame, missing: DataFrame) -> dict[str, DataFrame]:
    """The tables of a gap report, with a ``summary`` of their sizes; empty ones have a header alone."""
    tables = {"roster": roster, "inventory": inventory, "date_coverage": coverage, "matched": matched, "expected_not_in_matter": missing}
    sizes = [metrics({f"{name}_count": F.count(F.lit(1))}, t) for name, t in tables.items()]
    return {"summary": reduce(DataFrame.union, sizes), **tables}


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Write each table as CSV with a header below ``path``, which must not be there; all of them or none."""
    spark = next(iter(tables.values())).sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        raise FileExistsError(f"{path} is there already")
    half = f"{path}.tmp"
    fs.delete(at(half), True)
    for name, table in tables.items():
        table.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{half}/{name}")
    fs.rename(at(half), at(path))
