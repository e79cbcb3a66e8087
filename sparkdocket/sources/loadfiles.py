"""Load files, rosters and hash lists by Spark's own readers."""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdocket.plans.staging import stage

#: Header aliases of a load file's fields.
HEADERS = {
    "control_number": ["control_number", "control number", "begdoc", "bates", "docid"], "sha256": ["sha256", "sha-256", "hash"], "item_id": ["item_id", "item id"],
    "custodian": ["custodian", "cust"], "file_name": ["file_name", "file name", "filename"], "date_sent": ["date_sent", "date sent", "sent"], "message_id": ["message_id", "message id"],
}
JOIN_KEYS = ["message_id", "sha256", "item_id", "control_number"]


def read_dat(spark: SparkSession, path: str) -> DataFrame:
    """A Concordance file (þ around fields, ¶ between, ® for line ends), columns by its header line."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    unquote = F.transform(F.split("value", "¶"), lambda x: F.replace(F.regexp_replace(F.trim(x), "^þ|þ$", ""), F.lit("®"), F.lit("\n")))
    rows = lines.select(unquote.alias("f"), F.col("value"))
    header = lines.select(unquote.alias("f")).first()
    if header is None:
        raise ValueError("the load file is empty")
    names = header["f"]
    body = rows.where(~F.col("f").eqNullSafe(F.array(*[F.lit(n) for n in names])))
    return body.select(*[F.nullif(F.get("f", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record, text`` of CSV files: records numbered from 1 in each file, line ends inside quotes kept.

    Files are read in byte ranges, as Spark splits them.  A line begins a record if an
    even number of quotes stands before it in the file: a first pass counts quotes and
    lines of each range, from which every range knows how it begins, so that a large
    file with line ends in its fields needs no single task.  A quote that is not
    doubled inside a quoted field is one more, as anywhere in CSV.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    here = Window.partitionBy("file", "start").orderBy("line")
    before = F.coalesce(F.sum("quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Records that begin in a range, if it begins outside quotes and if inside.
    marked = stage(lines.withColumn("even", before % 2 == 0), "csv-lines").df
    ranges = marked.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.count_if("even").alias("out"), F.count_if(~F.col("even")).alias("in"))
    # A row per range: a file of 1 TB has some ten thousand.
    prior = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("inside", F.coalesce(F.sum("quotes").over(prior), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("in")).otherwise(F.col("out"))
    ranges = ranges.select("file", "start", "inside", F.coalesce(F.sum(begun).over(prior), F.lit(0)).alias("records"))
    known = marked.join(ranges, ["file", "start"]).withColumn("begins", F.col("even") != F.col("inside"))
    number = F.col("records") + F.sum(F.col("begins").cast("long")).over(here.rowsBetween(Window.unboundedPreceding, 0))
    placed = known.select("file", number.alias("record"), F.struct("start", "line", "value").alias("part"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["value"]), "\n")
    return placed.groupBy("file", "record").agg(F.regexp_replace(text, "\r$", "").alias("text"))


def read_csv(spark: SparkSession, path: str, *, max_bytes: int | None = None, max_rows: int | None = None) -> DataFrame:
    """A CSV with header; all fields are text, trimmed, blank is null; blank lines are none.

    Records may be short; what they have beyond the header is dropped.  ``max_bytes`` and ``max_rows`` refuse larger files (None: any size).
    """
    if max_bytes is not None:
        size = spark.read.text(path).select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0] or 0
        if size > max_bytes:
            raise ValueError(f"the load file has {size} bytes, more than {max_bytes}")
    records = csv_records(spark, path).where(F.trim("text") != "")
    first = records.orderBy("file", "record").first()
    if first is None:
        raise ValueError("the load file is empty")
    names = [h.strip() for h in next(csv.reader(io.StringIO(first.text.lstrip("\ufeff"))))]
    schema = ", ".join(f"f{n} string" for n in range(len(names)))
    heads = records.groupBy("file").agg(F.min("record").alias("record"))
    body = records.join(F.broadcast(heads), ["file", "record"], "left_anti")  # a row per file
    options = {"multiLine": "true", "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "maxCharsPerColumn": "-1"}
    if max_rows is not None and (n := body.count()) > max_rows:
        raise ValueError(f"the load file has {n} rows, more than {max_rows}")
    rows = body.select(F.from_csv("text", schema, options).alias("f"))
    return rows.select(*[F.nullif(F.trim(F.col(f"f.f{n}")), F.lit("")).alias(name) for n, name in enumerate(names)])


def read_load_file(spark: SparkSession, path: str) -> DataFrame:
    """A Concordance file where the first line has its field marks, else a CSV."""
    first = spark.read.text(path).first()
    return read_dat(spark, path) if first is not None and "þ" in first["value"][:4096] else read_csv(spark, path)


def expected_docs(loaded: DataFrame) -> DataFrame:
    """Columns renamed by the header map; at least one join key must be there."""
    have = {c.strip().lower(): c for c in loaded.columns}
    picked = {f: have[a] for f, names in HEADERS.items() for a in names if a in have}
    if not set(picked) & set(JOIN_KEYS):
        raise ValueError(f"none of {JOIN_KEYS} is in the load file's header")
    return loaded.select(*[F.col(f"`{c}`").alias(f) for f, c in picked.items()])


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """``name, notes`` of expected custodians, one row per name without case."""
    df = read_csv(spark, path)
    notes = F.col("notes") if "notes" in df.columns else F.lit(None).cast("string")
    return df.where("custodian IS NOT NULL").groupBy(F.lower("custodian").alias("key")).agg(F.min("custodian").alias("name"), F.max(notes).alias("notes")).drop("key")


def read_hash_list(spark: SparkSession, path: str) -> DataFrame:
    """``sha256`` values: the first token of each line that is one; ``#`` begins a comment."""
    tok = F.lower(F.regexp_extract("value", r"^\s*([^\s#,]+)", 1))
    tokens = spark.read.text(path).select(tok.alias("sha256")).where("sha256 <> ''")
    kinds = tokens.agg(F.count_if(F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("n"), F.count_if(F.col("sha256").rlike("^([0-9a-f]{32}|[0-9a-f]{40})$")).alias("other")).first()
    if not kinds["n"]:
        raise ValueError("the list holds MD5 or SHA-1 digests" if kinds["other"] else "the list holds no SHA-256 digest")
    return tokens.where(F.col("sha256").rlike("^[0-9a-f]{64}$")).distinct()
