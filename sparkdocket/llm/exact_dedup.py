"""Exact deduplication by skew-safe combining.

Texts meet in three steps, and each compares them in full, since the text itself
is part of the grouping key.  A task first combines the equal texts of its own
partition.  What is left goes to salted digest groups; the salt is the number of
the partition it comes from, so a text that a third of all rows hold is spread
over ``salts`` tasks, each of which gets one row of it from a partition at most.
The winners of the salts, at most ``salts`` for a text, then meet by digest alone.

Rows find their group by joining narrow rows (id and digest) to the winners.
There are at most ``HOT_SHARE`` texts that one of ``HOT_SHARE`` rows or more hold;
their winners are broadcast, and their rows never meet in one task.

Everything is built-in functions: no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdocket.plans.staging import stage

#: A text that one of so many rows or more hold is hot: there are at most so many hot texts.
HOT_SHARE = 10_000


def normal_text(text: Column) -> Column:
    """The text with A-Z (only) lower-cased; a null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def combine_texts(rows: DataFrame, salts: int) -> DataFrame:
    """``digest, content, keep_id, group_size`` for each distinct text of ``id, digest, text``.

    ``content`` is the text where another text shares its digest, else null.
    """
    best = F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    salted = rows.select(
        "digest", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), "text", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")
    ).groupBy("digest", "salt", "text").agg(*best)
    texts = salted.repartition("digest").groupBy("digest", "text").agg(*best)
    alone = F.count(F.lit(1)).over(Window.partitionBy("digest")) == 1
    return texts.select("digest", F.when(~alone, F.col("text")).alias("content"), "keep_id", "group_size")


def mark_copies(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """``id_col, keep_id, group_size, kept, text_sha256`` for each row of ``df``.

    Texts are equal when they are identical after lower-casing A-Z.  Of a group of
    equal texts the row with the largest id is kept; a null id is smaller than any
    other, and of rows that repeat the largest id exactly one is kept.  Null and
    empty texts are one group.  Further columns are not read, whatever their names;
    an empty table gives an empty one.  Texts are compared whole at any length.

    ``digest`` only groups; texts that share one are still told apart.
    """
    text = normal_text(F.col(f"`{text_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    won = stage(combine_texts(rows, salts), "exact-winners").df
    total = won.agg(F.sum("group_size").alias("n"), F.count("content").alias("shared")).first()
    # Of the texts with a digest of their own: a text of one in HOT_SHARE rows, so at most HOT_SHARE of them.
    hot = F.col("content").isNull() & (F.col("group_size") * HOT_SHARE >= (total.n or 0)) & (F.col("group_size") > 1)
    hot_won = won.where(hot).select("digest", F.struct("keep_id", "group_size").alias("of_hot"))
    cold_won = won.where(~hot).select(F.col("digest").alias("digest_of"), "content", F.struct("keep_id", "group_size").alias("of_cold"))
    # Texts travel once more only where some share a digest.
    full = F.col("digest") if digest is sha256 else sha256(F.col("text"))
    narrow = rows.select("id", "digest", full.alias("text_sha256"), (F.col("text") if total.shared else F.lit(None).cast("string")).alias("text"))
    marked = narrow.join(F.broadcast(hot_won), "digest", "left")
    # Rows of hot texts go on under keys of their own, which match nothing.
    key = F.when(F.col("of_hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    same = (F.col("key") == F.col("digest_of")) & (F.col("content").isNull() | (F.col("content") == F.col("text")))
    found = marked.withColumn("key", key).join(cold_won, same, "left").withColumn("of", F.coalesce("of_hot", "of_cold"))
    out = found.select("id", F.col("of.keep_id").alias("keep_id"), F.col("of.group_size").alias("group_size"), "text_sha256")
    return _one_kept(out).withColumnRenamed("id", id_col)


def _one_kept(rows: DataFrame) -> DataFrame:
    """Add ``kept`` to ``id, keep_id, group_size, text_sha256``: exactly one row of each text."""
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "exact-rows").df
    last = F.col("id").eqNullSafe(F.col("keep_id"))
    firsts = rows.where(last).groupBy("text_sha256").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    if firsts.where("n > 1").isEmpty():
        return rows.select("id", "keep_id", "group_size", last.alias("kept"), "text_sha256")
    picked = rows.join(firsts.select(F.col("first_row").alias("row"), F.lit(True).alias("is_first")), "row", "left")
    return picked.select("id", "keep_id", "group_size", F.col("is_first").isNotNull().alias("kept"), "text_sha256")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}

ORACLE = {
    "op13_exact_dedup": """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""
}
