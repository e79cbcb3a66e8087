"""Expected against present: cascade match, rosters, load files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def match_cascade(expected: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The first key, in order, by which each expected row is found.

    Both sides have ``id`` and the keys; null and blank keys match nothing.  Per
    key the present side is reduced to its smallest id before the join, so no key
    multiplies rows.  Returns every expected row with ``matched_by, present_id``
    (null where nothing matches).
    """
    hits = None
    for rank, k in enumerate(keys):
        one = present.where(F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "").groupBy(k).agg(F.min("id").alias("present_id"))
        h = expected.select("id", k).join(one, k).select("id", F.lit(rank).alias("rank"), F.lit(k).alias("matched_by"), "present_id")
        hits = h if hits is None else hits.union(h)
    best = hits.groupBy("id").agg(F.min(F.struct("rank", "present_id", "matched_by")).alias("b"))
    return expected.select("id").join(best, "id", "left").select("id", F.col("b.matched_by").alias("matched_by"), F.col("b.present_id").alias("present_id"))


def match_items(expected: DataFrame, present: DataFrame) -> DataFrame:
    """The cascade over items: message id, for mail item id and logical hash, native digest, for others item id and logical hash, control number.

    Both sides have ``id, message_id, item_id, logical_hash, native_sha256,
    control_number``; the expected side also ``is_mail``.
    """
    mail = F.coalesce("is_mail", F.lit(False))
    steps = [
        ("message_id", "message_id", None), ("mail_item_id", "item_id", mail), ("mail_logical_hash", "logical_hash", mail), ("native_sha256", "native_sha256", None),
        ("file_item_id", "item_id", ~mail), ("file_logical_hash", "logical_hash", ~mail), ("control_number", "control_number", None),
    ]
    want = expected.select("id", *[(F.col(c) if cond is None else F.when(cond, F.col(c))).alias(n) for n, c, cond in steps])
    have = present.select("id", *[F.col(c).alias(n) for n, c, _ in steps])
    return match_cascade(want, have, [n for n, _, _ in steps])


def custodian_inventory(items: DataFrame) -> DataFrame:
    """``custodian, n``: items by trimmed custodian, blank for none."""
    return items.groupBy(F.trim(F.coalesce("custodian", F.lit(""))).alias("custodian")).agg(F.count(F.lit(1)).alias("n"))


def unexpected(present: DataFrame, matches: DataFrame) -> DataFrame:
    """Present rows that no expected row found."""
    return present.select("id").join(matches.where("present_id IS NOT NULL").select(F.col("present_id").alias("id")).distinct(), "id", "left_anti")


def roster(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """Names expected but without items, and names with items that nobody expects (``name, finding, n``)."""
    name = F.lower(F.trim("name"))
    want = expected.select(name.alias("name")).where("name <> ''").distinct().withColumn("wanted", F.lit(1))
    have = inventory.groupBy(name.alias("name")).agg(F.sum("n").alias("n"))
    both = want.join(have, "name", "full_outer")
    finding = F.when(F.col("wanted").isNull(), "unexpected").when(F.coalesce("n", F.lit(0)) == 0, "missing")
    return both.select("name", finding.alias("finding"), F.coalesce("n", F.lit(0)).alias("n")).where("finding IS NOT NULL")
