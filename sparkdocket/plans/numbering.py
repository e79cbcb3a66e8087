"""Dense numbers in a global order, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocket.plans.staging import stage


#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_PLACES = 33


def number_rows(df: DataFrame, order: list[Column], out: str = "number", weight: Column | None = None) -> DataFrame:
    """Add 1..N in ``order`` (which should end in a unique key); with ``weight``, the sum of weights up to each row.

    Rows are dealt by range, sorted and written with their range's number and their place in it; the
    counts of the ranges, as many as there are partitions, give each range its offset.  So rows are shuffled
    once; sums of weights take a second shuffle.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged = stage(placed if weight is None else placed.withColumn("_weight", weight), "ranged")
    rows = ranged.df.withColumn("_range", F.shiftright("_place", _PLACES))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)) if weight is None else F.sum("_weight")).toDF("_range", "n")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    here = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.col("_place").bitwiseAND(F.lit((1 << _PLACES) - 1)) + 1 if weight is None else F.sum("_weight").over(here)
    numbered = rows.withColumn("_at", inside).join(F.broadcast(offsets), "_range")
    return numbered.withColumn(out, (F.col("_before") + F.col("_at")).cast("long")).drop("_range", "_at", "_before", "_weight", "_place")


def first_by(df: DataFrame, keys: list[str], order: list[str], picked: str, out: str) -> DataFrame:
    """One row per key with the ``picked`` value of the first row in order (nulls first).

    A minimum per key: it combines before the shuffle and no key's rows meet.
    """
    return df.groupBy(*keys).agg(F.min(F.struct(*order, F.col(picked).alias("_picked")))["_picked"].alias(out))
