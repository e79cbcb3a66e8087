"""Connected components as DataFrame rounds (alternating star contraction).

Every round is two group-by-and-join steps over the edge list, so nothing is
collected and a hub with very many neighbours is only ever a minimum per key
plus a join that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdocket.plans.staging import Scratch, stage


def _ends(*pairs: tuple[Column, Column]) -> Column:
    """A row ``u, v`` of each pair.  One pass over the edges: a union would double the plan each time it is used."""
    return F.inline(F.array(*[F.struct(u.alias("u"), v.alias("v")) for u, v in pairs]))


def _large_star(edges: DataFrame) -> DataFrame:
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    both = edges.select(_ends((u, v), (v, u)))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(low, "u").select(v.alias("u"), m.alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(_ends((v, m), (u, m))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", scratch: Scratch | None = None) -> DataFrame:
    """Label each vertex that has an edge with the smallest vertex it reaches.

    Null ends and self loops are ignored; repeated edges count once.  Returns
    ``vertex, component``; an empty edge list gives an empty table.  Rounds go on
    until nothing changes (a logarithm of the number of edges).  The table that the
    result reads belongs to ``scratch``, where given.
    """
    scratch = Scratch() if scratch is None else scratch
    kind = edges.schema[src].dataType
    current = stage(
        edges.select(F.col(src).cast(kind).alias("u"), F.col(dst).cast(kind).alias("v"))
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "cc",
    )
    before = _mark(current.df)
    while before[0]:
        following = stage(_small_star(_large_star(current.df)), "cc")
        current.drop()
        current, after = following, _mark(following.df)
        if after == before:
            break
        before = after
    scratch.tables.append(current)
    stars = current.df
    roots = stars.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
