"""Exact duplicate detection: two-tier item dedupe, and replay of a sequential scan."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.functions import norm
from sparkdocket.operators.graph import connected_components
from sparkdocket.plans.numbering import first_by
from sparkdocket.plans.staging import stage

#: Rounds of a replay before groups of open rows are replayed in tasks, and the rows of such a group at most.
ROUNDS, LOCAL_ROWS = 6, 200_000


def dedupe_items(items: DataFrame, order: tuple[str, ...] = ("path", "item_id"), seeds: DataFrame | None = None) -> DataFrame:
    """Roles of top-level items: ``item_id, dedup_role, dedup_tier, group_id, hash_conflict``.

    With a message id, the first item of it is unique and the others duplicates of
    it.  Without one, items compare by logical hash with each other and with the
    first items of message ids.  ``seeds`` (same columns) are items of earlier
    runs: they count as seen first and get no role.
    """
    cols = ["item_id", "mid", "logical_hash", *[c for c in order if c != "item_id"]]
    now = items.where(F.col("status").isin(norm.ANALYZABLE) & (F.coalesce(F.col("role"), F.lit("parent")) != "attachment"))
    now = now.withColumn("mid", norm.message_id(F.col("message_id"))).select(*cols, F.lit(1).alias("_run"))
    if seeds is not None:
        now = now.unionByName(seeds.withColumn("mid", norm.message_id(F.col("message_id"))).select(*cols, F.lit(0).alias("_run")))
    ranks = ["_run", *order]
    heads = first_by(now.where("mid IS NOT NULL"), ["mid"], ranks, "item_id", "mid_first").join(
        first_by(now.where("mid IS NOT NULL"), ["mid"], ranks, "logical_hash", "first_hash"), "mid"
    )
    # Items without a message id go past the join: as one null key they would all meet.
    bare = now.where("mid IS NULL").select("mid", *[c for c in now.columns if c != "mid"], *[F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in ("mid_first", "first_hash")])
    seen = now.where("mid IS NOT NULL").join(heads, "mid", "left").unionByName(bare)
    canon = first_by(seen.where("logical_hash IS NOT NULL AND (mid IS NULL OR item_id = mid_first)"), ["logical_hash"], ranks, "item_id", "hash_first")
    out = seen.join(canon, "logical_hash", "left").where("_run = 1")
    by_mid = F.col("mid").isNotNull()
    group = F.when(by_mid, F.col("mid_first")).otherwise(F.coalesce("hash_first", "item_id"))
    tier = F.when(by_mid, "message_id").when(F.col("logical_hash").isNotNull(), "logical_hash").otherwise("none")
    return out.select(
        "item_id", F.when(group == F.col("item_id"), "unique").otherwise("duplicate").alias("dedup_role"), tier.alias("dedup_tier"), group.alias("group_id"),
        (by_mid & (F.col("item_id") != F.col("mid_first")) & F.coalesce(F.col("logical_hash") != F.col("first_hash"), F.lit(False))).alias("hash_conflict"),
    )


def suppress_children(items: DataFrame, roles: DataFrame) -> DataFrame:
    """Attachments of duplicates, each with its twin under the canonical parent.

    A twin has the same native digest, else the same name (case ignored) and a
    known size; of several the first by path and id.  Without a twin it is null.
    """
    dup = roles.where("dedup_role = 'duplicate'").select(F.col("item_id").alias("dup_parent"), F.col("group_id").alias("canon_parent"))
    kids = items.where("role = 'attachment'")
    lost = kids.join(dup, kids["parent_item_id"] == dup["dup_parent"]).select(
        F.col("item_id").alias("child"), "canon_parent", F.col("native_sha256").alias("d1"), F.lower("path").alias("n1"), F.col("size_bytes").alias("s1")
    )
    pool = kids.select(F.col("parent_item_id").alias("canon_parent"), F.col("item_id").alias("twin"), F.col("native_sha256").alias("d2"), F.lower("path").alias("n2"), F.col("path").alias("p2"), F.col("size_bytes").alias("s2"))
    by_digest = lost.join(pool, (lost["canon_parent"] == pool["canon_parent"]) & (F.col("d1") == F.col("d2"))).select("child", F.lit(1).alias("rank"), "p2", "twin")
    by_name = lost.join(pool, (lost["canon_parent"] == pool["canon_parent"]) & (F.col("n1") == F.col("n2")) & (F.col("s1") == F.col("s2"))).select("child", F.lit(2).alias("rank"), "p2", "twin")
    best = by_digest.union(by_name).groupBy("child").agg(F.min(F.struct("rank", "p2", "twin"))["twin"].alias("twin"))
    return lost.join(best, "child", "left").select(F.col("child").alias("item_id"), F.lit("family").alias("dedup_tier"), "twin")


def replay_scan(rows: DataFrame, key1: str, key2: str, order: str) -> DataFrame:
    """First-seen dedup of a scan: ``order, role, tier, original``.

    In scan order a row is a duplicate if its first key belongs to an earlier
    unique row, else if its second key does; duplicates add no keys, so this is not
    transitive.  Rounds find the unique rows without replaying the scan: an open
    row that comes first among the open rows of both its keys is unique, and the
    other rows with one of its keys are closed.  ``order`` must be unique; null
    keys match nothing.

    Rows that are linked as a chain settle one a round.  After ``ROUNDS`` rounds the
    open rows are split into groups linked by keys; each group of at most
    ``LOCAL_ROWS`` is replayed in a task, and rounds go on for larger ones.
    """
    base = rows.select(F.col(order).alias("pos"), F.col(key1).alias("k1"), F.col(key2).alias("k2"))
    # Of rows with equal keys only the first can be unique.
    open_rows = stage(base.groupBy("k1", "k2").agg(F.min("pos").alias("pos")), "scan-open")
    found: list[DataFrame] = []
    rounds = 0
    while not open_rows.df.isEmpty():
        now = open_rows.df
        rounds += 1
        if rounds % ROUNDS == 0:
            solved, rest = _replay_groups(now)
            found = [stage(reduce(DataFrame.union, [*found, solved]), "scan-unique").df]
            following = stage(rest, "scan-open")
            open_rows.drop()
            open_rows = following
            continue
        m1 = now.where("k1 IS NOT NULL").groupBy("k1").agg(F.min("pos").alias("m1"))
        m2 = now.where("k2 IS NOT NULL").groupBy("k2").agg(F.min("pos").alias("m2"))
        ranked = now.join(m1, "k1", "left").join(m2, "k2", "left")
        first = (F.coalesce("m1", "pos") == F.col("pos")) & (F.coalesce("m2", "pos") == F.col("pos"))
        unique = stage(ranked.where(first).select("pos", "k1", "k2"), "scan-unique")
        found.append(unique.df)
        rest = now.join(unique.df.select("k1").where("k1 IS NOT NULL"), "k1", "left_anti")
        rest = rest.join(unique.df.select("k2").where("k2 IS NOT NULL"), "k2", "left_anti")
        following = stage(rest.join(unique.df.select("pos"), "pos", "left_anti"), "scan-open")
        open_rows.drop()
        open_rows = following
    uniques = open_rows.df.select("pos", "k1", "k2")
    for f in found:
        uniques = uniques.union(f)
    by1 = uniques.where("k1 IS NOT NULL").select("k1", F.col("pos").alias("u1"))
    by2 = uniques.where("k2 IS NOT NULL").select("k2", F.col("pos").alias("u2"))
    joined = base.join(by1, "k1", "left").join(by2, "k2", "left")
    tier = F.when(F.col("u1") < F.col("pos"), "key1").when(F.col("u2") < F.col("pos"), "key2").otherwise("none")
    return joined.select(
        F.col("pos").alias(order), F.when(tier == "none", "unique").otherwise("duplicate").alias("role"), tier.alias("tier"),
        F.when(tier == "key1", F.col("u1")).when(tier == "key2", F.col("u2")).otherwise(F.col("pos")).alias("original"),
    )


def _replay_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Unique rows of the small groups linked by keys, and the rows of the large ones."""
    one, two = F.concat(F.lit("1:"), F.col("k1").cast("string")), F.concat(F.lit("2:"), F.col("k2").cast("string"))
    parts = connected_components(rows.select(one.alias("src"), two.alias("dst")))
    own = F.coalesce(one, two, F.concat(F.lit("0:"), F.col("pos").cast("string")))
    placed = rows.withColumn("vertex", own).join(parts, "vertex", "left").withColumn("part", F.coalesce("component", "vertex")).select("pos", "k1", "k2", "part")
    placed = stage(placed, "scan-groups").df
    sizes = placed.groupBy("part").agg((F.count(F.lit(1)) <= LOCAL_ROWS).alias("small"))
    sized = placed.join(sizes, "part")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        used1, used2, keep = set(), set(), []
        for a, b in zip(pdf["k1"], pdf["k2"], strict=True):
            free = not (pd.notna(a) and a in used1) and not (pd.notna(b) and b in used2)
            keep.append(free)
            if free:
                used1.add(a)
                used2.add(b)
        return pdf.loc[keep, ["pos", "k1", "k2"]]

    schema = T.StructType([rows.schema[c] for c in ("pos", "k1", "k2")])
    solved = sized.where("small").groupBy("part").applyInPandas(replay, schema)
    return solved, sized.where("NOT small").select("pos", "k1", "k2")


def keep_set(members: DataFrame, policy: str = "first_seen", pattern: str | None = None) -> DataFrame:
    """Winner of each group: intact before degraded or orphaned, then the policy, then path and id.

    ``members`` has ``group_id, item_id, path, size_bytes, scan_order, degraded``;
    members whose ``materialize_ok`` (optional) is false cannot win, and a group
    without any that can is dropped.
    """
    rank = {
        "first_seen": F.col("scan_order").cast("long"), "keep_largest": -F.col("size_bytes").cast("long"),
        "prefer_path": F.when(F.lower("path").contains((pattern or "").lower()), 0).otherwise(1).cast("long"),
    }[policy]
    able = members.where("materialize_ok") if "materialize_ok" in members.columns else members
    key = F.struct(F.col("degraded").cast("int").alias("bad"), rank.alias("rank"), F.col("path"), F.col("item_id"))
    return able.groupBy("group_id").agg(F.min(key)["item_id"].alias("winner"), F.count(F.lit(1)).alias("members"), F.sum("size_bytes").alias("group_bytes"))


def keep_decisions(members: DataFrame, policy: str = "first_seen", pattern: str | None = None) -> DataFrame:
    """``group_id, item_id, role, winner`` for each member: ``unique`` for the winner, ``duplicate`` for others of its group, ``materialize_failed`` where it could not be written.

    A member that failed never wins; its group's next best does, and has none if all failed.
    """
    won = keep_set(members, policy, pattern).select("group_id", "winner")
    able = F.col("materialize_ok") if "materialize_ok" in members.columns else F.lit(True)
    role = F.when(~able, "materialize_failed").when(F.col("item_id") == F.col("winner"), "unique").otherwise("duplicate")
    # Rows of one group only look up its winner: Spark may split them over tasks.
    return members.join(won, "group_id", "left").select("group_id", "item_id", role.alias("role"), "winner")
