"""Fixed rollups: overview, people graph, conversations, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocket.functions import norm


def overview(items: DataFrame) -> DataFrame:
    """One row: items, top-level items and their bytes, families."""
    top = F.coalesce(F.col("role"), F.lit("")) != "attachment"
    return items.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(top).alias("top_level"), F.coalesce(F.sum(F.when(top, F.col("size_bytes"))), F.lit(0)).alias("top_level_bytes"),
        F.count_if(F.coalesce(F.col("role") == "parent", F.lit(False))).alias("families"),
    )


def top_with_rest(items: DataFrame, label: str, n: int) -> DataFrame:
    """The ``n`` most frequent labels (ties by label; null is blank) and a last row ``(other)`` with the rest."""
    counts = items.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "label").limit(n)
    rest = counts.join(top.select("label"), "label", "left_anti").agg(F.sum("n").alias("n")).where("n IS NOT NULL")
    return top.select("label", "n", F.lit(False).alias("is_rest")).union(rest.select(F.lit("(other)"), "n", F.lit(True)))


def people_nodes(p: DataFrame) -> DataFrame:
    """Per person: counts by role, distinct items, first and last day, items written to oneself."""
    role = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    # One row per person and item first: distinct counts are then plain counts.
    per_item = p.groupBy("person", "item_id").agg(
        *[role(r) for r in ("from", "to", "cc", "bcc")], F.min("item_at").alias("first_at"), F.max("item_at").alias("last_at"),
    )
    total = lambda r: F.sum(f"n_{r}").alias(f"n_{r}")
    return per_item.groupBy("person").agg(
        *[total(r) for r in ("from", "to", "cc", "bcc")], F.count(F.lit(1)).alias("n_items"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.count_if((F.col("n_from") > 0) & (F.col("n_to") + F.col("n_cc") + F.col("n_bcc") > 0)).alias("n_self"),
    )


def people_edges(p: DataFrame, parts: int | None = None) -> DataFrame:
    """Directed edges from writers to recipients; blind copies count but are not visible; no self loops.

    Edges are about as many as messages: ``parts`` says over how many tasks they are dealt, else the session does.
    """
    senders = p.where("role = 'from'").select("item_id", F.col("person").alias("src"))
    got = p.where("role <> 'from'").select("item_id", F.col("person").alias("dst"), "role", "item_at")
    e = senders.join(got, "item_id").where("src <> dst")
    e = e if parts is None else e.repartition(parts, "src", "dst")
    n = lambda r: F.count_if(F.col("role") == r).alias(f"n_{r}")
    return e.groupBy("src", "dst").agg(n("to"), n("cc"), n("bcc"), F.count_if(F.col("role") != "bcc").alias("n_visible"), F.min("item_at").alias("first_at"), F.max("item_at").alias("last_at"))


def iso_week(t: Column) -> Column:
    """``YYYY-Www`` of the ISO calendar."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(t).cast("string"), 2, "0"))


def people_timeline(p: DataFrame, bucket: str = "week", parts: int | None = None) -> DataFrame:
    """Distinct items per bucket, for everyone (person null) and per person; ``parts`` as for edges."""
    b = iso_week(F.col("item_at")) if bucket == "week" else F.date_format("item_at", "yyyy-MM-dd")
    seen = p.where("item_at IS NOT NULL").select(b.alias("bucket"), "person", "item_id").distinct()
    single = (seen if parts is None else seen.repartition(parts, "bucket", "person")).groupBy("bucket", "person").agg(F.count(F.lit(1)).alias("n_items"))
    everyone = seen.select("bucket", "item_id").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("n_items"))
    return everyone.select("bucket", F.lit(None).cast("string").alias("person"), "n_items").union(single.select("bucket", "person", "n_items"))


def expand_participants(items: DataFrame, slots: int = 200) -> DataFrame:
    """Participants of messages: the writer, then to, cc and bcc in order, at most ``slots`` new ones each item.

    ``items`` has ``item_id, from_addr, to_addrs, cc_addrs, bcc_addrs``; the same person in the same role counts once.
    """
    roles = [("from", F.array("from_addr")), ("to", F.col("to_addrs")), ("cc", F.col("cc_addrs")), ("bcc", F.col("bcc_addrs"))]

    def as_role(r: str):
        return lambda x: F.struct(F.lit(r).alias("role"), F.lower(F.trim(x)).alias("person"))

    listed = F.concat(*[F.transform(F.coalesce(a, F.array().cast("array<string>")), as_role(r)) for r, a in roles])
    return items.select("item_id", F.explode(F.slice(F.array_distinct(F.filter(listed, lambda x: F.coalesce(x["person"], F.lit("")) != "")), 1, slots)).alias("p")).select("item_id", "p.role", "p.person")


def conversations(messages: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Per conversation: messages, hits, first and last position; with hits, only conversations that have one."""
    m = messages if hits is None else messages.join(hits.select("item_id", F.lit(1).alias("hit")).distinct(), "item_id", "left")
    hit = F.col("hit").isNotNull() if hits is not None else F.lit(False)
    out = m.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(hit).alias("n_hits"), F.min("position").alias("first_at"), F.max("position").alias("last_at"))
    return out.where("n_hits > 0") if hits is not None else out


def reply_snippets(replies: DataFrame, parents: DataFrame, most: int = 100) -> DataFrame:
    """``item_id, snippet`` of what each reply (``item_id, parent_item_id``) answers: the parent's text, else its subject, white space collapsed and cut to ``most`` characters; ``[unavailable]`` without either."""
    told = lambda c: F.nullif(norm.collapse(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    words = F.coalesce(told("text"), told("subject"))
    short = F.when(F.length(words) > most, F.concat(F.substring(words, 1, most), F.lit("…"))).otherwise(words)
    before = parents.select(F.col("item_id").alias("parent_item_id"), short.alias("snippet"))
    return replies.select("item_id", "parent_item_id").join(before, "parent_item_id", "left").select("item_id", F.coalesce("snippet", F.lit("[unavailable]")).alias("snippet"))


def around(messages: DataFrame, anchors: DataFrame, before: int, after: int) -> DataFrame:
    """Messages around anchors (``conv_id, anchor``) by their distance in position.

    Positions fall into stretches as wide as a window, of which a window meets two at
    most: the join is on conversation and stretch, so that neither a long conversation
    nor many anchors in one meet as a whole.
    """
    width = before + after + 1
    stretch = lambda c: F.floor(c / width)
    m = messages.select("conv_id", "position", "item_id", stretch(F.col("position")).alias("stretch"))
    wide = anchors.select("conv_id", "anchor", F.explode(F.sequence(stretch(F.col("anchor") - before), stretch(F.col("anchor") + after))).alias("stretch"))
    near = m.join(wide, ["conv_id", "stretch"]).withColumn("gap", F.col("position") - F.col("anchor")).where(F.col("gap").between(-before, after))
    return near.select("conv_id", "anchor", "item_id", "gap")


def date_coverage(dated: DataFrame, start: str, end: str, bucket: str) -> DataFrame:
    """Every week (from Monday) or month that touches [start, end], its count and whether it is a hole.

    A hole is a single empty bucket between two that are not empty.
    """
    if bucket not in ("week", "month"):
        raise ValueError("coverage is by week or month")
    if start > end:
        raise ValueError("the window is empty")
    low, high = F.lit(start).cast("date"), F.lit(end).cast("date")
    step = F.expr("interval 7 days" if bucket == "week" else "interval 1 month")
    spark = dated.sparkSession
    grid = spark.range(1).select(F.explode(F.sequence(F.date_trunc(bucket, low), F.date_trunc(bucket, high), step)).alias("at")).select(F.col("at").cast("date").alias("bucket"))
    inside = dated.where(F.col("at").cast("date").between(low, high))
    counts = inside.groupBy(F.date_trunc(bucket, "at").cast("date").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # The calendar has as many rows as the window has buckets.
    w = Window.orderBy("bucket")
    full = grid.join(counts, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("is_hole", (F.col("n") == 0) & (F.coalesce(F.lag("n").over(w), F.lit(0)) > 0) & (F.coalesce(F.lead("n").over(w), F.lit(0)) > 0))
