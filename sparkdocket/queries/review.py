"""Culling, promotion, numbering, threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.functions import norm
from sparkdocket.operators import cull as c
from sparkdocket.operators import thread
from sparkdocket.plans import items as adapt

_RULES = c.Rules(statuses=["extracted", "partial", "normalized"], start="1995-01-01 00:00:00", end="1997-01-01 00:00:00", missing_date_culls=True, categories_excluded=["R", "5-low"], min_size=20_000, max_size=200_000, paths_excluded=["cust/1"])


def _flat(df):
    return df.select("item_id", "cull_status", F.concat_ws(",", "cull_reasons").alias("cull_reasons"))


def cull_rules(spark, sf_dir):
    return _flat(c.cull(adapt.order_items(spark, sf_dir), _RULES, "independent"))


def cull_family_keep(spark, sf_dir):
    return _flat(c.cull(adapt.order_items(spark, sf_dir), _RULES, "keep_children"))


def cull_family_cull(spark, sf_dir):
    return _flat(c.cull(adapt.order_items(spark, sf_dir), _RULES, "cull_children"))


def promote_order(spark, sf_dir):
    items = adapt.order_items(spark, sf_dir).select("item_id", "parent_item_id", "path", "status")
    return c.promote(c.whole_families(c.promotion_base(items), items))


def promote_culled(spark, sf_dir):
    """Only what the cull included, numbered."""
    items = adapt.order_items(spark, sf_dir)
    marked = items.join(c.cull(items, _RULES, "keep_children").select("item_id", "cull_status"), "item_id")
    return c.promote(c.promotion_base(marked))


def production_numbers(spark, sf_dir):
    o = adapt.table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("review_order"), (F.col("o_orderpriority") == "1-URGENT").alias("withheld"))
    return c.number_production(items, "PRD", 6)


def _turns(spark, sf_dir):
    t = adapt.table(spark, sf_dir, "conversations")
    mid = lambda turn: F.concat_ws("-", F.lit("m"), F.col("conv_id").cast("string"), turn.cast("string"))
    return t.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("item_id"),
        F.when(F.col("conv_id") % 3 != 0, mid(F.col("turn"))).alias("mid"),
        F.when((F.col("conv_id") % 3 == 1) & (F.col("turn") > 0), mid(F.col("turn") - 1)).alias("in_reply_to"), F.array().cast("array<string>").alias("refs"),
        F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("Re: FW : c"), F.col("conv_id").cast("string"))).alias("subject"),
        F.when(F.col("conv_id") % 3 == 2, F.sha2(F.col("conv_id").cast("string"), 256)).alias("conv_index"),
    )


def thread_conversations(spark, sf_dir):
    """Turns as messages: a third linked by headers, a third by subject, a third by index.

    A thread is named by its least message here, so that names do not depend on the digest.
    """
    t = thread.thread_items(_turns(spark, sf_dir))
    least = t.groupBy("thread_id").agg(F.min("item_id").alias("thread_first"), F.count(F.lit(1)).alias("n"))
    return t.join(least, "thread_id").select("item_id", "thread_first", "thread_method", "n")


def subject_groups(spark, sf_dir):
    """Subject lines made of the first words of first turns, grouped by their normal form."""
    t = adapt.table(spark, sf_dir, "conversations").where(F.col("text").isNotNull())
    subject = F.concat(F.when(F.col("turn") % 2 == 0, "RE: Fwd : ").otherwise(""), F.substring_index("text", " ", 2))
    return t.groupBy(norm.thread_subject(subject).alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_conv"))


_REASONS = """
r AS (SELECT item_id, parent_item_id, list_filter([
  CASE WHEN status NOT IN ('extracted', 'partial', 'normalized') THEN 'status' END,
  CASE WHEN coalesce(sent_at, received_at) < TIMESTAMP '1995-01-01' OR coalesce(sent_at, received_at) >= TIMESTAMP '1997-01-01' THEN 'date_outside' END,
  CASE WHEN coalesce(sent_at, received_at) IS NULL THEN 'date_missing' END,
  CASE WHEN contains(lower(path), 'cust/1') THEN 'path' END,
  CASE WHEN lower(file_category) IN ('r', '5-low') THEN 'category' END,
  CASE WHEN coalesce(size_bytes < 20000, true) THEN 'too_small' END,
  CASE WHEN coalesce(size_bytes > 200000, true) THEN 'too_large' END], lambda x: x IS NOT NULL) AS rs FROM items)
"""
_CULLED = "SELECT item_id, CASE WHEN len(rs) > 0 THEN 'culled' ELSE 'included' END AS cull_status, array_to_string(rs, ',') AS cull_reasons FROM"
_KEEP = "k AS (SELECT r.item_id, r.parent_item_id, CASE WHEN p.item_id IS NOT NULL AND len(p.rs) = 0 THEN [] ELSE r.rs END AS rs FROM r LEFT JOIN r p ON r.parent_item_id = p.item_id)"
QUERIES = {
    "cull_rules": cull_rules, "cull_family_keep": cull_family_keep, "cull_family_cull": cull_family_cull, "promote_order": promote_order, "promote_culled": promote_culled,
    "production_numbers": production_numbers, "thread_conversations": thread_conversations, "subject_groups": subject_groups,
}
ORACLE = {
    "cull_rules": f"WITH {adapt.ORDER_ITEMS_SQL}, {_REASONS} {_CULLED} r",
    "cull_family_keep": f"WITH {adapt.ORDER_ITEMS_SQL}, {_REASONS}, {_KEEP} {_CULLED} k",
    "cull_family_cull": f"""WITH {adapt.ORDER_ITEMS_SQL}, {_REASONS},
        k AS (SELECT r.item_id, CASE WHEN len(p.rs) > 0 THEN list_append(r.rs, 'parent_culled') ELSE r.rs END AS rs FROM r LEFT JOIN r p ON r.parent_item_id = p.item_id) {_CULLED} k""",
    "promote_order": f"""WITH {adapt.ORDER_ITEMS_SQL}, b AS (SELECT * FROM items WHERE status IN ('extracted', 'partial', 'normalized')),
        fam AS (SELECT DISTINCT coalesce(parent_item_id, item_id) AS f FROM b), i AS (SELECT * FROM items WHERE coalesce(parent_item_id, item_id) IN (SELECT f FROM fam))
        SELECT item_id, coalesce(parent_item_id, item_id) AS family_key,
          row_number() OVER (ORDER BY coalesce(parent_item_id, item_id), CASE WHEN parent_item_id IS NULL THEN 0 ELSE 1 END, path NULLS FIRST, item_id) AS review_order FROM i""",
    "promote_culled": f"""WITH {adapt.ORDER_ITEMS_SQL}, {_REASONS}, {_KEEP}, i AS (SELECT items.* FROM items JOIN k USING (item_id) WHERE len(k.rs) = 0 AND status IN ('extracted', 'partial', 'normalized'))
        SELECT item_id, coalesce(parent_item_id, item_id) AS family_key,
          row_number() OVER (ORDER BY coalesce(parent_item_id, item_id), CASE WHEN parent_item_id IS NULL THEN 0 ELSE 1 END, path NULLS FIRST, item_id) AS review_order FROM i""",
    "production_numbers": """WITH n AS (SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_custkey END NULLS LAST, o_orderkey) AS seq FROM orders WHERE o_orderpriority <> '1-URGENT')
        SELECT item_id, seq, 'PRD' || CASE WHEN seq < 1000000 THEN lpad(CAST(seq AS VARCHAR), 6, '0') ELSE CAST(seq AS VARCHAR) END AS control_number FROM n""",
    "thread_conversations": """WITH t AS (SELECT conv_id, turn, conv_id || '-' || turn || '-' || md5(coalesce(text, '')) AS item_id FROM conversations),
        c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, min(item_id) OVER (PARTITION BY conv_id) AS f FROM t)
        SELECT item_id, f AS thread_first, CASE conv_id % 3 WHEN 1 THEN CASE WHEN n > 1 THEN 'headers' ELSE 'singleton' END WHEN 0 THEN CASE WHEN n > 1 THEN 'subject' ELSE 'singleton' END ELSE CASE WHEN n > 1 THEN 'index' ELSE 'singleton' END END AS thread_method, n FROM c""",
    "subject_groups": r"""SELECT lower(trim(regexp_replace(trim(regexp_replace(CASE WHEN turn % 2 = 0 THEN 'RE: Fwd : ' ELSE '' END || array_to_string(string_split(text, ' ')[1:2], ' '), '\s+', ' ', 'g')), '^((re|fwd|fw)\s*:\s*)+', '', 'i'))) AS subject,
        count(*) AS n, min(conv_id) AS first_conv FROM conversations WHERE text IS NOT NULL GROUP BY 1""",
}
