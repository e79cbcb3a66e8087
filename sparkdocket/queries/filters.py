"""The filter language over documents, orders and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.operators.filterspec import PRESETS, Satellites, apply_filter, page, thin
from sparkdocket.plans import items as adapt


def _docs(spark, sf_dir):
    d = adapt.table(spark, sf_dir, "documents")
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return d.select(
        n.alias("item_id"), F.lit(None).cast("long").alias("parent_item_id"), F.lit(None).cast("long").alias("family_id"), F.col("source").alias("path"), F.col("source").alias("custodian"),
        F.concat(F.lit("text/"), "lang").alias("mime_type"), F.when(F.col("n_chars") < 40, "error").otherwise("extracted").alias("status"), (F.col("n_chars") >= 700).alias("in_review"), F.col("n_chars").alias("size_bytes"),
        F.substring_index("text", " ", 3).alias("subject"), F.when(F.col("lang") != "es", F.col("n_chars")).alias("review_order"), F.when(F.col("lang") == "fr", F.length("source") - 4).alias("note_count"),
        (text.contains("@").cast("long") + 2 * text.contains("+1 (").cast("long") + 8 * text.rlike("[0-9]{16}").cast("long")).alias("entity_flags"),
        F.when(F.col("lang") == "de", F.lit(None)).when(F.col("n_chars") < 1500, "negative").otherwise("positive").alias("sentiment_polarity"), F.when(F.col("lang") != "de", (F.col("n_chars") - 1500) / 40_000.0).alias("sentiment_compound"),
    )


_DOCS_SQL = """
items AS (SELECT doc_id AS item_id, source AS path, source AS custodian, 'text/' || lang AS mime_type, CASE WHEN n_chars < 40 THEN 'error' ELSE 'extracted' END AS status,
  n_chars >= 700 AS in_review, n_chars AS size_bytes, array_to_string(string_split(text, ' ')[1:3], ' ') AS subject, CASE WHEN lang <> 'es' THEN n_chars END AS review_order,
  CASE WHEN lang = 'fr' THEN length(source) - 4 END AS note_count,
  CAST(contains(coalesce(text, ''), '@') AS INT) + 2 * CAST(contains(coalesce(text, ''), '+1 (') AS INT) + 8 * CAST(regexp_matches(coalesce(text, ''), '[0-9]{16}') AS INT) AS entity_flags,
  CASE WHEN lang = 'de' THEN NULL WHEN n_chars < 1500 THEN 'negative' ELSE 'positive' END AS sentiment_polarity, CASE WHEN lang <> 'de' THEN (n_chars - 1500) / 40000.0 END AS sentiment_compound FROM documents),
corpus AS (SELECT * FROM items WHERE in_review), matter AS (SELECT * FROM items WHERE status IN ('extracted', 'partial', 'normalized'))
"""


def _sat(spark, sf_dir):
    lab = adapt.table(spark, sf_dir, "labels")
    privilege = lab.where("toxic = 1").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "asserted").otherwise("under_review").alias("status"), (F.col("quality") == 0).alias("withhold"),
        F.lit(True).alias("include_on_log"), F.when(F.col("quality") == 0, "  ").otherwise("advice").alias("description"),
    )
    return Satellites(codes=adapt.codes(spark, sf_dir), privilege=privilege, notes=adapt.table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("item_id"), F.col("text").alias("note_text")))


_PRIV_SQL = """privilege AS (SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'asserted' ELSE 'under_review' END AS status, quality = 0 AS withhold, true AS include_on_log,
  CASE WHEN quality = 0 THEN '  ' ELSE 'advice' END AS description FROM labels WHERE toxic = 1)"""

#: name: (spec, SQL condition over alias i, scope table)
_SPECS = {
    "filter_in_review": ([("in_review", "eq", True)], "i.in_review", "matter"),
    "filter_custodian_in": ([("custodian", "in", ["src1", "src3", "src11"])], "i.custodian IN ('src1', 'src3', 'src11')", "corpus"),
    "filter_subject_contains": ([("subject", "contains", "THe")], "contains(lower(coalesce(i.subject, '')), 'the')", "corpus"),
    "filter_path_contains": ([("path", "contains", "SRC1")], "contains(lower(i.path), 'src1')", "matter"),
    "filter_mime_prefix": ([("mime_type", "prefix", "TEXT/E")], "starts_with(lower(i.mime_type), 'text/e')", "corpus"),
    "filter_size_between": ([("size_bytes", "between", [500, 2000])], "i.size_bytes BETWEEN 500 AND 2000", "matter"),
    "filter_notes_false": ([("has_notes", "eq", False)], "NOT coalesce(i.note_count, 0) > 0", "corpus"),
    "filter_entity_bits": ([("entity_flags", "any_bits", 14)], "(i.entity_flags & 14) <> 0", "corpus"),
    "filter_sentiment": ([("sentiment_polarity", "any_of", ["negative"]), ("sentiment_compound", "between", [-0.02, 0.2])], "i.sentiment_polarity IN ('negative') AND i.sentiment_compound BETWEEN -0.02 AND 0.2", "matter"),
    "filter_unscored": ([("has_sentiment", "eq", False)], "i.sentiment_polarity IS NULL", "corpus"),
    "codes_any": ([("code", "any_of", ["responsive", "privileged"])], "i.item_id IN (SELECT item_id FROM codes)", "matter"),
    "codes_all": ([("code", "all_of", ["responsive", "privileged"])], "i.item_id IN (SELECT item_id FROM codes WHERE code = 'responsive') AND i.item_id IN (SELECT item_id FROM codes WHERE code = 'privileged')", "matter"),
    "codes_none": ([("code", "none_of", ["privileged"])], "i.item_id NOT IN (SELECT item_id FROM codes WHERE code = 'privileged')", "matter"),
    "code_missing": ([("code_missing", "eq", True)], "i.item_id NOT IN (SELECT item_id FROM codes)", "corpus"),
    "filter_note_text": ([("note_text", "contains", "SCHAU")], "i.item_id IN (SELECT doc_id FROM documents WHERE lang = 'de' AND contains(lower(text), 'schau'))", "matter"),
    "filter_privilege_withhold": ([("privilege_withhold", "eq", False), ("privilege_status", "any_of", ["asserted"])], "i.item_id NOT IN (SELECT item_id FROM privilege WHERE withhold) AND i.item_id IN (SELECT item_id FROM privilege WHERE status = 'asserted')", "matter"),
    "filter_log_incomplete": ([("privilege_log_ready", "eq", False)], "i.item_id IN (SELECT item_id FROM privilege WHERE include_on_log AND trim(description) = '')", "matter"),
}


def _query(conditions, scope):
    spec = {"version": 1, "scope": {"matter": "entire_matter", "corpus": "review_corpus"}[scope], "conditions": [dict(zip(("field", "op", "value"), c, strict=True)) for c in conditions]}
    return lambda spark, sf_dir: apply_filter(_docs(spark, sf_dir), spec, _sat(spark, sf_dir)).select("item_id", "custodian", "size_bytes")


def filter_dates(spark, sf_dir):
    spec = {"version": 1, "scope": "entire_matter", "conditions": [{"field": "best_effort_date", "op": "between", "value": ["1995-03-01T00:00:00+01:00", "1995-06-01T00:00:00Z"]}]}
    return apply_filter(adapt.order_items(spark, sf_dir), spec).select("item_id", "size_bytes")


def filter_family_expand(spark, sf_dir):
    """Expensive urgent orders, with their lines."""
    spec = {"version": 1, "scope": "entire_matter", "include_family": True, "conditions": [{"field": "file_category", "op": "eq", "value": "1-urgent"}, {"field": "size_bytes", "op": "gte", "value": 300_000}]}
    return apply_filter(adapt.order_items(spark, sf_dir), spec).select("item_id", "role")


def filter_participants(spark, sf_dir):
    """Mail that a supplier of the given domain got as a copy."""
    p = adapt.participants(spark, sf_dir).select("item_id", F.col("person").alias("person_key"), F.col("person").alias("person_id"), F.lit("smtp").alias("kind"), "role")
    o = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.lit("extracted").alias("status"))
    spec = {"version": 1, "scope": "entire_matter", "conditions": [{"field": "participant_domain", "op": "contains", "value": "Sellers"}, {"field": "participant_role", "op": "any_of", "value": ["bcc"]}]}
    return apply_filter(o, spec, Satellites(participants=p)).select("item_id")


def filter_preset_counts(spark, sf_dir):
    """How many items each preset that needs no other table selects."""
    names = ["uncoded", "privilege", "responsive", "has_notes", "pii", "has_email", "negative", "positive", "unscored"]
    parts = [apply_filter(_docs(spark, sf_dir), PRESETS[n], _sat(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("preset"), "n") for n in names]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def filter_page(spark, sf_dir):
    """The third page of 50 in review order: a report, so it is limited."""
    return thin(page(_docs(spark, sf_dir).where("in_review"), 100, 50)).select("item_id", "review_order", "path")


_FROM = f"WITH {_DOCS_SQL}, {adapt.CODES_SQL}, {_PRIV_SQL} "
QUERIES = {n: _query(c, scope) for n, (c, _, scope) in _SPECS.items()} | {"filter_dates": filter_dates, "filter_family_expand": filter_family_expand, "filter_participants": filter_participants, "filter_preset_counts": filter_preset_counts, "filter_page": filter_page}
_PRESET_SQL = {
    "uncoded": "item_id NOT IN (SELECT item_id FROM codes)", "privilege": "item_id IN (SELECT item_id FROM codes WHERE code = 'privileged')", "responsive": "item_id IN (SELECT item_id FROM codes WHERE code = 'responsive')",
    "has_notes": "coalesce(note_count, 0) > 0", "pii": "(entity_flags & 14) <> 0", "has_email": "(entity_flags & 1) <> 0", "negative": "sentiment_polarity = 'negative'", "positive": "sentiment_polarity = 'positive'", "unscored": "sentiment_polarity IS NULL",
}
ORACLE = {n: f"{_FROM} SELECT item_id, custodian, size_bytes FROM {scope} i WHERE {sql}" for n, (_, sql, scope) in _SPECS.items()} | {
    "filter_dates": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT item_id, size_bytes FROM items WHERE status IN ('extracted', 'partial', 'normalized') AND coalesce(sent_at, received_at) >= TIMESTAMP '1995-02-28 23:00:00' AND coalesce(sent_at, received_at) < TIMESTAMP '1995-06-01'",
    "filter_family_expand": f"""WITH {adapt.ORDER_ITEMS_SQL}, s AS (SELECT * FROM items WHERE status IN ('extracted', 'partial', 'normalized')),
        h AS (SELECT family_id FROM s WHERE file_category = '1-urgent' AND size_bytes >= 300000) SELECT item_id, role FROM s WHERE family_id IN (SELECT family_id FROM h)""",
    "filter_participants": f"WITH {adapt.PARTICIPANTS_SQL} SELECT o_orderkey AS item_id FROM orders WHERE o_orderkey IN (SELECT item_id FROM participants WHERE contains(person, '@sellers')) AND o_orderkey IN (SELECT item_id FROM participants WHERE role = 'bcc')",
    "filter_preset_counts": _FROM + " UNION ALL ".join(f"SELECT '{n}' AS preset, count(*) AS n FROM corpus WHERE {w}" for n, w in _PRESET_SQL.items()),
    "filter_page": _FROM + "SELECT item_id, review_order, path FROM corpus ORDER BY review_order NULLS LAST, path NULLS FIRST, item_id LIMIT 50 OFFSET 100",
}
