"""Entities, citations and anchors with their places."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.operators import spans
from sparkdocket.plans import items as adapt


def _d(spark, sf_dir):
    return adapt.table(spark, sf_dir, "documents")


def entity_spans(spark, sf_dir):
    return spans.entity_spans(_d(spark, sf_dir), "doc_id", {"body": F.col("text")}).select("doc_id", "entity_type", "start", "end", "masked", "match_hash")


def entity_span_texts(spark, sf_dir):
    """Each span's bytes cut out of the text: they are the value found."""
    found = spans.entity_spans(_d(spark, sf_dir), "doc_id", {"body": F.col("text")}).join(_d(spark, sf_dir).select("doc_id", "text"), "doc_id")
    cut = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    return found.where(cut == F.col("value")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("match_hash").alias("n_values"))


def citations_placed(spark, sf_dir):
    """A document's third to sixth words, in capitals and wide apart, as a citation without a place."""
    d = _d(spark, sf_dir).where("text IS NOT NULL")
    quote = F.translate(F.array_join(F.slice(F.split("text", " "), 3, 4), " \n "), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    c = spans.verify_citation(F.col("text"), quote, F.lit(None).cast("int"), F.lit(None).cast("int"))
    return d.select("doc_id", c.alias("c")).select("doc_id", "c.*")


def anchors_placed(spark, sf_dir):
    """Marks on the sixth and seventh words between their neighbours, of texts whose blanks have doubled since."""
    d = _d(spark, sf_dir).where("text IS NOT NULL")
    w = F.split("text", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    start = F.length(part(1, 5)) + 1
    now = F.replace(F.col("text"), F.lit(" "), F.lit("  "))
    a = spans.re_anchor(now, part(6, 2), F.concat(part(4, 2), F.lit(" ")), F.concat(F.lit(" "), part(8, 1)), start, F.lit(False))
    return d.where(F.size(w) >= 8).select("doc_id", a.alias("a")).select("doc_id", "a.*")


QUERIES = {"entity_spans": entity_spans, "entity_span_texts": entity_span_texts, "citations_placed": citations_placed, "anchors_placed": anchors_placed}

_LUHN = "(list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(d[len(d) - i + 1] AS INT) WHEN CAST(d[len(d) - i + 1] AS INT) > 4 THEN 2 * CAST(d[len(d) - i + 1] AS INT) - 9 ELSE 2 * CAST(d[len(d) - i + 1] AS INT) END)) % 10) = 0"
_PARTS = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS entity_type, {n} AS part, regexp_extract_all(text, '{p}') AS vs, string_split_regex(text, '{p}') AS gs FROM documents WHERE text IS NOT NULL" for k, ps in spans.SPAN_PATTERNS.items() for n, p in enumerate(ps)
)
_SPANS = f"""x AS ({_PARTS}),
  y AS (SELECT doc_id, entity_type, part, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS value, unnest(gs[1:len(vs)]) AS g FROM x),
  z AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d, CAST(sum(strlen(g) + strlen(value)) OVER (PARTITION BY doc_id, entity_type, part ORDER BY i) AS INT) AS e FROM y),
  v AS (SELECT *, e - CAST(strlen(value) AS INT) AS s FROM z WHERE CASE entity_type WHEN 'card' THEN regexp_matches(d, '^[2-6]') AND {_LUHN} WHEN 'ssn' THEN NOT regexp_matches(d, '^(000|666|9)') AND d[4:5] <> '00' AND d[6:9] <> '0000' ELSE true END),
  h AS (SELECT doc_id, entity_type, s AS start, e AS end, value, CASE entity_type WHEN 'email' THEN value[1] || '***@' || split_part(value, '@', -1) WHEN 'currency' THEN '$***' ELSE '***' || right(d, 4) END AS masked,
    sha256(CASE entity_type WHEN 'email' THEN lower(value) WHEN 'phone' THEN right(d, 10) WHEN 'currency' THEN regexp_replace(value, '[^0-9.]', '', 'g') ELSE d END) AS match_hash
    FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.doc_id = v.doc_id AND o.entity_type = v.entity_type AND o.part < v.part AND o.s <= v.s AND o.e >= v.e))"""
#: 1 where ``q`` occurs exactly once in ``t``, overlaps counted.
_ONCE = lambda t, q: f"CASE WHEN length({q}) > 0 AND instr({t}, {q}) > 0 AND instr(substr({t}, instr({t}, {q}) + 1), {q}) = 0 THEN 1 ELSE 0 END"
_FLAT = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
ORACLE = {
    "entity_spans": f"WITH {_SPANS} SELECT doc_id, entity_type, start, \"end\", masked, match_hash FROM h",
    "entity_span_texts": f"WITH {_SPANS} SELECT entity_type, count(*) AS n, count(DISTINCT match_hash) AS n_values FROM h GROUP BY 1",
    "citations_placed": f"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, text, array_to_string(w[1:2], ' ') || ' ' AS head, array_to_string(w[3:6], ' ') AS q FROM w),
        n AS (SELECT *, {_ONCE(_FLAT('text'), _FLAT('q'))} AS n, strlen(head) + strlen(q) - strlen(ltrim(q, ' ' || chr(10) || chr(13) || chr(9))) AS s, strlen(trim(q, ' ' || chr(10) || chr(13) || chr(9))) AS k FROM q)
        SELECT doc_id, CASE WHEN n = 1 THEN 'matched' ELSE 'quote_not_found' END AS status, CASE WHEN n = 1 THEN CAST(s AS INT) END AS start, CASE WHEN n = 1 THEN CAST(s + k AS INT) END AS end FROM n""",
    "anchors_placed": f"""WITH w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, text, w, array_to_string(w[4:5], ' ') || ' ' || array_to_string(w[6:7], ' ') || ' ' || w[8] AS whole FROM w WHERE len(w) >= 8),
        f AS (SELECT doc_id, w, regexp_replace(text, '\\s+', ' ', 'g') AS t, regexp_replace(whole, '\\s+', ' ', 'g') AS q FROM q),
        n AS (SELECT doc_id, w, {_ONCE('t', 'q')} AS n FROM f)
        SELECT doc_id, CASE WHEN n = 1 THEN 'moved' ELSE 'stale' END AS state, CASE WHEN n = 1 THEN CAST(length(array_to_string(w[1:5], '  ')) + 2 AS INT) END AS start, CASE WHEN n = 1 THEN CAST(length(array_to_string(w[1:7], '  ')) AS INT) END AS end FROM n""",
}
