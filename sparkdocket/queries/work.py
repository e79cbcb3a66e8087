"""Candidates of jobs and reports of jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkdocket.operators import audit, gap, jobs, qc
from sparkdocket.plans import items as adapt
from sparkdocket.plans.staging import shared_dir, stage
from sparkdocket.queries import rollups

_PATHS = ["src.ICS", "a/b.html", "notes.txt", "mail.eml", "", "x/team chat/1", "data.JSON", "scan.PDF"]
_MIMES = ["text/calendar; method=REQUEST", "text/html", "text/plain", "message/RFC822", "", "application/json", "image/png", "application/vnd.officedocument.thing"]


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _items(spark, sf_dir):
    """Documents as items in many states, by their id."""
    d = adapt.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("item_id"), F.when(i % 9 != 4, _pick(_PATHS, i)).alias("path"), F.when(i % 7 != 3, _pick(_MIMES, F.floor(i / 8))).alias("mime_type"), F.when(i % 5 == 0, "chat_message").otherwise("parent").alias("role"),
        F.when(i % 10 == 0, "IPM.SkypeTeams.Message").alias("message_class"), _pick(["email", "Other", " ", "attachment"], i).alias("file_category"), F.when(i % 3 != 0, jobs.TAXONOMY).alias("category_taxonomy"),
        F.when(i % 2 == 0, F.md5("text")).alias("native_sha256"), F.when(F.col("n_chars") > 900, F.md5("text")).when(i % 11 == 0, "  ").alias("text_sha256"), F.when(i % 4 == 0, "h").alias("html_sha256"),
        F.when(i % 6 == 0, "e").alias("embedded_sha256"), F.when(i % 3 == 1, "f").alias("indexed_sha256"), _pick(["extracted", "error", "partial"], i).alias("status"), (i % 8 < 5).alias("in_review"),
    )


def job_candidates(spark, sf_dir):
    items = _items(spark, sf_dir)
    parts = [jobs.candidates(items, j).select(F.lit(j).alias("job"), "item_id") for j in jobs.JOBS]
    parts.append(jobs.candidates(items, "suggest", in_review=True).select(F.lit("suggest_in_review").alias("job"), "item_id"))
    parts.append(jobs.candidates(items, "classify", in_review=True, force=True).select(F.lit("classify_again").alias("job"), "item_id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _back(spark, path, name):
    return spark.read.options(header=True, escape='"').csv(f"{path}/{name}")


def qc_report(spark, sf_dir):
    """A QC report written and read back: its summary, and its findings by rule."""
    i = rollups._qc_items(spark, sf_dir)
    found = stage(qc.findings(i, F.expr(rollups.QC_SELECTED)), "qc-found")  # the report reads it twice
    path = f"{shared_dir(spark)}/qc-report-{uuid.uuid4().hex}"
    root = audit.selection_fingerprint(i.where(rollups.QC_SELECTED), "item_id").first()
    jobs.write_report(jobs.qc_report(found.df, "selection", "default", root["items"], root["root"]), path)
    found.drop()
    rules = _back(spark, path, "findings").groupBy(F.concat_ws("/", F.lit("rule"), "rule", "severity").alias("metric")).agg(F.count(F.lit(1)).cast("string").alias("value"))
    return _back(spark, path, "summary").where("metric NOT IN ('selection_fingerprint', 'candidate_count')").union(rules)


def gap_report(spark, sf_dir):
    """A gap report written and read back: the sizes of its tables."""
    e, p = rollups._gap_sides(spark, sf_dir)
    matched = gap.match_cascade(e, p, ["native", "head", "control"])
    path = f"{shared_dir(spark)}/gap-report-{uuid.uuid4().hex}"
    tables = jobs.gap_report(rollups.gap_roster(spark, sf_dir), rollups.custodian_inventory(spark, sf_dir), rollups.QUERIES["date_coverage_week"](spark, sf_dir), matched.where("matched_by IS NOT NULL"), matched.where("matched_by IS NULL"))
    jobs.write_report(tables, path)
    read = [_back(spark, path, n).select(F.lit(n).alias("table")).groupBy("table").agg(F.count(F.lit(1)).cast("string").alias("read")) for n in tables if n != "summary"]
    rows = read[0]
    for r in read[1:]:
        rows = rows.union(r)
    summary = _back(spark, path, "summary").select(F.regexp_replace("metric", "_count$", "").alias("table"), "value")
    return summary.join(rows, "table", "left").select("table", F.col("value").cast("long").alias("rows"), F.coalesce(F.col("read").cast("long"), F.lit(0)).alias("rows_read"))


QUERIES = {"job_candidates": job_candidates, "qc_report": qc_report, "gap_report": gap_report}

_PICK = lambda values, n: f"(CAST({values!r} AS VARCHAR[]))[CAST(({n}) % {len(values)} AS INT) + 1]"
_ITEMS = f"""i AS (SELECT doc_id AS item_id, coalesce(CASE WHEN doc_id % 9 <> 4 THEN {_PICK(_PATHS, 'doc_id')} END, '') AS path, coalesce(CASE WHEN doc_id % 7 <> 3 THEN {_PICK(_MIMES, 'doc_id // 8')} END, '') AS mime, doc_id % 5 = 0 AS chat, doc_id % 10 = 0 AS teams,
  lower({_PICK(['email', 'Other', ' ', 'attachment'], 'doc_id')}) AS cat, doc_id % 3 <> 0 AS tax, doc_id % 2 = 0 AS nat, CASE WHEN n_chars > 900 THEN 't' WHEN doc_id % 11 = 0 THEN '  ' END AS txt, doc_id % 4 = 0 AS html, doc_id % 6 = 0 AS emb, doc_id % 3 = 1 AS idx, doc_id % 3 <> 1 AS ok, doc_id % 8 < 5 AS rev FROM documents)"""
_CLASSIFY = "(trim(cat) IN ('', 'attachment', 'other', 'unrecognized') OR NOT tax)"
_INDEX = "(ok AND (txt IS NOT NULL OR html))"
_WHERE = {
    "classify": _CLASSIFY,
    "calendar": "nat AND (lower(path) LIKE '%.ics' OR mime LIKE '%text/calendar%' OR path = '' OR mime = '' OR NOT (regexp_matches(lower(path), '\\.(pdf|eml)$') OR mime LIKE 'image/%' OR mime LIKE '%officedocument%' OR lower(mime) LIKE 'message/rfc822%'))",
    "chat": "(regexp_matches(lower(path), '\\.(html|json)$') OR path LIKE '%team chat%' OR mime LIKE '%text/html%' OR mime LIKE '%application/json%' OR teams) AND NOT (chat AND NOT teams)",
    "suggest": "trim(coalesce(txt, '')) <> ''", "index": _INDEX, "embed": "txt IS NOT NULL OR emb", "index_orphans": f"idx AND NOT {_INDEX}",
    "suggest_in_review": "trim(coalesce(txt, '')) <> '' AND rev", "classify_again": "rev",
}
_N = lambda name: f"(SELECT count(*) FROM ({rollups.ORACLE[name]}))"
ORACLE = {
    "job_candidates": f"WITH {_ITEMS} " + " UNION ALL ".join(f"SELECT '{j}' AS job, item_id FROM i WHERE {w}" for j, w in _WHERE.items()),
    "qc_report": f"""WITH q AS (SELECT * FROM ({rollups.ORACLE['qc_findings']})), n AS (SELECT count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warn') AS w FROM q)
        SELECT 'pack' AS metric, 'default' AS value UNION ALL SELECT 'scope', 'selection' UNION ALL SELECT 'error_count', CAST(e AS VARCHAR) FROM n UNION ALL SELECT 'warn_count', CAST(w AS VARCHAR) FROM n UNION ALL SELECT 'passed', CASE WHEN e = 0 THEN '1' ELSE '0' END FROM n
        UNION ALL SELECT 'rule/' || rule || '/' || severity, CAST(count(*) AS VARCHAR) FROM q GROUP BY rule, severity""",
    "gap_report": f"""WITH m AS (SELECT * FROM ({rollups.ORACLE['gap_match_cascade']})), n AS (SELECT 'roster' AS t, {_N('gap_roster')} AS c UNION ALL SELECT 'inventory', {_N('custodian_inventory')} UNION ALL SELECT 'date_coverage', {_N('date_coverage_week')}
        UNION ALL SELECT 'matched', count(*) FILTER (matched_by IS NOT NULL) FROM m UNION ALL SELECT 'expected_not_in_matter', count(*) FILTER (matched_by IS NULL) FROM m)
        SELECT t AS "table", c AS rows, c AS rows_read FROM n""",
}
