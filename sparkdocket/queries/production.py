"""Scan integrity, reports and production volumes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkdocket.operators import cull, dedupe, integrity, produce
from sparkdocket.plans import items as adapt
from sparkdocket.plans.staging import shared_dir
from sparkdocket.queries.reduction import ROLES_SQL, hashed_documents
from sparkdocket.sources.volume import read_volumes


def _scan(spark, sf_dir, strict):
    """Events as scanned messages, users as files."""
    e = adapt.table(spark, sf_dir, "events")
    kind, v = F.col("event_type"), F.col("value")
    faults = integrity.classify_message(
        strict, unreadable=F.when((kind == "error") & (v < 20), "crc_mismatch").when((kind == "error") & (v < 40), "message_read_failed"),
        body_cut=(kind == "signup") & (v < 30), body_absent=(kind == "signup") & (v < 60), attachments_bad=(kind == "purchase") & (v < 25), orphaned=F.col("user_id") % 11 == 0,
    )
    messages = e.select("event_id", "user_id", faults.alias("c")).select("event_id", "user_id", "c.*")
    bad = F.count_if(kind == "error")
    files = e.groupBy("user_id").agg(F.when(bad == F.count(F.lit(1)), "failed").when(bad > 3, "partial").otherwise("ok").alias("status"))
    return messages, files


def _classes(strict):
    return lambda spark, sf_dir: _scan(spark, sf_dir, strict)[0].select("event_id", "outcome", F.concat_ws(";", "reasons").alias("reasons"), "orphaned")


def integrity_sidecar(spark, sf_dir):
    return integrity.sidecar(_scan(spark, sf_dir, False)[0], "event_id")


def integrity_reasons(spark, sf_dir):
    return integrity.reason_counts(_scan(spark, sf_dir, True)[0])


def scan_preflight(spark, sf_dir):
    """Totals, advice and exit of a best-effort and of a strict scan."""
    parts = []
    for strict in (False, True):
        t = integrity.scan_totals(*_scan(spark, sf_dir, strict))
        row = integrity.exit_policy(integrity.preflight(t, strict), strict, allow_failed_files=True)
        rates = [F.round(c, 6).alias(c) for c in ("skip_rate", "crc_skip_rate", "failed_file_rate")]
        parts.append(row.select(F.lit(strict).alias("strict"), "recoverable", "skipped", "degraded", "files", "failed_files", *rates, "recommendation", F.concat_ws(";", "reasons").alias("reasons"), "exit_reason"))
    return parts[0].union(parts[1])


def error_codes(spark, sf_dir):
    """The twenty commonest error values with the rest in one row: a top-k report."""
    from sparkdocket.operators.rollups import top_with_rest

    e = adapt.table(spark, sf_dir, "events").where("event_type = 'error'")
    return top_with_rest(e.select(F.concat(F.lit("E"), F.floor(F.col("value") / 10).cast("string")).alias("code")), "code", 20)


def dedup_report(spark, sf_dir):
    d = hashed_documents(spark, sf_dir)
    return integrity.dedup_report(dedupe.dedupe_items(d).select("item_id", "group_id", "dedup_role", "dedup_tier"), d.select("item_id", "path", "size_bytes"), "item_id")


def production_volumes(spark, sf_dir):
    """Control numbers of orders and the volumes they go to, a thousand items each."""
    o = adapt.table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("review_order"), (F.col("o_orderpriority") == "1-URGENT").alias("withheld"))
    n = cull.number_production(items, "PRD", 6)
    return n.select("item_id", "control_number", produce.volume_of(F.col("seq") - 1, 1000).alias("volume"))


def production_sweep(spark, sf_dir):
    """Orders numbered for production of which the low-priority ones were withheld afterwards."""
    o = adapt.table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("review_order"), (F.col("o_orderpriority") == "1-URGENT").alias("withheld"))
    return cull.sweep_withheld(cull.number_production(items, "S", 4).select("item_id", "control_number"), o.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("item_id")))


def _produced(spark, sf_dir):
    """Documents as produced items: some are mail, some have redactions, some no file of their own."""
    d, lab = adapt.table(spark, sf_dir, "documents"), adapt.table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("item_id"), F.concat(F.col("source"), F.when(F.col("lang") == "de", ".TXT").when(F.col("lang") == "fr", ".tar.gz").otherwise("")).alias("path"),
        F.when(F.col("lang") == "en", "Email").otherwise("document").alias("file_category"), F.when(F.col("lang") == "es", "text/html; charset=utf-8").when(F.col("lang") == "en", "message/rfc822").alias("mime_type"),
        F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("from_addr"), F.when(F.col("n_chars") > 1500, F.md5("text")).alias("native_sha256"),
        F.when(F.col("quality") == 1, 2).alias("redaction_count"), F.when(F.col("toxic") == 0, F.md5(F.concat("text", F.lit("r")))).otherwise("  ").alias("redacted_sha256"), F.when(F.col("n_chars") > 60, F.md5("text")).alias("text_sha256"),
    )


def production_written(spark, sf_dir):
    """Volumes of a hundred documents each, written as files and read back."""
    d = adapt.table(spark, sf_dir, "documents")
    n = cull.number_production(d.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("review_order"), F.lit(False).alias("withheld")), "PRD", 8)
    held = d.select(F.col("doc_id").alias("item_id"), "text", F.concat("text", F.lit("r")).alias("redacted_text"), F.encode("text", "UTF-8").alias("native_bytes"), F.col("lang").alias("subject"))
    items = _produced(spark, sf_dir).join(held, "item_id").join(n.select("item_id", "seq", "control_number"), "item_id")
    path = f"{shared_dir(spark)}/production-{uuid.uuid4().hex}"
    produce.produce_volumes(items, path, per_volume=100)
    back = read_volumes(spark, path)
    return back.select(
        F.col("ITEM_ID").cast("long").alias("item_id"), F.col("CONTROL_NUMBER").alias("control_number"), "volume", F.col("NATIVE_PATH").alias("native_path"), F.col("TEXT_PATH").alias("text_path"),
        F.col("FILE_SIZE").cast("long").alias("file_size"), F.col("SHA256").alias("native_sha256"), F.col("PROD_STATUS").alias("prod_status"), F.sha2("native", 256).alias("native_read_sha256"), F.sha2("text", 256).alias("text_read_sha256"),
    )


def production_resolve(spark, sf_dir):
    return produce.resolve(_produced(spark, sf_dir)).select("item_id", produce.extension(F.col("path"), F.col("mime_type")).alias("ext"), "native", "text_source", "fault")


def _lines(profile):
    def run(spark, sf_dir):
        o = adapt.table(spark, sf_dir, "orders")
        number = F.concat(F.lit("P"), F.format_string("%08d", F.col("o_orderkey")))
        at = F.col("o_orderdate")
        columns = {
            "BEGBATES": number, "ENDBATES": number, "CONTROL_NUMBER": number, "ITEM_ID": F.col("o_orderkey"), "CUSTODIAN": F.concat(F.lit("C"), F.col("o_custkey").cast("string")), "FILE_CATEGORY": F.col("o_orderpriority"),
            "DATE_SENT": produce.load_date(F.when(F.col("o_orderstatus") != "P", at), profile), "SUBJECT": F.concat(F.lit('say "'), F.col("o_orderstatus"), F.lit('"\r\nþ end')), "TEXT_PATH": F.concat(F.lit("TEXT/"), number, F.lit(".txt")), "PROD_STATUS": F.lit("produced"),
        }
        return produce.load_lines(o.withColumn("seq", F.col("o_orderkey") + 1), columns, profile).select("seq", F.md5("line").alias("line_md5"), F.md5("csv").alias("csv_md5"))

    return run


def production_family(spark, sf_dir):
    i = adapt.order_items(spark, sf_dir)
    return produce.expand_for_production(i, i.where("file_category = 'R' AND size_bytes > 70000"))


_MSG = lambda strict: f"""m0 AS (SELECT event_id, user_id, event_type AS k, CASE WHEN event_type = 'error' AND value < 20 THEN 'crc_mismatch' WHEN event_type = 'error' AND value < 40 THEN 'message_read_failed' END AS u,
    list_filter([CASE WHEN event_type = 'signup' AND value < 30 THEN 'body_truncated' WHEN event_type = 'signup' AND value < 60 THEN 'body_unavailable' END,
      CASE WHEN event_type = 'purchase' AND value < 25 THEN 'attach_meta_failed' END, CASE WHEN user_id % 11 = 0 THEN 'orphaned_node' END], lambda x: x IS NOT NULL) AS fs FROM events),
  m AS (SELECT event_id, user_id, k, CASE WHEN u IS NOT NULL OR ({strict} AND len(fs) > 0) THEN 'skip' WHEN len(fs) > 0 THEN 'degraded' ELSE 'clean' END AS outcome,
    CASE WHEN u IS NOT NULL THEN [u] WHEN {strict} THEN fs[1:1] ELSE fs END AS rs, NOT (u IS NOT NULL OR ({strict} AND len(fs) > 0)) AND user_id % 11 = 0 AS orphaned FROM m0)"""  # noqa: E731
_CLASS_SQL = lambda strict: f"WITH {_MSG(strict)} SELECT event_id, outcome, array_to_string(rs, ';') AS reasons, orphaned FROM m"


def _preflight_sql(strict):
    return f"""SELECT * FROM (WITH {_MSG(strict)}, t AS (SELECT count(*) FILTER (outcome <> 'skip') AS recoverable, count(*) FILTER (outcome = 'skip') AS skipped, count(*) FILTER (outcome = 'degraded') AS degraded,
      count(*) FILTER (outcome = 'skip' AND list_contains(rs, 'crc_mismatch')) AS crc FROM m), g AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS b, count(*) AS n FROM events GROUP BY 1),
      f AS (SELECT count(*) AS files, count(*) FILTER (b = n) AS failed_files, count(*) FILTER (b < n AND b > 3) AS partial_files FROM g),
      r AS (SELECT *, skipped / greatest(recoverable + skipped, 1) AS s, crc / greatest(recoverable + skipped, 1) AS c, failed_files / greatest(files, 1) AS x FROM t, f),
      w AS (SELECT *, list_filter([CASE WHEN files > 0 AND failed_files >= files THEN 'all_files_failed' END, CASE WHEN recoverable = 0 AND (skipped > 0 OR failed_files > 0) THEN 'zero_recoverable' END,
        CASE WHEN {strict} AND (skipped > 0 OR failed_files > 0) THEN 'strict_integrity_failure' END], lambda x: x IS NOT NULL) AS stop,
        list_filter([CASE WHEN s > 0.05 THEN 'skip_rate_exceeded' END, CASE WHEN c > 0.01 THEN 'crc_skip_rate_exceeded' END, CASE WHEN x > 0 THEN 'failed_file_rate_exceeded' END], lambda x: x IS NOT NULL) AS worry FROM r)
      SELECT {strict} AS strict, recoverable, skipped, degraded, files, failed_files, round(s, 6) AS skip_rate, round(c, 6) AS crc_skip_rate, round(x, 6) AS failed_file_rate,
        CASE WHEN len(stop) > 0 THEN 'not_export_ready' WHEN len(worry) > 0 THEN 're_export_recommended' ELSE 'ok' END AS recommendation, array_to_string(CASE WHEN len(stop) > 0 THEN stop ELSE worry END, ';') AS reasons,
        CASE WHEN {strict} AND (skipped > 0 OR partial_files > 0 OR failed_files > 0 OR len(stop) > 0) THEN 'strict integrity failure' WHEN failed_files > 0 AND NOT recoverable > 0 THEN 'files failed to scan'
          WHEN len(stop) > 0 AND recoverable = 0 THEN 'nothing recoverable' END AS exit_reason FROM w)"""


def _lines_sql(profile):
    p = produce.PROFILES[profile]
    names = [p["headers"].get(f, f) for f in produce.FIELDS]
    fmt = {"plain": "%Y-%m-%dT%H:%M:%SZ", "us_dates": "%m/%d/%Y"}[profile]
    date = f"coalesce(CASE WHEN o_orderstatus <> 'P' THEN strftime((CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'UTC') AT TIME ZONE '{p['zone']}', '{fmt}') END, '')"
    n = "'P' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"
    value = {"BEGBATES": n, "ENDBATES": n, "CONTROL_NUMBER": n, "ITEM_ID": "CAST(o_orderkey AS VARCHAR)", "CUSTODIAN": "'C' || o_custkey", "FILE_CATEGORY": "o_orderpriority", "DATE_SENT": date,
             "SUBJECT": "'say \"' || o_orderstatus || '\"' || chr(13) || chr(10) || 'þ end'", "TEXT_PATH": f"'TEXT/' || {n} || '.txt'", "PROD_STATUS": "'produced'"}
    vals = [value.get(f, "''") for f in produce.FIELDS]
    clean = lambda v: f"'þ' || replace(replace(replace(replace({v}, 'þ', ''), chr(13) || chr(10), '®'), chr(13), '®'), chr(10), '®') || 'þ'"
    csv = lambda v: f"""'"' || replace({v}, '"', '""') || '"'"""
    join = lambda parts, sep: f" || '{sep}' || ".join(parts)
    head = lambda f, sep: join([f(f"'{x}'") for x in names], sep)
    return f"""SELECT 0::BIGINT AS seq, md5(chr(65279) || {head(clean, '¶')}) AS line_md5, md5({head(csv, ',')}) AS csv_md5
      UNION ALL SELECT o_orderkey + 1, md5({join([clean(v) for v in vals], '¶')}), md5({join([csv(v) for v in vals], ',')}) FROM orders"""


# At least three digits, as ``produce.volume_of``: lpad alone would cut the thousandth volume to VOL100.
_VOLUME_SQL = lambda n: f"'VOL' || lpad(CAST((seq - 1) // {n} + 1 AS VARCHAR), greatest(length(CAST((seq - 1) // {n} + 1 AS VARCHAR)), 3)::INT, '0')"
QUERIES = {
    "integrity_best_effort": _classes(False), "integrity_strict": _classes(True), "integrity_sidecar": integrity_sidecar, "integrity_reasons": integrity_reasons, "scan_preflight": scan_preflight, "error_codes": error_codes,
    "dedup_report": dedup_report, "production_volumes": production_volumes, "production_sweep": production_sweep, "production_resolve": production_resolve, "production_written": production_written, "production_lines": _lines("plain"), "production_lines_us": _lines("us_dates"), "production_family": production_family,
}
ORACLE = {
    "integrity_best_effort": _CLASS_SQL("false"), "integrity_strict": _CLASS_SQL("true"),
    "integrity_sidecar": f"WITH {_MSG('false')} SELECT event_id, outcome, array_to_string(rs, ';') AS reasons FROM m WHERE outcome <> 'clean'",
    "integrity_reasons": f"WITH {_MSG('true')} SELECT outcome, unnest(rs) AS reason, count(*) AS n FROM m GROUP BY 1, 2",
    "scan_preflight": f"{_preflight_sql('false')} UNION ALL {_preflight_sql('true')}",
    "error_codes": """WITH c AS (SELECT 'E' || CAST(floor(value / 10) AS BIGINT) AS label, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS i FROM c)
        SELECT label, n, false AS is_rest FROM k WHERE i <= 20 UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT), true FROM k WHERE i > 20 HAVING count(*) > 0""",
    "dedup_report": f"""WITH {ROLES_SQL} SELECT r.group_id, r.item_id, CASE WHEN r.item_id = r.group_id THEN 'unique' ELSE 'duplicate' END AS dedup_role, dedup_tier, h.path, h.size_bytes, k.path AS kept_path, k.size_bytes AS kept_size_bytes
        FROM roles r JOIN h USING (item_id) LEFT JOIN h k ON k.item_id = r.group_id""",
    "production_volumes": f"""WITH n AS (SELECT o_orderkey AS item_id, row_number() OVER (ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_custkey END NULLS LAST, o_orderkey) AS seq FROM orders WHERE o_orderpriority <> '1-URGENT')
        SELECT item_id, 'PRD' || CASE WHEN seq < 1000000 THEN lpad(CAST(seq AS VARCHAR), 6, '0') ELSE CAST(seq AS VARCHAR) END AS control_number, {_VOLUME_SQL(1000)} AS volume FROM n""",
    "production_sweep": """WITH n AS (SELECT o_orderkey AS item_id, o_orderpriority AS p, row_number() OVER (ORDER BY o_custkey NULLS LAST, o_orderkey) AS seq FROM orders WHERE o_orderpriority <> '1-URGENT')
        SELECT item_id, 'S' || CASE WHEN seq < 10000 THEN lpad(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS control_number, CASE WHEN p = '5-LOW' THEN 'withdrawn' ELSE 'produced' END AS status FROM n""",
    "production_resolve": """WITH r AS (SELECT doc_id AS item_id, lang, n_chars > 1500 AS own, lang = 'en' AS mail, coalesce(quality = 1, false) AS red, coalesce(toxic = 0, false) AS made, n_chars > 60 AS txt FROM documents LEFT JOIN labels USING (doc_id))
        SELECT item_id, CASE lang WHEN 'de' THEN 'txt' WHEN 'fr' THEN 'gz' WHEN 'es' THEN 'html' WHEN 'en' THEN 'eml' ELSE 'bin' END AS ext, CASE WHEN own THEN 'file' WHEN mail THEN 'mail' END AS native,
          CASE WHEN red THEN CASE WHEN made THEN 'redacted' END WHEN txt THEN 'text' END AS text_source, CASE WHEN NOT coalesce(own, false) AND NOT coalesce(mail, false) THEN 'missing_native' WHEN red AND NOT made THEN 'redacted_text_missing' END AS fault FROM r""",
    "production_written": f"""WITH r AS (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) AS seq, n_chars > 1500 AS own, lang = 'en' AS mail, coalesce(quality = 1, false) AS red, coalesce(toxic = 0, false) AS made, n_chars > 60 AS txt FROM documents LEFT JOIN labels USING (doc_id)),
        b AS (SELECT *, CASE WHEN red THEN CASE WHEN made THEN text || 'r' END WHEN txt THEN text END AS body FROM r),
        n AS (SELECT *, CASE WHEN own THEN text WHEN mail THEN 'From: ' || chr(13) || chr(10) || 'Subject: en' || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(body, '') END AS nat, 'PRD' || lpad(CAST(seq AS VARCHAR), 8, '0') AS c, {_VOLUME_SQL(100)} AS v,
          CASE WHEN NOT own AND mail THEN 'eml' ELSE CASE lang WHEN 'de' THEN 'txt' WHEN 'fr' THEN 'gz' WHEN 'es' THEN 'html' WHEN 'en' THEN 'eml' ELSE 'bin' END END AS e FROM b WHERE NOT (red AND NOT made))
        SELECT doc_id AS item_id, c AS control_number, v AS volume, CASE WHEN nat IS NOT NULL THEN v || '/NATIVES/' || c || '.' || e END AS native_path, CASE WHEN body IS NOT NULL THEN v || '/TEXT/' || c || '.txt' END AS text_path, strlen(nat) AS file_size, sha256(nat) AS native_sha256,
          CASE WHEN nat IS NOT NULL AND body IS NOT NULL THEN 'NATIVE_AND_TEXT' WHEN nat IS NOT NULL THEN 'NATIVE' ELSE 'TEXT_ONLY' END AS prod_status, sha256(nat) AS native_read_sha256, sha256(body) AS text_read_sha256 FROM n WHERE nat IS NOT NULL OR body IS NOT NULL""",
    "production_lines": _lines_sql("plain"), "production_lines_us": _lines_sql("us_dates"),
    "production_family": f"""WITH {adapt.ORDER_ITEMS_SQL}, b AS (SELECT * FROM items WHERE file_category = 'R' AND size_bytes > 70000)
        SELECT item_id FROM items WHERE item_id IN (SELECT item_id FROM b UNION ALL SELECT parent_item_id FROM b WHERE parent_item_id IS NOT NULL) OR family_id IN (SELECT family_id FROM b) OR parent_item_id IN (SELECT item_id FROM b)""",
}
