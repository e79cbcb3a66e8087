"""Overview, people, conversations, coverage, gap, QC, privilege, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.operators import audit, gap, qc
from sparkdocket.operators import rollups as r
from sparkdocket.plans import items as adapt


def _t(name):
    return lambda spark, sf_dir: adapt.table(spark, sf_dir, name)


def overview_totals(spark, sf_dir):
    return r.overview(adapt.order_items(spark, sf_dir))


def status_counts(spark, sf_dir):
    return adapt.order_items(spark, sf_dir).groupBy(F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def by_custodian_top_n(spark, sf_dir):
    return r.top_with_rest(adapt.order_items(spark, sf_dir), "custodian", 20)


def by_category_top_n(spark, sf_dir):
    return r.top_with_rest(adapt.order_items(spark, sf_dir), "file_category", 4)


def coded_counts(spark, sf_dir):
    d = adapt.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    c = adapt.codes(spark, sf_dir).groupBy("item_id").agg(F.count_if(F.col("code") == "responsive").alias("resp"), F.count_if(F.col("code") == "privileged").alias("priv"))
    return d.join(c, "item_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("items"), F.count("resp").alias("reviewed"), F.count_if(F.col("resp").isNull()).alias("unreviewed"), F.coalesce(F.sum("resp"), F.lit(0)).alias("responsive"), F.coalesce(F.sum("priv"), F.lit(0)).alias("privileged"))


def people_nodes(spark, sf_dir):
    return r.people_nodes(adapt.participants(spark, sf_dir))


def people_edges(spark, sf_dir):
    return r.people_edges(adapt.participants(spark, sf_dir), adapt.pieces(adapt.table(spark, sf_dir, "lineitem")))


def people_timeline(spark, sf_dir):
    return r.people_timeline(adapt.participants(spark, sf_dir), parts=adapt.pieces(adapt.table(spark, sf_dir, "lineitem")))


def domain_rollup(spark, sf_dir):
    n = r.people_nodes(adapt.participants(spark, sf_dir))
    return n.groupBy(F.substring_index("person", "@", -1).alias("domain")).agg(F.count(F.lit(1)).alias("people"), F.sum("n_items").alias("messages"))


def participant_slots(spark, sf_dir):
    """Recipients of orders, at most three new ones each: suppliers by key order."""
    o, li = adapt.table(spark, sf_dir, "orders"), adapt.table(spark, sf_dir, "lineitem")
    got = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))).alias("to_addrs"))
    none = F.array().cast("array<string>")
    items = o.join(got, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("from_addr"), "to_addrs", none.alias("cc_addrs"), none.alias("bcc_addrs"))
    return r.expand_participants(items, 3)


def _messages(spark, sf_dir):
    return adapt.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "role", "text")


def conversation_list(spark, sf_dir):
    m = _messages(spark, sf_dir)
    return r.conversations(m, m.where(F.lower("text").contains("the")).select("item_id"))


def conversation_all(spark, sf_dir):
    return r.conversations(_messages(spark, sf_dir))


def conversation_around(spark, sf_dir):
    """Two messages before and one after the last turn of each role user."""
    m = _messages(spark, sf_dir)
    anchors = m.where("role = 'user'").groupBy("conv_id").agg(F.max("position").alias("anchor"))
    return r.around(m, anchors, 2, 1)


def _coverage(bucket):
    def run(spark, sf_dir):
        return r.date_coverage(adapt.table(spark, sf_dir, "events").select(F.col("ts").alias("at")), "2023-12-15", "2024-12-31", bucket)

    return run


def date_coverage_weekday_holes(spark, sf_dir):
    """Order dates spread out seventeen times, so that weeks stay empty between others."""
    days = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")) * 17
    o = adapt.table(spark, sf_dir, "orders").select(F.date_add(F.lit("1900-01-01").cast("date"), days.cast("int")).cast("timestamp").alias("at"))
    return r.date_coverage(o, "1900-01-01", "2075-12-31", "week")


def gap_roster(spark, sf_dir):
    """Nations as expected custodians, two of them by other names than customers have them."""
    name = F.when(F.col("n_nationkey") == 7, "99").otherwise(F.col("n_nationkey").cast("string"))
    expected = adapt.table(spark, sf_dir, "nation").select(name.alias("name"))
    c = adapt.table(spark, sf_dir, "customer").groupBy(F.when(F.col("c_nationkey") == 3, " 3x ").otherwise(F.col("c_nationkey").cast("string")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return gap.roster(expected, c)


def _gap_sides(spark, sf_dir):
    d = adapt.table(spark, sf_dir, "documents")
    head = lambda c, n: F.md5(F.array_join(F.slice(F.split(c, " "), 1, n), " "))
    present = d.select(F.col("doc_id").alias("id"), F.md5("text").alias("native"), head("text", 12).alias("head"), F.concat_ws("/", "source", F.col("n_chars").cast("string")).alias("control"))
    want = adapt.table(spark, sf_dir, "labels").join(d, "doc_id")
    t = F.col("text")
    expected = want.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, F.md5(t)).alias("native"), F.when(F.col("toxic") == 1, head("text", 12)).alias("head"),
        F.when(F.col("lang") != "en", F.concat_ws("/", "source", F.col("n_chars").cast("string"))).alias("control"),
    )
    return expected, present


def gap_match_cascade(spark, sf_dir):
    return gap.match_cascade(*_gap_sides(spark, sf_dir), ["native", "head", "control"])


def gap_match_items(spark, sf_dir):
    """Labelled documents sought among all; English ones count as mail."""
    d = adapt.table(spark, sf_dir, "documents")
    sides = d.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "fr", F.concat_ws("-", "source", F.col("n_chars").cast("string"))).alias("message_id"), F.when(F.col("lang") != "es", F.col("doc_id")).alias("item_id"),
        F.md5("text").alias("logical_hash"), F.when(F.col("n_chars") > 2000, F.md5("text")).alias("native_sha256"), F.col("source").alias("control_number"), (F.col("lang") == "en").alias("is_mail"),
    )
    want = sides.join(adapt.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    want = want.withColumn("message_id", F.when(F.col("quality") == 1, F.col("message_id"))).withColumn("item_id", F.when(F.col("quality") == 0, F.col("item_id") + 1_000_000).otherwise(F.col("item_id")))
    return gap.match_items(want, sides)


def custodian_inventory(spark, sf_dir):
    return gap.custodian_inventory(adapt.order_items(spark, sf_dir).withColumn("custodian", F.when(F.col("status") != "error", F.concat(F.lit(" "), "custodian", F.lit("  ")))))


def gap_unexpected(spark, sf_dir):
    e, p = _gap_sides(spark, sf_dir)
    return gap.unexpected(p, gap.match_cascade(e, p, ["native", "head", "control"]))


def _qc_items(spark, sf_dir):
    i = adapt.order_items(spark, sf_dir)
    return i.select(
        "item_id", "parent_item_id", "family_id", F.when(F.col("file_category") == "1-urgent", "email").when(F.col("file_category") == "N", "pdf").otherwise("other").alias("file_category"), "status",
        F.when(F.col("size_bytes") < 2000, 0).otherwise(F.col("size_bytes")).alias("size_bytes"), (F.col("size_bytes") > 320_000).alias("withheld"), (F.col("size_bytes") > 5000).alias("has_native"),
        (F.col("status") != "partial").alias("has_text"), (F.col("file_category") == "A").alias("needs_ocr"), F.when(F.col("size_bytes") < 3000, 1).alias("redaction_count"), F.lit(False).alias("redacted_ok"),
    )


#: What the QC queries select.
QC_SELECTED = "status <> 'error' AND NOT (parent_item_id IS NOT NULL AND size_bytes BETWEEN 40000 AND 60000)"


def qc_findings(spark, sf_dir):
    return qc.findings(_qc_items(spark, sf_dir), F.expr(QC_SELECTED))


def qc_rollup(spark, sf_dir):
    return qc_findings(spark, sf_dir).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def qc_gate(spark, sf_dir):
    return qc.gate(qc.findings(_qc_items(spark, sf_dir), F.expr(QC_SELECTED), "native_heavy", {"text_missing": "off"}))


def privilege_family_consistency(spark, sf_dir):
    i = adapt.order_items(spark, sf_dir)
    return qc.family_consistency(i, i.where("file_category = 'A'").select("item_id"))


def audit_events(spark, sf_dir):
    """Each event of the chain with whether its link and its digest hold; digests cover the whole event."""
    e = adapt.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "event_type"), 256)
    before = e.select((F.col("seq") + 1).alias("seq"), own.alias("before"))
    linked = e.join(before, "seq", "left").withColumn("prev_hash", F.when(F.col("event_type") == "error", F.lit("broken")).otherwise(F.col("before")))
    good = audit.entry_hash(F.col("prev_hash"), F.col("user_id"))
    rows = linked.select("seq", "user_id", "prev_hash", F.when(F.col("event_type") == "purchase", F.lit("forged")).otherwise(good).alias("entry_hash"))
    return audit.verify_chain(rows, ["user_id"])


def audit_chain_verify(spark, sf_dir):
    """Events as audit rows.  Each names a digest of its predecessor's own row; every refund breaks its link."""
    e = adapt.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    made = e.select(F.col("event_id").alias("seq"), "user_id", "event_type", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("own"))
    before = made.select((F.col("seq") + 1).alias("seq"), F.col("own").alias("prev_own"))
    rows = made.join(before, "seq", "left").select("seq", "user_id", "event_type", F.when(F.col("event_type") == "purchase", F.lit("broken")).otherwise(F.col("prev_own")).alias("prev_hash"), F.col("own").alias("entry_hash"))
    v = audit.verify_chain(rows, ["user_id"])
    return v.groupBy("link_ok").agg(F.count(F.lit(1)).alias("n"), F.count_if("hash_ok").alias("n_hash_ok"))


_TOP = lambda label, n: f"""WITH {adapt.ORDER_ITEMS_SQL}, c AS (SELECT coalesce({label}, '') AS label, count(*) AS n FROM items GROUP BY 1),
  k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS i FROM c)
  SELECT label, n, false AS is_rest FROM k WHERE i <= {n} UNION ALL SELECT '(other)', CAST(sum(n) AS BIGINT), true FROM k WHERE i > {n} HAVING count(*) > 0"""  # noqa: E731
_P = f"WITH {adapt.PARTICIPANTS_SQL}"
_PI = f"""{_P}, i AS (SELECT person, item_id, count(*) FILTER (role = 'from') AS f, count(*) FILTER (role = 'to') AS t, count(*) FILTER (role = 'cc') AS c, count(*) FILTER (role = 'bcc') AS b,
  min(item_at) AS lo, max(item_at) AS hi FROM participants GROUP BY ALL),
  n AS (SELECT person, CAST(sum(f) AS BIGINT) AS n_from, CAST(sum(t) AS BIGINT) AS n_to, CAST(sum(c) AS BIGINT) AS n_cc, CAST(sum(b) AS BIGINT) AS n_bcc, count(*) AS n_items, min(lo) AS first_at, max(hi) AS last_at,
  count(*) FILTER (f > 0 AND t + c + b > 0) AS n_self FROM i GROUP BY person)"""
_COVER = lambda src, lo, hi, unit, step: f"""WITH g AS (SELECT CAST(unnest(generate_series(date_trunc('{unit}', DATE '{lo}'), date_trunc('{unit}', DATE '{hi}'), INTERVAL {step})) AS DATE) AS bucket),
  c AS (SELECT CAST(date_trunc('{unit}', seen) AS DATE) AS bucket, count(*) AS n FROM ({src}) WHERE CAST(seen AS DATE) BETWEEN DATE '{lo}' AND DATE '{hi}' GROUP BY 1),
  f AS (SELECT bucket, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (bucket))
  SELECT bucket, n, n = 0 AND coalesce(lag(n) OVER (ORDER BY bucket), 0) > 0 AND coalesce(lead(n) OVER (ORDER BY bucket), 0) > 0 AS is_hole FROM f"""  # noqa: E731
_HEAD = lambda c, n: f"md5(array_to_string(string_split({c}, ' ')[1:{n}], ' '))"
_GAP = f"""WITH p AS (SELECT doc_id AS id, md5(text) AS native, {_HEAD('text', 12)} AS head, source || '/' || n_chars AS control FROM documents),
  e AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN md5(text) END AS native, CASE WHEN toxic = 1 THEN {_HEAD('text', 12)} END AS head, CASE WHEN lang <> 'en' THEN source || '/' || n_chars END AS control FROM labels JOIN documents USING (doc_id)),
  m AS (SELECT e.id, coalesce(a.i, b.i, c.i) AS present_id, CASE WHEN a.i IS NOT NULL THEN 'native' WHEN b.i IS NOT NULL THEN 'head' WHEN c.i IS NOT NULL THEN 'control' END AS matched_by FROM e
    LEFT JOIN (SELECT native, min(id) AS i FROM p GROUP BY 1) a ON a.native = e.native LEFT JOIN (SELECT head, min(id) AS i FROM p GROUP BY 1) b ON b.head = e.head LEFT JOIN (SELECT control, min(id) AS i FROM p GROUP BY 1) c ON c.control = e.control)"""
_QC = f"""WITH {adapt.ORDER_ITEMS_SQL}, q AS (SELECT item_id, parent_item_id, CASE file_category WHEN '1-urgent' THEN 'email' WHEN 'N' THEN 'pdf' ELSE 'other' END AS cat, status, CASE WHEN size_bytes < 2000 THEN 0 ELSE size_bytes END AS sz,
    size_bytes > 320000 AS withheld, size_bytes > 5000 AS has_native, status <> 'partial' AS has_text, file_category = 'A' AS needs_ocr, CASE WHEN size_bytes < 3000 THEN 1 ELSE 0 END AS reds FROM items),
  s AS (SELECT * FROM q WHERE status <> 'error' AND NOT (parent_item_id IS NOT NULL AND sz BETWEEN 40000 AND 60000)),
  w AS (SELECT * FROM q WHERE withheld),
  found AS (SELECT 'withheld' AS rule, item_id, 'error' AS severity FROM s WHERE withheld UNION ALL SELECT 'redacted_text_missing', item_id, 'error' FROM s WHERE reds > 0 UNION ALL SELECT 'native_missing', item_id, 'error' FROM s WHERE NOT has_native AND cat <> 'email'
    UNION ALL SELECT 'text_missing', item_id, CASE WHEN cat IN ('email', 'pdf') THEN 'error' ELSE 'warn' END FROM s WHERE NOT has_text UNION ALL SELECT 'needs_ocr', item_id, 'warn' FROM s WHERE needs_ocr UNION ALL SELECT 'zero_size', item_id, 'warn' FROM s WHERE sz = 0
    UNION ALL SELECT 'bad_status', item_id, 'warn' FROM s WHERE status IN ('error', 'partial') UNION ALL SELECT 'orphan_child', item_id, 'error' FROM s WHERE parent_item_id IS NOT NULL AND parent_item_id NOT IN (SELECT item_id FROM s)
    UNION ALL SELECT 'incomplete_parent', item_id, 'warn' FROM s WHERE item_id IN (SELECT parent_item_id FROM q WHERE parent_item_id IS NOT NULL AND NOT withheld AND item_id NOT IN (SELECT item_id FROM s))
    UNION ALL SELECT 'withheld_relative', item_id, 'warn' FROM s WHERE NOT withheld AND (parent_item_id IN (SELECT item_id FROM w) OR item_id IN (SELECT parent_item_id FROM w WHERE parent_item_id IS NOT NULL)))"""

QUERIES = {
    "overview_totals": overview_totals, "status_counts": status_counts, "by_custodian_top_n": by_custodian_top_n, "by_category_top_n": by_category_top_n, "coded_counts": coded_counts,
    "people_nodes": people_nodes, "people_edges": people_edges, "people_timeline": people_timeline, "domain_rollup": domain_rollup, "participant_slots": participant_slots,
    "conversation_list": conversation_list, "conversation_all": conversation_all, "conversation_around": conversation_around,
    "date_coverage_week": _coverage("week"), "date_coverage_month": _coverage("month"), "date_coverage_holes": date_coverage_weekday_holes,
    "gap_roster": gap_roster, "gap_match_cascade": gap_match_cascade, "gap_unexpected": gap_unexpected, "gap_match_items": gap_match_items, "custodian_inventory": custodian_inventory, "qc_findings": qc_findings, "qc_rollup": qc_rollup, "qc_gate": qc_gate,
    "privilege_family_consistency": privilege_family_consistency, "audit_chain_verify": audit_chain_verify, "audit_events": audit_events,
}
ORACLE = {
    "overview_totals": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT count(*) AS items, count(*) FILTER (role <> 'attachment') AS top_level, CAST(sum(size_bytes) FILTER (role <> 'attachment') AS BIGINT) AS top_level_bytes, count(*) FILTER (role = 'parent') AS families FROM items",
    "status_counts": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT status, count(*) AS n FROM items GROUP BY 1",
    "by_custodian_top_n": _TOP("custodian", 20), "by_category_top_n": _TOP("file_category", 4),
    "coded_counts": f"""WITH {adapt.CODES_SQL}, c AS (SELECT item_id, count(*) FILTER (code = 'responsive') AS r, count(*) FILTER (code = 'privileged') AS p FROM codes GROUP BY 1)
        SELECT lang, count(*) AS items, count(c.item_id) AS reviewed, count(*) - count(c.item_id) AS unreviewed, CAST(coalesce(sum(r), 0) AS BIGINT) AS responsive, CAST(coalesce(sum(p), 0) AS BIGINT) AS privileged FROM documents LEFT JOIN c ON item_id = doc_id GROUP BY 1""",
    "people_nodes": f"{_PI} SELECT * FROM n",
    "people_edges": f"""{_P}, e AS (SELECT a.person AS src, b.person AS dst, b.role, b.item_at FROM participants a JOIN participants b USING (item_id) WHERE a.role = 'from' AND b.role <> 'from' AND a.person <> b.person)
        SELECT src, dst, count(*) FILTER (role = 'to') AS n_to, count(*) FILTER (role = 'cc') AS n_cc, count(*) FILTER (role = 'bcc') AS n_bcc, count(*) FILTER (role <> 'bcc') AS n_visible, min(item_at) AS first_at, max(item_at) AS last_at FROM e GROUP BY 1, 2""",
    "people_timeline": f"""{_P}, b AS (SELECT isoyear(item_at) || '-W' || lpad(CAST(weekofyear(item_at) AS VARCHAR), 2, '0') AS bucket, person, item_id FROM participants)
        SELECT bucket, NULL AS person, count(DISTINCT item_id) AS n_items FROM b GROUP BY 1 UNION ALL SELECT bucket, person, count(DISTINCT item_id) FROM b GROUP BY 1, 2""",
    "domain_rollup": f"{_PI} SELECT split_part(person, '@', 2) AS domain, count(*) AS people, CAST(sum(n_items) AS BIGINT) AS messages FROM n GROUP BY 1",
    "participant_slots": """WITH u AS (SELECT DISTINCT l_orderkey AS item_id, 's' || l_suppkey AS person FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY person) AS i FROM u)
        SELECT o_orderkey AS item_id, 'from' AS role, 'c' || o_custkey AS person FROM orders UNION ALL SELECT item_id, 'to', person FROM k WHERE i <= 2 AND item_id IN (SELECT o_orderkey FROM orders)""",
    "conversation_list": "SELECT conv_id, count(*) AS n_messages, count(*) FILTER (contains(lower(text), 'the')) AS n_hits, min(turn) AS first_at, max(turn) AS last_at FROM conversations GROUP BY 1 HAVING n_hits > 0",
    "conversation_all": "SELECT conv_id, count(*) AS n_messages, 0::BIGINT AS n_hits, min(turn) AS first_at, max(turn) AS last_at FROM conversations GROUP BY 1",
    "conversation_around": """WITH a AS (SELECT conv_id, max(turn) AS anchor FROM conversations WHERE role = 'user' GROUP BY 1)
        SELECT conv_id, anchor, conv_id || '-' || turn AS item_id, turn - anchor AS gap FROM conversations JOIN a USING (conv_id) WHERE turn - anchor BETWEEN -2 AND 1""",
    "date_coverage_week": _COVER("SELECT ts AS seen FROM events", "2023-12-15", "2024-12-31", "week", "7 DAY"), "date_coverage_month": _COVER("SELECT ts AS seen FROM events", "2023-12-15", "2024-12-31", "month", "1 MONTH"),
    "date_coverage_holes": _COVER("SELECT DATE '1900-01-01' + CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 17 AS INT) AS seen FROM orders", "1900-01-01", "2075-12-31", "week", "7 DAY"),
    "gap_roster": """WITH w AS (SELECT CASE WHEN n_nationkey = 7 THEN '99' ELSE CAST(n_nationkey AS VARCHAR) END AS name FROM nation), h AS (SELECT CASE WHEN c_nationkey = 3 THEN '3x' ELSE CAST(c_nationkey AS VARCHAR) END AS name, count(*) AS n FROM customer GROUP BY 1)
        SELECT coalesce(w.name, h.name) AS name, CASE WHEN w.name IS NULL THEN 'unexpected' ELSE 'missing' END AS finding, coalesce(n, 0) AS n FROM w FULL JOIN h ON w.name = h.name WHERE w.name IS NULL OR h.name IS NULL""",
    "gap_match_cascade": f"{_GAP} SELECT id, matched_by, present_id FROM m",
    "gap_match_items": """WITH p AS (SELECT doc_id AS id, CASE WHEN lang = 'fr' THEN source || '-' || n_chars END AS mid, CASE WHEN lang <> 'es' THEN doc_id END AS item, md5(text) AS lh, CASE WHEN n_chars > 2000 THEN md5(text) END AS nat, source AS ctl, coalesce(lang = 'en', false) AS mail FROM documents),
        e AS (SELECT p.id, CASE WHEN quality = 1 THEN mid END AS mid, CASE WHEN quality = 0 THEN item + 1000000 ELSE item END AS item, lh, nat, ctl, mail FROM p JOIN labels ON doc_id = id),
        m AS (SELECT e.id, 1 AS r, 'message_id' AS k, p.id AS pid FROM e JOIN p ON p.mid = e.mid UNION ALL SELECT e.id, 2, 'mail_item_id', p.id FROM e JOIN p ON p.item = e.item WHERE e.mail UNION ALL SELECT e.id, 3, 'mail_logical_hash', p.id FROM e JOIN p ON p.lh = e.lh WHERE e.mail
          UNION ALL SELECT e.id, 4, 'native_sha256', p.id FROM e JOIN p ON p.nat = e.nat UNION ALL SELECT e.id, 5, 'file_item_id', p.id FROM e JOIN p ON p.item = e.item WHERE NOT e.mail UNION ALL SELECT e.id, 6, 'file_logical_hash', p.id FROM e JOIN p ON p.lh = e.lh WHERE NOT e.mail
          UNION ALL SELECT e.id, 7, 'control_number', p.id FROM e JOIN p ON p.ctl = e.ctl), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY r, pid) AS i FROM m)
        SELECT e.id, b.k AS matched_by, b.pid AS present_id FROM e LEFT JOIN b ON b.id = e.id AND i = 1""",
    "custodian_inventory": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT CASE WHEN status <> 'error' THEN custodian ELSE '' END AS custodian, count(*) AS n FROM items GROUP BY 1",
    "gap_unexpected": f"{_GAP} SELECT id FROM p WHERE id NOT IN (SELECT present_id FROM m WHERE present_id IS NOT NULL)",
    "qc_findings": f"{_QC} SELECT * FROM found", "qc_rollup": f"{_QC} SELECT rule, severity, count(*) AS n FROM found GROUP BY 1, 2",
    "qc_gate": f"{_QC}, g AS (SELECT rule, CASE WHEN rule = 'zero_size' THEN 'error' ELSE severity END AS severity FROM found WHERE rule <> 'text_missing') SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warn') AS warnings, count(*) FILTER (severity = 'error') = 0 AS passed FROM g",
    "privilege_family_consistency": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT family_id, count(*) AS members, count(*) FILTER (file_category = 'A') AS privileged FROM items GROUP BY 1 HAVING privileged > 0 AND privileged < members",
    "audit_events": """WITH e AS (SELECT event_id AS seq, user_id, event_type, sha256(event_id || '|' || event_type) AS own FROM events), l AS (SELECT e.*, CASE WHEN e.event_type = 'error' THEN 'broken' ELSE b.own END AS prev_hash FROM e LEFT JOIN e b ON b.seq + 1 = e.seq),
        h AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'forged' ELSE sha256(coalesce(prev_hash, '') || chr(10) || user_id) END AS entry_hash FROM l)
        SELECT h.seq, h.prev_hash IS NOT DISTINCT FROM p.entry_hash AS link_ok, h.entry_hash = sha256(coalesce(h.prev_hash, '') || chr(10) || h.user_id) AS hash_ok FROM h LEFT JOIN h p ON p.seq + 1 = h.seq""",
    "audit_chain_verify": """WITH m AS (SELECT event_id AS seq, event_type, sha256(event_id || '|' || event_type) AS own FROM events), j AS (SELECT m.*, b.own AS prev FROM m LEFT JOIN m b ON b.seq + 1 = m.seq)
        SELECT (CASE WHEN event_type = 'purchase' THEN 'broken' ELSE prev END) IS NOT DISTINCT FROM prev AS link_ok, count(*) AS n, 0::BIGINT AS n_hash_ok FROM j GROUP BY 1""",
}
