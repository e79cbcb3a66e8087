"""Reviewers' marks, privilege log, samples and conversation pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.operators import marks as mk
from sparkdocket.operators import rollups as r
from sparkdocket.plans import items as adapt

_GROUP = {"relevance": ["responsive", "not_responsive", "unsure"]}


def _coded(spark, sf_dir):
    """Codes of documents, and after a call that codes the French ones responsive and takes a code from them."""
    start = adapt.codes(spark, sf_dir)
    d = adapt.table(spark, sf_dir, "documents")
    before = start.union(d.where("n_chars > 4000").select(F.col("doc_id").alias("item_id"), F.lit("unsure").alias("code")))
    return before, mk.apply_codes(before, d.where("lang = 'fr'").select(F.col("doc_id").alias("item_id")), ["responsive", "hot"], ["privileged"], _GROUP)


def codes_applied(spark, sf_dir):
    return _coded(spark, sf_dir)[1]


def codes_to_families(spark, sf_dir):
    """Large returned lines coded with their whole units."""
    i = adapt.order_items(spark, sf_dir)
    units = mk.family_units(i, i.where("file_category = 'R' AND size_bytes > 70000"))
    none = spark.createDataFrame([], "item_id string, code string")
    return mk.apply_codes(none, units, ["key"], [])


def _privilege(spark, sf_dir):
    lab = adapt.table(spark, sf_dir, "labels").where("toxic = 1")
    return lab.select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 1, "under_review").otherwise("asserted").alias("status"), (F.col("quality") == 0).alias("withhold"), F.lit(True).alias("include_on_log"), F.lit("advice").alias("description"))


def privilege_synced(spark, sf_dir):
    return mk.sync_privilege(_privilege(spark, sf_dir), _coded(spark, sf_dir)[1].union(adapt.table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id", F.lit("privileged"))))


def privilege_upserted(spark, sf_dir):
    """Updates that leave some columns as they were; documents under 700 characters lose their row."""
    d = adapt.table(spark, sf_dir, "documents")
    updates = d.where("n_chars > 2000").select(F.col("doc_id").alias("item_id"), F.when(F.col("lang") == "en", "partial_redaction").alias("status"), F.when(F.col("lang") == "de", True).alias("withhold"), F.lit(None).cast("boolean").alias("include_on_log"), F.col("source").alias("description"))
    return mk.upsert(_privilege(spark, sf_dir), updates, "item_id", d.where("n_chars < 700").select(F.col("doc_id").alias("item_id")))


def notes_counted(spark, sf_dir):
    """Turns as notes of their conversation, after the assistant's third ones were deleted."""
    c = adapt.table(spark, sf_dir, "conversations")
    notes = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"), F.col("conv_id").alias("item_id"), F.col("text").alias("note_text"))
    gone = c.where("role = 'assistant' AND turn = 3").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"))
    changed = c.where("turn = 0").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note_id"), F.col("conv_id").alias("item_id"), F.lit("edited").alias("note_text"))
    kept = mk.upsert(notes, changed, "note_id", gone)
    return mk.counts_by_item(kept, "note_count").join(kept.groupBy("item_id").agg(F.count_if(F.col("note_text") == "edited").alias("n_edited")), "item_id")


def _texts_now(spark, sf_dir):
    """Documents some of which have changed since they were marked."""
    d = adapt.table(spark, sf_dir, "documents")
    return d.select("*", F.when(F.col("source").isin("src1", "src12"), F.concat(F.lit("New start. "), "text")).when(F.col("source") == "src2", F.concat_ws(" ", "text", "text")).when(F.col("source") == "src3", F.replace("text", F.lit(" "), F.lit("\n "))).otherwise(F.col("text")).alias("now"))


def redactions_state(spark, sf_dir):
    d = _texts_now(spark, sf_dir)
    reds = d.select(F.col("doc_id").alias("item_id"), F.md5("text").alias("source_sha")).union(d.where("lang = 'de'").select("doc_id", F.md5("source")))
    return mk.redaction_state(reds, d.select(F.col("doc_id").alias("item_id"), F.md5("now").alias("text_sha")))


def anchors_resolved(spark, sf_dir):
    """A mark on the fifth to seventh word of each document, sought in the text as it is now."""
    w = F.split("text", " ")
    part = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    before, quote, after = F.concat(part(4, 1), F.lit(" ")), part(5, 3), F.concat(F.lit(" "), part(8, 1))
    start = F.length(part(1, 4)) + 1
    d = _texts_now(spark, sf_dir).where("text IS NOT NULL")
    return d.select("doc_id", mk.re_anchor(F.col("now"), quote, before, after, start.cast("int"), F.col("now") == F.col("text")).alias("a")).select("doc_id", "a.state", "a.start")


def suggestions_resolved(spark, sf_dir):
    """Two suggestions a document, the second for French ones of the same code, by a quotation of its start."""
    d = _texts_now(spark, sf_dir)
    quote = F.substring("text", 1, 40)
    one = d.select((F.col("doc_id") * 2).alias("suggestion_id"), F.col("doc_id").alias("item_id"), F.lit("hot").alias("code"), quote.alias("quote"))
    two = d.select((F.col("doc_id") * 2 + 1).alias("suggestion_id"), F.col("doc_id").alias("item_id"), F.when(F.col("lang") == "fr", "hot").otherwise("key").alias("code"), F.concat(quote, F.when(F.col("lang") == "es", "?").otherwise("")).alias("quote"))
    return mk.resolve_suggestions(one.union(two), d.select(F.col("doc_id").alias("item_id"), F.col("now").alias("text")))


def _suggested(spark, sf_dir):
    d = _texts_now(spark, sf_dir)
    quote = F.substring("text", 1, 40)
    one = d.select((F.col("doc_id") * 2).alias("suggestion_id"), F.col("doc_id").alias("item_id"), F.lit("hot").alias("code"), quote.alias("quote"), F.lit(0).alias("start"), F.octet_length(quote).alias("end"))
    two = d.select((F.col("doc_id") * 2 + 1).alias("suggestion_id"), F.col("doc_id").alias("item_id"), F.when(F.col("lang") == "fr", "hot").otherwise("key").alias("code"), F.concat(quote, F.when(F.col("lang") == "es", "?").otherwise("")).alias("quote"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return mk.accept_suggestions(one.union(two), d.select(F.col("doc_id").alias("item_id"), F.col("now").alias("text")), adapt.codes(spark, sf_dir))


def suggestions_accepted(spark, sf_dir):
    """Whether the place of each accepted suggestion holds its quotation, white space aside."""
    resolved = _suggested(spark, sf_dir)[0].where("outcome = 'accepted'")
    d = _texts_now(spark, sf_dir).select(F.col("doc_id").alias("item_id"), "text", "now")
    cut = F.substring(F.col("now").cast("binary"), F.col("start") + 1, F.col("end") - F.col("start")).cast("string")
    flat = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return resolved.join(d, "item_id").select("suggestion_id", "item_id", "code", (flat(cut) == flat(F.substring("text", 1, 40))).alias("holds"))


def codes_after_suggestions(spark, sf_dir):
    return _suggested(spark, sf_dir)[1]


def privilege_log(spark, sf_dir):
    """Lines have no sender or date of their own: their order's serve."""
    i = adapt.order_items(spark, sf_dir)
    items = i.select("item_id", "parent_item_id", "path", F.when(F.col("role") == "parent", F.col("custodian")).otherwise("  ").alias("from_addr"), F.when(F.col("file_category") == "A", F.lit("list")).alias("recipients"), F.when(F.col("role") == "parent", F.col("file_category")).otherwise("").alias("subject"), "sent_at")
    priv = i.where("size_bytes > 60000").select("item_id", F.when(F.col("status") == "partial", "none").when(F.col("role") == "parent", "asserted").otherwise("under_review").alias("status"), (F.col("size_bytes") > 90_000).alias("withhold"), (F.col("file_category") != "N").alias("include_on_log"), F.lit("advice").alias("description"))
    return mk.privilege_log(items, priv)


def _coders(spark, sf_dir):
    """Events as codings: the user codes the item of the same number as the whole value."""
    e = adapt.table(spark, sf_dir, "events")
    return e.select(F.floor("value").cast("long").alias("item_id"), F.col("user_id").alias("coder"), F.col("event_id").alias("coded_at"))


def qc_sample(spark, sf_dir):
    """A sampling operator: a tenth of the coded items."""
    return mk.sample_coded(_coders(spark, sf_dir), "seed-1", percent=10.0)


def qc_sample_report(spark, sf_dir):
    outcomes = adapt.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") == "F", "agree").when(F.col("o_orderstatus") == "O", "disagree").alias("outcome"))
    return mk.sample_report(mk.sample_coded(_coders(spark, sf_dir), "seed-2", n=40), outcomes)


def _convs(spark, sf_dir):
    c = adapt.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.lit(1).alias("item_id"))
    return r.conversations(c).select("conv_id", "n_messages", F.when(F.col("n_messages") > 2, F.col("last_at")).alias("last_at"))


def conversation_page(spark, sf_dir):
    """The page of twenty after a cursor: a page, so it is limited."""
    return mk.conversation_page(_convs(spark, sf_dir), (3, 2), 20)


def _stream(forward):
    def run(spark, sf_dir):
        c = adapt.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "role")
        return mk.stream_pages(c.drop("role"), c.where("role = 'user'").select("conv_id", F.col("position").alias("anchor")), 2, forward)

    return run


def stream_gaps(spark, sf_dir):
    """The next three messages after each user's, where a third of all messages are missing."""
    c = adapt.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("position"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "role")
    return mk.stream_pages(c.where("position % 3 <> 1").drop("role"), c.where("role = 'user'").select("conv_id", F.col("position").alias("anchor")), 3, True)


_ID = "conv_id || '-' || turn"
_NOW = "CASE WHEN source IN ('src1', 'src12') THEN 'New start. ' || text WHEN source = 'src2' THEN text || ' ' || text WHEN source = 'src3' THEN replace(text, ' ', chr(10) || ' ') ELSE text END AS now"
_SQUASH = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
_CODED = f"""{adapt.CODES_SQL}, b AS (SELECT * FROM codes UNION ALL SELECT doc_id, 'unsure' FROM documents WHERE n_chars > 4000), fr AS (SELECT doc_id FROM documents WHERE lang = 'fr'),
  coded AS (SELECT item_id, code FROM b WHERE NOT (item_id IN (SELECT doc_id FROM fr) AND code IN ('privileged', 'unsure', 'not_responsive')) UNION SELECT doc_id, unnest(['responsive', 'hot']) FROM fr)"""
_PRIV = "p AS (SELECT doc_id AS item_id, CASE WHEN quality = 1 THEN 'under_review' ELSE 'asserted' END AS status, coalesce(quality = 0, false) AS withhold, true AS include_on_log, 'advice' AS description FROM labels WHERE toxic = 1)"
QUERIES = {
    "codes_applied": codes_applied, "codes_to_families": codes_to_families, "privilege_synced": privilege_synced, "privilege_upserted": privilege_upserted, "notes_counted": notes_counted, "redactions_state": redactions_state,
    "anchors_resolved": anchors_resolved, "suggestions_resolved": suggestions_resolved, "suggestions_accepted": suggestions_accepted, "codes_after_suggestions": codes_after_suggestions, "privilege_log": privilege_log, "qc_sample": qc_sample, "qc_sample_report": qc_sample_report,
    "conversation_page": conversation_page, "stream_gaps": stream_gaps, "stream_forward": _stream(True), "stream_before": _stream(False),
}
_SAMPLE = lambda seed, size: f"(SELECT item_id, coder FROM (SELECT item_id, arg_max(coder, coded_at) AS coder FROM k GROUP BY 1) ORDER BY md5('{seed}' || item_id), item_id LIMIT ({size}))"
_K = "k AS (SELECT CAST(floor(value) AS BIGINT) AS item_id, user_id AS coder, event_id AS coded_at FROM events)"
_STREAM = lambda sign: f"WITH a AS (SELECT conv_id, turn AS anchor FROM conversations WHERE role = 'user') SELECT c.conv_id, anchor, CAST({sign}(turn - anchor) AS INT) AS nth, c.conv_id || '-' || turn AS item_id FROM conversations c JOIN a ON a.conv_id = c.conv_id AND {sign}(turn - anchor) BETWEEN 1 AND 2"
#: Suggestions as in ``suggestions_resolved``; a quotation is unique if it stands once, overlaps counted.
_ACCEPTED = f"""d AS (SELECT *, {_NOW} FROM documents), s AS (SELECT doc_id * 2 AS suggestion_id, doc_id AS item_id, 'hot' AS code, substring(text, 1, 40) AS quote FROM d
          UNION ALL SELECT doc_id * 2 + 1, doc_id, CASE WHEN lang = 'fr' THEN 'hot' ELSE 'key' END, substring(text, 1, 40) || CASE WHEN lang = 'es' THEN '?' ELSE '' END FROM d),
        j AS (SELECT s.*, max(suggestion_id) OVER (PARTITION BY item_id, code) AS latest, lower({_SQUASH("coalesce(now, '')")}) AS t, lower({_SQUASH('quote')}) AS q FROM s JOIN d ON doc_id = item_id),
        a AS (SELECT suggestion_id, item_id, code FROM j WHERE suggestion_id = latest AND length(q) > 0 AND instr(t, q) > 0 AND instr(substr(t, instr(t, q) + 1), q) = 0)"""
ORACLE = {
    "suggestions_accepted": f"WITH {_ACCEPTED} SELECT suggestion_id, item_id, code, true AS holds FROM a",
    "codes_after_suggestions": f"WITH {adapt.CODES_SQL}, {_ACCEPTED} SELECT item_id, code FROM codes UNION SELECT item_id, code FROM a",
    "codes_applied": f"WITH {_CODED} SELECT item_id, code FROM coded",
    "codes_to_families": f"""WITH {adapt.ORDER_ITEMS_SQL}, h AS (SELECT coalesce(parent_item_id, item_id) AS top FROM items WHERE file_category = 'R' AND size_bytes > 70000) SELECT item_id, 'key' AS code FROM items WHERE coalesce(parent_item_id, item_id) IN (SELECT top FROM h)""",
    "privilege_synced": f"""WITH {_CODED}, {_PRIV}, k AS (SELECT item_id FROM coded WHERE code = 'privileged' UNION SELECT doc_id FROM documents WHERE lang = 'es')
        SELECT * FROM p WHERE item_id IN (SELECT item_id FROM k) UNION ALL SELECT item_id, 'asserted', true, true, '' FROM k WHERE item_id NOT IN (SELECT item_id FROM p)""",
    "privilege_upserted": f"""WITH {_PRIV}, u AS (SELECT doc_id AS item_id, CASE WHEN lang = 'en' THEN 'partial_redaction' END AS s, CASE WHEN lang = 'de' THEN true END AS w, source AS d FROM documents WHERE n_chars > 2000)
        SELECT coalesce(p.item_id, u.item_id) AS item_id, coalesce(s, status) AS status, coalesce(w, withhold) AS withhold, include_on_log, coalesce(d, description) AS description FROM p FULL JOIN u ON p.item_id = u.item_id
        WHERE coalesce(p.item_id, u.item_id) NOT IN (SELECT doc_id FROM documents WHERE n_chars < 700)""",
    "notes_counted": "SELECT conv_id AS item_id, count(*) AS note_count, count(*) FILTER (turn = 0 OR text = 'edited') AS n_edited FROM conversations WHERE NOT (role = 'assistant' AND turn = 3) GROUP BY 1",
    "redactions_state": f"""WITH d AS (SELECT *, {_NOW} FROM documents), r AS (SELECT doc_id AS item_id, md5(text) AS source_sha FROM d UNION ALL SELECT doc_id, md5(source) FROM d WHERE lang = 'de')
        SELECT item_id, source_sha, CASE WHEN source_sha = md5(now) THEN 'active' ELSE 'stale' END AS state FROM r JOIN d ON doc_id = item_id""",
    "anchors_resolved": f"""WITH d AS (SELECT *, {_NOW}, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL),
        q AS (SELECT doc_id, now, text, array_to_string(w[4:4], ' ') || ' ' AS b, array_to_string(w[5:7], ' ') AS q, ' ' || array_to_string(w[8:8], ' ') AS a, length(array_to_string(w[1:4], ' ')) + 1 AS s FROM d),
        n AS (SELECT *, {_SQUASH('now')} AS t, {_SQUASH('b || q || a')} AS whole, length({_SQUASH("b || '|'")}) - 1 AS pre FROM q), f AS (SELECT *, strpos(t, whole) AS i FROM n),
        g AS (SELECT *, now = text AND substring(now, s + 1, length(q)) = q AS here, length(whole) > 0 AND i > 0 AND strpos(substring(t, i + 1), whole) = 0 AS once FROM f)
        SELECT doc_id, CASE WHEN here THEN 'active' WHEN once THEN 'moved' ELSE 'stale' END AS state, CAST(CASE WHEN here THEN s WHEN once THEN i - 1 + pre END AS INT) AS start FROM g""",
    "suggestions_resolved": f"""WITH d AS (SELECT *, {_NOW} FROM documents), s AS (SELECT doc_id * 2 AS suggestion_id, doc_id AS item_id, 'hot' AS code, substring(text, 1, 40) AS quote FROM d
          UNION ALL SELECT doc_id * 2 + 1, doc_id, CASE WHEN lang = 'fr' THEN 'hot' ELSE 'key' END, substring(text, 1, 40) || CASE WHEN lang = 'es' THEN '?' ELSE '' END FROM d),
        j AS (SELECT s.*, max(suggestion_id) OVER (PARTITION BY item_id, code) AS latest, lower({_SQUASH("coalesce(now, '')")}) AS t, lower({_SQUASH('quote')}) AS q FROM s JOIN d ON doc_id = item_id)
        SELECT suggestion_id, item_id, code, CASE WHEN suggestion_id < latest THEN 'superseded' WHEN length(q) > 0 AND (length(t) - length(replace(t, q, ''))) // length(q) = 1 THEN 'accepted' ELSE 'unverified' END AS outcome FROM j""",
    "privilege_log": f"""WITH {adapt.ORDER_ITEMS_SQL}, x AS (SELECT *, CASE WHEN role = 'parent' THEN custodian END AS f, CASE WHEN file_category = 'A' THEN 'list' END AS rc, CASE WHEN role = 'parent' THEN file_category END AS su FROM items)
        SELECT x.item_id, x.path, CASE WHEN x.role = 'parent' THEN 'asserted' ELSE 'under_review' END AS privilege_status, x.size_bytes > 90000 AS withhold, 'advice' AS description, coalesce(x.f, p.f) AS from_addr, coalesce(x.rc, p.rc) AS recipients, coalesce(x.su, p.su) AS subject, coalesce(x.sent_at, p.sent_at) AS sent_at, row_number() OVER (ORDER BY coalesce(x.sent_at, p.sent_at) NULLS LAST, x.path NULLS FIRST, x.item_id) AS seq
        FROM x LEFT JOIN x p ON p.item_id = x.parent_item_id WHERE x.size_bytes > 60000 AND x.status <> 'partial' AND x.file_category <> 'N'""",
    "qc_sample": f"WITH {_K} SELECT * FROM {_SAMPLE('seed-1', 'SELECT greatest(1, CAST(ceil(count(DISTINCT item_id) * 0.1) AS BIGINT)) FROM k')}",
    "qc_sample_report": f"WITH {_K}, s AS {_SAMPLE('seed-2', '40')} SELECT coder, CASE WHEN o_orderstatus = 'F' THEN 'agree' WHEN o_orderstatus = 'O' THEN 'disagree' END AS outcome, count(*) AS n FROM s LEFT JOIN orders ON o_orderkey = item_id GROUP BY 1, 2",
    "conversation_page": """WITH c AS (SELECT conv_id, count(*) AS n_messages, CASE WHEN count(*) > 2 THEN max(turn) END AS last_at FROM conversations GROUP BY 1)
        SELECT conv_id, n_messages, last_at FROM c WHERE last_at IS NULL OR last_at < 3 OR (last_at = 3 AND conv_id > 2) ORDER BY last_at DESC NULLS LAST, conv_id LIMIT 20""",
    "stream_gaps": """WITH m AS (SELECT conv_id, turn FROM conversations WHERE turn % 3 <> 1), a AS (SELECT conv_id, turn AS anchor FROM conversations WHERE role = 'user'),
        n AS (SELECT a.conv_id, anchor, m.turn, CAST(row_number() OVER (PARTITION BY a.conv_id, anchor ORDER BY m.turn) AS INT) AS nth FROM a JOIN m ON m.conv_id = a.conv_id AND m.turn > anchor)
        SELECT conv_id, anchor, nth, conv_id || '-' || turn AS item_id FROM n WHERE nth <= 3""",
    "stream_forward": _STREAM("1 * "), "stream_before": _STREAM("-1 * "),
}
