"""Header chains, audit chains, selection fingerprints, snippets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkdocket.operators import audit, kwindex, qc, rollups, thread
from sparkdocket.plans import items as adapt
from sparkdocket.plans.staging import shared_dir, stage
from sparkdocket.queries import keywords
from sparkdocket.sources import loadfiles


def mail_headers(spark, sf_dir):
    """Turns as mail with folded headers: references to all turns before (one twice, another case), an index that grows by a block a turn."""
    c = adapt.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    ids = F.transform(F.sequence(F.lit(0), F.col("turn")), lambda i: F.concat(F.lit("<C"), F.col("conv_id").cast("string"), F.lit("-"), i.cast("string"), F.lit("@Mail.Example>")))
    before = F.slice(ids, F.lit(1), F.col("turn").cast("int"))
    refs = F.array_join(F.concat(before, F.slice(F.transform(before, F.lower), 1, 1)), "\r\n\t")
    digits = F.concat(F.lpad(F.hex("conv_id"), 44, "0"), F.array_join(F.transform(F.sequence(F.lit(0), F.col("turn")), lambda i: F.lpad(F.hex(i), 10, "0")), ""))
    code = F.regexp_replace(F.base64(F.unhex(digits)), r"\s", "")
    block = F.concat(
        F.lit("Subject: re\r\nMESSAGE-ID: "), F.element_at(ids, -1), F.lit("\r\nReferences:"), F.concat(F.lit("\r\n "), refs), F.lit("\r\nIn-Reply-To: "),
        F.when(F.col("role") == "user", F.concat(F.lit("see "), F.coalesce(F.get(before, F.lit(0)), F.lit("")))).otherwise(F.concat(F.lit("bare-"), F.col("turn").cast("string"), F.lit("@X"))),
        F.lit("\r\nThread-Index: "), F.substring(code, 1, 20), F.lit("\r\n  "), F.substring(code, F.lit(21), F.length(code)), F.lit("\r\nDate: x"),
    )
    h = thread.thread_headers(c.select(F.struct("conv_id", "turn").alias("key"), block.alias("block")), "key", "block")
    return h.select("key.conv_id", "key.turn", "mid", "in_reply_to", F.array_join("refs", ";").alias("refs"), "conv_index", "index_parent")


def audit_appended(spark, sf_dir):
    """Each user's events as a chain, appended in two turns."""
    e = adapt.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    first = stage(audit.append_events(e.where("event_id % 3 <> 0"), None, "user_id", "event_id", ["event_type", "event_id"]), "audit").df
    then = audit.append_events(e.where("event_id % 3 = 0"), audit.chain_heads(first, "user_id"), "user_id", "event_id", ["event_type", "event_id"])
    whole = stage(first.unionByName(then), "audit").df
    checked = audit.verify_chains(whole, "user_id", ["event_type", "event_id"])
    return whole.join(checked, ["user_id", "seq"]).select("user_id", "event_id", "seq", "entry_hash", "link_ok", "hash_ok")


def selection_roots(spark, sf_dir):
    """Fingerprints of documents by source, with repeats, and a rule pack."""
    d = adapt.table(spark, sf_dir, "documents")
    parts = []
    for name, rows, pack in (("all", d.union(d), ""), ("long", d.where("n_chars > 1000"), " strict "), ("none", d.where("false"), "strict")):
        parts.append(audit.selection_fingerprint(rows, "doc_id", pack).select(F.lit(name).alias("selection"), "items", "root"))
    return parts[0].union(parts[1]).union(parts[2])


def selection_gate(spark, sf_dir):
    """Runs over all documents: the latest counts, for its own selection and pack only."""
    d = adapt.table(spark, sf_dir, "documents")
    whole = audit.selection_fingerprint(d, "doc_id", "strict")
    root = whole.first()["root"]
    errors = qc.gate(d.select(F.when(F.col("n_chars") < 0, "error").otherwise("warn").alias("severity"))).first()["errors"]
    runs = spark.createDataFrame([(1, "2024-01-01", root, "strict", errors + 5), (2, "2024-01-02", root, "strict", errors)], "run_id int, finished_at string, root string, pack string, errors long")
    out = []
    for name, rows, pack in (("same", d, "strict"), ("changed", d.where("doc_id > 0"), "strict"), ("other_pack", d, "loose"), ("empty", d.where("false"), "strict")):
        mine = audit.selection_fingerprint(rows, "doc_id", "strict" if name == "other_pack" else pack)
        out.append(qc.gate_selection(runs, mine, pack).select(F.lit(name).alias("selection"), "run_id", "passed", "reason"))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def kw_windows(spark, sf_dir):
    """The shortest stretch of each hit's text that holds all three words, and its terms with three on both sides."""
    index = keywords._index(spark, sf_dir)
    w = stage(index.windows("body:(of AND is AND that) -qui", "body"), "windows").df
    d = adapt.table(spark, sf_dir, "documents")
    return w.join(kwindex.snippets(d, w, "doc_id", F.col("text")), "doc_id").select("doc_id", "start", "end", "snippet")


def reply_snippets(spark, sf_dir):
    """What each turn replies to: the first words of the turn before, of some of which the text is gone."""
    c = adapt.table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    parents = c.select(name(F.col("turn")).alias("item_id"), F.when(F.col("turn") % 4 != 1, F.col("text")).alias("text"), F.when(F.col("turn") % 8 == 1, F.col("role")).alias("subject"))
    replies = c.where("turn > 0").select(name(F.col("turn")).alias("item_id"), name(F.col("turn") - 1).alias("parent_item_id"))
    return rollups.reply_snippets(replies, parents)


def csv_read_back(spark, sf_dir):
    """Documents written as CSV, with line ends and quotes in their texts, and read in byte ranges."""
    d = adapt.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('say "'), F.regexp_replace("text", r"\s+$", ""), F.lit('",\n')).alias("text"), F.lit("x").alias("last"))
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    d.write.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return loadfiles.read_csv(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "last")


QUERIES = {"csv_read_back": csv_read_back, "mail_headers": mail_headers, "audit_appended": audit_appended, "selection_roots": selection_roots, "selection_gate": selection_gate, "kw_windows": kw_windows, "reply_snippets": reply_snippets}

_TREE = lambda name, rows, pack: f"""SELECT '{name}' AS selection, coalesce(CAST(sum(n) AS BIGINT), 0) AS items, sha256(coalesce(string_agg(node || ':' || digest, chr(10) ORDER BY node || ':' || digest), '') || {pack}) AS root FROM (
  SELECT node, sha256(string_agg(leaf || ':' || digest, chr(10) ORDER BY leaf || ':' || digest)) AS digest, sum(n) AS n FROM (
    SELECT left(leaf, 2) AS node, leaf, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest, count(*) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS id, left(sha256(CAST(doc_id AS VARCHAR)), 4) AS leaf FROM documents WHERE {rows}) GROUP BY leaf) GROUP BY node)"""  # noqa: E731
_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '" + keywords.kw.TOKEN + "', 1)"
ORACLE = {
    "csv_read_back": r"""SELECT doc_id, md5(trim('say "' || regexp_replace(text, '\s+$', '') || '",' || chr(10), ' ')) AS text_md5, 'x' AS last FROM documents""",
    "mail_headers": """WITH c AS (SELECT conv_id, turn, role, list_transform(range(0, turn), lambda i: 'c' || conv_id || '-' || i || '@mail.example') AS b, lpad(lower(to_hex(conv_id)), 44, '0') AS h, list_transform(range(0, turn + 1), lambda i: lpad(lower(to_hex(i)), 10, '0')) AS k FROM conversations)
        SELECT conv_id, turn, 'c' || conv_id || '-' || turn || '@mail.example' AS mid, CASE WHEN role <> 'user' THEN 'bare-' || turn || '@x' WHEN turn > 0 THEN b[1] ELSE 'see' END AS in_reply_to, array_to_string(b, ';') AS refs,
          h || array_to_string(k, '') AS conv_index, h || array_to_string(k[1:turn], '') AS index_parent FROM c""",
    "audit_appended": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 = 0, event_id) AS seq FROM events),
        r AS (SELECT user_id, event_id, seq, sha256(chr(10) || event_type || chr(10) || event_id) AS entry_hash FROM e WHERE seq = 1
          UNION ALL SELECT e.user_id, e.event_id, e.seq, sha256(r.entry_hash || chr(10) || e.event_type || chr(10) || e.event_id) FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1)
        SELECT user_id, event_id, seq, entry_hash, true AS link_ok, true AS hash_ok FROM r""",
    "selection_roots": " UNION ALL ".join([_TREE("all", "true", "''"), _TREE("long", "n_chars > 1000", "chr(10) || '#pack=strict'"), _TREE("none", "false", "chr(10) || '#pack=strict'")]),
    "selection_gate": """SELECT 'same' AS selection, 2 AS run_id, true AS passed, NULL AS reason UNION ALL SELECT 'changed', 2, false, 'selection_changed' UNION ALL SELECT 'other_pack', 2, false, 'other_pack' UNION ALL SELECT 'empty', 2, false, 'empty_selection'""",
    "kw_windows": f"""WITH {keywords._sql_posts()}, wb AS (SELECT doc_id, term, pos FROM post WHERE field = 'body' AND term IN ('of', 'is', 'that') AND doc_id NOT IN (SELECT doc_id FROM post WHERE term = 'qui')),
        wl AS (SELECT doc_id, pos, max(CASE WHEN term = 'of' THEN pos END) OVER w AS a, max(CASE WHEN term = 'is' THEN pos END) OVER w AS b, max(CASE WHEN term = 'that' THEN pos END) OVER w AS c FROM wb WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
        ws AS (SELECT doc_id, least(a, b, c) AS start, pos FROM wl WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), wf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos - start, start) AS n FROM ws)
        SELECT wf.doc_id, CAST(start AS INT) AS start, CAST(pos AS INT) AS end, (SELECT string_agg(p.term, ' ' ORDER BY p.pos) FROM post p WHERE p.doc_id = wf.doc_id AND p.field = 'body' AND p.pos BETWEEN wf.start - 3 AND wf.pos + 3) AS snippet FROM wf WHERE n = 1""",
    "reply_snippets": r"""WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 1 THEN text END AS t, CASE WHEN turn % 8 = 1 THEN role END AS s FROM conversations),
        x AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(t, ''), '\s+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(s, ''), '\s+', ' ', 'g')) AS s FROM p),
        y AS (SELECT conv_id, turn, CASE WHEN t <> '' THEN t ELSE s END AS v FROM x)
        SELECT c.conv_id || '-' || c.turn AS item_id, CASE WHEN coalesce(v, '') = '' THEN '[unavailable]' WHEN length(v) > 100 THEN left(v, 100) || '…' ELSE v END AS snippet FROM conversations c LEFT JOIN y ON y.conv_id = c.conv_id AND y.turn = c.turn - 1 WHERE c.turn > 0""",
}
