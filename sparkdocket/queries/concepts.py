"""Concept clusters, units, incremental jobs, hashed vectors, the case report, and functions of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdocket.functions import hashing, norm
from sparkdocket.operators import concepts as c
from sparkdocket.operators import cull, dedupe, thread
from sparkdocket.operators import keyword as kw
from sparkdocket.operators import text as t
from sparkdocket.operators.filterspec import PRESETS, Satellites, apply_filter
from sparkdocket.plans import items as adapt
from sparkdocket.sources.chat import detect_packages


def _d(spark, sf_dir):
    return adapt.table(spark, sf_dir, "documents")


def vocabulary(spark, sf_dir):
    """The 500 commonest terms: the cap is the feature."""
    return c.vocabulary(c.cluster_tokens(_d(spark, sf_dir), "doc_id", "text"), "doc_id", 500)


def concept_clusters(spark, sf_dir):
    """Turns of conversations in four clusters, three rounds."""
    turns = adapt.table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "text")
    w = t.tf_idf(c.cluster_tokens(turns, "item_id", "text"), "item_id").withColumn("weight", F.round("weight", 9))
    return c.kmeans(w, "item_id", 4, 3, "s").select("item_id", "cluster", F.round("similarity", 6).alias("similarity"))


def sentence_units(spark, sf_dir):
    u = _d(spark, sf_dir).select("doc_id", c.sentence_units(F.col("text"), None).alias("u"))
    return u.select("doc_id", F.size("u").alias("n"), F.md5(F.array_join("u", "\n")).alias("units_md5"))


def tone_rescoring(spark, sf_dir):
    d, lab = _d(spark, sf_dir), adapt.table(spark, sf_dir, "labels")
    now = d.select(F.col("doc_id").alias("item_id"), F.md5("text").alias("text_sha"))
    stored = d.join(lab, "doc_id").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("toxic") == 1, F.md5("source")).otherwise(F.md5("text")).alias("text_sha"), F.when(F.col("lang") == "fr", "old").otherwise("m1").alias("method"),
        F.when(F.col("quality") == 1, 0.05).otherwise(0.1).alias("strong"), F.when(F.col("lang") != "es", (F.col("n_chars") % 100 - 50) / 100.0).alias("compound"),
    )
    return c.rescoring(now, stored, "m1", 0.05)


def hashed_vectors(spark, sf_dir):
    return c.hashed_vectors(_d(spark, sf_dir), "doc_id", "text")


def entity_job(spark, sf_dir):
    """Entities of three fields of the documents whose fingerprint has changed since a run on the labelled ones."""
    d, lab = _d(spark, sf_dir), adapt.table(spark, sf_dir, "labels")
    fields = {"body": F.col("text"), "subject": F.substring_index("text", "\n", 1), "from": F.concat(F.col("source"), F.lit("@mail.example.com"))}
    now = kw.fingerprints(d, "doc_id", [*fields.values()])
    stored = kw.fingerprints(d.join(lab.where("toxic = 0"), "doc_id"), "doc_id", [*fields.values()])
    due = kw.changed(now, stored, "doc_id").where("change <> 'remove'").select("doc_id")
    rows = d.join(due, "doc_id", "left_semi").select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.alias("t")) for n, v in fields.items()])).alias("f")).select(F.struct("doc_id", "f.field").alias("id"), F.col("f.t").alias("t"))
    h = t.entity_hits(rows, "id", "t")
    return h.groupBy(F.col("id.doc_id").alias("doc_id"), F.col("id.field").alias("field"), "entity_type").agg(F.count(F.lit(1)).alias("n"))


def case_report(spark, sf_dir):
    i = adapt.order_items(spark, sf_dir)
    return c.case_report(i.select("custodian", "file_category", "status", "role", "size_bytes"), {"custodians": (F.col("custodian"), 25), "categories": (F.col("file_category"), 5), "status": (F.col("status"), 10), "roles": (F.col("role"), 1)})


def email_hashes(spark, sf_dir):
    """Turns as mail between the people of a conversation."""
    m = adapt.table(spark, sf_dir, "conversations")
    none, at = F.array().cast("array<string>"), F.timestamp_seconds(F.col("conv_id") * 86_400 + F.col("turn") * 60)
    files = F.array(F.struct(F.lit("A.TXT").alias("name"), F.col("turn").alias("size"), F.md5("role").alias("digest")))
    h = hashing.email_hash(F.concat(F.lit("<m"), F.col("turn").cast("string"), F.lit("@x>")), F.concat(F.lit("  c "), F.col("conv_id").cast("string")), F.upper("role"), F.array(F.lit(" B@x "), F.lit("a@x")), none, none, at, F.lit(None).cast("timestamp"), F.col("text"), files)
    return m.select("conv_id", "turn", h.alias("logical_hash"))


def children_suppressed(spark, sf_dir):
    """Orders of one customer as duplicates of its first; a line's twin has its part, else its name and price."""
    o, i = adapt.table(spark, sf_dir, "orders"), adapt.order_items(spark, sf_dir)
    canon = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("c"))
    oid = lambda k: F.concat(F.lit("O"), F.col(k).cast("string"))
    roles = o.join(canon, "o_custkey").select(oid("o_orderkey").alias("item_id"), F.when(F.col("o_orderkey") == F.col("c"), "unique").otherwise("duplicate").alias("dedup_role"), oid("c").alias("group_id"))
    kids = i.withColumn("native_sha256", F.when(F.col("file_category") != "N", F.concat("file_category", F.floor(F.col("size_bytes") / 1000).cast("string")))).withColumn("path", F.upper(F.substring("path", 1, 6))).withColumn("size_bytes", F.floor(F.col("size_bytes") / 20_000))
    return dedupe.suppress_children(kids, roles)


def hash_list_marked(spark, sf_dir):
    d = _d(spark, sf_dir).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("native_sha256"))
    listed = _d(spark, sf_dir).where("lang = 'fr'").select(F.upper(F.md5("text")).alias("sha256"))
    return cull.mark_hash_list(d, listed).select("doc_id", "in_hash_list")


def threads_inherited(spark, sf_dir):
    """Lines take the thread of their order."""
    i = adapt.order_items(spark, sf_dir)
    threads = i.where("role = 'parent'").select("item_id", F.col("custodian").alias("thread_id"), F.lit("index").alias("thread_method"))
    return thread.inherit(i.where("role = 'attachment'"), threads)


def header_references(spark, sf_dir):
    """References headers made of a conversation's turns, one of them twice."""
    m = adapt.table(spark, sf_dir, "conversations")
    one = lambda k: F.concat(F.lit("<M"), k.cast("string"), F.lit("@X.example>"))
    head = F.concat_ws(" ", one(F.col("conv_id")), one(F.col("turn")), F.lit("junk"), one(F.col("conv_id")))
    return m.select("conv_id", "turn", F.concat_ws(",", thread.references(head)).alias("refs"))


def participant_kinds(spark, sf_dir):
    """Suppliers' and customers' names written as mail addresses, directory names, display names and numbers."""
    k = F.col("c_custkey")
    s = F.when(k % 4 == 0, F.concat(F.lit(" "), "c_name", F.lit("@Mail.example "))).when(k % 4 == 1, F.concat(F.lit("/O=Org/CN="), "c_name")).when(k % 4 == 2, F.concat(F.col("c_name"), F.lit("   (Sales)"))).otherwise(k.cast("string"))
    return adapt.table(spark, sf_dir, "customer").select("c_custkey", norm.participant_kind(s).alias("kind"), norm.participant_key(s).alias("key"))


def conversation_ids(spark, sf_dir):
    m = adapt.table(spark, sf_dir, "conversations")
    team = F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.col("role"))
    return m.select("conv_id", "turn", norm.conversation_id(team, F.lit("general"), F.lit(None).cast("string"), F.col("conv_id")).alias("conversation_id"))


def packages_detected(spark, sf_dir):
    """A listing made of pages: a folder per host, a file per page."""
    p = adapt.table(spark, sf_dir, "pages")
    n = F.col("page_id") % 9
    name = F.when(n == 0, "Manifest.csv").when(n == 1, "mail.PST").when(n == 2, "export.zip").when(n == 3, "summary.txt").otherwise("page.html")
    return detect_packages(p.select(F.concat_ws("/", F.split("url", "/")[2], name).alias("path")))


def error_texts_scrubbed(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "pages")
    message = F.concat(F.lit("cannot open C:\\data\\in\\p"), F.col("page_id").cast("string"), F.lit(".html and /var/x/y.txt"))
    return p.select("page_id", norm.scrub_paths(message).alias("message"))


def _f_items(spark, sf_dir):
    """Documents with the columns that the remaining filters ask for."""
    d = _d(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("item_id"), F.lit("extracted").alias("status"), F.lit(True).alias("in_review"), F.lit(None).cast("long").alias("parent_item_id"), F.lit(None).cast("long").alias("family_id"),
        F.when(F.col("n_chars") > 900, F.md5("text")).alias("text_sha256"), F.lit(None).cast("string").alias("html_sha256"), F.when(F.col("lang") == "en", 2).alias("entity_count"), F.when(F.col("lang") == "fr", True).alias("pdf_needs_ocr"),
        F.when(F.col("lang") == "de", 1).alias("redaction_count"), F.when(F.col("n_chars") > 1500, "r").alias("redacted_sha256"), F.when(F.col("n_chars") > 2500, F.md5("text")).otherwise("s").alias("redacted_source_sha256"),
        F.when(F.col("lang") == "es", 3).alias("highlight_count"), F.when(F.col("lang") == "es", 1).alias("note_count"), F.when(F.col("n_chars") > 3000, "calendar").when(F.col("n_chars") > 2000, "chat").alias("file_category"),
        F.when(F.col("lang") != "fr", F.when(F.col("n_chars") > 1000, "positive").otherwise("negative")).alias("sentiment_polarity"), (F.col("n_chars") % 32).alias("entity_flags"),
    )


_LEFT = {
    "has_text": ("has_text", "eq", True), "has_entity": ("has_entity", "eq", False), "entity_type": ("entity_type", "any_of", ["email", "card"]), "participant_key": ("participant_key", "contains", "SRC1@"), "participant_email": ("participant_email", "eq", "SRC2@mail.example"),
    "cluster_id": ("concept_cluster_id", "any_of", [1, 3]), "cluster_set": ("concept_cluster_set_id", "eq", 1), "has_cluster": ("has_concept_cluster", "eq", False), "needs_ocr": ("pdf_needs_ocr", "eq", False), "stale": ("redacted_text_stale", "eq", True),
}


def _f_satellites(spark, sf_dir):
    d = _d(spark, sf_dir)
    item, lab = F.col("doc_id").alias("item_id"), adapt.table(spark, sf_dir, "labels")
    return Satellites(
        codes=adapt.codes(spark, sf_dir), notes=d.select(item, F.col("text").alias("note_text")), entities=t.entity_hits(d, "doc_id", "text").select(F.col("id").alias("item_id"), "entity_type"),
        participants=d.select(item, F.col("doc_id").alias("person_id"), F.concat("source", F.lit("@mail.example")).alias("person_key"), F.lit("smtp").alias("kind"), F.lit("from").alias("role")),
        clusters=d.where("lang <> 'de'").select(item, (F.col("n_chars") % 5).alias("cluster_id"), (F.col("n_chars") % 2).alias("set_id"), F.when(F.col("lang") == "en", "default").otherwise("own").alias("set_name")),
        privilege=lab.where("toxic = 1").select(item, F.lit("asserted").alias("status"), (F.col("quality") == 0).alias("withhold"), F.lit(True).alias("include_on_log"), F.lit(" ").alias("description")),
    )


def filters_left(spark, sf_dir):
    """Items of each filter that no other query uses."""
    items, sat = _f_items(spark, sf_dir), _f_satellites(spark, sf_dir)
    spec = lambda cond: {"version": 1, "scope": "entire_matter", "conditions": [dict(zip(("field", "op", "value"), cond, strict=True))]}
    parts = [apply_filter(items, spec(cond), sat).select(F.lit(n).alias("filter"), "item_id") for n, cond in _LEFT.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def presets_all(spark, sf_dir):
    """How many items each of the 18 presets selects."""
    items, sat = _f_items(spark, sf_dir), _f_satellites(spark, sf_dir)
    parts = [apply_filter(items, spec, sat).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("preset"), "n") for n, spec in PRESETS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def cull_presets(spark, sf_dir):
    """The culling presets over documents, some of them marked duplicates."""
    d = _d(spark, sf_dir)
    items = d.select(F.col("doc_id").alias("item_id"), F.lit(None).cast("long").alias("parent_item_id"), F.when(F.col("lang") == "fr", "duplicate").otherwise("unique").alias("dedup_role"), F.when(F.col("n_chars") > 500, F.col("n_chars")).otherwise(0).alias("size_bytes"), F.when(F.col("lang") == "es", "System").otherwise("document").alias("file_category"), F.lit("extracted").alias("status"))
    parts = [cull.cull(items, cull.PRESETS[n], "keep_children").select(F.lit(n).alias("preset"), "item_id", "cull_status", F.concat_ws(",", "cull_reasons").alias("cull_reasons")) for n in ("unique_only", "noise_light")]
    return parts[0].union(parts[1])


_STOP = "(" + ", ".join(f"'{w}'" for w in c.STOP_WORDS + c.STRUCTURAL) + ")"
_LINE = " AND ".join(["l <> ''", *[f"NOT starts_with(lower(l), '{p}')" for p in c.HEADER_PREFIXES], *[f"NOT contains(lower(l), '{p}')" for p in c.FORWARD_MARKS + c.DISCLAIMERS]])
_PROSE = lambda col: rf"array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce({col}, ''), '\r?\n'), lambda l: trim(l)), lambda l: {_LINE}), chr(10))"
_TOK = lambda src, key: f"tok AS (SELECT {key}, unnest(list_filter(regexp_extract_all(lower({_PROSE('text')}), '[a-z0-9ß-ÿ]{{2,}}'), lambda w: NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {_STOP})) AS term FROM {src})"


def _kmeans_sql(rounds):
    steps = []
    for n in range(rounds):
        steps.append(f"""b{n} AS (SELECT item_id, cluster, round(sum(weight * c), 9) AS dot FROM w JOIN c{n} USING (term) GROUP BY 1, 2), r{n} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dot DESC, cluster) AS i FROM b{n}),
          p{n} AS (SELECT ids.item_id, coalesce(cluster, 0) AS cluster, coalesce(dot, 0.0) AS similarity FROM ids LEFT JOIN (SELECT * FROM r{n} WHERE i = 1) x ON x.item_id = ids.item_id),
          s{n} AS (SELECT cluster, term, sum(weight) AS s FROM w JOIN p{n} USING (item_id) GROUP BY 1, 2), c{n + 1} AS (SELECT s{n}.cluster, term, round(s / norm, 9) AS c FROM s{n} JOIN (SELECT cluster, sqrt(sum(s * s)) AS norm FROM s{n} GROUP BY 1) q ON q.cluster = s{n}.cluster)""")
    last = f"p{rounds - 1}"
    return f"""WITH turns AS (SELECT conv_id || '-' || turn AS item_id, text FROM conversations), {_TOK('turns', 'item_id')}, tf AS (SELECT item_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), nn AS (SELECT count(DISTINCT item_id) AS n FROM tok),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), raw AS (SELECT item_id, term, (1 + ln(tf)) * ln(1 + n / (1 + df)) AS x FROM tf JOIN df USING (term), nn WHERE df >= 2 AND df <= greatest(1, CAST(floor(0.9 * n) AS BIGINT))),
      w AS (SELECT raw.item_id, term, round(x / norm, 9) AS weight FROM raw JOIN (SELECT item_id, sqrt(sum(x * x)) AS norm FROM raw GROUP BY 1) q ON q.item_id = raw.item_id), ids AS (SELECT DISTINCT item_id FROM w),
      seeds AS (SELECT item_id, row_number() OVER (ORDER BY md5('s|' || item_id), item_id) - 1 AS cluster FROM ids QUALIFY cluster < 4), c0 AS (SELECT cluster, term, weight AS c FROM w JOIN seeds USING (item_id)), {', '.join(steps)}
      SELECT item_id, dense_rank() OVER (ORDER BY cluster) - 1 AS cluster, round(similarity, 6) AS similarity FROM {last}"""


_ENT = lambda p: f"regexp_extract_all(t, '{t.ENTITY_PATTERNS[p]}')"
_PRES = {
    "uncoded": "item_id NOT IN (SELECT item_id FROM codes)", "privilege": "item_id IN (SELECT item_id FROM codes WHERE code = 'privileged')", "responsive": "item_id IN (SELECT item_id FROM codes WHERE code = 'responsive')",
    "has_notes": "lang = 'es'", "has_highlights": "lang = 'es'", "withheld": "item_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0)", "log_incomplete": "item_id IN (SELECT doc_id FROM labels WHERE toxic = 1)", "has_redactions": "lang = 'de'",
    "pii": "(n_chars % 32) & 14 <> 0", "has_email": "(n_chars % 32) & 1 <> 0", "has_card": "(n_chars % 32) & 8 <> 0", "needs_ocr": "lang = 'fr'", "calendar": "n_chars > 3000", "chat": "n_chars > 2000 AND n_chars <= 3000",
    "stale_redactions": "lang = 'de' AND n_chars <= 2500", "negative": "lang <> 'fr' AND n_chars <= 1000", "positive": "lang <> 'fr' AND n_chars > 1000", "unscored": "lang = 'fr'",
}
QUERIES = {
    "vocabulary": vocabulary, "concept_clusters": concept_clusters, "sentence_units": sentence_units, "tone_rescoring": tone_rescoring, "hashed_vectors": hashed_vectors, "entity_job": entity_job, "case_report": case_report,
    "email_hashes": email_hashes, "children_suppressed": children_suppressed, "hash_list_marked": hash_list_marked, "threads_inherited": threads_inherited, "header_references": header_references, "participant_kinds": participant_kinds,
    "conversation_ids": conversation_ids, "packages_detected": packages_detected, "error_texts_scrubbed": error_texts_scrubbed, "filters_left": filters_left, "presets_all": presets_all, "cull_presets": cull_presets,
}
_FR = lambda v: f"octet_length(encode({v})) || ':' || {v} || chr(10)"
_SECTION = lambda name, label, n: f"""SELECT * FROM (WITH c AS (SELECT coalesce({label}, '') AS label, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM items GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS i FROM c)
    SELECT '{name}' AS section, label, n, bytes FROM k WHERE i <= {n} UNION ALL SELECT '{name}', '(other)', CAST(sum(n) AS BIGINT), CAST(sum(bytes) AS BIGINT) FROM k WHERE i > {n} HAVING count(*) > 0)"""  # noqa: E731
ORACLE = {
    "vocabulary": f"WITH {_TOK('documents', 'doc_id')}, d AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2 ORDER BY 2 DESC, 1 LIMIT 500) SELECT term, df, CAST(row_number() OVER (ORDER BY term) - 1 AS INT) AS number FROM d",
    "concept_clusters": _kmeans_sql(3),
    "sentence_units": rf"""WITH p AS (SELECT doc_id, trim({_PROSE('text')}) AS p FROM documents), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]["'')\]]*)(\s+|$)', '\1' || chr(1), 'g'), chr(1)), lambda u: trim(u)), lambda u: u <> '') AS a,
        list_filter(list_transform(string_split(p, chr(10)), lambda u: trim(u)), lambda u: u <> '') AS b FROM p), u AS (SELECT doc_id, CASE WHEN len(a) > 1 THEN a ELSE b END AS u FROM s)
        SELECT doc_id, CAST(len(u) AS INT) AS n, md5(coalesce(array_to_string(u, chr(10)), '')) AS units_md5 FROM u""",
    "tone_rescoring": """WITH s AS (SELECT doc_id, CASE WHEN toxic = 1 THEN md5(source) ELSE md5(text) END AS sha, CASE WHEN lang = 'fr' THEN 'old' ELSE 'm1' END AS m, CASE WHEN quality = 1 THEN 0.05 ELSE 0.1 END AS st, CASE WHEN lang <> 'es' THEN (n_chars % 100 - 50) / 100.0 END AS c FROM documents JOIN labels USING (doc_id)),
        j AS (SELECT d.doc_id AS item_id, st, c, coalesce(md5(text) = sha AND m = 'm1', false) AS same FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id)
        SELECT item_id, CASE WHEN NOT same THEN 'rescore' WHEN st = 0.05 THEN 'skip' ELSE 'relabel' END AS action, CASE WHEN same THEN CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' WHEN c IS NOT NULL THEN 'neutral' END END AS polarity FROM j""",
    "hashed_vectors": """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9ß-ÿ]+')) AS w FROM documents), n AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY 1, 2),
        f AS (SELECT doc_id, n, 'w:' || w AS t, 1.0::DOUBLE AS v FROM n UNION ALL SELECT doc_id, n, '3:' || substring(w, i, 3), 0.35::DOUBLE FROM (SELECT *, unnest(range(1, length(w) - 1)) AS i FROM n WHERE length(w) >= 3)),
        s AS (SELECT doc_id, CAST(('0x' || substring(md5(t), 1, 8))::BIGINT % 32 AS INT) AS bucket, n * v AS v FROM f UNION ALL SELECT doc_id, CAST(('0x' || substring(md5(t), 9, 8))::BIGINT % 32 AS INT), n * v * 0.5 FROM f),
        g AS (SELECT doc_id, bucket, sum(v) AS v FROM s GROUP BY 1, 2) SELECT g.doc_id, bucket, round(v / norm, 6) AS weight FROM g JOIN (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM g GROUP BY 1) q ON q.doc_id = g.doc_id""",
    "entity_job": f"""WITH d AS (SELECT doc_id, text, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)), f AS (SELECT doc_id, 'body' AS field, text AS t FROM d UNION ALL SELECT doc_id, 'subject', string_split(text, chr(10))[1] FROM d UNION ALL SELECT doc_id, 'from', source || '@mail.example.com' FROM d),
        h AS (SELECT doc_id, field, 'email' AS entity_type, unnest({_ENT('email')}) AS v FROM f UNION ALL SELECT doc_id, field, 'phone', unnest({_ENT('phone')}) FROM f UNION ALL SELECT doc_id, field, 'currency', unnest({_ENT('currency')}) FROM f
          UNION ALL SELECT doc_id, field, 'ssn', unnest(list_filter({_ENT('ssn')}, lambda x: NOT regexp_matches(x, '^(000|666|9..)-|-00-|-0000$'))) FROM f
          UNION ALL SELECT doc_id, field, 'card', unnest(list_filter({_ENT('card')}, lambda x: regexp_matches(x, '^[2-6]') AND list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substring(reverse(x), i + 1, 1) AS INT) > 4 THEN 2 * CAST(substring(reverse(x), i + 1, 1) AS INT) - 9 ELSE 2 * CAST(substring(reverse(x), i + 1, 1) AS INT) END ELSE CAST(substring(reverse(x), i + 1, 1) AS INT) END)) % 10 = 0)) FROM f)
        SELECT doc_id, field, entity_type, count(*) AS n FROM h GROUP BY 1, 2, 3""",
    "case_report": f"WITH {adapt.ORDER_ITEMS_SQL} " + " UNION ALL ".join([_SECTION("custodians", "custodian", 25), _SECTION("categories", "file_category", 5), _SECTION("status", "status", 10), _SECTION("roles", "role", 1)]),
    "email_hashes": f"""WITH m AS (SELECT *, CAST(conv_id * 86400 + turn * 60 AS VARCHAR) AS sent, trim(replace(replace(replace(replace(replace(CASE WHEN regexp_matches(text, '(?i)<(html|body|p|div|br)\\b') THEN NULL ELSE text END, chr(13) || chr(10), chr(10)), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), '')) AS b FROM conversations)
        SELECT conv_id, turn, sha256('docket-email-1' || chr(10) || {_FR("'m' || turn || '@x'")} || {_FR("'c ' || conv_id")} || {_FR("lower(role)")} || {_FR("'a@x' || chr(10) || 'b@x'")} || {_FR("''")} || {_FR("''")} || {_FR("sent")} || {_FR("''")} || {_FR("coalesce(b, '')")} || {_FR("'a.txt' || chr(9) || turn || chr(9) || md5(role)")}) AS logical_hash FROM m""",
    "children_suppressed": f"""WITH {adapt.ORDER_ITEMS_SQL}, c AS (SELECT o_orderkey AS k, min(o_orderkey) OVER (PARTITION BY o_custkey) AS g FROM orders), kid AS (SELECT item_id, parent_item_id, CASE WHEN file_category <> 'N' THEN file_category || size_bytes // 1000 END AS dg, upper(substring(path, 1, 6)) AS p, size_bytes // 20000 AS s FROM items WHERE role = 'attachment'),
        lost AS (SELECT kid.*, 'O' || g AS canon FROM kid JOIN c ON parent_item_id = 'O' || k AND k <> g), m AS (SELECT l.item_id, 1 AS r, x.p, x.item_id AS twin FROM lost l JOIN kid x ON x.parent_item_id = l.canon AND x.dg = l.dg UNION ALL SELECT l.item_id, 2, x.p, x.item_id FROM lost l JOIN kid x ON x.parent_item_id = l.canon AND lower(x.p) = lower(l.p) AND x.s = l.s),
        b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY r, p, twin) AS i FROM m) SELECT l.item_id, 'family' AS dedup_tier, b.twin FROM lost l LEFT JOIN b ON b.item_id = l.item_id AND i = 1""",
    "hash_list_marked": "SELECT doc_id, md5(coalesce(text, '')) IN (SELECT md5(text) FROM documents WHERE lang = 'fr' AND text IS NOT NULL) AS in_hash_list FROM documents",
    "threads_inherited": f"WITH {adapt.ORDER_ITEMS_SQL} SELECT k.item_id, p.custodian AS thread_id, 'index' AS thread_method FROM items k JOIN items p ON p.item_id = k.parent_item_id WHERE k.role = 'attachment' AND p.role = 'parent'",
    "header_references": "SELECT conv_id, turn, CASE WHEN conv_id = turn THEN m ELSE m || ',' || n END AS refs FROM (SELECT conv_id, turn, 'm' || conv_id || '@x.example' AS m, 'm' || turn || '@x.example' AS n FROM conversations)",
    "participant_kinds": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'smtp' WHEN 1 THEN 'x500' WHEN 2 THEN 'display' ELSE 'other' END AS kind,
        CASE c_custkey % 4 WHEN 0 THEN lower(c_name) || '@mail.example' WHEN 1 THEN '/o=org/cn=' || lower(c_name) WHEN 2 THEN lower(c_name) || ' (sales)' ELSE CAST(c_custkey AS VARCHAR) END AS key FROM customer""",
    "conversation_ids": "SELECT conv_id, turn, sha256(CASE WHEN conv_id % 3 = 0 THEN 'unknown' ELSE role END || chr(10) || 'general' || chr(10) || 'unknown' || chr(10) || conv_id) AS conversation_id FROM conversations",
    "packages_detected": """WITH f AS (SELECT split_part(url, '/', 3) AS folder, page_id % 9 AS n FROM pages), s AS (SELECT folder, max(CAST(n = 1 AS INT)) AS pst, max(CAST(n = 2 AS INT)) AS zip, max(CAST(n = 3 AS INT)) + max(CAST(n = 0 AS INT)) + max(CAST(n IN (1, 2) AS INT)) AS g FROM f GROUP BY 1)
        SELECT folder, CASE WHEN g >= 2 AND pst + zip > 0 THEN 'package' WHEN pst = 1 THEN 'mailbox' WHEN zip = 1 THEN 'archive' ELSE 'raw' END AS kind FROM s""",
    "error_texts_scrubbed": "SELECT page_id, 'cannot open …/p' || page_id || '.html and …/y.txt' AS message FROM pages",
    "filters_left": f"""WITH e AS (SELECT doc_id FROM documents WHERE regexp_matches(text, '{t.ENTITY_PATTERNS["email"]}') UNION SELECT doc_id FROM (SELECT doc_id, text AS t FROM documents) WHERE len(list_filter({_ENT('card')}, lambda x: regexp_matches(x, '^[2-6]') AND list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 1 THEN CASE WHEN CAST(substring(reverse(x), i + 1, 1) AS INT) > 4 THEN 2 * CAST(substring(reverse(x), i + 1, 1) AS INT) - 9 ELSE 2 * CAST(substring(reverse(x), i + 1, 1) AS INT) END ELSE CAST(substring(reverse(x), i + 1, 1) AS INT) END)) % 10 = 0)) > 0)
        SELECT 'has_text' AS filter, doc_id AS item_id FROM documents WHERE n_chars > 900 AND text IS NOT NULL UNION ALL SELECT 'has_entity', doc_id FROM documents WHERE lang IS NULL OR lang <> 'en' UNION ALL SELECT 'entity_type', doc_id FROM e UNION ALL SELECT 'participant_key', doc_id FROM documents WHERE contains(source || '@', 'src1@')
        UNION ALL SELECT 'participant_email', doc_id FROM documents WHERE source = 'src2' UNION ALL SELECT 'cluster_id', doc_id FROM documents WHERE lang <> 'de' AND n_chars % 5 IN (1, 3) UNION ALL SELECT 'cluster_set', doc_id FROM documents WHERE lang <> 'de' AND n_chars % 2 = 1
        UNION ALL SELECT 'has_cluster', doc_id FROM documents WHERE lang IS NULL OR lang <> 'en' UNION ALL SELECT 'needs_ocr', doc_id FROM documents WHERE lang IS NULL OR lang <> 'fr' UNION ALL SELECT 'stale', doc_id FROM documents WHERE lang = 'de' AND n_chars <= 2500 AND (n_chars > 900 OR n_chars <= 1500)""",
    "presets_all": f"WITH {adapt.CODES_SQL}, i AS (SELECT doc_id AS item_id, lang, n_chars FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS preset, count(*) AS n FROM i WHERE {w}" for n, w in _PRES.items()),
    "cull_presets": """SELECT 'unique_only' AS preset, doc_id AS item_id, CASE WHEN lang = 'fr' THEN 'culled' ELSE 'included' END AS cull_status, CASE WHEN lang = 'fr' THEN 'exact_duplicate' ELSE '' END AS cull_reasons FROM documents
        UNION ALL SELECT 'noise_light', doc_id, CASE WHEN lang IN ('fr', 'es') OR NOT n_chars > 500 THEN 'culled' ELSE 'included' END, array_to_string(list_filter([CASE WHEN lang = 'fr' THEN 'exact_duplicate' END, CASE WHEN lang = 'es' THEN 'category' END, CASE WHEN NOT n_chars > 500 THEN 'empty' END], lambda x: x IS NOT NULL), ',') FROM documents""",
}
