"""Text analytics over documents, pages, embeddings and events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkdocket.functions import norm
from sparkdocket.operators import neardup
from sparkdocket.operators import text as t
from sparkdocket.operators.vectorstore import StoreMissing, VectorStore
from sparkdocket.plans import items as adapt
from sparkdocket.plans.staging import shared_dir


def _d(spark, sf_dir):
    return adapt.table(spark, sf_dir, "documents")


def entity_hits(spark, sf_dir):
    h = t.entity_hits(_d(spark, sf_dir), "doc_id", "text")
    return h.select(F.col("id").alias("doc_id"), "entity_type", "masked", "match_hash")


def entity_counts(spark, sf_dir):
    return t.entity_hits(_d(spark, sf_dir), "doc_id", "text").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_docs"), F.count_distinct("match_hash").alias("n_values"))


def entity_flags(spark, sf_dir):
    return t.entity_flags(t.entity_hits(_d(spark, sf_dir), "doc_id", "text")).withColumnRenamed("id", "doc_id")


def classify_pages(spark, sf_dir):
    p = adapt.table(spark, sf_dir, "pages")
    kind = t.classify_file(F.col("url"), F.lit(None).cast("string"), F.col("html").cast("binary"))
    return p.select("page_id", kind.alias("k")).select("page_id", "k.category", "k.method")


def html_strip(spark, sf_dir):
    return adapt.table(spark, sf_dir, "pages").select("page_id", F.md5(norm.strip_html(F.col("html"))).alias("text_md5"))


def chunk_documents(spark, sf_dir):
    """The reference's limit of 48 chunks a document, as the query's SQL has it; ``chunk_documents_whole`` has none."""
    c = t.chunk_text(_d(spark, sf_dir), "doc_id", "text", most=48)
    return c.select(F.col("id").alias("doc_id"), "ordinal", "start", "end", F.md5("chunk").alias("chunk_md5"), "dropped")


def chunk_documents_whole(spark, sf_dir):
    c = t.chunk_text(_d(spark, sf_dir), "doc_id", "text")
    return c.select(F.col("id").alias("doc_id"), "ordinal", "start", "end", F.md5("chunk").alias("chunk_md5"))


def tfidf_by_source(spark, sf_dir):
    """Term weights with each source as one document."""
    return t.tf_idf(t.tokens(_d(spark, sf_dir), ["source"], "text"), "source").select("source", "term", F.round("weight", 6).alias("weight"))


def cluster_labels(spark, sf_dir):
    """The eight telling terms of each language: a top-k report."""
    return t.group_labels(t.tokens(_d(spark, sf_dir), ["lang"], "text"), "lang").select("lang", "rank", "term", F.round("score", 6).alias("score"))


def bm25_search(spark, sf_dir):
    return t.bm25(t.tokens(_d(spark, sf_dir), ["doc_id"], "text"), "doc_id", ["the", "and", "er"])


#: Paths of the stores that this application has built, by application and tables.
_STORES: dict[tuple, str] = {}


def _vectors(spark, sf_dir):
    return adapt.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")


def _chunk_vectors(vectors):
    """Four vectors that follow each other as the chunks of one item."""
    return vectors.select((F.col("vec_id") - F.col("vec_id") % 4).alias("vec_id"), (F.col("vec_id") % 4).cast("int").alias("ordinal"), "vector")


def _new_store(spark):
    return VectorStore.create(spark, f"{shared_dir(spark)}/vector-store-{uuid.uuid4().hex}", "vec_id", "embeddings", cells=32)


def _store(spark, sf_dir):
    """The store of all embeddings; built once, then opened, and built again if its folder is gone."""
    name = (spark.sparkContext.applicationId, sf_dir)
    if name in _STORES:
        try:
            return VectorStore.open(spark, _STORES[name], "embeddings")
        except StoreMissing:
            del _STORES[name]
    store = _new_store(spark).upsert(_vectors(spark, sf_dir))
    _STORES[name] = store.path
    return store


def _asked(spark, sf_dir):
    """Every vector whose id is divisible by 100."""
    return _vectors(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vector")


def semantic_scores(spark, sf_dir):
    """All scores of at least 0.15, for each query."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), best=None, min_score=0.15).drop("ordinal")


def semantic_prefiltered(spark, sf_dir):
    """The 20 best of each query inside one label, at least 0.05: items are cut down before they are scored."""
    few = _vectors(spark, sf_dir).where("label = 3")
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), best=20, min_score=0.05, eligible=few).drop("ordinal")


def semantic_top(spark, sf_dir):
    """The 50 best of each query: a top-k report."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir)).drop("ordinal")


def semantic_all_scores(spark, sf_dir):
    """All scores of at least 0.05 inside one label, for each query."""
    return _store(spark, sf_dir).search(_asked(spark, sf_dir), best=None, min_score=0.05, eligible=_vectors(spark, sf_dir).where("label = 3")).drop("ordinal")


def semantic_chunks(spark, sf_dir):
    """The ten best items of each query, each by the best of its chunks."""
    store = _new_store(spark).upsert(_chunk_vectors(_vectors(spark, sf_dir)), ordinal="ordinal")
    return store.search(_asked(spark, sf_dir), best=10)


def _vectors_kept_up(spark, sf_dir):
    """A store that began with other vectors and was brought up to date: additions, changes, orphans, a deletion."""
    v = _vectors(spark, sf_dir)
    then = v.where("vec_id % 3 <> 0").withColumn("vector", F.when(F.col("vec_id") % 7 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    strange = v.where("vec_id % 5 = 0").withColumn("vec_id", -1 - F.col("vec_id"))
    store = _new_store(spark).upsert(then.unionByName(strange)).upsert(v)
    return store.delete(v.where("vec_id % 11 = 1").select("vec_id"))


def vectors_kept_up(spark, sf_dir):
    """A search over segments and tombstones."""
    return _vectors_kept_up(spark, sf_dir).search(_asked(spark, sf_dir), best=15).drop("ordinal")


def vectors_merged(spark, sf_dir):
    """The same over one merged segment."""
    return _vectors_kept_up(spark, sf_dir).merge().search(_asked(spark, sf_dir), best=15).drop("ordinal")


def sentiment_aggregate(spark, sf_dir):
    """Event values, scaled to [-1, 1], as unit scores of users."""
    e = adapt.table(spark, sf_dir, "events")
    score = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 100.0 - 0.5)), 3)
    return t.tone_of_units(e.select("user_id", "event_id", score.alias("score")), "user_id", "score", "event_id")


def _ranges(spark, sf_dir):
    li = adapt.table(spark, sf_dir, "lineitem")
    start = (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("int")).cast("int")
    return li.select(F.col("l_orderkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 9).cast("int").alias("end"))


def redact_merge(spark, sf_dir):
    return t.merge_ranges(_ranges(spark, sf_dir), "key")


def redact_text(spark, sf_dir):
    d = _d(spark, sf_dir).select(F.col("doc_id").alias("key"), "text")
    return t.redact(d, t.merge_ranges(_ranges(spark, sf_dir), "key"), "key", "text").select(F.col("key").alias("doc_id"), F.md5("redacted").alias("redacted_md5"))


def citation_verify(spark, sf_dir):
    """A document's third to sixth words as a quotation of it."""
    quote = F.array_join(F.slice(F.split("text", " "), 3, 4), "  ")
    d = _d(spark, sf_dir).where("text IS NOT NULL").select("doc_id", t.quote_occurrences(F.col("text"), quote).alias("n"))
    return d.select("doc_id", "n", (F.col("n") == 1).alias("verified"))


def dat_encode(spark, sf_dir):
    o = adapt.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", t.dat_line([F.col("o_orderkey"), F.col("o_orderstatus"), F.concat(F.col("o_orderpriority"), F.lit("\r\n"), F.col("o_custkey").cast("string")), F.lit(None)]).alias("line"))


def near_dup_minhash(spark, sf_dir):
    return neardup.near_duplicates(_d(spark, sf_dir))


def bytes_labels(spark, sf_dir):
    return _d(spark, sf_dir).select("doc_id", norm.bytes_label(F.col("n_chars") * 977).alias("label"))


_PAT = t.ENTITY_PATTERNS
_TOK = r"list_filter(regexp_extract_all(lower(text), '[a-z0-9\x{00df}-\x{00ff}]{2,}'), lambda w: NOT regexp_full_match(w, '[0-9]+'))"
_LUHN = "(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(v[len(v) - i + 1] AS INT) WHEN CAST(v[len(v) - i + 1] AS INT) > 4 THEN 2 * CAST(v[len(v) - i + 1] AS INT) - 9 ELSE 2 * CAST(v[len(v) - i + 1] AS INT) END)) % 10) = 0"
_HITS = f"""WITH r AS ({" UNION ALL ".join(f"SELECT doc_id, '{k}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS v FROM documents" for k, p in _PAT.items())}),
  h AS (SELECT doc_id, entity_type, v, CASE WHEN entity_type = 'email' THEN v[1] || '***@' || split_part(v, '@', -1) WHEN entity_type = 'currency' THEN '$***' ELSE '***' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4) END AS masked,
    sha256(CASE WHEN entity_type = 'email' THEN lower(v) ELSE regexp_replace(v, '[^0-9.]', '', 'g') END) AS match_hash FROM r
    WHERE CASE entity_type WHEN 'card' THEN regexp_matches(v, '^[2-6]') AND {_LUHN} WHEN 'ssn' THEN NOT regexp_matches(v, '^(000|666|9..)-|-00-|-0000$') ELSE true END)"""
_MERGED = """x AS (SELECT DISTINCT l_orderkey AS key, l_linenumber * 20 + CAST(l_quantity AS INT) AS s, l_linenumber * 20 + CAST(l_quantity AS INT) + CAST(l_quantity AS INT) % 9 AS e FROM lineitem),
  y AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x WHERE e > s),
  z AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y),
  m AS (SELECT key, min(s) AS s, max(e) AS e FROM z GROUP BY key, island)"""
QUERIES = {
    "entity_hits": entity_hits, "entity_counts": entity_counts, "entity_flags": entity_flags, "classify_pages": classify_pages, "html_strip": html_strip, "chunk_documents": chunk_documents, "chunk_documents_whole": chunk_documents_whole,
    "tfidf_by_source": tfidf_by_source, "cluster_labels": cluster_labels, "bm25_search": bm25_search, "semantic_scores": semantic_scores, "semantic_prefiltered": semantic_prefiltered, "semantic_top": semantic_top, "semantic_all_scores": semantic_all_scores,
    "semantic_chunks": semantic_chunks, "vectors_kept_up": vectors_kept_up, "vectors_merged": vectors_merged,
    "sentiment_aggregate": sentiment_aggregate, "redact_merge": redact_merge, "redact_text": redact_text, "citation_verify": citation_verify, "dat_encode": dat_encode, "bytes_labels": bytes_labels, "near_dup_minhash": near_dup_minhash,
}
_PAIRS = """p AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)"""
ORACLE = {
    "semantic_top": f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 50",
    "semantic_all_scores": f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM p WHERE label = 3 AND score >= 0.05",
    "entity_hits": f"{_HITS} SELECT doc_id, entity_type, masked, match_hash FROM h",
    "entity_counts": f"{_HITS} SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS n_docs, count(DISTINCT match_hash) AS n_values FROM h GROUP BY 1",
    "entity_flags": f"{_HITS} SELECT doc_id, CAST(bit_or(CASE entity_type WHEN 'email' THEN 1 WHEN 'phone' THEN 2 WHEN 'ssn' THEN 4 WHEN 'card' THEN 8 ELSE 16 END) AS BIGINT) AS flags, count(*) AS n_hits FROM h GROUP BY 1",
    "classify_pages": r"""WITH x AS (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]{1,8})$', 1)) AS ext FROM pages)
        SELECT page_id, CASE WHEN ext IN ('html', 'htm') THEN 'web' ELSE 'other' END AS category, CASE WHEN ext IN ('html', 'htm') THEN 'extension' ELSE 'none' END AS method FROM x""",
    "html_strip": r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'gs'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS text_md5 FROM pages""",
    "chunk_documents": """WITH b AS (SELECT doc_id, text, CAST(greatest(1, ceil((length(text) - 120) / 680.0)) AS INT) AS chunks FROM documents WHERE length(text) > 0),
        r AS (SELECT *, unnest(range(0, least(chunks, 48))) AS ordinal FROM b)
        SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(ordinal * 680 AS INT) AS start, CAST(least(ordinal * 680 + 800, length(text)) AS INT) AS end, md5(substr(text, ordinal * 680 + 1, 800)) AS chunk_md5, greatest(chunks - 48, 0) AS dropped FROM r""",
    "chunk_documents_whole": """WITH b AS (SELECT doc_id, text, CAST(greatest(1, ceil((length(text) - 120) / 680.0)) AS INT) AS chunks FROM documents WHERE length(text) > 0),
        r AS (SELECT *, unnest(range(0, chunks)) AS ordinal FROM b)
        SELECT doc_id, CAST(ordinal AS INT) AS ordinal, CAST(ordinal * 680 AS INT) AS start, CAST(least(ordinal * 680 + 800, length(text)) AS INT) AS end, md5(substr(text, ordinal * 680 + 1, 800)) AS chunk_md5 FROM r""",
    "tfidf_by_source": f"""WITH t AS (SELECT source, unnest({_TOK}) AS term FROM documents), f AS (SELECT source, term, count(*) AS tf FROM t GROUP BY 1, 2), n AS (SELECT count(DISTINCT source) AS n FROM t),
        d AS (SELECT term, count(*) AS df FROM f GROUP BY 1), w AS (SELECT source, term, (1 + ln(tf)) * ln(1 + n / (1 + df)) AS w FROM f JOIN d USING (term), n WHERE df >= 2 AND df <= greatest(1, floor(0.9 * n))),
        s AS (SELECT source, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT source, term, round(w / norm, 6) AS weight FROM w JOIN s USING (source)""",
    "cluster_labels": f"""WITH t AS (SELECT lang, unnest({_TOK}) AS term FROM documents), f AS (SELECT lang, term, count(*) AS tf FROM t GROUP BY 1, 2), k AS (SELECT count(DISTINCT lang) AS k FROM t), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
        s AS (SELECT lang, term, round((1 + ln(tf)) * ln(1 + k / df), 9) AS score FROM f JOIN d USING (term), k), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, term) AS rank FROM s)
        SELECT lang, CAST(rank AS INT) AS rank, term, round(score, 6) AS score FROM r WHERE rank <= 8""",
    "bm25_search": f"""WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1), g AS (SELECT count(*) AS n, avg(len) AS mean FROM l),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN ('the', 'and', 'er') GROUP BY 1, 2), d AS (SELECT term, count(*) AS df FROM f GROUP BY 1)
        SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM f JOIN d USING (term) JOIN l USING (doc_id), g GROUP BY 1 HAVING count(*) = 3""",
    "semantic_scores": f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM p WHERE score >= 0.15",
    "semantic_prefiltered": f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM p WHERE label = 3 AND score >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20",
    "semantic_chunks": f"""WITH {_PAIRS}, c AS (SELECT query_id, vec_id - vec_id % 4 AS vec_id, CAST(vec_id % 4 AS INT) AS ordinal, score FROM p),
        b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY score DESC, ordinal) = 1)
        SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""",
    **{n: f"WITH {_PAIRS} SELECT query_id, vec_id, score FROM p WHERE vec_id % 11 <> 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 15" for n in ("vectors_kept_up", "vectors_merged")},
    "sentiment_aggregate": """WITH u AS (SELECT user_id, event_id, round(greatest(-1, least(1, value / 100.0 - 0.5)), 3) AS s FROM events),
        a AS (SELECT user_id, arg_max(s, struct_pack(a := abs(s), p := -event_id)) AS compound, min(s) AS low, max(s) AS high FROM u GROUP BY 1)
        SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS polarity FROM a""",
    "redact_merge": f"WITH {_MERGED} SELECT key, s AS start, e AS end FROM m",
    "redact_text": f"""WITH RECURSIVE {_MERGED}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s) AS i, lag(e, 1, 0) OVER (PARTITION BY key ORDER BY s) AS pe FROM m),
        j AS (SELECT doc_id, text, string_agg(substr(text, CAST(least(pe, length(text)) + 1 AS INT), CAST(least(s, length(text)) - least(pe, length(text)) AS INT)) || CASE WHEN least(e, length(text)) > least(s, length(text)) THEN '[REDACTED]' ELSE '' END, '' ORDER BY i) AS head, max(e) AS last
          FROM documents JOIN k ON key = doc_id GROUP BY doc_id, text)
        SELECT doc_id, md5(head || substr(text, CAST(last AS INT) + 1)) AS redacted_md5 FROM j UNION ALL SELECT doc_id, md5(text) FROM documents WHERE doc_id NOT IN (SELECT key FROM m)""",
    "citation_verify": r"""WITH q AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t, lower(trim(regexp_replace(array_to_string(string_split(text, ' ')[3:6], ' '), '\s+', ' ', 'g'))) AS q FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, CASE WHEN length(q) > 0 THEN CAST((length(t) - length(replace(t, q, ''))) // length(q) AS INT) ELSE 0 END AS n, t, q FROM q) SELECT doc_id, n, n = 1 AS verified FROM n""",
    "dat_encode": "SELECT o_orderkey, 'þ' || o_orderkey || 'þ¶þ' || o_orderstatus || 'þ¶þ' || o_orderpriority || '®' || o_custkey || 'þ¶þþ' AS line FROM orders",
    "bytes_labels": "WITH b AS (SELECT doc_id, n_chars * 977 AS b FROM documents) SELECT doc_id, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KB', round(b / 1024.0, 1)) WHEN b < 1073741824 THEN printf('%.2f MB', round(b / 1048576.0, 2)) ELSE printf('%.2f GB', round(b / 1073741824.0, 2)) END AS label FROM b",
}
