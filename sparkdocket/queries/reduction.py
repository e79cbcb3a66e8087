"""Dedupe, scan replay, keep sets, threads, culling, promotion, numbering."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocket.functions import hashing
from sparkdocket.operators import dedupe
from sparkdocket.plans import items as adapt
from sparkdocket.plans.staging import shared_dir
from sparkdocket.streaming.incremental import dedupe_stream


def hashed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = adapt.document_items(spark, sf_dir)
    kids, none = F.array().cast("array<string>"), F.lit(None).cast("string")
    return d.withColumn("logical_hash", hashing.file_hash(F.col("file_category"), none, F.col("custodian"), none, F.col("text"), kids)).drop("text")


_BODY = "trim(replace(replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(8203), ''), chr(8204), ''), chr(8205), ''), chr(65279), ''))"
_FRAME = lambda e: f"octet_length(encode({e})) || ':' || {e} || chr(10)"
HASHED_SQL = f"""
b AS (SELECT doc_id, source, n_chars, lang, {_BODY} AS body FROM documents),
h AS (SELECT doc_id AS item_id, source AS path, n_chars AS size_bytes,
        CASE WHEN lang <> 'en' THEN lower(source || '-' || n_chars || '@Mail') END AS mid,
        sha256('docket-file-1' || chr(10) || {_FRAME("'document'")} || {_FRAME("''")} || {_FRAME("source")} || {_FRAME("''")} || {_FRAME("body")} || {_FRAME("''")}) AS lh FROM b)
"""
ROLES_SQL = f"""{HASHED_SQL},
m AS (SELECT *, first_value(item_id) OVER (PARTITION BY mid ORDER BY path NULLS FIRST, item_id) AS mf,
        first_value(lh) OVER (PARTITION BY mid ORDER BY path NULLS FIRST, item_id) AS fh FROM h WHERE mid IS NOT NULL
      UNION ALL SELECT *, NULL, NULL FROM h WHERE mid IS NULL),
c AS (SELECT lh, arg_min(item_id, struct_pack(p := path, i := item_id)) AS hf FROM m WHERE mid IS NULL OR item_id = mf GROUP BY lh),
roles AS (SELECT item_id, size_bytes, CASE WHEN mid IS NOT NULL THEN mf ELSE hf END AS group_id, CASE WHEN mid IS NOT NULL THEN 'message_id' ELSE 'logical_hash' END AS dedup_tier,
        mid IS NOT NULL AND item_id <> mf AND lh <> fh AS hash_conflict FROM m LEFT JOIN c USING (lh))
"""


def dedupe_exact(spark, sf_dir):
    return dedupe.dedupe_items(hashed_documents(spark, sf_dir))


def dedupe_streamed(spark, sf_dir):
    """Documents that arrive in three deliveries, by id modulo 3, as a stream: what an earlier delivery had comes first."""
    folder = f"{shared_dir(spark)}/deliveries-{uuid.uuid4().hex}"
    items = hashed_documents(spark, sf_dir).select("item_id", "role", "status", "path", "message_id", "logical_hash")
    for number in range(3):
        items.where(F.pmod("item_id", F.lit(3)) == number).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(items.schema).parquet(f"{folder}/in")
        dedupe_stream(arriving, f"{folder}/roles", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/roles").select("item_id", "dedup_role", "dedup_tier", "group_id", "hash_conflict")


def dedupe_summary(spark, sf_dir):
    """Counts and saved bytes by tier, from the roles."""
    d = hashed_documents(spark, sf_dir)
    roles = dedupe.dedupe_items(d).join(d.select("item_id", "size_bytes"), "item_id")
    dup = F.col("dedup_role") == "duplicate"
    return roles.groupBy("dedup_tier").agg(
        F.count_if(~dup).alias("n_unique"), F.count_if(dup).alias("n_duplicate"),
        F.coalesce(F.sum(F.when(dup, F.col("size_bytes"))), F.lit(0)).alias("saved_bytes"), F.count_if("hash_conflict").alias("n_conflicts"),
    )


def duplicate_listing(spark, sf_dir):
    """Each duplicate with its original's path and size."""
    d = hashed_documents(spark, sf_dir).select("item_id", "path", "size_bytes")
    dup = dedupe.dedupe_items(hashed_documents(spark, sf_dir)).where("dedup_role = 'duplicate'").select("item_id", "group_id")
    return dup.join(d, "item_id").join(d.select(F.col("item_id").alias("group_id"), F.col("path").alias("original_path"), F.col("size_bytes").alias("original_size")), "group_id").select(
        "item_id", "path", "size_bytes", F.col("group_id").alias("original_id"), "original_path", "original_size"
    )


def content_hash(spark, sf_dir):
    """Scan digest of documents: language and source as subject and sender."""
    d = adapt.table(spark, sf_dir, "documents")
    files = F.array(F.struct(F.col("source").alias("name"), F.col("n_chars").alias("size")))
    subject = F.concat(F.lit("RE: Fwd:"), F.col("lang"))
    return d.select("doc_id", hashing.scan_hash(subject, F.col("doc_id"), F.col("source"), F.col("text"), files).alias("content_hash"), hashing.mih(F.concat(F.lit("<"), F.col("source"), F.lit(">"))).alias("mih"))


def scan_replay(spark, sf_dir):
    """Events as a scan: user and type as first key, user and hour as second."""
    e = adapt.table(spark, sf_dir, "events")
    keyed = e.select("event_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("k1"), F.concat_ws("/", F.floor(F.col("value")).cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("k2"))
    return dedupe.replay_scan(keyed, "k1", "k2", "event_id")


def _members(spark, sf_dir):
    d = adapt.table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "lang", (F.col("n_chars") % 50).cast("string")).alias("group_id"), F.col("doc_id").alias("item_id"), F.col("source").alias("path"), F.col("n_chars").alias("size_bytes"), F.col("doc_id").alias("scan_order"), (F.col("source") == "src5").alias("degraded"))


def keep_set_first(spark, sf_dir):
    return dedupe.keep_set(_members(spark, sf_dir))


def keep_set_largest(spark, sf_dir):
    return dedupe.keep_set(_members(spark, sf_dir), "keep_largest")


def keep_set_prefer_path(spark, sf_dir):
    return dedupe.keep_set(_members(spark, sf_dir), "prefer_path", "SRC1")


def keep_set_decisions(spark, sf_dir):
    """A row for each member: the winner by size, others, and long ones that could not be written."""
    return dedupe.keep_decisions(_members(spark, sf_dir).withColumn("materialize_ok", F.col("size_bytes") < 5000), "keep_largest")


def keep_set_materialized(spark, sf_dir):
    """The best member that could be written; long ones could not."""
    return dedupe.keep_set(_members(spark, sf_dir).withColumn("materialize_ok", F.col("size_bytes") < 5000))


def _keep_sql(rank: str, where: str = "true") -> str:
    return f"""
SELECT lang || '/' || (n_chars % 50) AS group_id,
       arg_min(doc_id, struct_pack(b := CASE WHEN source = 'src5' THEN 1 ELSE 0 END, r := {rank}, p := source, i := doc_id)) AS winner,
       count(*) AS members, CAST(sum(n_chars) AS BIGINT) AS group_bytes FROM documents WHERE {where} GROUP BY 1"""


QUERIES = {
    "dedupe_exact": dedupe_exact, "dedupe_streamed": dedupe_streamed, "dedupe_summary": dedupe_summary, "duplicate_listing": duplicate_listing, "content_hash": content_hash, "scan_replay": scan_replay,
    "keep_set_first": keep_set_first, "keep_set_largest": keep_set_largest, "keep_set_prefer_path": keep_set_prefer_path, "keep_set_materialized": keep_set_materialized, "keep_set_decisions": keep_set_decisions,
}
ORACLE = {
    "dedupe_exact": f"WITH {ROLES_SQL} SELECT item_id, CASE WHEN item_id = group_id THEN 'unique' ELSE 'duplicate' END AS dedup_role, dedup_tier, group_id, hash_conflict FROM roles",
    "dedupe_streamed": f"""WITH {HASHED_SQL}, o AS (SELECT *, struct_pack(d := item_id % 3, p := path, i := item_id) AS o FROM h),
        m AS (SELECT *, first_value(item_id) OVER (PARTITION BY mid ORDER BY o) AS mf, first_value(lh) OVER (PARTITION BY mid ORDER BY o) AS fh FROM o WHERE mid IS NOT NULL UNION ALL SELECT *, NULL, NULL FROM o WHERE mid IS NULL),
        c AS (SELECT lh, arg_min(item_id, o) AS hf FROM m WHERE mid IS NULL OR item_id = mf GROUP BY lh),
        r AS (SELECT item_id, CASE WHEN mid IS NOT NULL THEN mf ELSE hf END AS group_id, CASE WHEN mid IS NOT NULL THEN 'message_id' ELSE 'logical_hash' END AS dedup_tier, mid IS NOT NULL AND item_id <> mf AND lh <> fh AS hash_conflict FROM m LEFT JOIN c USING (lh))
        SELECT item_id, CASE WHEN item_id = group_id THEN 'unique' ELSE 'duplicate' END AS dedup_role, dedup_tier, group_id, hash_conflict FROM r""",
    "dedupe_summary": f"""WITH {ROLES_SQL} SELECT dedup_tier, count(*) FILTER (item_id = group_id) AS n_unique, count(*) FILTER (item_id <> group_id) AS n_duplicate,
        CAST(coalesce(sum(size_bytes) FILTER (item_id <> group_id), 0) AS BIGINT) AS saved_bytes, count(*) FILTER (hash_conflict) AS n_conflicts FROM roles GROUP BY 1""",
    "duplicate_listing": f"""WITH {ROLES_SQL} SELECT r.item_id, a.source AS path, a.n_chars AS size_bytes, r.group_id AS original_id, b.source AS original_path, b.n_chars AS original_size
        FROM roles r JOIN documents a ON a.doc_id = r.item_id JOIN documents b ON b.doc_id = r.group_id WHERE r.item_id <> r.group_id""",
    "content_hash": r"""SELECT doc_id, sha256(encode(lower(lang) || '|' || doc_id || '|' || lower(trim(source)) || '|') || unhex(left(hex(encode(lower(regexp_replace(coalesce(text, ''), '[\t\n\x0B\f\r]', '', 'g')))), 8192))
        || encode('|' || lower(source) || ':' || n_chars || ';')) AS content_hash, md5(lower(source)) AS mih FROM documents""",
    "scan_replay": """WITH RECURSIVE k AS (SELECT event_id, user_id || '/' || event_type AS k1, CAST(floor(value) AS BIGINT) || '/' || strftime(ts, '%Y-%m-%d') AS k2 FROM events),
        o AS (SELECT min(event_id) AS pos, k1, k2 FROM k GROUP BY k1, k2),
        n AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM o),
        s(i, u) AS (SELECT 0::BIGINT, MAP {'': 0::BIGINT} UNION ALL
          SELECT s.i + 1, CASE WHEN u['1' || k1] IS NULL AND u['2' || k2] IS NULL THEN map_concat(u, MAP {'1' || k1: pos, '2' || k2: pos}) ELSE u END FROM s JOIN n ON n.i = s.i + 1),
        f AS (SELECT u FROM s ORDER BY i DESC LIMIT 1),
        j AS (SELECT event_id, f.u['1' || k1] AS u1, f.u['2' || k2] AS u2 FROM k, f)
        SELECT event_id, CASE WHEN u1 < event_id OR u2 < event_id THEN 'duplicate' ELSE 'unique' END AS role,
          CASE WHEN u1 < event_id THEN 'key1' WHEN u2 < event_id THEN 'key2' ELSE 'none' END AS tier,
          CASE WHEN u1 < event_id THEN u1 WHEN u2 < event_id THEN u2 ELSE event_id END AS original FROM j""",
    "keep_set_decisions": """WITH m AS (SELECT lang || '/' || n_chars % 50 AS group_id, doc_id AS item_id, source, n_chars, n_chars < 5000 AS ok FROM documents),
        w AS (SELECT group_id, arg_min(item_id, struct_pack(b := CASE WHEN source = 'src5' THEN 1 ELSE 0 END, r := -n_chars, p := source, i := item_id)) AS winner FROM m WHERE ok GROUP BY 1)
        SELECT m.group_id, item_id, CASE WHEN NOT ok THEN 'materialize_failed' WHEN item_id = winner THEN 'unique' ELSE 'duplicate' END AS role, winner FROM m LEFT JOIN w ON w.group_id = m.group_id""",
    "keep_set_first": _keep_sql("doc_id"),
    "keep_set_largest": _keep_sql("-n_chars"),
    "keep_set_prefer_path": _keep_sql("CASE WHEN contains(lower(source), 'src1') THEN 0 ELSE 1 END"),
    "keep_set_materialized": _keep_sql("doc_id", "n_chars < 5000"),
}
