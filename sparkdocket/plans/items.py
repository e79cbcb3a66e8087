"""The item table and its satellites, from the generated test tables.

A deployment fills the same columns from its own sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Core columns of an item.
ITEM_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("item_id", "family_id", "parent_item_id", "role", "path", "custodian", "file_category", "mime_type", "status", "message_id", "subject", "logical_hash")]
    + [T.StructField("size_bytes", T.LongType())]
    + [T.StructField(n, T.TimestampType()) for n in ("imported_at", "sent_at", "received_at", "created_at", "modified_at")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(rows: DataFrame, per: int = 500_000) -> int:
    """How many partitions hold about ``per`` of the rows each."""
    return max(1, -(-rows.count() // per))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as top-level items.  Those not in English carry a message id of source and length."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("item_id"), F.lit(None).cast("long").alias("parent_item_id"), F.lit("parent").alias("role"),
        F.col("source").alias("path"), F.col("source").alias("custodian"), F.lit("document").alias("file_category"), F.col("lang").alias("language"),
        F.lit("extracted").alias("status"), F.col("n_chars").alias("size_bytes"), "text",
        F.when(F.col("lang") != "en", F.concat(F.lit("<"), F.col("source"), F.lit("-"), F.col("n_chars").cast("string"), F.lit("@Mail>"))).alias("message_id"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as parents and their lines as attachments, with string ids O<key> and L<key>-<line>-<part>-<supplier>."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    parent = F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))
    parents = o.select(
        parent.alias("item_id"), F.lit(None).cast("string").alias("parent_item_id"), parent.alias("family_id"), F.lit("parent").alias("role"),
        F.concat(F.lit("cust/"), F.col("o_custkey").cast("string")).alias("path"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("custodian"),
        F.lower(F.col("o_orderpriority")).alias("file_category"), F.when(F.col("o_orderstatus") == "P", "partial").when(F.col("o_orderstatus") == "F", "extracted").otherwise("error").alias("status"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderdate").alias("sent_at"), F.lit(None).cast("timestamp").alias("received_at"),
    )
    owner = F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))
    children = li.select(
        F.concat(F.lit("L"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])).alias("item_id"), owner.alias("parent_item_id"),
        owner.alias("family_id"), F.lit("attachment").alias("role"), F.concat(F.lit("part/"), F.col("l_partkey").cast("string")).alias("path"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("custodian"), F.col("l_returnflag").alias("file_category"),
        F.when(F.col("l_linestatus") == "F", "extracted").otherwise("normalized").alias("status"),
        F.floor("l_extendedprice").cast("long").alias("size_bytes"), F.lit(None).cast("timestamp").alias("sent_at"), F.col("l_shipdate").alias("received_at"),
    )
    return parents.union(children)


ORDER_ITEMS_SQL = """
items AS (
  SELECT 'O' || o_orderkey AS item_id, NULL::VARCHAR AS parent_item_id, 'O' || o_orderkey AS family_id, 'parent' AS role,
         'cust/' || o_custkey AS path, 'C' || o_custkey AS custodian, lower(o_orderpriority) AS file_category,
         CASE o_orderstatus WHEN 'P' THEN 'partial' WHEN 'F' THEN 'extracted' ELSE 'error' END AS status,
         CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(o_orderdate AS TIMESTAMP) AS sent_at, NULL::TIMESTAMP AS received_at FROM orders
  UNION ALL
  SELECT 'L' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey, 'O' || l_orderkey, 'O' || l_orderkey, 'attachment', 'part/' || l_partkey, 'S' || l_suppkey,
         l_returnflag, CASE l_linestatus WHEN 'F' THEN 'extracted' ELSE 'normalized' END, CAST(floor(l_extendedprice) AS BIGINT),
         NULL, CAST(l_shipdate AS TIMESTAMP) FROM lineitem)
"""


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as review codes: ``item_id, code``; an unlabelled document has none."""
    lab = table(spark, sf_dir, "labels")
    return lab.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("quality") == 1, "responsive"), F.when(F.col("toxic") == 1, "privileged")))).alias("code")).select(
        F.col("doc_id").alias("item_id"), "code"
    )


CODES_SQL = """
codes AS (SELECT doc_id AS item_id, 'responsive' AS code FROM labels WHERE quality = 1
          UNION ALL SELECT doc_id, 'privileged' FROM labels WHERE toxic = 1)
"""


def participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mail: the customer writes; suppliers of lines get it as to, cc or bcc by return flag.

    Orders and lines are dealt by order, about as many to a task at any size, and stay so.
    """
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    n = pieces(li)
    o = o.select("o_orderkey", "o_custkey", "o_orderdate").repartition(n, "o_orderkey")
    li = li.select("l_orderkey", "l_suppkey", "l_returnflag").repartition(n, "l_orderkey")
    mail = lambda prefix, c, dom: F.concat(F.lit(prefix), c.cast("string"), F.lit(dom))
    at = F.col("o_orderdate").alias("item_at")
    senders = o.select(F.col("o_orderkey").alias("item_id"), mail("c", F.col("o_custkey"), "@buyers.example").alias("person"), F.lit("from").alias("role"), at)
    kind = F.when(F.col("l_returnflag") == "A", "cc").when(F.col("l_returnflag") == "R", "bcc").otherwise("to")
    # A supplier whose key a customer shares modulo 7 writes to itself.
    who = F.when(F.col("l_suppkey") % 7 == F.col("o_custkey") % 7, mail("c", F.col("o_custkey"), "@buyers.example")).otherwise(mail("s", F.col("l_suppkey"), "@sellers.example"))
    got = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("item_id"), who.alias("person"), kind.alias("role"), at)
    return senders.union(got.distinct())


PARTICIPANTS_SQL = """
participants AS (
  SELECT o_orderkey AS item_id, 'c' || o_custkey || '@buyers.example' AS person, 'from' AS role, o_orderdate AS item_at FROM orders
  UNION ALL
  SELECT DISTINCT o_orderkey, CASE WHEN l_suppkey % 7 = o_custkey % 7 THEN 'c' || o_custkey || '@buyers.example' ELSE 's' || l_suppkey || '@sellers.example' END,
         CASE l_returnflag WHEN 'A' THEN 'cc' WHEN 'R' THEN 'bcc' ELSE 'to' END, o_orderdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""
