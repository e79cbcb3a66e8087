"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256; ``records`` holds the exact header block of
every record with the digest of its payload.  A record as WARC/1.1 prescribes it
is the header block, the payload (empty for a revisit) and two line ends; it is
put together again by joining the two tables on the digest.  Reading checks that
the stored bytes still have the digest that addresses them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocket.plans.staging import shared_dir

_EOL = "\r\n"


def base32_of_hex(sha1_hex: Column) -> Column:
    """Upper-case base32 of a 20-byte digest given in hex: four groups of 40 bits."""
    digits = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    # conv's digits and the base32 alphabet of RFC 4648.
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


@dataclass
class Archive:
    """Paths of an archive's two tables."""

    records: str
    payloads: str


def write_archive(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    uri_col: str = "url",
    payload_col: str = "html",
    date_col: str | None = None,
    date: str = "1970-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
) -> Archive:
    """Write one WARC record per row of ``pages``.

    Of the records whose payloads are equal and have ``min_revisit_bytes`` bytes
    or more, the one with the smallest id is a ``response`` and the others are
    ``revisit`` records of it; rows that repeat that smallest id are all
    responses, and a null id is never the smallest unless all are null (then all
    are responses).  Shorter payloads are always responses.  A null payload is
    empty, a null uri gives a record without a target.  The time of capture is that
    of ``date_col`` (a timestamp), or ``date`` where there is none.  Other columns
    are left out, and an empty table gives an empty archive.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    captured = F.lit(None).cast("string") if date_col is None else F.date_format(F.to_utc_timestamp(date_col, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(captured, F.lit(date)).alias("date"), payload.alias("payload")).select(
        "id", "uri", "date", "payload",
        F.sha2("payload", 256).alias("sha256"),
        base32_of_hex(F.sha1("payload")).alias("sha1"),
        F.octet_length("payload").cast("long").alias("bytes"),
    )
    firsts = base.groupBy(F.col("sha256").alias("digest")).agg(F.min("id").alias("first_id"))
    slim = base.drop("payload")
    again = (F.col("bytes") >= min_revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first_id"))
    kind = F.when(F.coalesce(again, F.lit(False)), "revisit").otherwise("response")
    http = F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}{_EOL}")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda field, value: F.concat(F.lit(field + ": "), value, F.lit(_EOL))
    revisit = F.col("kind") == "revisit"
    # A uri goes in percent-encoded where it has control characters, so that a header stays on its line.
    uri = F.regexp_replace(F.regexp_replace(F.regexp_replace("uri", "%", "%25"), "\r", "%0D"), "\n", "%0A")
    headers = F.concat(
        F.lit("WARC/1.1" + _EOL),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.col("date")),
        F.when(F.col("uri").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", uri)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(
            revisit,
            F.concat(
                line("WARC-Refers-To", name(F.col("first_id"))),
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit(_EOL), http,
    )
    records = (
        slim.join(firsts, F.col("sha256") == F.col("digest"))
        .withColumn("kind", kind)
        .select(F.col("id").alias("record_key"), headers.alias("header_block"), "sha256")
    )
    made = Archive(f"{path}/records", f"{path}/payloads")
    records.write.option("compression", "zstd").parquet(made.records)
    base.select("sha256", "payload").dropDuplicates(["sha256"]).write.option("compression", "zstd").parquet(made.payloads)
    return made


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """Reconstruct each record: its parsed fields, full payload and raw bytes.

    Revisits get the payload of the record they refer to.  ``intact`` is false
    where the stored bytes no longer have their digest, ``complete`` where the raw
    record is not as long as its header says.
    """
    payloads = spark.read.parquet(archive.payloads).select(
        F.col("sha256").alias("address"), "payload",
        (F.sha2("payload", 256) == F.col("sha256")).alias("strong_ok"),
        base32_of_hex(F.sha1("payload")).alias("found_sha1"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    field = lambda n: F.nullif(F.regexp_extract("header_block", rf"\n{n}: ([^\r]*)\r\n", 1), F.lit(""))
    key = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("null"))
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(field("WARC-Target-URI"), "%0A", "\n"), "%0D", "\r"), "%25", "%")
    joined = spark.read.parquet(archive.records).join(payloads, F.col("sha256") == F.col("address"), "left")
    kind = field("WARC-Type")
    body = F.when(kind == "response", F.col("payload")).otherwise(F.lit(b""))
    raw = F.concat(F.col("header_block").cast("binary"), body, F.lit(b"\r\n\r\n"))
    head = F.octet_length(F.substring_index("header_block", _EOL + _EOL, 1)) + 4
    return joined.select(
        "record_key", "header_block", kind.alias("record_type"), plain.alias("uri"), "payload", "payload_bytes",
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_digest"),
        key(field("WARC-Refers-To")).alias("refers_to"),
        raw.alias("raw_record"), F.coalesce(F.octet_length(raw) == head + field("Content-Length").cast("long") + 4, F.lit(False)).alias("complete"),
        (F.coalesce("strong_ok", F.lit(False)) & F.col("found_sha1").eqNullSafe(F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1))).alias("intact"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = write_archive(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    kind = pages.schema["page_id"].dataType
    return read_archive(spark, archive).where(F.assert_true(F.col("intact") & F.col("complete"), F.lit("a record is not as it was written")).isNull()).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


_B32 = " || ".join(
    f"translate(upper(to_base(CAST('0x' || substr(h, {1 + 10 * k}, 10) AS UBIGINT)::BIGINT, 32, 8)), "
    "'0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
    for k in range(4)
)
QUERIES = {"op5_warc": op5_warc}
ORACLE = {
    "op5_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, sha1(html) AS h, octet_length(encode(html)) AS n,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM q
""",
}
