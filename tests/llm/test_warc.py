import base64
import hashlib

from sparkdocket.llm.warc import read_archive, write_archive


def test_round_trip(spark, tmp_path):
    rows = [(3, "http://a/%0A?x=1\n", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (5, "http://c/", ""), (4, "http://d/", "x" * 300_000), (None, "http://e/", "n"), (1, "http://b/", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "kept out") for r in rows], "page_id long, url string, html string, payload string")
    archive = write_archive(pages, f"file://{tmp_path}/a")
    got = read_archive(spark, archive).collect()
    assert len(got) == len(rows) and all(r.intact and r.complete for r in got)
    assert all("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n" in r.header_block for r in got)
    by = {}
    for r in got:
        by.setdefault(r.record_key, []).append(r)
    assert [r.record_type for r in by[1]] == ["response"] * 2  # ties of the smallest id
    assert by[3][0].record_type == "revisit" and by[3][0].refers_to == "1"
    assert by[2][0].record_type == "response" and by[5][0].refers_to == "2"
    assert by[3][0].uri == "http://a/%0A?x=1\n" and by[2][0].uri is None
    for i, _, html in rows:
        r = by[i][0]
        raw = (html or "").encode()
        assert bytes(r.payload) == raw and r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        head, _, body = bytes(r.raw_record).partition(b"\r\n\r\n")
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0].split()[1])
        assert len(body) == length + 4 and body.endswith(b"\r\n\r\n")
        assert (raw in body) if r.record_type == "response" else body.count(b"HTTP/1.1") == 1
    stored = spark.read.parquet(archive.payloads)
    assert stored.count() == stored.select("sha256").distinct().count() == 4


def test_capture_times(spark, tmp_path):
    from pyspark.sql import functions as F

    pages = spark.createDataFrame([(1, "u", "ab"), (2, "v", "cd")], "page_id long, url string, html string").withColumn("at", F.when(F.col("page_id") == 1, F.to_timestamp(F.lit("2024-02-03 04:05:06"))))
    got = {r.record_key: r.header_block for r in read_archive(spark, write_archive(pages, f"file://{tmp_path}/d", date_col="at")).collect()}
    assert "WARC-Date: 2024-02-03T04:05:06Z\r\n" in got[1] and "WARC-Date: 1970-01-01T00:00:00Z\r\n" in got[2]


def test_short_payloads_are_responses_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    kinds = [r.record_type for r in read_archive(spark, write_archive(pages, f"file://{tmp_path}/b", min_revisit_bytes=3)).collect()]
    assert kinds == ["response", "response"]
    assert read_archive(spark, write_archive(pages.limit(0), f"file://{tmp_path}/c")).count() == 0
