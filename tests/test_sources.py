import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkdocket.sources import archives, chat, loadfiles
from sparkdocket.streaming.incremental import dedupe_stream


def test_load_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("﻿þControl Numberþ¶þSHA256þ¶þCustodianþ\nþD1þ¶þabþ¶þx®yþ\nþD2þ¶þþ¶þzþ\n", encoding="utf-8")
    df = loadfiles.read_dat(spark, f"file://{tmp_path}/a.dat")
    assert sorted(map(tuple, loadfiles.expected_docs(df).collect())) == [("D1", "ab", "x\ny"), ("D2", None, "z")]
    assert loadfiles.read_load_file(spark, f"file://{tmp_path}/a.dat").columns == df.columns
    (tmp_path / "b.csv").write_text('custodian,notes\nAnn,"a ""b"""\n ann ,\n')
    assert [tuple(r) for r in loadfiles.read_roster(spark, f"file://{tmp_path}/b.csv").collect()] == [("Ann", 'a "b"')]
    assert loadfiles.read_load_file(spark, f"file://{tmp_path}/b.csv").columns == ["custodian", "notes"]
    with pytest.raises(ValueError):
        loadfiles.expected_docs(loadfiles.read_csv(spark, f"file://{tmp_path}/b.csv").drop("custodian"))
    (tmp_path / "h.txt").write_text("# list\n" + "A" * 64 + " name\nzz\n")
    assert [r[0] for r in loadfiles.read_hash_list(spark, f"file://{tmp_path}/h.txt").collect()] == ["a" * 64]
    (tmp_path / "m.txt").write_text("d" * 32)
    with pytest.raises(ValueError, match="MD5"):
        loadfiles.read_hash_list(spark, f"file://{tmp_path}/m.txt")


def test_chat_and_calendar(spark):
    docs = [(1, '[{"id":"a","body":"<p>Hi</p>","from":"x","timestamp":"2024-01-02T03:04:05Z"},{"from":"nobody"}]'), (2, '{"team":"T","messages":[{"id":"b","content":"yo","channel":"C"}]}'), (3, "not json"), (4, None)]
    rows = chat.parse_chat_json(spark.createDataFrame(docs, "k int, j string"), "j", "k").orderBy("k").collect()
    assert [(r.k, r.message_id, r.body, r.team, r.channel) for r in rows] == [(1, "a", "Hi", None, None), (2, "b", "yo", "T", "C")]
    ics = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Long\r\n  name\\, x\r\nDTSTART:20240102T030405Z\r\nATTENDEE;CN=A:mailto:A@B.c\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART:20240102T030405\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;VALUE=DATE:20240103\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;TZID=Europe/Berlin:20240102T030405\r\nEND:VEVENT\r\nEND:VCALENDAR"
    e = chat.parse_ics(spark.createDataFrame([(1, ics)], "k int, t string"), "t", "k").orderBy("ordinal").collect()
    assert (e[0].subject, e[0].attendees, str(e[0].starts_at)) == ("Long name, x", ["a@b.c"], "2024-01-02 03:04:05")
    assert (e[1].starts_at, e[1].unresolved, e[2].all_day, str(e[3].starts_at)) == (None, True, True, "2024-01-02 02:04:05")


def test_archives(spark):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>a</w:t><w:tab/><w:t>b</w:t></w:p><w:p><w:t>c</w:t></w:p></w:d>')
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("x/y.zip", inner.getvalue())
        z.writestr("t.docx", inner.getvalue())
        z.writestr("../up", "no")
    df = spark.createDataFrame([("p.zip", outer.getvalue()), ("bad.zip", b"nope")], "path string, content binary")
    got = {(r.archive, r.path): (r.content, r.problem) for r in archives.expand_zip(df).collect()}
    assert set(got) == {("p.zip", "x/y.zip/word/document.xml"), ("p.zip", "t.docx"), ("p.zip", "../up"), ("bad.zip", "")}
    assert archives.office_text(bytes(got["p.zip", "t.docx"][0])) == "a\tb\nc" and got["p.zip", "../up"][1] == "unsafe path"


def test_stream(spark, tmp_path):
    schema = "item_id long, role string, status string, path string, message_id string, logical_hash string"
    for k, rows in enumerate([[(1, "parent", "extracted", "a", "<m>", "h")], [(2, "parent", "extracted", "a", "M", "h"), (3, "parent", "extracted", "a", None, "h")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        dedupe_stream(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    got = {r.item_id: (r.dedup_role, r.group_id) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {1: ("unique", 1), 2: ("duplicate", 1), 3: ("duplicate", 1)}


def test_stream_equals_batches(spark, tmp_path):
    """Many batches of random items, a batch that fails in its midst and runs again, late items: the roles of batch after batch."""
    import random

    from pyspark.sql import functions as F

    from sparkdocket.operators.dedupe import dedupe_items
    from sparkdocket.streaming.incremental import dedupe_roles

    rng = random.Random(9)
    schema = "item_id long, role string, status string, path string, message_id string, logical_hash string"
    pick = lambda n: None if rng.random() < 0.3 else f"{rng.randrange(n)}"
    batches = [[(b * 100 + k, rng.choice(["parent", "parent", None, "attachment"]), rng.choice(["extracted", "extracted", "error"]), rng.choice("abc"), pick(25), pick(25)) for k in range(30)] for b in range(4)]
    # Late: earlier ids and paths arrive last and stay duplicates.
    batches.append([(k - 500, "parent", "extracted", "A", f"{k}", f"{k}") for k in range(25)])
    want, seen = {}, None
    for rows in batches:
        df = spark.createDataFrame(rows, schema)
        got = dedupe_items(df, seeds=seen).collect()
        want |= {r.item_id: (r.dedup_role, r.dedup_tier, r.group_id, r.hash_conflict) for r in got}
        unique = df.where(F.col("item_id").isin([r.item_id for r in got if r.dedup_role == "unique"]))
        seen = unique if seen is None else seen.union(unique)
    broken = {"left": 1}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        roles = dedupe_roles(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        if n == 2:
            # After state and rows are made, some rows fail the batch.
            torn = roles.withColumn("item_id", F.when(F.col("item_id") % 7 == 0, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("item_id")))
            q = torn.writeStream.format("parquet").outputMode("append").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
            try:
                q.awaitTermination(120)
            except Exception as e:  # noqa: BLE001
                broken["left"] -= "lost" in str(e)
        dedupe_stream(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    assert broken["left"] == 0
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert len(rows) == len(want) and {r.item_id: (r.dedup_role, r.dedup_tier, r.group_id, r.hash_conflict) for r in rows} == want


def test_office_texts_and_entry_names(spark):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"><w:p><w:t>a</w:t></w:p></w:d>')
    empty = io.BytesIO()
    with zipfile.ZipFile(empty, "w") as z:
        z.writestr("word/document.xml", '<w:d xmlns:w="w"/>')
    df = spark.createDataFrame([("a", raw.getvalue()), ("b", b"no zip"), ("c", empty.getvalue()), ("d", None)], "path string, content binary")
    got = {r.path: (r.text, r.problem) for r in archives.office_texts(df).collect()}
    assert got["a"] == ("a", None) and got["c"] == (None, "no text") and all(got[k][0] is None and got[k][1].startswith("BadZipFile") for k in "bd")
    name = archives.decode_zip_name
    assert [name(None, True), name("é".encode(), False), name(b"\x82", False), name(b"\xe9", False), name(b"\xff", True)] == [None, "é", "é", "é", "\ufffd"]


def test_volumes_are_written_once(spark, tmp_path):
    """A task that fails and runs again, a second job, a job that fails: no file twice, no volume of a lost job."""
    from pyspark.sql import functions as F

    from sparkdocket.sources.volume import ROW, read_volumes, write_volumes

    names = ["ITEM_ID", "NATIVE_PATH", "TEXT_PATH"]
    dat = lambda vs: "¶".join(f"þ{v}þ" for v in vs)
    rows = []
    for k in range(25):
        v, c = f"VOL{k // 10 + 1:03d}", f"C{k:04d}"
        native, text = (bytes([k]) * k if k % 3 else None), (f"text {k}" if k % 2 else None)
        rows.append((v, k, c, "bin", native, text, dat([k, f"{v}/NATIVES/{c}.bin" if native is not None else "", f"{v}/TEXT/{c}.txt" if text else ""]), f"{k}"))
    df = spark.createDataFrame(rows, ROW).repartition(4)
    path = f"file://{tmp_path}/out"
    write_volumes(df, path, line="\ufeff" + dat(names), csv="ITEM_ID", readme="how to load")
    back = {int(r.ITEM_ID): (r.volume, bytes(r.native) if r.native is not None else None, bytes(r.text).decode() if r.text is not None else None) for r in read_volumes(spark, path).collect()}
    assert back == {r[1]: (r[0] if r[4] is not None or r[5] else None, r[4], r[5]) for r in rows}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["VOL001", "VOL002", "VOL003", "summary.json"]
    lines = (tmp_path / "out/VOL002/DATA/load.dat").read_text(encoding="utf-8-sig").splitlines()
    assert lines == [dat(names), *[r[6] for r in rows[10:20]]] and (tmp_path / "out/VOL002/DATA/load.csv").read_text().split() == ["ITEM_ID", *map(str, range(10, 20))]
    # The same again is refused unless it may overwrite, and then replaces.
    with pytest.raises(Exception, match="there already"):
        write_volumes(df, path, line="", csv="")
    write_volumes(df.where("seq < 5"), path, line=dat(names), csv="ITEM_ID", overwrite=True)
    assert len(list((tmp_path / "out/VOL001/TEXT").iterdir())) == 2
    # A job that fails leaves neither volumes nor attempts.
    torn = df.withColumn("line", F.when(F.col("seq") == 13, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        write_volumes(torn, f"file://{tmp_path}/torn", line="", csv="")
    left = list((tmp_path / "torn").iterdir()) if (tmp_path / "torn").exists() else []
    assert left == []


def test_csv_in_any_split(spark, tmp_path):
    """Records with line ends, quotes and blanks inside: the same rows whatever the byte ranges."""
    import csv
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["a", "é", ",", '"', "\n", "\r\n", " ", "7", ""]) for _ in range(rng.randrange(12)))
    rows = [[str(k), word(), word()] for k in range(150)]
    for name, part in (("a.csv", rows[:100]), ("b.csv", rows[100:])):
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            out = csv.writer(f)
            out.writerow(["\ufeffid" if name == "a.csv" else "id", "first", "second"])
            out.writerows(part)
            f.write("\r\n150,short\r\n" if name == "b.csv" else "")
    clean = lambda v: v.strip(" ") or None
    want = {r[0]: (clean(r[1]), clean(r[2])) for r in rows} | {"150": ("short", None)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "200", "37"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {r.id: (r.first, r.second) for r in loadfiles.read_csv(spark, f"file://{tmp_path}/*.csv").collect()}
            assert got == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for option in ({"max_rows": 100}, {"max_bytes": 100}):
        with pytest.raises(ValueError, match="more than"):
            loadfiles.read_csv(spark, f"file://{tmp_path}/*.csv", **option)
    assert loadfiles.read_csv(spark, f"file://{tmp_path}/*.csv", max_rows=151, max_bytes=10**6).count() == 151


@pytest.mark.parametrize("name,per", [("production_volumes", 1000), ("production_written", 100)])
def test_sql_names_the_thousandth_volume(spark, name, per):
    """Volume names grow beyond three digits in the query and in its SQL."""
    import duckdb

    from sparkdocket.operators.produce import volume_of
    from sparkdocket.queries.production import ORACLE

    part = re.search(r"'VOL' \|\| .*?(?= AS (?:v|volume)\b)", ORACLE[name]).group(0)
    seqs = [1, per, per + 1, 998 * per + 1, 999 * per, 999 * per + 1, 1000 * per + 1, 123456 * per]
    want = [r[0] for r in spark.createDataFrame([(n,) for n in seqs], "seq long").coalesce(1).select(volume_of(F.col("seq") - 1, per)).collect()]
    assert [duckdb.sql(f"SELECT {part} FROM (SELECT {n}::BIGINT AS seq)").fetchall()[0][0] for n in seqs] == want
    assert want[5] == "VOL1000"


def test_volumes_are_read_without_a_list_of_their_files(spark, tmp_path, monkeypatch):
    """The driver lists load files alone; a line's file that is missing or lies outside the volumes gives null; contents come in bounded batches."""
    from sparkdocket.sources import volume

    names = ["ITEM_ID", "NATIVE_PATH", "TEXT_PATH"]
    dat = lambda vs: "¶".join(f"þ{v}þ" for v in vs)
    rows = [("VOL001", k, f"C{k}", "bin", bytes([k]) * 3000, f"text {k}", dat([k, f"VOL001/NATIVES/C{k}.bin", f"VOL001/TEXT/C{k}.txt"]), "") for k in range(40)]
    rows += [("VOL002", 50 + k, f"C{50 + k}", "bin", None, None, dat([50 + k, named, ""]), "") for k, named in enumerate([r"VOL001\\\\NATIVES\\\\C7.bin", "VOL001//NATIVES/C7.bin", "VOL001/NATIVES/C99.bin", "VOL001/NATIVES/..", "VOL001/DATA/load.dat", "../secret"])]
    path = f"file://{tmp_path}/out"
    volume.write_volumes(spark.createDataFrame(rows, volume.ROW), path, line=dat(names), csv="")
    (tmp_path / "secret").write_text("no")
    monkeypatch.setattr(volume, "_READ_BYTES", 5000, raising=False)
    back = volume.read_volumes(spark, path)
    assert sorted(f.rsplit("/", 2)[-2:] for f in back.inputFiles()) == [["DATA", "load.dat"]] * 2
    got = {int(r.ITEM_ID): (r.native and bytes(r.native), r.text and bytes(r.text).decode()) for r in back.collect()}
    assert got == {r[1]: (r[4], r[5]) for r in rows[:40]} | {50 + k: (bytes([7]) * 3000 if k < 2 else None, None) for k in range(6)}
