"""Header chains, audit chains, fingerprints, pages with gaps, job candidates, reports."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from sparkdocket.operators import audit, jobs, marks, qc, thread
from sparkdocket.plans.staging import shared_dir, stage


def test_headers(spark):
    block = "Subject: x\r\nMessage-Id:\r\n <A@B>\r\nReferences: <<a@x>> junk <B@Y>\r\n\t<b@y> <> <c\r\n @z>\r\nThread-Index: AQ ID\r\n BA==\r\nIn-Reply-To: plain@id "
    rows = [(1, block), (2, "References: none here\nIn-Reply-To: see <Q@R> and <S@T>\nThread-Index: not base64!"), (3, None), (4, ""), (5, "X-References: <no@no>\nreferences:<yes@yes>")]
    got = {r.id: r for r in thread.thread_headers(spark.createDataFrame(rows, "id int, block string"), "id", "block").collect()}
    assert (got[1].mid, got[1].refs, got[1].in_reply_to, got[1].conv_index) == ("a@b", ["a@x", "b@y", "c @z"], "plain@id", "01020304")
    assert (got[2].refs, got[2].in_reply_to, got[2].conv_index, got[2].index_parent) == ([], "q@r", None, None)
    for k in (3, 4):
        assert (got[k].mid, got[k].refs, got[k].in_reply_to, got[k].conv_index) == (None, [], None, None)
    assert got[5].refs == ["yes@yes"]
    index = spark.createDataFrame([("0" * 44,), ("0" * 54,), ("0" * 64,), (None,)], "x string").select(F.length(thread.index_parent(F.col("x")))).collect()
    assert [r[0] for r in index] == [None, 44, 54, None]


def test_appended_chains(spark):
    """Many chains at once, one with most events; a change anywhere shows."""
    rows = [("hot" if k % 3 else f"c{k % 7}", k, None if k % 11 == 0 else f"a{k}") for k in range(400)]
    df = spark.createDataFrame(rows, "chain string, at int, action string").repartition(5)
    first = audit.append_events(df.where("at < 150"), None, "chain", "at", ["action", "at"]).cache()
    then = audit.append_events(df.where("at >= 150"), audit.chain_heads(first, "chain"), "chain", "at", ["action", "at"]).cache()
    whole = first.union(then)
    want, last = {}, {}
    for chain, at, action in rows:
        seq, prev = last.get(chain, (0, None))
        digest = hashlib.sha256("\n".join([prev or "", action or "", str(at)]).encode()).hexdigest()
        want[chain, seq + 1] = (at, prev, digest)
        last[chain] = (seq + 1, digest)
    assert {(r.chain, r.seq): (r.at, r.prev_hash, r.entry_hash) for r in whole.collect()} == want
    assert audit.verify_chains(whole, "chain", ["action", "at"]).where("NOT link_ok OR NOT hash_ok").isEmpty()
    changed = whole.withColumn("action", F.when(F.col("at") == 200, "forged").otherwise(F.col("action")))
    bad = audit.verify_chains(changed, "chain", ["action", "at"]).where("NOT link_ok OR NOT hash_ok").collect()
    assert [(r.link_ok, r.hash_ok) for r in bad] == [(True, False)]
    lost = audit.verify_chains(whole.where("at <> 200"), "chain", ["action", "at"]).where("NOT link_ok").collect()
    assert len(lost) == 1
    assert audit.append_events(df.limit(0), None, "chain", "at", ["at"]).count() == 0


def test_selection_fingerprints(spark):
    root = lambda ids, pack="": audit.selection_fingerprint(spark.createDataFrame([(i,) for i in ids], "id string"), "id", pack).first()
    ids = [f"item-{k}" for k in range(300)]
    whole = root(ids)
    assert whole["items"] == 300 and root([*reversed(ids), ids[0], None])[:] == whole[:]
    roots = {whole.root, root(ids[1:]).root, root([*ids[1:], "item-x"]).root, root(ids, "strict").root, root([]).root}
    assert len(roots) == 5 and root([])["items"] == 0
    runs = spark.createDataFrame([(1, "2024-01-01", whole.root, "p", 0), (2, "2024-01-02", whole.root, "p", 3)], "run_id int, finished_at string, root string, pack string, errors long")
    mine = audit.selection_fingerprint(spark.createDataFrame([(i,) for i in ids], "id string"), "id")
    assert qc.gate_selection(runs, mine, "p").first()[:] == (2, False, "errors")
    assert qc.gate_selection(runs.where("run_id = 1"), mine, "p").first()[:] == (1, True, None)
    assert qc.gate_selection(runs.limit(0), mine, "p").first()[:] == (None, False, "no_run")


def test_pages_with_gaps(spark):
    """Positions 0, 1, 5, 6, 9: after 1 come 5 and 6; an anchor need not be a message's."""
    m = spark.createDataFrame([("a", p, f"a{p}") for p in (0, 1, 5, 6, 9)] + [("b", 2, "b2")], "conv_id string, position int, item_id string").repartition(3)
    anchors = spark.createDataFrame([("a", 1), ("a", 3), ("a", 9), ("b", 0), ("c", 0)], "conv_id string, anchor int")
    page = lambda forward: sorted((r.conv_id, r.anchor, r.nth, r.item_id) for r in marks.stream_pages(m, anchors, 2, forward).collect())
    assert page(True) == [("a", 1, 1, "a5"), ("a", 1, 2, "a6"), ("a", 3, 1, "a5"), ("a", 3, 2, "a6"), ("b", 0, 1, "b2")]
    assert page(False) == [("a", 1, 1, "a0"), ("a", 3, 1, "a1"), ("a", 3, 2, "a0"), ("a", 9, 1, "a6"), ("a", 9, 2, "a5")]


def test_reports_and_jobs(spark):
    rows = spark.createDataFrame([("r", "error", "i, \"1\""), ("r", "warn", None)], "rule string, severity string, item_id string")
    path = f"{shared_dir(spark)}/report-{uuid.uuid4().hex}"
    jobs.write_report(jobs.qc_report(rows, "all", "p", 2, "f"), path)
    back = {r.metric: r.value for r in spark.read.options(header=True, escape='"').csv(f"{path}/summary").collect()}
    assert back == {"pack": "p", "scope": "all", "candidate_count": "2", "error_count": "1", "warn_count": "1", "passed": "0", "selection_fingerprint": "f"}
    assert {r.item_id for r in spark.read.options(header=True, escape='"').csv(f"{path}/findings").collect()} == {'i, "1"', None}
    with pytest.raises(FileExistsError):
        jobs.write_report(jobs.qc_report(rows, "all", "p", 2, "f"), path)
    with pytest.raises(ValueError, match="no job"):
        jobs.candidates(rows, "nothing")


def test_appended_chains_where_heads_turn_small(spark):
    """A join with heads that is planned as a sorted one and broadcast at run time leaves each chain in one task."""
    rows = stage(spark.range(40000).selectExpr("id % 500 AS chain", "id AS at").repartition(8), "events").df
    first = stage(audit.append_events(rows.where("at < 20000"), None, "chain", "at", ["at"]), "audit").df
    told = {"spark.sql.autoBroadcastJoinThreshold": "500000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in told}
    for k, v in told.items():
        spark.conf.set(k, v)
    try:
        then = audit.append_events(rows.where("at >= 20000"), audit.chain_heads(first, "chain"), "chain", "at", ["at"])
        got = then.selectExpr("max(seq)", "count(DISTINCT chain, seq)", "count(*)").first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got[:] == (80, 20000, 20000)
