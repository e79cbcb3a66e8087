import hashlib
import random

from pyspark.sql import functions as F

from sparkdocket.llm import exact_dedup
from sparkdocket.llm.exact_dedup import mark_copies


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    """Sorted rows; of rows that repeat the largest id of a group one is kept."""
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    out = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        turn = 0
        for i in ids:
            out.append((i, best, len(ids), i == best and turn == 0, hashlib.sha256(t.encode()).hexdigest()))
            turn += i == best
    return sorted(out, key=repr)


def odd_rows():
    rng = random.Random(5)
    texts = ["", None, "Abc", "aBC", "abc ", "Ünder", "ünder", "ÜNDER", "x" * 300_000, "X" * 300_000, "\u212a", "k", "K"]
    rows = [(k, rng.choice(texts)) for k in range(300)]
    rows += [(k, "one TEXT of a third of all rows") for k in range(300, 500)]
    return [*rows, (None, "abc"), (None, "none"), (None, "none"), (499, "one TEXT of a third of all rows"), (7, "twice"), (7, "Twice"), (8, "TWICE")]


def marked(df, **kw):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in mark_copies(df, **kw).collect()), key=repr)


def test_against_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, digest string, `group.size` int, kept string").repartition(7)
    want = brute(rows)
    assert marked(df) == want
    assert marked(df, salts=3) == want
    # Digests that texts share: the texts themselves decide.
    assert marked(df, digest=lambda t: F.length(t).cast("string")) == want
    assert marked(df, digest=lambda t: F.lit("all")) == want


def test_few_hot_texts(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (1, 2, 5):
        monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
        assert marked(df) == brute(rows)


def test_empty_table(spark):
    assert mark_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_plan_is_native(spark):
    plan = mark_copies(spark.createDataFrame(odd_rows(), "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
