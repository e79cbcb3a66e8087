"""The written vector store."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdocket.operators import vectorstore
from sparkdocket.operators.vectorstore import StaleStore, StoreMissing, VectorStore
from sparkdocket.plans.staging import shared_dir


def fresh(spark, cells=9, model="m"):
    return VectorStore.create(spark, f"{shared_dir(spark)}/test-vectors-{uuid.uuid4().hex}", "id", model, cells)


def made(n, dims=6, seed=3, spread=0.3):
    """Vectors in seven directions, a third of them in one."""
    rng = np.random.default_rng(seed)
    way = rng.normal(size=(7, dims))
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 7, n))
    return way[own] + spread * rng.normal(size=(n, dims))


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, ordinal int, vector array<double>")


def brute(rows, queries, best, least=-1.0, may=None):
    unit = lambda x: np.array(x, float) / np.linalg.norm(x)
    out = set()
    for q, x in queries:
        items = {}
        for i, o, v in rows:
            if may is None or i in may:
                s = round(float(unit(x) @ unit(v)), 6)
                if s >= least:
                    items[i] = min(items.get(i, (9.0, 0)), (-s, o))
        out |= {(q, i, -s, o) for i, (s, o) in sorted(items.items(), key=lambda r: (r[1][0], r[0]))[:best]}
    return out


def found(df):
    return {(r.query_id, r.id, r.score, r.ordinal) for r in df.collect()}


def test_search_is_exact(spark, monkeypatch):
    v = made(400)
    rows = [(k // 3, k % 3, x.tolist()) for k, x in enumerate(v)] + [(900, 0, v[5].tolist()), (901, 0, v[5].tolist())]
    odd = [(500, 0, None), (501, 0, [0.0] * 6), (502, 0, [1.0, 2.0]), (503, 0, [None] * 6), (504, 0, [float("nan")] * 6), (505, 0, [float("inf")] * 6), (None, 0, v[0].tolist())]
    store = fresh(spark).upsert(table(spark, rows + odd).repartition(5), ordinal="ordinal")
    asked = [(k, v[k].tolist()) for k in range(0, 400, 10)]
    q = spark.createDataFrame([*asked, (7000, None), (7001, [0.0] * 6), (7002, [1.0])], "query_id long, vector array<double>")
    assert found(store.search(q, best=7)) == brute(rows, asked, 7)
    assert found(store.search(q, best=None, min_score=0.9)) == brute(rows, asked, None, 0.9)
    may = spark.createDataFrame([(k,) for k in range(40, 60)], "id long")
    assert found(store.search(q, best=30, min_score=0.2, eligible=may)) == brute(rows, asked, 30, 0.2, set(range(40, 60)))
    assert found(store.search(q, best=3, eligible=may.limit(0))) == set() and found(store.search(q.limit(0))) == set()
    # Many blocks of vectors and of queries give the same.
    monkeypatch.setattr(vectorstore, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(vectorstore, "QUERY_BLOCK", 3)
    assert found(store.search(q, best=7)) == brute(rows, asked, 7)


def test_cells_out_of_reach_are_not_searched(spark):
    v = made(2000, dims=8, spread=0.05)
    store = fresh(spark, cells=20).upsert(table(spark, [(k, 0, x.tolist()) for k, x in enumerate(v)]))
    pairs = []
    plain = store._pairs

    def counted(*args, **kw):
        made_pairs = plain(*args, **kw)
        pairs.append(made_pairs.count())
        return made_pairs

    store._pairs = counted
    q = spark.createDataFrame([(k, v[k].tolist()) for k in range(0, 2000, 40)], "query_id long, vector array<double>")
    assert found(store.search(q, best=5)) == brute([(k, 0, x) for k, x in enumerate(v)], [(k, v[k]) for k in range(0, 2000, 40)], 5)
    assert len(pairs) == 2 and sum(pairs) < 50 * 20 / 2


def test_upkeep_equals_a_rebuild(spark):
    v = made(60)
    rows = [(k // 2, k % 2, x.tolist()) for k, x in enumerate(v)]
    later = [(i, o, (x if i % 5 else [-y for y in x])) for i, o, x in rows if i != 7] + [(77, 0, v[0].tolist())]
    store = fresh(spark).upsert(table(spark, rows), ordinal="ordinal")
    assert store.upsert(table(spark, rows), ordinal="ordinal").documents().where(F.col("seg") > 1).count() == 0
    store = VectorStore.open(spark, store.path, "m").upsert(table(spark, later), ordinal="ordinal")
    store = store.delete(spark.createDataFrame([(3,)], "id long"))
    left = [r for r in later if r[0] != 3]
    asked = [(k, v[k].tolist()) for k in range(0, 60, 6)]
    q = spark.createDataFrame(asked, "query_id long, vector array<double>")
    for x in (store, VectorStore.open(spark, store.path, "m"), store.merge()):
        assert x.items == len({i for i, _, _ in left}) and found(x.search(q, best=9)) == brute(left, asked, 9)
    kept = store.merge().upsert(table(spark, [(3, 0, v[6].tolist())]), ordinal="ordinal", orphans=False)
    assert found(kept.search(q, best=9)) == brute([*left, (3, 0, v[6].tolist())], asked, 9)


def test_guards(spark):
    with pytest.raises(StoreMissing):
        VectorStore.open(spark, f"{shared_dir(spark)}/no-such-store", "m")
    with pytest.raises(StoreMissing):
        fresh(spark).search(spark.createDataFrame([], "query_id long, vector array<double>"))
    store = fresh(spark).upsert(table(spark, [(1, 0, [1.0, 2.0])]))
    with pytest.raises(StaleStore):
        VectorStore.open(spark, store.path, "another")
    with pytest.raises(ValueError):
        fresh(spark, cells=10**7).upsert(table(spark, [(1, 0, [1.0, 2.0])]))
    with pytest.raises(ValueError):
        fresh(spark).upsert(table(spark, [(1, 0, None)]))
