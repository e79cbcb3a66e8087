import numpy as np

import pytest

from sparkdocket.llm.embed_dedup import fit_spherical_kmeans, link_embeddings, spread


def brute(v):
    unit = v / np.abs(v).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    return hit


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    v = np.concatenate([base, base[:20] + 0.12 * rng.normal(size=(20, 16)), base[:10], np.repeat(base[:1], 90, 0) + 0.1 * rng.normal(size=(90, 16))])
    rows = [(int(i), [float(x) for x in r], 0, "n") for i, r in enumerate(v)]
    bad = [(900, None, 0, "n"), (901, [0.0] * 16, 0, "n"), (902, [float("nan")] * 16, 0, "n"), (903, [None] * 16, 0, "n"), (904, [], 0, "n"), (905, [float("inf")] + [1.0] * 15, 0, "n"), (906, [1.0, 2.0], 0, "n"), (None, [float("nan")], 0, "n")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, n_links int, component_id string")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(hit, label[None, :], len(v)).min(1))
        if (new == label).all():
            break
        label = new
    for options in ({}, {"cell_rows": 20, "block_rows": 16, "margin": 6.0}, {"cell_rows": 8, "block_rows": 7, "margin": 6.0, "max_cells": 3}):
        got = {r.vec_id: r for r in link_embeddings(df, **options).collect()}
        assert len(got) == len(rows) + len(bad)
        assert [got[i].n_links for i in range(len(v))] == hit.sum(1).tolist()
        assert [got[i].component_id for i in range(len(v))] == label.tolist()
        assert all(got[b[0]].n_links == 0 and got[b[0]].component_id == b[0] and got[b[0]].kept for b in bad)
        assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


def test_empty_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<float>"
    assert link_embeddings(spark.createDataFrame([], schema)).count() == 0
    assert [r.n_links for r in link_embeddings(spark.createDataFrame([(1, None)], schema)).collect()] == [0]
    none = link_embeddings(spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.01]), (None, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in none) == [("3", 1, "3", True), ("None", 0, "None", True), ("None", 1, "3", False)]
    twice = link_embeddings(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], schema)).collect()
    assert sorted((r.vec_id, r.n_links) for r in twice) == [(1, 1), (1, 1), (2, 0)]


def test_kmeans_centres_are_units():
    rows = np.random.default_rng(0).normal(size=(50, 4))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    assert np.allclose(np.linalg.norm(fit_spherical_kmeans(rows, 7), axis=1), 1)


def test_every_length_and_extreme_sizes(spark):
    """Lengths that few vectors have link as others do; neither huge nor tiny components lose a link."""
    rows = [(k, np.random.default_rng(k).normal(size=8).tolist()) for k in range(6)]
    rows += [(10, [1.0, 2.0, 3.0]), (11, [1.0, 2.0, 3.01]), (12, [1e200, 1e200]), (13, [2e200, 2e200]), (14, [5e-324, 0.0, 0.0, 0.0]), (15, [1.0, 0.0, 0.0, 0.0])]
    got = {r.vec_id: r for r in link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[k].n_links, got[k].component_id) for k in range(10, 16)] == [(1, 10), (1, 10), (1, 12), (1, 12), (1, 14), (1, 14)]


@pytest.mark.parametrize("decay", [0.0, 0.7, 1.2])
@pytest.mark.parametrize("levels", [{"cell_rows": 50}, {"cell_rows": 40, "max_cells": 8}])
def test_recall_at_the_production_margin(spark, decay, levels):
    """Pairs just above the threshold, many cells, vectors that spread evenly or along few directions."""
    rng = np.random.default_rng(5)
    scale = np.arange(1, 33) ** -decay
    base = rng.normal(size=(1500, 32)) * scale
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(1500, 32)) * scale
    off -= (off * base).sum(axis=1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.97, size=(1500, 1))
    v = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * off])
    hit = brute(v)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    got = {r.vec_id: r.n_links for r in link_embeddings(df, **levels).collect()}
    found = np.array([got[k] for k in range(len(v))])
    assert (found <= hit.sum(axis=1)).all() and found.sum() >= 0.95 * hit.sum()


def test_spread_counts_directions():
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(4000, 32))
    few = flat * (np.arange(32) < 4)
    one = np.zeros((1, 32))
    assert 25 < spread(flat, one) <= 32 and 3.5 < spread(few, one) <= 4
