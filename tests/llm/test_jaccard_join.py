import random

import pytest

from sparkdocket.llm.jaccard_join import boundary_by_cost, jaccard_components, keep_one_per_component, needed, pack, partner_sizes, prefix_size, subset_sizes, unpack


def brute(rows, k, percent):
    def sh(t):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).replace("\n", " ").replace("\t", " ").split(" ") if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    s = [sh(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s[i]), low.get(find(i))) for i, (d, _) in enumerate(rows)]


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40)) for _ in range(n)]
    rows = []
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 40, 90, 300]:
        base = text(n)
        rows.append(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(3)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
            if rng.random() < 0.3:
                w += text(rng.randrange(4))
            rows.append(rng.choice([" ", "\n", "  "]).join(w).upper() if rng.random() < 0.2 else " ".join(w))
    hub = text(60)
    for k in range(60):  # a long list: many variants of one text
        w = list(hub)
        w[k] = "edit"
        rows.append(" ".join(w))
    return [*enumerate(rows, 100), (5, None), (6, ""), (7, " \t\n"), (7, "q w e r t y"), (7, "q w e r t y"), (None, "q w e r t y"), (None, "lone text here now")]


@pytest.mark.parametrize(("k", "percent", "options"), [(4, 85, {}), (5, 80, {"short_list": 3, "block_rows": 16}), (3, 60, {"short_list": 1_000_000, "extra": 0})])
def test_against_brute_force(spark, k, percent, options):
    rows = corpus(k)
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "doc_id long, text string, n long, digest string").repartition(5)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=k, percent=percent, **options).collect()), key=key)
    assert got == sorted(brute(rows, k, percent), key=key)


@pytest.mark.parametrize("block_rows", [400, 4])
def test_what_pairs_connect_is_compared_as_a_group(spark, monkeypatch, block_rows):
    """Sets travel once a group; only pairs of groups beyond a block are checked one by one."""
    from sparkdocket.llm import jaccard_join

    sent, verified = [], jaccard_join._verified
    monkeypatch.setattr(jaccard_join, "_verified", lambda pairs, *rest: sent.append(pairs.count()) or verified(pairs, *rest))
    rows = [r for r in corpus(8) if r[0] is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, short_list=1_000_000, block_rows=block_rows).collect())
    assert got == sorted(brute(rows, 4, 85))
    assert bool(sent) == (block_rows == 4) and all(sent)


@pytest.mark.parametrize("most_words", [1 << 20, 1])
def test_rows_that_are_not_judged_are_not_joined(spark, most_words):
    from sparkdocket.llm.jaccard_join import _parted

    keyed = spark.range(5000).selectExpr("IF(id % 1000 = 7, NULL, id) AS _id", "CAST(CAST(id AS STRING) AS BINARY) AS _mark")
    judged = keyed.where("crc32(_mark) % 100 = 3").selectExpr("_id AS id", "_mark AS mark").union(keyed.where("_id IS NULL").toDF("id", "mark"))
    clear, hits = ([(r._id, bytes(r._mark)) for r in part.collect()] for part in _parted(keyed, judged, most_words))
    assert len(clear) + len(hits) == 5000 and {(r.id, bytes(r.mark)) for r in judged.collect()} <= set(hits)
    assert len(hits) < 150


def test_clusters_of_several_parts(spark, monkeypatch):
    """Texts of shared passages, all in one cluster: groups of near copies of many sizes, chains, and sets that link with few or none."""
    from sparkdocket.llm import jaccard_join

    rng = random.Random(12)
    passages = [[f"{c}{k}" for k in range(12)] for c in "abcdefghi"]
    rows = []
    for group in range(14):
        chosen = [w for p in rng.sample(passages, 5) for w in p]
        for _ in range(rng.choice([1, 1, 2, 5, 40, 90])):
            w = list(chosen)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"]) + str(group)
            rows.append(" ".join(w))
    chain = [w for p in passages for w in p]
    for k in range(80):  # each links with its neighbours alone
        rows.append(" ".join([*chain[: 108 - k], *[f"n{i}" for i in range(k)]]))
    rng.shuffle(rows)
    rows = [*enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = sorted(brute(rows, 4, 85))
    assert 10 < len({c for _, _, c in want}) < len(rows)
    for leaders in (1, 24):
        monkeypatch.setattr(jaccard_join, "LEADERS", leaders)
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df, k=4, percent=85, short_list=3, block_rows=8).collect())
        assert got == want


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "z")], "doc_id long, text string, source string")
    kept = keep_one_per_component(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert jaccard_components(df.limit(0)).count() == 0


def test_bounds():
    for percent in (60, 80, 85):
        for s in range(1, 40):
            for t in partner_sizes(s, percent):
                c = needed(s, t, percent)
                if c <= min(s, t):
                    assert c in subset_sizes(s, percent) and c in subset_sizes(t, percent)
                    assert prefix_size(s, percent) >= s - c + 1
    assert boundary_by_cost({}, 85) == 0 and boundary_by_cost({5: 1000, 300: 1000}, 85) >= 5
    import numpy as np

    keys = np.array([0, 1, 2**40, 2**48 - 1])
    assert (unpack(pack(keys)) == keys).all()


def test_one_of_each_group_by_row(spark):
    """An id may repeat: what goes is a row, never another document of the same id."""
    x, y, z = " ".join(f"x{k}" for k in range(30)), " ".join(f"y{k}" for k in range(30)), " ".join(f"z{k}" for k in range(12))
    rows = [(1, x), (5, x + " end"), (5, y), (6, y), (7, z), (7, z), (7, x), (None, z), (None, "only null"), (None, "only null"), (8, None), (8, None), (9, ""), (9, "")]
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "doc_id int, text string, id string, _mark int").repartition(3)
    kept = keep_one_per_component(df)
    assert kept.columns == df.columns
    got = sorted((str(r.doc_id), str(r.text), r.id, r._mark) for r in kept.collect())
    want = [(1, x), (5, y), (7, z), (None, "only null"), (8, None), (8, None), (9, ""), (9, "")]
    assert got == sorted((str(d), str(t), "own", 3) for d, t in want)
    assert keep_one_per_component(df.limit(0)).count() == 0


def test_few_texts_beside_the_listed_ones_are_joined(spark):
    """Of rows that are not listed the bits let 3 in 100 through (12 before), and others with another seed."""
    from sparkdocket.llm.jaccard_join import _parted

    keyed = spark.range(48_000).selectExpr("id AS _id", "unhex(md5(CAST(id AS STRING))) AS _mark")
    listed = keyed.where("_id % 6 = 0").selectExpr("_id AS id", "_mark AS mark")
    through = []
    for seed in (0, 1):
        clear, hits = _parted(keyed, listed, seed=seed)
        ids = {r._id for r in hits.select("_id").collect()}
        assert clear.count() + len(ids) == 48_000 and {r.id for r in listed.select("id").collect()} <= ids
        through.append({k for k in ids if k % 6})
    assert all(len(t) < 0.05 * 40_000 for t in through) and len(through[0] & through[1]) < 0.01 * 40_000


def test_sets_with_enough_rare_shingles_are_in_no_long_list(spark, monkeypatch):
    """Texts of common passages and some words of their own: what is not counted does not push them into clusters."""
    from sparkdocket.llm import jaccard_join

    found, clusters = [], jaccard_join._clusters
    monkeypatch.setattr(jaccard_join, "_clusters", lambda lists, *rest: found.append(lists.select("rid").distinct().count()) or clusters(lists, *rest))
    passages = [[f"{c}{k}" for k in range(12)] for c in "abcdef"]
    rows = []
    for k in range(200):
        rows.append((k, " ".join([*[w for p in passages for w in p], *[f"own{k}x{i}" for i in range(36)]])))
    rows.append((900, rows[5][1] + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == sorted(brute(rows, 4, 85)) and len({c for _, _, c in got}) == 200
    assert found[0] < 20  # of 201; all of them before


def test_sizes_that_link_are_of_neighbouring_classes():
    from sparkdocket.llm.jaccard_join import size_classes

    for percent in (60, 80, 85, 100):
        bounds = size_classes(percent, 5000)
        klass = lambda s: sum(b <= s for b in bounds)  # noqa: E731, B023
        for s in range(1, 900):
            assert 1 <= klass(s) <= klass(partner_sizes(s, percent)[-1]) <= klass(s) + 1
