import random
import re

import pytest

from sparkdocket.llm.decontaminate import WindowTable, drop_contaminated, find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if t else []


def brute(doc, items, window=10):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        iw = words(text)
        if item is None or not iw:
            continue
        n = min(window, len(iw))
        wins = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)}
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wins:
                found.add(str(item))
                hit.update(range(i, i + n))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["alpha", "Béta", "gamma", "d", "e5", "z"]
    text = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 25]))) for k in range(12)] + [(None, "alpha alpha"), (40, None), (41, ""), (0, text(14))]
    docs = [(k, text(rng.choice([0, 1, 5, 40, 400]))) for k in range(60)] + [(60, None), (61, ""), (61, "..."), (62, items[6][1] * 30), (62, items[6][1] * 30)]
    # n_words is a clashing column: it is replaced.
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id int, text string, n_words string, _row int")
    b = spark.createDataFrame(items, "item_id int, text string")
    for block_words in (1_000_000, 20):  # one block, and many passes
        got = find_contamination(d, b, block_words=block_words, keep=["doc_id", "_row"]).collect()
        want = sorted((i, *brute(t, items)) for i, t in docs)
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == want
        assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)
    kept = drop_contaminated(d, b)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t in docs if brute(t, items)[1] == 0)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words here")], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [(r.n_words, r.n_hit, list(r.item_ids)) for r in find_contamination(d, none).collect()] == [(3, 0, [])]
    assert find_contamination(d.limit(0), none).count() == 0


def test_tables_are_small_and_checked(spark):
    """Random words, the worst case: some 30 bytes a word, and no broadcast above the limit."""
    rng = random.Random(1)
    words = [b"%x" % rng.getrandbits(40) for _ in range(100_000)]
    table = WindowTable([("a", words)], 10)
    assert table.nbytes() < 12 << 20
    assert table.search(words[500:515]) == ([(0, 15)], {"a"}) and table.search(words[500:509]) == ([], set())
    d = spark.createDataFrame([(1, " ".join(str(k) for k in range(40))), (2, "x")], "doc_id int, text string")
    items = [(k, " ".join(str(x) for x in range(3 * k, 3 * k + 12))) for k in range(8)]
    got = find_contamination(d, spark.createDataFrame(items, "item_id int, text string"), table_bytes=3000, keep=["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in got) == [(1, *brute(" ".join(str(k) for k in range(40)), items)), (2, 1, 0, [])]
    with pytest.raises(ValueError):
        find_contamination(d, spark.createDataFrame(items, "item_id int, text string"), table_bytes=500)
