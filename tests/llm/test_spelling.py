import random
import re
import zlib
from collections import Counter

import pytest

from sparkdocket.llm.spelling import group_variants, near_words, pivots_of
from sparkdocket.plans.staging import Scratch


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(links[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in group_variants(df).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcéñ") for _ in range(rng.choice([6, 7, 8, 9]))) for _ in range(40)] + ["common×word", "ZeitungÄ", "aaaaaaaa", "aaaaaaa", "abababab"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.choice([0, 3, 60])):
            w = base[min(int(rng.expovariate(0.15)), len(base) - 1)]
            if rng.random() < 0.1:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + "Z" + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((k, " ".join(words)))
    rows += [(None, "nullable nullable"), (None, None), (1000, ""), (1001, "x" * 9_000 + " " + "x" * 8_999), (1002, "x" * 9_000 + "1" + "x" * 8_999), (3, rows[3][1]), (3, rows[3][1])]
    # Steps of ten in frequency, so that forms follow forms.
    rows += [(2000 + k, ("chainword " * 400 if k == 0 else "chainwore " * 8)) for k in range(6)] + [(3000, "chainvore chainvore")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    want = brute(rows)
    assert any(r[3] and r[5] != r[3] for r in want) and any(r[2] > 3 for r in want)
    assert got(df) == want


def test_hot_keys_are_dealt_into_parts(spark, monkeypatch):
    """Words that share nearly all bigrams: the parts find the same links."""
    import sparkdocket.llm.spelling as spelling

    words = sorted({f"qu{a}{b}{c}zwxv" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyzabcd"})
    df = spark.createDataFrame([(w, k + 2) for k, w in enumerate(words)], "word string, n long")
    scratch = Scratch()
    links = {(r.a, r.b, r.n_a, r.n_b) for r in near_words(df, scratch).collect()}
    n = {w: k + 2 for k, w in enumerate(words)}
    assert len(links) == 1000 * 27 // 2
    assert all(near(a, b) and (n[a], n[b]) == (x, y) for a, b, x, y in links)
    monkeypatch.setattr(spelling, "HOT_SHARE", 1)
    assert {(r.a, r.b, r.n_a, r.n_b) for r in near_words(df, scratch).collect()} == links
    scratch.clear()


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(4)
    for _ in range(200):
        at = sorted(rng.sample(range(12), rng.randrange(3, 7)))
        prefix = [(p, k) for k, p in enumerate(at)]
        cost = [rng.randrange(1, 9) for _ in prefix]
        best = min(cost[i] + cost[j] for i in range(len(at)) for j in range(i) if at[i] - at[j] >= 2)
        (p, i), (q, j) = pivots_of(prefix, cost)
        assert abs(p - q) >= 2 and cost[i] + cost[j] == best


def test_empty_and_short(spark):
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert got(spark.createDataFrame([(1, "a bc"), (2, None)], "doc_id long, text string")) == []
    with pytest.raises(ValueError):
        group_variants(spark.createDataFrame([(1, "a")], "doc_id long, text string"), least_length=3)
