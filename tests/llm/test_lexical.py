import math
import random
import re
from collections import Counter

import pyarrow as pa

from sparkdocket.llm.lexical import rank_documents, search_block

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LAST = 2**63 - 1


def terms(t):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) if t else []


def brute(docs, items, k):
    """Sorted lists of (item_id, rank, doc_id, score)."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    docs_n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in held:
            m = 75 + (25 * sum(c.values()) * docs_n) // total
            s = sum(r * math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, LAST if i is None else i, i))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(sorted(scores, key=lambda r: r[:2])[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def tables(spark, n=700):
    rng = random.Random(8)
    vocab = [f"{a}{b}" for a in ("Lo", "mi", "ß", "x9", "É", "tt") for b in ("ra", "no", "q", "Z", "7", "é")] + ["the"] * 20
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "-", "\x7f"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 20]))) for k in range(40)] + [(None, "mira"), (3, "Lora the"), (50, None), (51, " .,"), (52, "unheard"), (5, "minO the the")]
    items += [items[0], items[0]]
    docs = [(k, text(rng.choice([0, 1, 5, 40]))) for k in range(n)]
    docs += [(n + k, docs[7][1] + " MIRA miNo") for k in range(200)]  # one text of many rows: ties
    docs += [(None, "mira q"), (None, "mira q"), (4, docs[4][1]), (4, docs[4][1]), (9999, None), (9998, ""), (9997, "--"), (9996, text(20_000))]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item int, score string").repartition(6)
    return docs, items, d, spark.createDataFrame(items, "item_id int, text string")


def test_against_brute_force(spark):
    docs, items, d, b = tables(spark)
    assert rows(rank_documents(d, b)) == brute(docs, items, 20)
    # Many blocks of both sides, and fewer results than copies.
    assert rows(rank_documents(d, b, k=3, doc_entries=900, item_entries=60)) == brute(docs, items, 3)


def test_empty_tables(spark):
    _, _, d, b = tables(spark, 10)
    assert rank_documents(d.limit(0), b).collect() == []
    assert rank_documents(d, b.limit(0)).collect() == []


def test_batches_are_left_out():
    """Two hundred leaves of documents on other subjects: bounds exclude nearly all of them."""
    rng = random.Random(1)
    docs = [[b"w%d" % (64 * (k // 100) + rng.randrange(64)) for _ in range(30)] for k in range(6400)]
    items = [[b"w%d" % (64 * s + rng.randrange(64)) for _ in range(5)] for s in range(64)]
    table = lambda texts: {"terms": pa.array([sorted(set(t)) for t in texts], pa.list_(pa.binary()))}
    counts = pa.array([[t.count(x) for x in sorted(set(t))] for t in docs], pa.list_(pa.int64()))
    left = pa.table(table(docs) | {"counts": counts, "n": pa.array([30] * 6400), "id": pa.array(range(6400))})
    weights = pa.array([[5000] * len(set(t)) for t in items], pa.list_(pa.int64()))
    right = pa.table(table(items) | {"weights": weights, "item": pa.array(range(64)), "floor": pa.array([0] * 64), "floor_id": pa.array([-(2**63)] * 64)})
    found, batches = search_block(left, right, 5, 6400, 6400 * 30)
    got = {}
    for i, d, s in zip(*(found[c].to_pylist() for c in ("item", "id", "score")), strict=True):
        got.setdefault(i, []).append((-s, d))
    for i, item in enumerate(items):
        scores = sorted((-sum(5000 * ((10**9 * c) // (1000 * c + 12 * 100)) for t in set(item) if (c := docs[d].count(t))), d) for d in range(6400))
        assert got[i] == [s for s in scores if s[0] < 0][:5]
    assert batches < 64 // 8 * (6400 // 32 // 16) / 2
