"""Operators against direct Python versions, and their edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdocket.functions import norm
from sparkdocket.operators import concepts, cull, dedupe, gap, graph, neardup, qc, rollups, text
from sparkdocket.operators.filterspec import FilterError, apply_filter
from sparkdocket.operators.graph import connected_components
from sparkdocket.plans import items as adapt
from sparkdocket.plans.numbering import number_rows


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2050)] + [(5, None), (7, 7)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_round_of_components_reads_the_edges_few_times(spark):
    """What the driver plans grows with the leaves of the plan (there were twelve), several times a round."""
    edges = spark.createDataFrame([(2, 1), (3, 2)], "u long, v long")
    leaves = graph._small_star(graph._large_star(edges))._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves <= 4


def test_scan_replay(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"ABCDEFGHIJ"])) for k in range(120)]
    first1, first2, want = {}, {}, []
    for pos, a, b in rows:
        if a is not None and a in first1:
            want.append((pos, "duplicate", "key1", first1[a]))
        elif b is not None and b in first2:
            want.append((pos, "duplicate", "key2", first2[b]))
        else:
            want.append((pos, "unique", "none", pos))
            if a is not None:
                first1[a] = pos
            if b is not None:
                first2[b] = pos
    keyed = spark.createDataFrame([(p, a, b) for p, a, b in rows if a is not None or b is not None], "pos long, a string, b string")
    got = sorted((r.pos, r.role, r.tier, r.original) for r in dedupe.replay_scan(keyed, "a", "b", "pos").collect())
    both_null = {p for p, a, b in rows if a is None and b is None}
    assert got == [w for w in want if w[0] not in both_null]


def test_dedupe_with_seeds(spark):
    cols = "item_id long, role string, status string, path string, message_id string, logical_hash string"
    items = spark.createDataFrame([(3, "parent", "extracted", "b", "<X@a>", "h1"), (4, None, "partial", "a", None, "h1"), (5, "attachment", "extracted", "a", None, "h9"), (6, "parent", "error", "a", "x@a", "h1"), (7, "parent", "extracted", "z", None, None)], cols)
    seeds = spark.createDataFrame([(1, "parent", "extracted", "z", "x@A", "h0")], cols)
    plain = {r.item_id: (r.dedup_role, r.dedup_tier, r.group_id) for r in dedupe.dedupe_items(items).collect()}
    assert plain == {3: ("unique", "message_id", 3), 4: ("unique", "logical_hash", 4), 7: ("unique", "none", 7)}
    later = {r.item_id: (r.dedup_role, r.group_id, r.hash_conflict) for r in dedupe.dedupe_items(items, seeds=seeds).collect()}
    assert later[3] == ("duplicate", 1, True) and set(later) == {3, 4, 7}


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(7)
    got = {r.k: r.n for r in number_rows(df, [F.col("k")], "n").collect()}
    assert got == {k: k + 1 for k in range(1000)}


def _hash_shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join"), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_numbers_need_no_second_shuffle(spark):
    numbered = number_rows(spark.range(50).repartition(3), [F.col("id").desc()], "n")
    assert _hash_shuffles(numbered)[1] == 1  # that of the ranges' counts
    assert {r.id: r.n for r in numbered.collect()} == {k: 50 - k for k in range(50)}
    sums = number_rows(spark.range(50).repartition(3), [F.col("id")], "n", F.col("id"))
    assert {r.id: r.n for r in sums.collect()} == {k: k * (k + 1) // 2 for k in range(50)}


def test_whole_families(spark):
    rows = [(f"O{k}", None) for k in range(20) if k != 7] + [(f"L{k}-{n}", f"O{k}") for k in range(20) for n in range(k % 4)]
    items = spark.createDataFrame(rows, "item_id string, parent_item_id string")
    base = items.where("item_id IN ('O3', 'L5-0', 'L7-2', 'O8')")
    got = cull.whole_families(base, items)
    want = {r.item_id for r in cull.expand_both_ways(base, items).collect()}
    assert {r.item_id for r in got.collect()} == want and {"L3-1", "O5", "L7-0", "O8"} < want and "O6" not in want
    assert _hash_shuffles(got)[0] == 1


def test_minhash_estimates_jaccard():
    a, b = {f"s{k}" for k in range(1000)}, {f"s{k}" for k in range(200, 1200)}
    same = (neardup.signature(a) == neardup.signature(b)).mean()
    assert abs(same - len(a & b) / len(a | b)) < 0.15
    assert neardup.shingles("one two 日本語 three four five six seven 42")[0] == {"日本", "本語", "three four five six seven"}
    assert (neardup.signature({"x"}) == neardup.signature({"x"})).all() and isinstance(neardup.signature({"x"}), np.ndarray)


def test_filter_errors(spark):
    items = spark.createDataFrame([(1, "extracted")], "item_id long, status string")
    for spec in ({"version": 2}, {"version": 1, "scope": "x"}, {"version": 1, "more": 1}, {"version": 1, "conditions": [{"field": "subject", "op": "gte", "value": 1}]}, {"version": 1, "conditions": [{"field": "sent_at", "op": "gte", "value": "2020-01-01T00:00:00"}]}):
        with pytest.raises(FilterError):
            apply_filter(items, spec)


def test_normal_forms(spark):
    row = spark.createDataFrame([(" <<A@b>> ", "RE: Fw:  Hi  there", "a <x@y>; z ;;", "a/./b//c.txt", "../x", 125911584000000000)], "m string, s string, r string, p string, q string, f long").select(
        norm.message_id(F.col("m")), norm.thread_subject(F.col("s")), norm.recipients(F.col("r")), norm.safe_path(F.col("p")), norm.safe_path(F.col("q")), F.date_format(norm.filetime(F.col("f")), "yyyy-MM-dd"),
    ).first()
    assert list(row) == ["a@b", "hi there", ["x@y", "z"], "a/b/c.txt", None, "2000-01-01"]


def test_findings_among_relatives(spark):
    """Three levels, missing parents, and a selection as a table and as a condition, against sets."""
    rng = random.Random(4)
    rows = [(k, rng.choice([None, rng.randrange(k // 2, k + 1), 900]) if k > 3 else None, rng.random() < 0.2, rng.random() < 0.6) for k in range(300)]
    rows = [(k, None if p == k else p, w, c) for k, p, w, c in rows]
    items = spark.createDataFrame(rows, "item_id long, parent_item_id long, withheld boolean, picked boolean").selectExpr(
        "*", "'email' AS file_category", "'extracted' AS status", "1L AS size_bytes", "true AS has_native", "true AS has_text", "false AS needs_ocr", "0 AS redaction_count", "false AS redacted_ok"
    )
    chosen, held = {r[0] for r in rows if r[3]}, {r[0] for r in rows if r[2]}
    want = {("withheld", k) for k in chosen & held}
    want |= {("orphan_child", k) for k, p, _, c in rows if c and p is not None and p not in chosen}
    want |= {("incomplete_parent", p) for k, p, w, c in rows if p in chosen and not w and not c}
    want |= {("withheld_relative", k) for k, p, w, c in rows if c and not w and p in held} | {("withheld_relative", p) for k, p, w, _ in rows if w and p in chosen - held}
    by_table, by_condition = qc.findings(items, items.where("picked").select("item_id")), qc.findings(items, F.col("picked"))
    for found in (by_table, by_condition):
        assert sorted((r.rule, r.item_id) for r in found.collect()) == sorted(want)
    assert _hash_shuffles(by_condition)[0] == 1


def test_empty_inputs(spark):
    with pytest.raises(ValueError):
        rollups.date_coverage(spark.createDataFrame([], "at timestamp"), "2020-02-01", "2020-01-01", "week")
    sel = spark.createDataFrame([], "item_id string, parent_item_id string, file_category string, status string, size_bytes long, withheld boolean, has_native boolean, has_text boolean, needs_ocr boolean, redaction_count int, redacted_ok boolean")
    assert [r.rule for r in qc.findings(sel, sel).collect()] == ["empty_selection"]
    none = spark.createDataFrame([], "id long, k string")
    assert gap.match_cascade(none, none, ["k"]).count() == 0
    assert text.merge_ranges(spark.createDataFrame([(1, 5, 5), (1, 3, 4), (1, 4, 6), (1, 8, 9)], "key int, start int, end int"), "key").count() == 2


def test_chunks_reach_the_end_of_a_long_text(spark):
    from sparkdocket.operators.text import chunk_text

    df = spark.createDataFrame([(1, "ab" * 50_000)], "id int, text string")
    got = chunk_text(df, "id", "text").orderBy("ordinal").collect()
    assert len(got) == 147 and got[-1].end == 100_000 and {r.dropped for r in got} == {0}
    assert {r.dropped for r in chunk_text(df, "id", "text", most=48).collect()} == {99}


def test_replay_of_chains(spark, monkeypatch):
    """Rows linked in a chain, one unique row a round, settle in a bounded number of rounds; large groups go on in rounds."""
    import random

    from sparkdocket.operators import dedupe

    rng = random.Random(4)
    rows = [(k, f"a{k // 2}", f"b{(k + 1) // 2}") for k in range(60)] + [(100 + k, f"c{rng.randrange(9)}", None if rng.random() < 0.2 else f"d{rng.randrange(9)}") for k in range(60)] + [(500, None, None), (501, None, "b3"), (502, None, None)]
    used1, used2, want = {}, {}, {}
    for pos, a, b in sorted(rows):
        if a in used1:
            want[pos] = ("key1", used1[a])
        elif b in used2:
            want[pos] = ("key2", used2[b])
        else:
            want[pos] = ("none", pos)
            used1 |= {a: pos} if a is not None else {}
            used2 |= {b: pos} if b is not None else {}
    df = spark.createDataFrame(rows, "pos long, k1 string, k2 string")
    for rounds, most in ((2, 200_000), (3, 50)):
        monkeypatch.setattr(dedupe, "ROUNDS", rounds)
        monkeypatch.setattr(dedupe, "LOCAL_ROWS", most)
        got = {r.pos: (r.tier, r.original) for r in dedupe.replay_scan(df, "k1", "k2", "pos").collect() if r.pos not in (500, 502)}
        assert got == {k: v for k, v in want.items() if k not in (500, 502)}


def test_near_duplicate_groups(spark, monkeypatch):
    """Groups against pairwise comparison of the same signatures, with small and with large buckets."""
    import random

    import numpy as np

    from sparkdocket.operators import neardup

    rng = random.Random(2)
    base = [[f"w{rng.randrange(500)}" for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(12):
            w = list(b)
            w[rng.randrange(60)] = "edit"
            texts.append(" ".join(w))
    texts += [texts[0], "short", None, "", " ".join(f"z{k}" for k in range(40))]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    sigs = {}
    for k, t in enumerate(texts):
        p = neardup.prepared(t)
        found, n = neardup.shingles(p) if len(p) >= 80 else (set(), 0)
        if found:
            sigs[k] = (neardup.signature(found), n)
    root = {k: k for k in sigs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sigs:
        for b in sigs:
            x, y = sigs[a][0], sigs[b][0]
            banded = any((x[i : i + 8] == y[i : i + 8]).all() for i in range(0, 128, 8))
            if a < b and banded and (x == y).mean() >= 0.8:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    want = {}
    for k in range(len(texts)):
        if k not in sigs:
            want[k] = ("skipped", None)
            continue
        group = [m for m in sigs if find(m) == find(k)]
        pivot = min(group, key=lambda m: (-sigs[m][1], m))
        near = [m for m in group if (sigs[m][0] == sigs[pivot][0]).mean() >= 0.8]
        want[k] = ("unique", None) if k not in near or len(near) < 2 else ("pivot" if k == pivot else "member", pivot)
    for short in (24, 2):
        monkeypatch.setattr(neardup, "SHORT", short)
        got = {r.doc_id: (r.role, r.group_id) for r in neardup.near_duplicates(df).collect()}
        assert got == want
    assert any(v[0] == "member" for v in want.values()) and np.uint64(1)


def test_messages_around_many_anchors(spark):
    rows = [(c, p, f"{c}-{p}") for c in (1, 2) for p in range(50)]
    anchors = [(1, a) for a in range(0, 50, 3)] + [(2, 49), (3, 1)]
    got = {(r.conv_id, r.anchor, r.item_id, r.gap) for r in rollups.around(spark.createDataFrame(rows, "conv_id int, position int, item_id string"), spark.createDataFrame(anchors, "conv_id int, anchor int"), 4, 2).collect()}
    assert got == {(c, a, i, p - a) for c, p, i in rows for d, a in anchors if c == d and -4 <= p - a <= 2}


def test_marks_refuse_and_keyword_queries_check(spark):
    from sparkdocket.operators import keyword as kw
    from sparkdocket.operators import marks as mk

    codes = spark.createDataFrame([(1, "a"), (2, "b")], "item_id int, code string")
    ids = codes.select("item_id")
    with pytest.raises(ValueError):
        mk.apply_codes(codes, ids, ["a"], ["a"])
    with pytest.raises(ValueError):
        mk.apply_codes(codes, ids, ["a", "b"], [], {"g": ["a", "b"]})
    assert {tuple(r) for r in mk.apply_codes(codes, ids.where("item_id = 1"), ["b"], [], {"g": ["a", "b"]}).collect()} == {(1, "b"), (2, "b")}
    posts = kw.postings(spark.createDataFrame([(1, "Jo@Mail.example, the cat"), (2, "東京都 cat"), (3, None)], "item_id int, t string"), "item_id", {"body": F.col("t")})
    assert {(r.item_id, r.pos, r.term) for r in posts.collect()} == {(1, 0, "jo@mail.example"), (1, 1, "the"), (1, 2, "cat"), (2, 0, "東京"), (2, 1, "京都"), (2, 2, "cat")}
    for bad in ({}, {"none": ["x"]}, {"all": ["?"]}, {"all": ["x"], "or": ["y"]}, {"all": [{"text": "x", "fields": "y"}]}):
        with pytest.raises(ValueError):
            kw.matching(posts, "item_id", bad)
    assert [r.item_id for r in kw.matching(posts, "item_id", {"all": ["東京都"]}).collect()] == [2]
    assert [r.item_id for r in kw.search(posts, "item_id", {"all": [{"text": "the cat", "phrase": True}]}).collect()] == [1]


def test_prose_lines_drop_phrases_not_words(spark):
    from sparkdocket.operators.concepts import prose_lines

    text = "From: a@b\n  The report is confidential to some.  \r\n\nThis e-mail is STRICTLY CONFIDENTIAL.\n-----Original Message-----\nTo whom\nto: x\nAttachments: y\nbegin forwarded message:"
    got = spark.createDataFrame([(text,), (None,)], "t string").select(prose_lines(F.col("t")).alias("p")).collect()
    assert [r.p for r in got] == ["The report is confidential to some.\nTo whom", ""]


def test_sentence_units_keep_their_digits(spark):
    """A unit that begins or ends with its own number in the list loses no digit."""
    want = ["First one.", "1 is next.", "222 then 2!", "3?", "44.", "x 5."]
    got = spark.createDataFrame([(" ".join(want),)], "t string").select(concepts.sentence_units(F.col("t"), None)).first()[0]
    assert got == want


def test_participants_stay_dealt_by_item(spark, monkeypatch):
    """People are counted where their orders' lines are, over as many tasks as the lines need, whatever the session says."""
    assert [adapt.pieces(spark.range(n)) for n in (0, 500_000, 500_001)] == [1, 1, 2]
    monkeypatch.setattr(adapt, "pieces", lambda rows, per=0: 9)
    p = adapt.participants(spark, "/root/testdata/sf0.001")
    assert p.rdd.getNumPartitions() == 9
    plan = rollups.people_timeline(p, parts=7)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "hashpartitioning" in x and ("item_id" in x or "person" in x)]
    plain = lambda df: sorted(map(str, df.collect()))
    assert plain(rollups.people_timeline(p, parts=7)) == plain(rollups.people_timeline(p))
    assert rollups.people_edges(p, 7).rdd.getNumPartitions() == 7 and plain(rollups.people_edges(p, 7)) == plain(rollups.people_edges(p))


def test_hashed_vectors_shuffle_buckets_only(spark):
    """Odd texts against a direct version; repeated keys are one text; no word is shuffled."""
    import hashlib
    import math
    import re

    rows = [(1, "Hello hello wörld x"), (1, "more of it"), (2, None), (3, "?!"), (4, "z" * 500 + " a ab abc"), (5, "ÅÄ ÷ 一 Straße")]
    df = spark.createDataFrame(rows, "id int, text string")
    made = concepts.hashed_vectors(df, "id", "text")
    sums = {}
    for key, t in rows:
        for w in re.findall("[a-z0-9ß-ÿ]+", (t or "").lower()):
            for name, v in [("w:" + w, 1.0), *[("3:" + w[i : i + 3], 0.35) for i in range(len(w) - 2)]]:
                h = hashlib.md5(name.encode()).hexdigest()
                for b, x in ((int(h[:8], 16) % 32, v), (int(h[8:16], 16) % 32, v / 2)):
                    sums.setdefault(key, {}).setdefault(b, []).append(x)
    want = {}
    for key, own in sums.items():
        norm_ = math.sqrt(sum(math.fsum(x) ** 2 for x in own.values()))
        want |= {(key, b): math.fsum(x) / norm_ for b, x in own.items()}
    got = {(r.id, r.bucket): r.weight for r in made.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if re.search(r"Exchange hashpartitioning\(id#\d+, w#", x)]
