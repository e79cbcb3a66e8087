"""The written keyword index and its queries."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from sparkdocket.operators import keyword as kw
from sparkdocket.operators import kwindex, kwquery
from sparkdocket.operators.kwindex import KeywordIndex
from sparkdocket.operators.kwquery import InvalidQuery, holds, parse
from sparkdocket.plans.segments import StaleStore, StoreMissing
from sparkdocket.plans.staging import shared_dir

def fields():
    return {"subject": F.col("subject"), "body": F.col("body")}


def fresh(spark, **kw):
    return KeywordIndex.create(spark, f"{shared_dir(spark)}/test-index-{uuid.uuid4().hex}", "id", buckets=8, **kw)


def items(spark, rows):
    return spark.createDataFrame(rows, "id int, subject string, body string")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_trees():
    a, b, c = (("term", None, t) for t in "abc")
    assert parse("a b OR c") == ("or", (("and", (a, b)), c))
    assert parse("a AND (b OR NOT c)") == ("and", (a, ("or", (b, ("not", c)))))
    assert parse("-a +b") == ("and", (("not", a), b))
    assert parse("body:(a OR subject:b)") == ("or", (("term", "body", "a"), ("term", "subject", "b")))
    assert parse('body:"a b"~3') == ("phrase", "body", ("a", "b"), 3)
    assert parse("Foo-Bar") == ("phrase", None, ("foo", "bar"), 0)
    assert parse("一有的") == ("phrase", None, ("一有", "有的"), 0)
    assert parse("a@b.co") == ("term", None, "a@b.co")
    assert kwquery.scoring_terms(parse("a -(b OR NOT body:c)")) == {("", "a"), ("body", "c")}
    assert holds(parse("a OR NOT b"), lambda leaf: False) and not holds(parse("a OR b"), lambda leaf: False)


@pytest.mark.parametrize("text", ["", "  ", "(", ")", "a OR", "OR a", "AND", "a AND OR b", "NOT", "(a", "a)", "()", '""', "-", "...", "(" * 200 + "a" + ")" * 200])
def test_what_cannot_be_read_is_told(text):
    with pytest.raises(InvalidQuery):
        parse(text)


def test_random_queries_against_brute_force(spark):
    """Random trees as texts over random items, many leaves, all fields."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(9)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randrange(n)))
    rows = [(k, text(4), text(14)) for k in range(120)] + [(120, None, None), (121, "", "x@y.zz")]
    index = fresh(spark).upsert(items(spark, rows), fields())
    said = {i: {"subject": (s or "").split(), "body": (b or "").split()} for i, s, b in rows}

    def leaf(i, node):
        kind, field, terms = node[:3]
        for f, ws in said[i].items():
            if field not in (None, f):
                continue
            if kind == "term" and terms in ws:
                return True
            if kind == "phrase":
                for at in range(len(ws)):
                    spot = at if ws[at] == terms[0] else None
                    for t in terms[1:]:
                        spot = next((p for p in range(spot + 1, len(ws)) if ws[p] == t), None) if spot is not None else None
                    if spot is not None and spot - at - len(terms) + 1 <= node[3]:
                        return True
        return False

    def query(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            field = rng.choice(["", "", "body:", "subject:"])
            if rng.random() < 0.4:
                phrase = " ".join(rng.choice(words) for _ in range(rng.choice([2, 2, 3])))
                return f'{field}"{phrase}"' + rng.choice(["", "~1", "~4"])
            return field + rng.choice(words)
        if kind < 0.35:
            return f"NOT {query(depth - 1)}" if rng.random() < 0.5 else f"-({query(depth - 1)})"
        return "(" + rng.choice([" ", " AND ", " OR ", " OR "]).join(query(depth - 1) for _ in range(rng.choice([2, 3]))) + ")"

    for depth in (1, 2, 2, 3, 3, 5):
        q = query(depth)
        tree = parse(q)
        assert ids(index.matching(q)) == [i for i in sorted(said) if holds(tree, lambda n, i=i: leaf(i, n))], q


def test_upkeep_equals_a_rebuild(spark):
    one = [(1, "alpha", "old text"), (2, "beta", "stays"), (3, "gone", "orphan")]
    two = [(1, "alpha", "new text"), (2, "beta", "stays"), (4, "delta", "added text")]
    index = fresh(spark).upsert(items(spark, one), fields())
    again = index.upsert(items(spark, one), fields())
    assert ids(again.search("text")) == [1] and ids(again.documents()) == [1, 2, 3]
    index = again.upsert(items(spark, two), fields())
    assert ids(index.search("text")) == [1, 4] and ids(index.search("old OR orphan")) == [] and ids(index.search("NOT text")) == [2]
    # Without orphans: only what is given changes.
    index = index.upsert(items(spark, [(5, "eps", "text")]), fields(), orphans=False)
    assert ids(index.search("text")) == [1, 4, 5]
    index = index.delete(spark.createDataFrame([(4,), (77,)], "id int"))
    rebuilt = fresh(spark).upsert(items(spark, [two[0], two[1], (5, "eps", "text")]), fields())
    shown = lambda x, q: sorted((r.id, r.score) for r in x.search(q).collect())
    for x in (index, KeywordIndex.open(spark, index.path), index.merge()):
        assert x.stats == rebuilt.stats and x.items == 3
        assert shown(x, "text OR stays") == shown(rebuilt, "text OR stays")
    merged = KeywordIndex.open(spark, index.path)
    assert len(merged.segments) == 1 and not merged.killers
    # An item that was deleted may come again.
    assert ids(merged.upsert(items(spark, [(4, "delta", "added text")]), fields(), orphans=False).search("added")) == [4]


def test_a_lost_writer_leaves_the_last_version(spark):
    index = fresh(spark).upsert(items(spark, [(1, "a", "first")]), fields())
    # Files of a next segment, but no manifest.
    items(spark, [(1, "a", "torn")]).select("id").write.parquet(f"{index.path}/dead/seg={index.version + 1}")
    assert ids(KeywordIndex.open(spark, index.path).search("first")) == [1]
    index = KeywordIndex.open(spark, index.path).upsert(items(spark, [(1, "a", "first"), (2, "a", "second")]), fields())
    assert ids(index.search("first OR second")) == [1, 2]


def test_guards(spark, monkeypatch):
    with pytest.raises(StoreMissing):
        KeywordIndex.open(spark, f"{shared_dir(spark)}/no-such-index")
    with pytest.raises(StoreMissing):
        fresh(spark).search("a")
    index = fresh(spark).upsert(items(spark, [(1, "a", "b")]), fields())
    emptied = index.delete(spark.createDataFrame([(1,)], "id int"))
    with pytest.raises(StoreMissing):
        emptied.search("a")
    assert emptied.merge().items == 0
    monkeypatch.setattr(kwindex, "TOKENIZER", "another")
    with pytest.raises(StaleStore):
        KeywordIndex.open(spark, index.path)


def test_a_query_reads_its_buckets_only(spark):
    index = fresh(spark).upsert(items(spark, [(k, f"s{k}", f"word{k} common") for k in range(300)]), fields())
    plan = index.postings(["word7"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term", plan)
    files = lambda df: len({r[0] for r in df.select(F.input_file_name()).distinct().collect()})
    read = spark.read.parquet(f"{index.path}/postings")
    assert files(index.postings(["word7"])) < files(read) / 4
    # A frequent term's postings are dealt over files.
    assert files(read.where("term = 'common'")) == index.spread


def test_hostile_texts_are_tokenized_in_time(spark):
    rows = [(1, "a", "a." * 100_000), (2, "a", "a-b_" * 50_000), (3, "x" * 100_000, "@" * 100_000)]
    index = fresh(spark).upsert(items(spark, rows), fields())
    assert ids(index.search("a")) == [1, 2]


def test_postings_are_dealt_by_the_number_of_tokens(spark, monkeypatch):
    """A task of the build sorts about as many tokens at any size: more of them make more files, with the same postings."""
    rows = [(k, f"s{k}", f"word{k} common" + " common again" * (k % 3)) for k in range(300)]
    few = fresh(spark, spread=1).upsert(items(spark, rows), fields())
    monkeypatch.setattr(kwindex, "_TOLD", 20)
    many = fresh(spark, spread=1).upsert(items(spark, rows), fields())
    files = lambda x: len({r[0] for r in x.postings(["common"]).select(F.input_file_name()).distinct().collect()})
    assert files(few) == 1 and files(many) >= 5
    shown = lambda x: sorted(tuple(map(str, r)) for r in x.postings().collect())
    said = []
    for k, s, b in rows:
        for name, words in (("subject", s.split()), ("body", b.split())):
            said += [(k, name, t, words.count(t), len(words), [n for n, w in enumerate(words) if w == t], 1) for t in set(words)]
    assert shown(few) == shown(many) == sorted(tuple(map(str, r)) for r in said)
    assert shown(many.merge()) == sorted(tuple(map(str, (*r[:-1], 2))) for r in said) and files(many.merge()) >= 5


def test_tokens_of_texts_and_of_columns_agree(spark):
    odd = ["", " ", "A.B@c.de x@y a@b@c.d", "一有的 的x一y有", "Größe ÅNGSTRÖM İx ß_ẞ", "x" * 41 + " " + "y" * 40, "한국어 テスト abc", "@ a@ @b 1@2-", "%+-a@b.c.", "ǅ \U0001d400 𠀀一 \x00a", "a" * 70 + "@b.cd", "×÷ é-è"]
    rows = spark.createDataFrame([*enumerate(odd), (99, None)], "id int, t string")
    for r in rows.select("t", F.lower(F.coalesce("t", F.lit(""))).alias("low"), kw.tokens_of(F.col("t")).alias("terms")).collect():
        assert kw.terms_of(r.low) == r.terms, r.t
