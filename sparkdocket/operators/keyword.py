"""Keyword search over fields: a postings table, boolean clauses, phrases, BM25.

A posting is ``item, field, pos, term``.  Latin words are lower-case runs of
letters and digits (longer than ``LONGEST`` are dropped), a word with ``@`` stays
whole, and runs of CJK characters become overlapping pairs.  A query is data, not
a text to be parsed: ``{"all": [...], "any": [...], "none": [...]}``, each clause
``{"text", "field", "phrase"}`` or just a text.  Clauses of ``all`` must hold, one
of ``any`` must where there are any, none of ``none`` may.  The words of a clause
must all occur, next to each other in order for a phrase; pairs of one CJK run are
a phrase always.

Only postings of the query's terms are read on; everything about them is grouped
by item, so no list of a term is gathered anywhere.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 40
_CJK = "぀-ヿ㐀-䶿一-鿿가-힯"
#: Mail addresses (at most 64 characters before the @), Latin words, CJK runs; portable between engines.
_RUN = f"[0-9a-zß-öø-ÿ]+|[{_CJK}]+"
TOKEN = f"([0-9a-z._%+-]{{0,63}}[0-9a-z]@[0-9a-z][0-9a-z.-]*[0-9a-z]|{_RUN})"
_TOKENS, _RUNS, _ANY_CJK = re.compile(TOKEN), re.compile(_RUN), re.compile(f"[{_CJK}]")


def tokens_of(text: Column) -> Column:
    """The terms of a text in order, an array; of a null none."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    of_run = lambda w: F.when(w.rlike(f"^[{_CJK}]"), pairs(w)).when(F.length(w) <= LONGEST, F.array(w)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, of_run))


def postings(items: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """``key, field, pos, term`` of the given fields."""
    each = F.array(*[F.struct(F.lit(n).alias("field"), tokens_of(c).alias("terms")) for n, c in fields.items()])
    rows = items.select(key, F.explode(each).alias("f")).select(key, "f.field", F.posexplode("f.terms"))
    return rows.select(key, "field", "pos", F.col("col").alias("term"))


def terms_of(text: str) -> list[str]:
    """What ``tokens_of`` gives, of a text that is lower-cased already."""
    runs = (_TOKENS if "@" in text else _RUNS).findall(text)
    if not _ANY_CJK.search(text):
        return runs if max(map(len, runs), default=0) <= LONGEST else [w for w in runs if len(w) <= LONGEST]
    out = []
    for w in runs:
        if _ANY_CJK.match(w):
            out += [w[i : i + 2] for i in range(max(len(w) - 1, 1))]
        elif len(w) <= LONGEST:
            out.append(w)
    return out


def query_terms(text: str) -> list[list[str]]:
    """The words of a clause, each a list of terms that stand side by side (several for a CJK run)."""
    out = []
    for run in re.findall(TOKEN, text.lower()):
        if re.match(f"[{_CJK}]", run):
            out.append([run[i : i + 2] for i in range(max(len(run) - 1, 1))])
        elif len(run) <= LONGEST:
            out.append([run])
    return out


def _clauses(query: dict) -> list[tuple[str, str | None, list[list[str]]]]:
    """(kind, field, sequences of terms that must each occur side by side)."""
    out = []
    for kind in ("all", "any", "none"):
        for c in query.get(kind, []):
            c = {"text": c} if isinstance(c, str) else c
            if unknown := set(c) - {"text", "field", "phrase"}:
                raise ValueError(f"unknown properties {sorted(unknown)}")
            words = query_terms(c["text"])
            if not words:
                raise ValueError(f"no word in {c['text']!r}")
            out.append((kind, c.get("field"), [[t for w in words for t in w]] if c.get("phrase") else words))
    if unknown := set(query) - {"all", "any", "none"}:
        raise ValueError(f"unknown properties {sorted(unknown)}")
    if not any(kind != "none" for kind, _, _ in out):
        raise ValueError("a query needs a clause of all or any")
    return out


def matching(posts: DataFrame, key: str, query: dict) -> DataFrame:
    """The distinct items that satisfy the query."""
    clauses = _clauses(query)
    needed = sorted({t for _, _, seqs in clauses for s in seqs for t in s})
    slim = posts.where(F.col("term").isin(needed))
    hits = []
    number = 0
    tests: dict[str, list[Column]] = {"all": [], "any": [], "none": []}
    for kind, field, seqs in clauses:
        own = []
        for seq in seqs:
            rows = slim if field is None else slim.where(F.col("field") == field)
            if len(seq) == 1:
                found = rows.where(F.col("term") == seq[0]).select(key)
            else:
                starts = [rows.where(F.col("term") == t).select(key, "field", (F.col("pos") - n).alias("start"), F.lit(n).alias("n")) for n, t in enumerate(seq)]
                found = reduce(DataFrame.union, starts).groupBy(key, "field", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(seq)).select(key)
            hits.append(found.select(key, F.lit(number).alias("clause")))
            own.append(F.array_contains("met", F.lit(number)))
            number += 1
        tests[kind].append(reduce(lambda a, b: a & b, own))
    # At most one row per item and part of the query meets the others of its item.
    met = reduce(DataFrame.union, hits).distinct().groupBy(key).agg(F.collect_set("clause").alias("met"))
    good = [*tests["all"], *[~t for t in tests["none"]]]
    if tests["any"]:
        good.append(reduce(lambda a, b: a | b, tests["any"]))
    return met.where(reduce(lambda a, b: a & b, good)).select(key)


def search(posts: DataFrame, key: str, query: dict, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score``: items that satisfy the query, by BM25 summed over fields and positive terms."""
    wanted = sorted({(field or "", t) for kind, field, seqs in _clauses(query) if kind != "none" for s in seqs for t in s})
    lengths = posts.groupBy(key, "field").agg(F.count(F.lit(1)).alias("len"))
    stats = F.broadcast(lengths.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")))  # a row per field
    scope = reduce(lambda a, c: a | c, [(F.col("term") == t) & ((F.col("field") == f) if f else F.lit(True)) for f, t in wanted])
    tf = posts.where(F.col("term").isin(sorted({t for _, t in wanted})) & scope).groupBy(key, "field", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = F.broadcast(tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")))  # a row per field and term of the query
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    scored = tf.join(df, ["field", "term"]).join(stats, "field").join(lengths, [key, "field"]).groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return scored.join(matching(posts, key, query), key, "left_semi")


def top(found: DataFrame, key: str, n: int = 50) -> DataFrame:
    """The n best by score, ties by key: a report."""
    return found.orderBy(F.desc("score"), key).limit(n)


def fingerprints(items: DataFrame, key: str, parts: list[Column]) -> DataFrame:
    """``key, fingerprint`` of what the index holds of each item."""
    return items.select(key, F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in parts]), 256).alias("fingerprint"))


def changed(now: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``key, change``: items to ``add``, ``update`` or ``remove`` in the index."""
    both = now.select(key, F.col("fingerprint").alias("new")).join(stored.select(key, F.col("fingerprint").alias("old")), key, "full")
    change = F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "remove").when(F.col("old") != F.col("new"), "update")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def language_tag(text: Column, votes: dict[str, list[str]], least: int = 50, share: float = 0.08) -> Column:
    """The language of a text by script, else by the share of its words among each language's frequent words.

    Under ``least`` characters, or where no share is reached, ``und``; ties go to the first language.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(F.lower(t), F.lit("([a-zß-öø-ÿ]+)"), F.lit(1))
    found = F.transform(F.array(*[F.struct(F.lit(k).alias("lang"), F.array(*[F.lit(w) for w in ws]).alias("words")) for k, ws in votes.items()]), lambda v: F.struct(F.size(F.filter(words, lambda w: F.array_contains(v["words"], w))).alias("n"), v["lang"].alias("lang")))
    best = F.aggregate(found, F.struct(F.lit(-1).alias("n"), F.lit("und").alias("lang")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    by_script = F.when(t.rlike("[぀-ヿ]"), "ja").when(t.rlike("[가-힯]"), "ko").when(t.rlike("[一-鿿]"), "zh")
    by_words = F.when((F.size(words) > 0) & (best["n"] >= share * F.size(words)), best["lang"]).otherwise("und")
    return F.when(F.length(t) < least, "und").otherwise(F.coalesce(by_script, by_words))
