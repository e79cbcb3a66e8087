"""Spelling variant grouping with pivotal grams.

Words within one edit are found with bigrams in an order from rare to common.  A
word's prefix is its bigrams up to the third in that order (with those of equal
rank); its pivots are the two disjoint bigrams of the prefix that fewest words
hold, chosen by dynamic programming.  One edit spoils at most one of two disjoint
bigrams.  So of two near words, the one whose prefix ends first has a pivot in
the other's prefix, and the edit leaves it only a few places there: the same
position when lengths agree, the same or the next one when the other word is
longer by one, the same or the one before when it is shorter.  Pivots are joined
with prefixes on bigram, position and length; ``levenshtein`` verifies inside the
join, so that it emits near words only.

The bigrams of the alphabet (26 + 64 letters) are at most 8,100, which bounds the
table of their counts that every task gets.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdocket.plans.staging import Scratch, stage

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Words that a task counts before it hands them on.
_HELD = 200_000
#: A key with at least one of so many pivots is hot: there are at most so many hot keys.
HOT_SHARE = 20_000


def _runs_of(least: int) -> re.Pattern:
    return re.compile("[a-zÀ-ÿ]{%d,}" % least)


def misspell(key: str, run: str, every: int) -> str:
    """The run, without one of its letters where ``every`` divides the crc32 of key and run."""
    h = zlib.crc32(f"{key}:{run}".encode())
    if every and h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1 :]
    return run


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """``word, n``: lower-cased runs of letters, one letter deleted where ``every`` divides the hash of document and run."""
    pattern = _runs_of(least_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                for word, n in Counter(pattern.findall(text.translate(_LOWER).decode())).items():
                    word = misspell(key, word, every)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > _HELD:
                    yield flush()
        if held:
            yield flush()

    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    found = texts.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _bigrams(word: str) -> list[str]:
    return [word[i : i + 2] for i in range(len(word) - 1)]


def _bigram_counts(words: DataFrame) -> dict[str, int]:
    """Number of words that hold each bigram; at most 8,100 entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for word in b.column(0).to_pylist():
                held.update(set(_bigrams(word)))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    counted = words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in counted.collect()}


def pivots_of(prefix: list[tuple[int, int]], cost: list[int]) -> list[tuple[int, int]]:
    """Two disjoint ones of ``(position, rank)`` in order of position, of least total cost.

    best[k] after each entry is the cheapest choice of k disjoint entries so far;
    an entry may follow those that end two positions before it.
    """
    best: list[list] = [[(0, []), None, None]]
    ends = [p for p, _ in prefix]
    for i, (at, rank) in enumerate(prefix):
        before = i
        while before and ends[before - 1] > at - 2:
            before -= 1
        row = list(best[-1])
        for k in (1, 2):
            if (got := best[before][k - 1]) is not None:
                taken = (got[0] + cost[rank], [*got[1], (at, rank)])
                if row[k] is None or taken[0] < row[k][0]:
                    row[k] = taken
        best.append(row)
    return best[-1][2][1]


def signature(word: str, rank: dict[str, int], cost: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Prefix and pivots as lists of ``(position, rank)`` by position.

    Pivots are among the first three of a bigram's occurrences (three of them hold
    a disjoint pair).  One edit adds or removes two bigrams at most, so they are
    among the first five in a near word: a prefix has no more, and a word of
    100,000 equal letters has a short one.
    """
    ranks = [rank[g] for g in _bigrams(word)]
    last = sorted(ranks)[2]
    seen: Counter = Counter()
    prefix, early = [], []
    for p, r in enumerate(ranks):
        if r <= last and seen[r] < 5:
            seen[r] += 1
            prefix.append((p, r))
            if seen[r] <= 3:
                early.append((p, r))
    return prefix, pivots_of(early, cost)


def _halves(word: str, size: int) -> int:
    """Hashes (16 bits each) of the first half of ``size`` letters and of as many last letters as the other half has.

    Of two words within one edit, the shorter one of ``size`` letters, one of both is equal.
    """
    k = size // 2
    return zlib.crc32(word[:k].encode()) & 0xFFFF | (zlib.crc32(word[len(word) - (size - k) :].encode()) & 0xFFFF) << 16


def _signatures(words: DataFrame) -> DataFrame:
    """A row per gram of a prefix (``pivot`` false) and per place where a pivot may stand in a near word (true).

    ``halves`` has the hashes for words of at least the same length, and above them, for prefixes, those for shorter words.
    """
    counts = _bigram_counts(words)
    order = sorted(counts, key=lambda g: (counts[g], g))
    rank, cost = {g: k for k, g in enumerate(order)}, [counts[g] for g in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                prefix, pivots = signature(word, rank, cost)
                size, last = len(word), max(r for _, r in prefix)
                same, less = _halves(word, size), _halves(word, size - 1)
                rows += [(word, n, last, False, r, p, size, less << 32 | same) for p, r in prefix]
                for p, r in pivots:
                    places = [(p, size), (p, size + 1), (p + 1, size + 1), (p, size - 1), (p - 1, size - 1)]
                    rows += [(word, n, last, True, r, at, long, same if long >= size else less) for at, long in places if at >= 0]
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.uint64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:-1], columns[-1].view(pa.int64())], names=["word", "n", "last", "pivot", "gram", "place", "size", "halves"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, pivot boolean, gram int, place int, size int, halves long")


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``a, n_a, b, n_b`` with a < b for the words of ``word, n`` that differ by one inserted, deleted or replaced letter.

    Words have at least four letters.
    """
    rows = scratch.stage(_signatures(words), "spell-signatures")
    key = ["gram", "place", "size"]
    pivots, prefixes = rows.where("pivot"), rows.where(~F.col("pivot"))
    total = pivots.count()
    # Hot keys: those of more than one in HOT_SHARE of all pivots (and than 1000), so at most HOT_SHARE keys; they are dealt into parts of that size.
    part = max(1000, total // HOT_SHARE)
    hot = pivots.groupBy(*key).count().where(F.col("count") > part).select(*key, F.ceil(F.col("count") / part).cast("int").alias("parts"))
    hot = F.broadcast(scratch.stage(hot, "spell-hot"))
    parts = F.coalesce("parts", F.lit(1))
    left = pivots.join(hot, key, "left").select(*key, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("s"), F.col("n").alias("n_s"), F.col("last").alias("last_s"), F.col("halves").alias("halves_s"), (F.length("word") < F.col("size")).alias("shorter"))
    right = prefixes.join(hot, key, "left").select(*key, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("word").alias("r"), F.col("n").alias("n_r"), F.col("last").alias("last_r"), F.col("halves").alias("halves_r"))
    # Cheap tests first: one half of the words agrees.
    apart = F.col("halves_s").bitwiseXOR(F.when(F.col("shorter"), F.shiftrightunsigned("halves_r", 32)).otherwise(F.col("halves_r")))
    half = (apart.bitwiseAND(F.lit(0xFFFF)) == 0) | (apart.bitwiseAND(F.lit(0xFFFF0000)) == 0)
    near = (F.col("last_s") <= F.col("last_r")) & half & (F.levenshtein("s", "r", 1) == 1)
    on = [left[c] == right[c] for c in (*key, "part")]
    found = left.join(right, [*on, near])
    swapped = F.col("s") < F.col("r")
    return found.select(
        F.least("s", "r").alias("a"), F.when(swapped, F.col("n_s")).otherwise(F.col("n_r")).alias("n_a"), F.greatest("s", "r").alias("b"), F.when(swapped, F.col("n_r")).otherwise(F.col("n_s")).alias("n_b")
    ).distinct()


def follow_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for each of ``word, form``: pointers double until none moves.

    A form is at least ``times`` as frequent as its word, so chains are short.
    """
    roots = scratch.stage(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        moved = scratch.stage(moved, "spell-roots")
        if moved.where("moved").isEmpty():
            return roots
        roots = moved.select("word", "root")


def group_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, every: int = 31, times: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of the documents.

    Words are maximal runs of Latin letters with A-Z lower-cased (``every`` > 0
    first deletes a letter of some, by a hash of document and run; a null id
    hashes as ``null``), of at least ``least_length`` letters (4 or more) and
    ``least_count`` occurrences.  A word's form is its most frequent near word
    (ties: the first in code-point order) if that is at least ``times`` as
    frequent, and its root the last of the forms that follow.  Null and empty
    texts have no words; repeated rows count each time; very long words are words
    like others; further columns are not read; an empty table gives an empty one.
    """
    if least_length < 4:
        raise ValueError("words need three bigrams: least_length must be 4 or more")
    scratch = Scratch()
    words = scratch.stage(count_words(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, every=every), "spell-words")
    links = scratch.stage(near_words(words, scratch), "spell-links")
    both = links.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).union(links.select("b", "n_b", "a", "n_a"))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("first"))
    enough = -F.col("first.less") >= F.col("n") * times
    near = scratch.stage(near.select("word", "n_near", F.when(enough, F.col("first.other")).alias("form"), F.when(enough, -F.col("first.less")).alias("form_n")), "spell-near")
    roots = follow_forms(near.where(F.col("form").isNotNull()), scratch)
    out = words.join(near, "word", "left").join(roots, "word", "left")
    done = stage(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")), "spell-variants").df
    scratch.clear()
    return done


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}

#: SQL has no crc32 to delete letters by; the tests compare with brute force.
ORACLE: dict = {}
