"""Concept clusters, sentence units, incremental scoring and hashed vectors."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkdocket.plans.staging import stage

STOP_WORDS = ["the", "and", "for", "that", "with", "was", "are", "der", "die", "und", "das", "les", "des", "que", "los", "las"]
# How lines begin that are header fields, marks of forwarded messages, phrases of disclaimers, words of headers.
HEADER_PREFIXES = ["from:", "to:", "cc:", "bcc:", "sent:", "date:", "subject:", "reply-to:", "importance:", "attachments:"]
FORWARD_MARKS = ["-----original message-----", "----- original message -----", "begin forwarded message", "---------- forwarded message ----------"]
DISCLAIMERS = [
    "privileged and confidential", "attorney-client privileged", "attorney client privileged", "intended recipient", "intended solely for", "unauthorized disclosure", "confidentiality notice",
    "if you are not the intended", "please delete this email", "this email and any attachments", "may contain confidential", "strictly confidential", "do not distribute",
]
_HASHED_WORD = re.compile("[a-z0-9ß-ÿ]+")
#: Words whose vectors a task keeps, and how long they may be.
_KNOWN_WORDS, _KNOWN_LONGEST = 100_000, 64
STRUCTURAL = ["from", "sent", "subject", "mailto", "cc", "bcc"]


def prose_lines(text: Column) -> Column:
    """The text's lines, trimmed, without blank ones, header fields, forward marks and disclaimers."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda line: F.trim(line))
    low = lambda line: F.lower(line)
    noise = lambda line: reduce(lambda a, b: a | b, [*[low(line).startswith(p) for p in HEADER_PREFIXES], *[low(line).contains(p) for p in FORWARD_MARKS + DISCLAIMERS]])
    return F.array_join(F.filter(lines, lambda line: (line != "") & ~noise(line)), "\n")


def cluster_tokens(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """``key, term``: words of two and more characters, not only digits, no stop words nor words of headers."""
    found = F.regexp_extract_all(F.lower(prose_lines(F.col(text_col))), F.lit("([a-z0-9ß-ÿ]{2,})"), F.lit(1))
    return df.select(key, F.explode(F.filter(found, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(STOP_WORDS + STRUCTURAL))).alias("term"))


def vocabulary(toks: DataFrame, key: str, most: int = 20_000, min_df: int = 2) -> DataFrame:
    """``term, df, number``: the terms in most documents, ties by term, numbered alphabetically from 0.

    ``most`` is the feature's own bound; terms beyond it play no part in clustering.
    """
    df = toks.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    chosen = df.orderBy(F.desc("df"), "term").limit(most)
    return chosen.withColumn("number", F.row_number().over(Window.orderBy("term")) - 1)  # at most ``most`` rows


#: Largest table of centres that goes to the tasks, in numbers (32 MB).
MOST_CENTRES = 4_000_000


def kmeans(weights: DataFrame, key: str, k: int, iterations: int = 20, seed: str = "0") -> DataFrame:
    """``key, cluster, similarity`` by spherical k-means over sparse unit rows (``key, term, weight``).

    The first centres are the rows with the least digests of seed and key.  A row
    goes to the centre of the largest product (rounded to nine digits), ties to the
    lowest number; centres are normalized sums.  It stops when nothing moves.  Empty
    clusters go and the others are numbered anew by their old order.

    Rows are packed once, a document each.  Centres are a matrix that goes to the
    tasks, so there may be at most MOST_CENTRES numbers in it (``vocabulary`` bounds the terms); a task places
    its rows and returns one sum for each cluster and term, and no term's rows meet.
    """
    spark = weights.sparkSession
    numbers = stage(weights.select("term").distinct(), "km-terms").df
    width = numbers.count()
    if width * k > MOST_CENTRES:
        raise ValueError(f"{k} clusters of {width} terms are too many to send to the tasks; bound the terms with vocabulary()")
    terms = sorted(r.term for r in numbers.collect())  # at most MOST_CENTRES / k
    column = spark.sparkContext.broadcast({t: n for n, t in enumerate(terms)})
    packed = weights.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("t")).select(key, F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    packed = stage(packed, "km-rows").df
    first = packed.orderBy(F.md5(F.concat(F.lit(seed), F.lit("|"), F.col(key).cast("string"))), key).limit(k).toArrow()  # k documents
    centres = np.zeros((max(len(first), 1), max(width, 1)))
    for n, (names, values) in enumerate(zip(first["terms"].to_pylist(), first["weights"].to_pylist(), strict=True)):
        centres[n, [column.value[t] for t in names]] = values
    kind = packed.schema[key].dataType.simpleString()
    before = None
    for _ in range(max(1, iterations)):
        shared = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            """Rows with their cluster, then the sums of all of them."""
            centres, number = shared.value, column.value
            sums = np.zeros_like(centres)
            for b in batches:
                cluster, near = [], []
                for names, values in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    at, w = [number[t] for t in names], np.array(values)
                    dots = np.round(centres[:, at] @ w, 9)
                    cluster.append(int(dots.argmax()))
                    near.append(float(dots[cluster[-1]]))
                    sums[cluster[-1], at] += w
                nothing = pa.nulls(len(cluster), pa.int32()), pa.nulls(len(cluster), pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(near, pa.float64()), *nothing], names=[key, "cluster", "similarity", "term", "sum"])
            row, col = np.nonzero(sums)
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(row), b.schema.field(0).type), pa.array(row, pa.int32()), pa.nulls(len(row), pa.float64()), pa.array(col, pa.int32()), pa.array(sums[row, col])], names=[key, "cluster", "similarity", "term", "sum"])

        out = stage(packed.mapInArrow(place, f"`{key}` {kind}, cluster int, similarity double, term int, sum double"), "km-placed").df
        placed = out.where("term IS NULL").select(key, "cluster", "similarity")
        moved = before is None or not placed.join(before.select(key, F.col("cluster").alias("old")), key).where("cluster <> old").isEmpty()
        before = placed
        shared.unpersist()
        if not moved:
            break
        total = out.where("term IS NOT NULL").groupBy("cluster", "term").agg(F.sum("sum").alias("s")).toArrow()  # at most MOST_CENTRES rows
        centres = np.zeros_like(centres)
        centres[total["cluster"].to_numpy(), total["term"].to_numpy()] = total["s"].to_numpy()
        size = np.linalg.norm(centres, axis=1, keepdims=True)
        centres = np.round(np.divide(centres, size, out=centres, where=size > 0), 9)
    dense = before.select("cluster").distinct().withColumn("n", F.row_number().over(Window.orderBy("cluster")) - 1)  # at most k rows
    return before.join(F.broadcast(dense), "cluster").select(key, F.col("n").alias("cluster"), "similarity")


def sentence_units(text: Column, most: int | None = 200) -> Column:
    """Sentences of the prose lines, or its lines where there is one sentence of several; ``most`` is the feature's own bound."""
    prose = F.trim(prose_lines(text))
    parts = lambda c: F.filter(F.transform(c, lambda u: F.trim(u)), lambda u: u != "")
    sentences = parts(F.split(F.regexp_replace(prose, r"([.!?][\"')\]]*)(\s+|$)", "$1\x01"), "\x01"))
    lines = parts(F.split(prose, "\n"))
    units = F.when(F.size(sentences) > 1, sentences).otherwise(lines)
    return units if most is None else F.slice(units, 1, most)


def rescoring(now: DataFrame, stored: DataFrame, method: str, strong: float) -> DataFrame:
    """``item_id, action, polarity``: skip, relabel or rescore each item.

    ``now`` has ``item_id, text_sha``; ``stored`` has ``item_id, text_sha, method,
    strong, compound``.  Where only the threshold differs the label is made anew
    from the stored score; where text or method differ, or nothing is stored, the
    item must be scored again.
    """
    s = stored.select("item_id", F.col("text_sha").alias("old_sha"), F.col("method").alias("old_method"), F.col("strong").alias("old_strong"), "compound")
    same = F.coalesce((F.col("text_sha") == F.col("old_sha")) & (F.col("old_method") == method), F.lit(False))
    action = F.when(~same, "rescore").when(F.col("old_strong") == strong, "skip").otherwise("relabel")
    polarity = F.when(F.col("compound") >= strong, "positive").when(F.col("compound") <= -strong, "negative").when(F.col("compound").isNotNull(), "neutral")
    return now.join(s, "item_id", "left").select("item_id", action.alias("action"), F.when(same, polarity).alias("polarity"))


def hashed_vectors(df: DataFrame, key: str, text_col: str, buckets: int = 32) -> DataFrame:
    """``key, bucket, weight``: unit vectors of hashed words (1) and their character trigrams (0.35), each again at half weight in a second bucket."""

    def spots(feature: str) -> tuple[int, int]:
        digest = hashlib.md5(feature.encode()).hexdigest()
        return int(digest[:8], 16) % buckets, int(digest[8:16], 16) % buckets

    def of_word(word: str, grams: dict[str, tuple[int, int]]) -> np.ndarray:
        out = [0.0] * buckets
        a, b = spots("w:" + word)
        out[a] += 1.0
        out[b] += 0.5
        for i in range(len(word) - 2):
            gram = word[i : i + 3]
            if (at := grams.get(gram)) is None:
                at = grams[gram] = spots("3:" + gram)
            out[at[0]] += 0.35
            out[at[1]] += 0.175
        return np.array(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}  # vectors of words met so far, within a bound
        grams: dict[str, tuple[int, int]] = {}  # the alphabet bounds them
        for b in batches:
            if len(known) > _KNOWN_WORDS:
                known.clear()
            sums = np.zeros((b.num_rows, buckets))
            for row, text in enumerate(b.column(1).to_pylist()):
                for part in batched(Counter(_HASHED_WORD.findall(text)).items(), 10_000):
                    vectors = []
                    for w, _ in part:
                        if (v := known.get(w)) is None:
                            v = of_word(w, grams)
                            if len(w) <= _KNOWN_LONGEST:
                                known[w] = v
                        vectors.append(v)
                    sums[row] += np.array([n for _, n in part], float) @ np.array(vectors)
            rows, at = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(sums[rows, at])], names=[key, "bucket", "v"])

    # A text is summed where it is read; only its buckets are shuffled.
    texts = df.select(key, F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    each = texts.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, bucket int, v double")
    sums = each.groupBy(key, "bucket").agg(F.sum("v").alias("v"))
    length = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return sums.join(length, key).select(key, "bucket", F.round(F.col("v") / F.col("norm"), 6).alias("weight"))


def report_table(items: DataFrame, label: Column, name: str, n: int) -> DataFrame:
    """A section of the case report: ``section, label, n, bytes``, the n commonest labels and ``(other)``."""
    counts = items.groupBy(F.coalesce(label.cast("string"), F.lit("")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    top = counts.orderBy(F.desc("n"), "label").limit(n)
    rest = counts.join(F.broadcast(top.select("label")), "label", "left_anti").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).where("n IS NOT NULL")
    return top.union(rest.select(F.lit("(other)").alias("label"), "n", "bytes")).select(F.lit(name).alias("section"), "label", "n", "bytes")


def case_report(items: DataFrame, sections: dict[str, tuple[Column, int]]) -> DataFrame:
    """All sections of a case report from one item table, which is written once."""
    slim = stage(items, "report-items").df
    return reduce(DataFrame.union, [report_table(slim, label, name, n) for name, (label, n) in sections.items()])
