"""Near-duplicate groups by MinHash signatures, banded lookup and a pivot per group.

The exact mode of this library's shingle joins lives elsewhere; this is the
estimate that e-discovery reviews use: 128 slots, 16 bands of 8, similarity at or
above the threshold, and membership decided by similarity to the group's pivot.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdocket.operators.graph import connected_components
from sparkdocket.plans.staging import stage

_CJK = r"぀-ヿ㐀-䶿一-鿿가-힯"
_RUN = re.compile(rf"[{_CJK}]+|[^\W{_CJK}]+")
#: Buckets of more classes are compared block by block.
SHORT = 24
_ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍﻿"))


def prepared(text: str | None) -> str:
    return " ".join((text or "").translate(_ZERO_WIDTH).lower().split())


def shingles(text: str, k: int = 5) -> tuple[set[str], int]:
    """Word k-grams of each run of words, pairs of characters of CJK runs, and the number of tokens.

    Tokens of ASCII digits only are dropped; a CJK run ends a run of words.
    """
    out: set[str] = set()
    words: list[str] = []
    count = 0

    def close() -> None:
        for i in range(len(words) - k + 1):
            out.add(" ".join(words[i : i + k]))
        words.clear()

    for tok in _RUN.findall(text):
        if re.match(rf"[{_CJK}]", tok):
            close()
            count += len(tok)
            out.update(tok[i : i + 2] for i in range(len(tok) - 1)) if len(tok) > 1 else out.add(tok)
        elif not (tok.isascii() and tok.isdigit()):
            count += 1
            words.append(tok)
    close()
    return out, count


def signature(items: set[str], slots: int = 128, seed: int = 1) -> np.ndarray:
    """Unsigned minima over a SplitMix64 stream per shingle."""
    digests = b"".join([hashlib.sha256(s.encode()).digest()[:8] for s in items])
    base = np.frombuffer(digests, ">u8").astype(np.uint64) ^ np.uint64(seed)
    low = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        step = np.arange(1, slots + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part in np.array_split(base, max(1, len(base) // 4096)):
            z = part[:, None] + step[None, :]
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            low = np.minimum(low, (z ^ (z >> np.uint64(31))).min(axis=0))
    return low


def sketch(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 80, slots: int = 128) -> DataFrame:
    """``id, tokens, sig`` (slots as order-preserving signed longs; null where the text is skipped)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, sigs = [], []
            for text in b.column("text").to_pylist():
                p = prepared(text)
                found, n = shingles(p) if len(p) >= min_chars else (set(), 0)
                tokens.append(n)
                sigs.append((signature(found, slots) ^ np.uint64(1 << 63)).view(np.int64).tolist() if found else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(tokens, pa.int32()), pa.array(sigs, pa.list_(pa.int64()))], names=["id", "tokens", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, tokens int, sig array<long>")


def _large_buckets(sized: DataFrame, sig: DataFrame, threshold: float, slots: int, block_rows: int = 300) -> DataFrame:
    """Links inside buckets of many classes: compared block by block, a spanning forest per pair of blocks."""
    blocks = F.ceil(F.col("size") / block_rows).cast("int")
    placed = sized.select("cls", "band", "h", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).join(sig, "cls")
    dealt = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", "h", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "cls", "sig")
    kind = sig.schema["cls"].dataType.simpleString()
    least = int(np.ceil(threshold * slots - 1e-9))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cls")
        m = np.stack(pdf["sig"].to_numpy())
        label = np.arange(len(m))
        hit = np.stack([(m == row).sum(axis=1) >= least for row in m])
        while True:
            low = np.minimum(label, np.where(hit, label[None, :], len(m)).min(axis=1))
            low = np.minimum(low, low[low])
            if (low == label).all():
                break
            label = low
        cls, own = pdf["cls"].to_numpy(), label != np.arange(len(m))
        return pd.DataFrame({"x": cls[label[own]], "y": cls[own]})

    return dealt.groupBy("band", "h", "bi", "bj").applyInPandas(compare, f"x {kind}, y {kind}")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 16, slots: int = 128) -> DataFrame:
    """``id, role, group_id, similarity``: pivot, member, unique or skipped.

    Equal signatures form one class first, so copies never turn into pairs.  Texts
    of fewer than 80 prepared characters or without shingles are skipped.
    """
    sk = stage(sketch(docs, id_col, text_col, slots=slots), "nd-sketch")
    seen = sk.df.where("sig IS NOT NULL")
    classes = stage(seen.groupBy("sig").agg(F.min("id").alias("cls"), F.max("tokens").alias("tokens")), "nd-classes")
    rows = slots // bands
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.xxhash64(F.slice("sig", k * rows + 1, rows)).alias("h")) for k in range(bands)])
    banded = classes.df.select("cls", F.explode(keys).alias("k")).select("cls", "k.band", "k.h")
    banded = stage(banded, "nd-banded").df
    sizes = stage(banded.groupBy("band", "h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "nd-sizes").df
    sized = banded.join(sizes, ["band", "h"])
    few = sized.where(F.col("size") <= SHORT)
    pairs = few.alias("a").join(few.alias("b"), ["band", "h"]).where(F.col("a.cls") < F.col("b.cls")).select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y")).distinct()
    sig = classes.df.select("cls", "sig")
    equal = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / F.lit(float(slots))
    both = pairs.join(sig.select(F.col("cls").alias("x"), F.col("sig").alias("sx")), "x").join(sig.select(F.col("cls").alias("y"), F.col("sig").alias("sy")), "y")
    many = _large_buckets(sized.where(F.col("size") > SHORT), sig, threshold, slots)
    edges = stage(both.where(equal(F.col("sx"), F.col("sy")) >= threshold).select("x", "y").union(many), "nd-edges")
    parts = connected_components(edges.df, "x", "y").withColumnRenamed("vertex", "cls")
    grouped = seen.join(classes.df.select("sig", "cls"), "sig").join(parts, "cls", "left").withColumn("part", F.coalesce("component", "cls"))
    pivots = grouped.groupBy("part").agg(F.min(F.struct((-F.col("tokens")).alias("t"), "id"))["id"].alias("pivot"))
    placed = grouped.join(pivots, "part")
    pivot_sig = seen.select(F.col("id").alias("pivot"), F.col("sig").alias("ps")).join(pivots.select("pivot"), "pivot", "left_semi")
    scored = placed.join(pivot_sig, "pivot").select("id", "pivot", "part", F.when(F.col("id") == F.col("pivot"), 1.0).otherwise(equal(F.col("sig"), F.col("ps"))).alias("sim"))
    kept = scored.where(F.col("sim") >= threshold)
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = kept.join(sizes, "part").select("id", F.when(F.col("id") == F.col("pivot"), "pivot").otherwise("member").alias("role"), F.col("pivot").alias("group_id"), F.col("sim").alias("similarity"))
    out = sk.df.select("id", F.col("sig").isNull().alias("skip")).join(members, "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("skip"), "skipped").otherwise(F.coalesce("role", F.lit("unique"))).alias("role"), "group_id", "similarity")
