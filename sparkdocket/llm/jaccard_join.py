"""N-gram Jaccard self-join by a size-aware heavy-light split.

A document is the set of its word shingles; documents with equal sets form one
node.  Two nodes of sizes s and t that link share at least
c(s, t) = ceil(T (s + t) / (100 + T)) shingles, T being the threshold in per cent.

* Light sets enumerate all their subsets of the sizes c(s, t) that partners t of
  theirs may ask for.  Sets that share such a subset link; in a group of sets with
  one subset, everything that links with anything links with the smallest set, so
  one row per member keeps all connections.
* Heavy sets are found by scanning inverted lists.  In a total order of shingles
  two linking sets share at least 1 + d of their first s - ceil(T s / 100) + 1 + d,
  so only these are listed, and a pair that shares fewer is dropped unseen.  Lists
  also hold the light sets large enough to link with a heavy one.
* The boundary between light and heavy sizes is where the estimated number of
  rows is smallest, from the histogram of set sizes.

The order puts rare shingles first.  Document frequencies are counted for the
shingles whose hash falls below a global cut; for the others a sample of the sets
tells which are frequent.  First come those that occur once (they need no list at
all), then the uncounted that the sample does not know, which are mostly rare, then
the counted that occur a few times, last the frequent of both kinds by frequency.
So a set that holds enough rare shingles, counted or not, is in no long list.  The
order steers the work alone: any order of all shingles gives the same result.
Short lists give pairs; what pairs connect is
compared as a group, on the exact sets.  Sets of long lists form clusters (two sets of one long list are always
in the same cluster).  A cluster is compared block by block, first with some of its
sets, which joins groups of near copies at linear cost, then between the parts that
are still apart, where sizes allow a link; a task returns a spanning forest of the
links it finds, never the pairs.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.columns import small_batches
from sparkdocket.operators.graph import connected_components
from sparkdocket.plans.staging import Scratch
from sparkdocket.plans.staging import stage as staged

_A = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, known: dict | None = None) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the k-word shingles (A-Z lower-cased, ASCII space).

    With fewer words the whole sequence is one shingle; without words there are none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.int64)
    known = _WordHashes() if known is None else known
    h = np.array([*map(known.__getitem__, words)], dtype=np.uint64)
    n = min(k, len(h))
    with np.errstate(over="ignore"):
        rolled = mixed(h[: len(h) - n + 1] + np.uint64(n))
        for j in range(1, n):
            rolled = mixed(rolled * _A + h[j : len(h) - n + 1 + j])
    return np.unique((rolled >> np.uint64(16)).view(np.int64))


def needed(s: int, t: int, percent: int) -> int:
    """Least number of common shingles with which sets of sizes s and t link."""
    return -(-percent * (s + t) // (100 + percent))


def partner_sizes(s: int, percent: int) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_sizes(s: int, percent: int) -> list[int]:
    """Subset sizes that a set of size s must enumerate."""
    return sorted({c for t in partner_sizes(s, percent) if t > 0 and (c := needed(s, t, percent)) <= min(s, t)})


def size_classes(percent: int, largest: int = 1 << 31) -> list[int]:
    """Least sizes of classes of sizes: sets that link are of one class or of neighbouring ones."""
    out = [1]
    while (least := max(100 * out[-1] // percent, 5 * out[-1] // 4) + 1) < largest:
        out.append(least)
    return out


def prefix_size(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def boundary_by_cost(sizes: dict[int, int], percent: int, list_row_cost: float = 3.0, largest: int = 24) -> int:
    """The largest light size: the one with the least estimated rows.

    A light set costs its subsets, a listed set its prefix times what a list row
    costs more than a subset row (it is joined several times).
    """
    best, best_cost = 0, float("inf")
    for b in range(largest + 1):
        cost = 0.0
        for s, n in sizes.items():
            if s <= b:
                cost += n * sum(comb(s, c) for c in subset_sizes(s, percent))
            if s > b or 100 * s >= percent * (b + 1):
                cost += n * list_row_cost * prefix_size(s, percent)
        if cost < best_cost:
            best, best_cost = b, cost
    return best


def pack(keys: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as six bytes each."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.int64)


_SPACE = 1 << 48
#: Sets with hashes below this share of the space are counted.
COUNTED = 0.35
_CUT = int(_SPACE * COUNTED)
#: One set in so many tells which of the other hashes are frequent: those that two sets of the sample hold.
SAMPLED = 16


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Rows ``rid, id, mark, n, digest, sh`` of rows ``rid, id, mark, text``: the set's size, its digest and packed hashes.

    ``sh`` is null where the task has met the set before.
    """
    kind = docs.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("rid", T.LongType()), T.StructField("id", kind), T.StructField("mark", T.BinaryType()), T.StructField("n", T.LongType()),
            T.StructField("digest", T.BinaryType()), T.StructField("sh", T.BinaryType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = _WordHashes()
        met: set[bytes] = set()
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            sizes, digests, packed = [], [], []
            for text in texts:
                keys = shingle_set(text, k, known)
                raw = pack(keys) if len(keys) else b""
                digest = xxhash.xxh3_128_digest(raw)
                sizes.append(len(keys))
                digests.append(digest)
                packed.append(raw if len(keys) and digest not in met else None)
                met.add(digest)
                if len(known) > 60_000:
                    known.clear()
                if len(met) > 60_000:
                    met.clear()
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("id"), b.column("mark"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _frequencies(sets: DataFrame, shingles: int, standing: Broadcast, low: int = 0, high: int = _CUT) -> DataFrame:
    """Document frequencies of 2 and more (``key, df``) of the shingles from ``low`` to below ``high``, in the ``standing`` sets.

    Keys travel as packed, sorted stretches of key ranges; the number of ranges
    follows the number of shingles, so a range stays at about a million keys.
    """
    ranges = max(64, int(2 * shingles * (high - low) / _SPACE) // 1_000_000)
    width = -(-(high - low) // ranges)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = standing.value
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            cuts = np.searchsorted(keys, np.arange(ranges + 1) * width)
            some = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(some, pa.int32()), pa.array([pack(keys[cuts[r] : cuts[r + 1]] - r * width) for r in some], pa.binary()),
                    pa.array([np.minimum(counts[cuts[r] : cuts[r + 1]], 60_000).astype("<u2").tobytes() for r in some], pa.binary()),
                ],
                names=["range", "keys", "counts"],
            )

        for b in batches:
            for raw in b.filter(pa.array(_has_bit(words, bits, b.column("rid").to_numpy()))).column("sh").to_pylist():
                keys = unpack(raw)
                held.append(keys[np.searchsorted(keys, low) : np.searchsorted(keys, high)] - low)
                size += len(held[-1])
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([unpack(x) for x in pdf["keys"]])
        counts = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["counts"]]).astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
        df = np.add.reduceat(counts, heads)
        often = df >= 2
        return pd.DataFrame({"key": keys[heads][often] + (low + int(pdf["range"].iloc[0]) * width), "df": df[often]})

    return sets.select("rid", "sh").mapInArrow(packed, "range int, keys binary, counts binary").groupBy("range").applyInPandas(counted, "key long, df long")


def _bit_of(values: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(values.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bit_filter(df: DataFrame, column: str, most_bits: int = 1 << 30) -> tuple[np.ndarray, int]:
    """A bit array in which every value of ``column`` sets a bit.

    It has 8 bits a value, rounded up to a power of two, and at most ``most_bits``
    (128 MB); beyond that it lets more values pass but never loses one.
    """
    rows = df.count()
    bits = 1 << 16
    while bits < min(8 * rows, most_bits):
        bits *= 2

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _bit_of(b.column(0).to_numpy(), bits)
            word, inverse = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], names=["word", "value"])

    found = df.select(column).mapInArrow(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return out, bits


def _has_bit(table: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    at = _bit_of(values, bits)
    return (table[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def _bodies(sets: DataFrame, wanted: DataFrame, sent: list[Broadcast]) -> DataFrame:
    """``rid, sh`` of the wanted ``rid`` values; a bit filter keeps most others out of the shuffle."""
    table = sets.sparkSession.sparkContext.broadcast(_bit_filter(wanted, "rid"))
    sent.append(table)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = table.value
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_has_bit(words, bits, b.column("rid").to_numpy())))

    return sets.select("rid", "sh").mapInArrow(passing, "rid long, sh binary").join(wanted, "rid", "left_semi")


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 4,
    percent: int = 85,
    extra: int = 4,
    short_list: int = 24,
    block_rows: int = 400,
    ordered_shingles: int = 1 << 18,
) -> DataFrame:
    """Return ``id, n_shingles long, component_id``, one row per input row.

    Documents link when 100 * common >= ``percent`` * union of their shingle sets.
    ``component_id`` is the smallest id reachable by links.  Null and wordless
    texts have no shingles and link with nothing; rows that repeat an id are
    documents of their own with that id.  A null id is never the smallest; a
    document with a null id alone in its component has a null component.  An
    empty table gives an empty result.

    The other parameters steer the work, not the result: ``extra`` is the d of the
    prefix rule, ``short_list`` the length up to which lists give pairs,
    ``block_rows`` the block size of clusters, and ``ordered_shingles`` how many of
    the most frequent shingles are ordered among each other (a broadcast table; bits
    tell which others are longer than a short list).
    """
    parts = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("binary").alias("mark")), k, percent, extra, short_list, block_rows, ordered_shingles)
    return parts.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _components(docs: DataFrame, k: int, percent: int, extra: int = 4, short_list: int = 24, block_rows: int = 400, ordered_shingles: int = 1 << 18) -> DataFrame:
    """``id, mark, n, root, component_id`` of rows ``id, text, mark``; the root is a number of the component.

    All Python work runs in jobs inside; the plan that is returned only reads their result.
    """
    scratch, sent, conf = Scratch(), [], docs.sparkSession.conf
    partitions = conf.get("spark.sql.shuffle.partitions")
    try:
        with small_batches(docs.sparkSession):
            out = _labelled(docs, k, percent, extra, short_list, block_rows, ordered_shingles, scratch, sent)
    finally:
        conf.set("spark.sql.shuffle.partitions", partitions)
    for table in sent:
        table.unpersist()
    scratch.clear()
    return out


def _labelled(docs: DataFrame, k: int, percent: int, extra: int, short_list: int, block_rows: int, ordered_shingles: int, scratch: Scratch, sent: list[Broadcast]) -> DataFrame:
    spark, stage = docs.sparkSession, scratch.stage
    sets = stage(_sets(docs.select(F.monotonically_increasing_id().alias("rid"), "id", "mark", "text"), k), "jj-sets")
    with_sets = sets.where("sh IS NOT NULL")
    totals = with_sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    # Six bytes a shingle travel, some twice: partitions of about 8 MB, so that sorts and fetches stay small.
    partitions = min(20_000, totals["t"] * 12 // (8 << 20))
    spark.conf.set("spark.sql.shuffle.partitions", str(max(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    # One row stands for each distinct set.  A few copies pass the bits; they link with their like and change nothing.
    same = stage(sets.where("n > 0").groupBy("digest").agg(F.min("rid").alias("rid"), F.min("id").alias("low")), "jj-same")
    one_each = same.select("rid")
    standing = spark.sparkContext.broadcast(_bit_filter(one_each, "rid"))
    sent.append(standing)
    counted = stage(_frequencies(with_sets, totals["t"], standing), "jj-frequent")
    sampled = with_sets.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0)
    sampled = stage(_frequencies(sampled, totals["t"] // SAMPLED, standing, _CUT, _SPACE).withColumn("df", F.col("df") * SAMPLED), "jj-sampled")
    often = counted.where(F.col("df") > short_list).union(sampled)
    top = often.orderBy(F.desc("df"), "key").limit(ordered_shingles).toArrow()
    by_key = np.argsort(top["key"].to_numpy())
    table = spark.sparkContext.broadcast(
        (top["key"].to_numpy()[by_key].astype(np.int64), top["df"].to_numpy()[by_key].astype(np.int64), *_bit_filter(counted, "key"), *_bit_filter(often, "key"))
    )
    sent.append(table)
    sizes = {r["n"]: r["c"] for r in with_sets.where("n <= 32").groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    light = boundary_by_cost(sizes, percent)

    def prefixes_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, key, place) of the prefix shingles that may occur elsewhere."""
        top_keys, top_df, words, bits, often_words, often_bits = table.value
        lens = np.fromiter((len(r) // 6 for r in raws), np.int64, len(raws))
        flat = unpack(b"".join(raws))
        known = flat < _CUT
        rank = np.ones(len(flat), np.int64)
        rank[known] = np.where(_has_bit(words, bits, flat[known]), 2, 0)
        if len(top_keys):
            rank[(rank > 0) & _has_bit(often_words, often_bits, flat)] = 3
            spot = np.minimum(np.searchsorted(top_keys, flat), len(top_keys) - 1)
            rank = np.where(top_keys[spot] == flat, 3 + top_df[spot], rank)
        who, key, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.cumsum(lens)
        for i, s in enumerate(lens.tolist()):
            if s <= light and 100 * s < percent * (light + 1):
                continue
            r = rank[ends[i] - s : ends[i]]
            p = min(s, prefix_size(s, percent) + extra)
            cold = int((r == 0).sum())
            if cold >= p:
                continue  # a prefix of shingles that occur nowhere else
            first = np.argsort(r, kind="stable")[cold:p]
            who.append(np.full(len(first), i))
            key.append(flat[ends[i] - s : ends[i]][first])
            pos.append(np.arange(cold, p))
        return np.concatenate(who), np.concatenate(key), np.concatenate(pos)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits = standing.value
        for b in batches:
            b = b.filter(pa.array(_has_bit(words, bits, b.column("rid").to_numpy())))
            n = b.column("n").to_numpy()
            parts = np.cumsum(n) // 200_000  # rows of about so many shingles at a time
            cuts = [*np.nonzero(np.append(True, parts[1:] != parts[:-1]))[0].tolist(), len(n)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                who, key, pos = prefixes_of(part.column("sh").to_pylist())
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(key), part.column("rid").take(rows), part.column("n").take(rows), pa.array(pos.astype(np.int32))], names=["key", "rid", "n", "pos"])

    def subset_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, size, who = [], [], []
            for i, raw in enumerate(b.column("sh").to_pylist()):
                members = unpack(raw)
                for c in subset_sizes(len(members), percent):
                    for chosen in combinations(range(len(members)), c):
                        key.append(xxhash.xxh3_128_digest(members[list(chosen)].tobytes()))
                        size.append(c)
                        who.append(i)
            rows = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(size, pa.int32()), b.column("rid").take(rows), b.column("n").take(rows)], names=["key", "c", "rid", "n"])

    # Light sets: a star around the smallest set of each subset group.
    subsets = with_sets.where(F.col("n") <= light).select("rid", "n", "sh").mapInArrow(subset_rows, "key binary, c int, rid long, n long").join(one_each, "rid", "left_semi")
    smallest = stage(
        subsets.groupBy("key", "c").agg(F.min(F.struct("n", "rid")).alias("m"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key", "c", F.col("m.n").alias("mn"), F.col("m.rid").alias("mrid")), "jj-smallest"
    )
    light_links = (
        subsets.join(smallest, ["key", "c"]).where(F.col("rid") != F.col("mrid"))
        .where((F.col("n") + F.col("mn")) * percent <= F.col("c") * (100 + percent))
        .select(F.col("rid").alias("x"), F.col("mrid").alias("y")).distinct()
    )

    # Heavy sets: inverted lists that hold more than one set.
    listed = stage(with_sets.select("rid", "n", "sh").mapInArrow(index_rows, "key long, rid long, n long, pos int"), "jj-listed")
    table.unpersist()
    lengths = stage(listed.groupBy("key").agg(F.count(F.lit(1)).alias("len")).where("len > 1"), "jj-lengths")
    lists = stage(listed.join(lengths, "key"), "jj-lists")
    pairs = stage(_short_pairs(lists.where(F.col("len") <= short_list), percent, extra), "jj-pairs")
    clusters = stage(_clusters(lists.where(F.col("len") > short_list), pairs, scratch), "jj-clusters")
    paired, listed_long = (clusters.where(c).select("rid", "cluster") for c in ("paired", "NOT paired"))
    links = _pair_links(paired, pairs, with_sets, percent, block_rows, scratch, sent).union(_cluster_links(listed_long, with_sets, percent, block_rows, scratch, sent)).union(light_links)
    parts = connected_components(stage(links, "jj-links"), "x", "y", scratch=scratch)

    # From rows to the smallest document of each component.
    rooted = same.join(parts.withColumnRenamed("vertex", "rid"), "rid", "left").select("digest", "low", F.coalesce("component", "rid").alias("root"))
    lowest = stage(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "jj-lowest")
    named = stage(rooted.join(lowest, "root").select("digest", "root", "component_id"), "jj-named")
    out = sets.select("id", "mark", "n", "digest").join(named, "digest", "left").select("id", "mark", "n", "root", "component_id")
    return staged(out, "jj-components").df


def _short_pairs(lists: DataFrame, percent: int, extra: int) -> DataFrame:
    """Pairs of sets that share enough of their prefixes to link."""
    l, r = lists.alias("l"), lists.alias("r")
    both = F.col("l.n") + F.col("r.n")
    joined = (
        l.join(r, F.col("l.key") == F.col("r.key")).where(F.col("l.rid") < F.col("r.rid"))
        .where(F.least("l.n", "r.n") * 100 >= F.greatest("l.n", "r.n") * percent)
        .select(F.col("l.rid").alias("x"), F.col("r.rid").alias("y"), both.alias("both"), F.lit(1).alias("shared"))
    )
    # A pair that shares long lists too is compared there; short lists alone must then hold all that it shares.
    need = F.ceil(F.col("both") * percent / (100 + percent))
    return joined.groupBy("x", "y").agg(F.sum("shared").alias("shared"), F.max("both").alias("both")).where(F.col("shared") >= F.least(F.lit(1 + extra), need)).select("x", "y")


def _clusters(long_lists: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """``rid, cluster, paired``: sets of one long list are in one cluster, and, apart from those, sets that pairs of short lists connect.

    Both kinds take the same rounds, as odd and even vertices.
    """
    heads = scratch.stage(long_lists.groupBy("key").agg(F.min("rid").alias("head")), "jj-heads")
    listed = long_lists.join(heads, "key").select((F.col("rid") * 2 + 1).alias("u"), (F.col("head") * 2 + 1).alias("v"))
    parts = connected_components(listed.union(pairs.select(F.col("x") * 2, F.col("y") * 2)), "u", "v", scratch=scratch)
    return parts.select(F.shiftright("vertex", 1).alias("rid"), F.shiftright("component", 1).alias("cluster"), (F.col("vertex") % 2 == 0).alias("paired"))


def _linked_rows(packed: list[bytes], percent: int) -> np.ndarray:
    """Boolean matrix of the links among some sets, from exact counts of common shingles."""
    sets = [unpack(x) for x in packed]
    sizes = np.array([len(x) for x in sets])
    keys, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(keys)) > 1
    number = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    keep = often[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(often.sum()), 4096):  # columns in parts of bounded size
        lo, hi = np.searchsorted(column, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    return common * (100 + percent) >= (sizes[:, None] + sizes[None, :]) * percent


#: Sets of a cluster that all others are compared with first, about, and how often such ones are chosen; clusters up to so many blocks do without.
LEADERS, LEAD_ROUNDS, FEW_BLOCKS = 24, 2, 8


def _forest(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """A spanning forest (``x, y``) of the links in each group of rows ``rid, sh``."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("rid").sort_values("rid")
        hit = _linked_rows(pdf["sh"].tolist(), percent)
        label = np.arange(len(pdf))
        while True:
            low = np.where(hit, label[None, :], len(label)).min(axis=1)
            new = np.minimum(label, low)
            new = np.minimum(new, new[new])
            if (new == label).all():
                break
            label = new
        rid = pdf["rid"].to_numpy()
        own = label != np.arange(len(label))
        return pd.DataFrame({"x": rid[own], "y": rid[label[own]]})

    return dealt.groupBy(*keys).applyInPandas(compare, "x long, y long")


def _cluster_links(clusters: DataFrame, sets: DataFrame, percent: int, block_rows: int, scratch: Scratch, sent: list[Broadcast]) -> DataFrame:
    """Links inside clusters that connect what all links connect.

    In a cluster of few blocks all pairs of blocks are compared.  Of larger ones each block is
    compared with itself and with some sets of the cluster, its leaders, which takes
    work in proportion to the cluster and joins a group of near copies to one part.
    Only sets of different parts are then left to compare: two blocks of one large part
    never meet, and the blocks of the largest part meet those of the others alone.
    Blocks hold sets of one class of sizes, and meet those of the same and the next classes.
    """
    stage = scratch.stage
    members = stage(clusters, "jj-clusters")
    bounds = F.array(*[F.lit(6 * n).cast("long") for n in size_classes(percent)])
    klass = F.size(F.filter(bounds, lambda n: n <= F.octet_length("sh")))
    bodies = stage(_bodies(sets, members.select("rid"), sent).join(members, "rid").withColumn("klass", klass), "jj-members")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    sizes = stage(sizes, "jj-blocks")
    few = bodies.join(sizes.where(F.col("blocks") <= FEW_BLOCKS), "cluster").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    few = few.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    links = stage(_forest(few.select("cluster", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "rid", "sh"), ["cluster", "bi", "bj"], percent), "jj-few")
    large = stage(sizes.where(F.col("blocks") > FEW_BLOCKS).select("cluster"), "jj-large")
    if large.isEmpty():
        return links
    open_rows = members.join(large, "cluster", "left_semi")
    for number in range(LEAD_ROUNDS):
        sizes = open_rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
        sizes = stage(sizes.select("cluster", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("rows") / LEADERS).alias("every")), "jj-blocks")
        rows = bodies.join(open_rows.select("rid"), "rid", "left_semi")
        placed = rows.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rid", F.lit(number)), F.col("blocks")).cast("int"))
        led = placed.where((F.col("blocks") > 1) & (F.pmod(F.xxhash64("rid", F.lit(number), F.lit(7)), F.col("every")) == 0))
        led = led.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = placed.select("cluster", "block", "rid", "sh").union(led.select("cluster", "block", "rid", "sh"))
        found = stage(_forest(dealt, ["cluster", "block"], percent), "jj-led")
        links = stage(links.union(found), "jj-led")
        connected = connected_components(links, "x", "y", scratch=scratch).select(F.col("vertex").alias("rid"), "component")
        parts = members.join(large, "cluster", "left_semi").join(connected, "rid", "left").select("rid", "cluster", F.coalesce("component", "rid").alias("part"))
        parts = stage(parts, "jj-parts")
        counts = stage(parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("rows")), "jj-counts")
        open_rows = stage(parts.join(counts.where(F.col("rows") < block_rows), ["cluster", "part"], "left_semi").select("rid", "cluster"), "jj-open")
    # Blocks: of a large part alone, or of small parts together (pure = -1).
    shape = counts.groupBy("cluster").agg(F.max(F.struct("rows", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts"))
    pure = F.when(F.col("rows") < block_rows, F.lit(-1)).otherwise(F.col("part"))
    shelf = parts.join(counts, ["cluster", "part"]).join(shape.where("parts > 1"), "cluster").join(bodies.select("rid", "klass"), "rid").select("rid", "cluster", "part", pure.alias("pure"), "klass", (pure == F.col("main")).alias("in_main"))
    shelves = shelf.groupBy("cluster", "pure", "klass").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
    number = F.pmod(F.xxhash64(F.when(F.col("pure") < 0, F.col("part")).otherwise(F.col("rid"))), F.col("blocks"))
    placed = shelf.join(shelves, ["cluster", "pure", "klass"]).select("rid", "cluster", F.struct("pure", "klass", number.alias("number")).alias("block"), "in_main")
    placed = stage(placed, "jj-placed")
    blocks = stage(placed.select("cluster", "block", "in_main").distinct(), "jj-meeting")
    a, b = blocks.where("NOT in_main").alias("a"), blocks.alias("b")
    apart = (F.col("a.block.pure") < 0) | (F.col("a.block.pure") != F.col("b.block.pure"))
    near = F.abs(F.col("a.block.klass") - F.col("b.block.klass")) <= 1
    once = F.col("b.in_main") | (F.col("a.block") <= F.col("b.block"))
    meet = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & near & apart & once).select(F.col("a.cluster").alias("cluster"), F.col("a.block").alias("bi"), F.col("b.block").alias("bj"))
    sides = meet.select("cluster", F.explode(F.array_distinct(F.array("bi", "bj"))).alias("block"), "bi", "bj")
    dealt = placed.select("rid", "cluster", "block").join(sides, ["cluster", "block"]).join(bodies.select("rid", "sh"), "rid").select("cluster", "bi", "bj", "rid", "sh")
    return links.union(_forest(dealt, ["cluster", "bi", "bj"], percent))


#: Sets of small groups that are compared together, about.
PACKED = 64


def _pair_links(members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, block_rows: int, scratch: Scratch, sent: list[Broadcast]) -> DataFrame:
    """Links among sets that pairs connect (``rid, cluster``), which connect what all links connect.

    A group of at most a block's sets is compared as a whole, small ones several at a time: each set
    travels once, however many pairs it is in.  Pairs of larger groups are checked one by one.
    """
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("rows"))
    placed = scratch.stage(members.join(sizes, "cluster"), "jj-paired")
    told = placed.agg(F.count_if(F.col("rows") <= PACKED).alias("packed"), F.count_if(F.col("rows") > block_rows).alias("beyond")).first()
    together = F.pmod(F.xxhash64("cluster"), F.lit(-(-told["packed"] // PACKED) or 1)).cast("long")
    block = F.when(F.col("rows") > PACKED, F.col("cluster")).otherwise(-1 - together)
    dealt = placed.where(F.col("rows") <= block_rows).select("rid", block.alias("block"))
    links = _forest(_bodies(sets, dealt.select("rid"), sent).join(dealt, "rid"), ["block"], percent)
    if told["beyond"]:
        beyond = placed.where(F.col("rows") > block_rows).select(F.col("rid").alias("x"))
        links = links.union(_verified(pairs.join(beyond, "x", "left_semi"), sets, percent, scratch, sent))
    return links


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, sent: list[Broadcast]) -> DataFrame:
    """Those of the pairs (x, y) that link, by their exact sets."""
    wanted = scratch.stage(pairs.select(F.col("x").alias("rid")).union(pairs.select(F.col("y").alias("rid"))).distinct(), "jj-wanted")
    own = scratch.stage(_bodies(sets, wanted, sent), "jj-bodies")
    full = pairs.join(own.select(F.col("rid").alias("x"), F.col("sh").alias("sx")), "x").join(own.select(F.col("rid").alias("y"), F.col("sh").alias("sy")), "y")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = []
            for a, z in zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True):
                a, z = unpack(a), unpack(z)
                common = len(np.intersect1d(a, z, assume_unique=True))
                right.append(common * (100 + percent) >= (len(a) + len(z)) * percent)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(right, pa.bool_()))

    return full.select("x", "y", "sx", "sy").mapInArrow(linked, "x long, y long")


def keep_one_per_component(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with its own columns: that of the smallest id.

    The decision is made by row.  Ids may repeat: rows with one id and different
    texts are documents of their own, each in its own component; of rows with the
    same id and text one stays.  A document with a null id stays only if its
    component has no other id.  Null and wordless texts all stay, and an empty
    table stays empty.  Columns of any names pass through.
    """
    mark = F.unhex(F.md5(F.col(text_col)))
    parts = _components(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark.alias("mark")), k, percent).where("n > 0")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    rows = parts.groupBy("root", "id", "mark").agg(F.count(F.lit(1)).alias("rows"))
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    judged = rows.join(best, "root").select("id", "mark", "rows", (order == F.col("best")).alias("first"))
    judged = staged(judged.where("NOT first OR rows > 1"), "jj-judged").df
    own = [F.col(f"`{c}`").alias(f"own_{n}") for n, c in enumerate(docs.columns)]
    names = [F.col(f"own_{n}").alias(c) for n, c in enumerate(docs.columns)]
    alike = F.col("_id").eqNullSafe(F.col("id")) & (F.col("_mark") == F.col("mark"))
    keys = [F.col(id_col).alias("_id"), mark.alias("_mark")]
    clear, hits = _parted(docs.select(*own, *keys), judged)
    # Keys alone tell which hits are not judged; texts are joined only where a second table of bits may hold their key.
    spared = _parted(docs.select(*keys), judged)[1].join(judged, alike, "left_anti").select(F.col("_id").alias("id"), F.col("_mark").alias("mark")).distinct()
    unsure = _parted(hits, staged(spared, "jj-spared").df, seed=1)[1]
    met = clear.union(unsure.join(judged, alike, "left_anti"))
    repeated = judged.where("first")
    if not repeated.isEmpty():
        again = hits.join(repeated, alike, "left_semi")
        met = met.union(again.dropDuplicates(["_id", "_mark"]))
    return met.select(*names)


def _parted(keyed: DataFrame, listed: DataFrame, most_words: int = 1 << 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows ``_id, _mark`` that are not listed (``id, mark``), and those that may be.

    A broadcast table of bits, of bounded size, tells them apart, so that a join with what is
    listed shuffles few texts beyond its own.  Where it is full, more rows are joined and none is lost.
    """
    rows, words = listed.count(), 1 << 10
    while words < min(rows // 2, most_words):  # 32 bits a row
        words *= 2
    place = lambda *key: F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(64 * words))
    bits = listed.select(place("id", "mark").alias("at")).groupBy(F.shiftright("at", 6).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("_bits"))
    placed = keyed.withColumn("_at", place("_id", "_mark"))
    placed = placed.join(F.broadcast(bits), F.shiftright("_at", 6) == F.col("_word"), "left")
    hit = F.expr("coalesce(shiftright(_bits, CAST(_at % 64 AS INT)) & 1L, 0L) = 1L")
    return placed.where(~hit).select(*keyed.columns), placed.where(hit).select(*keyed.columns)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_jaccard_join": op7_jaccard_join}
ORACLE = {
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, ws, least(4, len(ws)) AS l, unnest(range(1, len(ws) - least(4, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + l - 1], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT s.doc_id, n.n, s.g, row_number() OVER (PARTITION BY s.doc_id ORDER BY q.df, s.g) AS r
      FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) q USING (g)),
x AS (SELECT doc_id, n, g FROM f WHERE r <= n - (85 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
k AS (SELECT a, b FROM c JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b AND sb.g = sa.g
      GROUP BY a, b, na, nb HAVING 185 * count(*) >= 85 * (na + nb)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
t(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT t.id, e.b FROM t JOIN e ON t.reach = e.a),
m AS (SELECT id, min(reach) AS component_id FROM t GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
}
