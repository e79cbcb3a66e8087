"""Ranked lexical search by dual trees.

Documents and items are vectors over terms: an item's coordinate is the weight of
a term times its occurrences there, a document's the damped frequency of the term.
A score is their product.  Items and documents are dealt into blocks of bounded
size, and each pair of blocks is one group of a co-grouping: no block passes the
driver and nothing that grows is broadcast.  Inside a group both sides are
binary trees whose nodes hold the maximum of each coordinate.  The product of two
nodes' maxima bounds every score between them; where it does not reach the weakest
kth score of the node's items, the whole batch is left out.

Before that, one document in ``PILOT`` is searched in the same way.  The kth score
found there is one that every result must reach, so groups start with it and
hand on few rows.  All counts are exact; documents are read and split once.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdocket.plans.staging import Scratch, stage

#: Bytes of terms lower-cased; all other ASCII becomes a space.
_TERM_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Size of the filter for terms of items, in bits (2 MB).
_BITS = 1 << 24
#: Of so many documents one is searched first.
PILOT = 64
#: Non-zero coordinates in a block of documents and of items, about.
DOC_ENTRIES, ITEM_ENTRIES = 1 << 19, 50_000
_DOC_LEAF, _ITEM_LEAF, _BATCH = 32, 8, 16
_LAST = np.iinfo(np.int64).max


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters, digits and all beyond ASCII, A-Z lower-cased; a null has none."""
    return text.translate(_TERM_BYTES).split() if text else []


class _Wanted(dict):
    """Whether a term may be one of the items' (by the bit filter), kept for terms met before."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) > 300_000:
            self.clear()
        h = zlib.crc32(term) % _BITS
        yes = self[term] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return yes


def _counted(rows: DataFrame, bits=None) -> DataFrame:
    """``id, n, terms, counts`` per row of ``id, text``; with ``bits``, only the terms that it lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(bits.value) if bits is not None else None
        for b in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                found = terms_of(text)
                held = Counter(found)
                kept = list(held) if wanted is None else [t for t in held if wanted[t]]
                terms += kept
                counts += map(held.__getitem__, kept)
                sizes.append(len(found))
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(at, pa.array(counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], names=["id", "n", "terms", "counts"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, terms array<binary>, counts array<long>")


def _filter_bits(items: DataFrame) -> bytes:
    """The bit filter over all terms of items: at most 262,144 rows of eight bytes come here."""
    h = F.pmod(F.crc32("term"), F.lit(_BITS).cast("long"))
    bits = items.select(F.explode("terms").alias("term")).select(h.alias("h"))
    words = bits.groupBy((F.col("h") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 AS int)))").alias("bits")).toArrow()
    out = np.zeros(_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


class _Vectors:
    """Rows of sparse vectors over the columns of a block, ordered so that alike ones stand together."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, count: int, weight: np.ndarray, tie: np.ndarray):
        # The column that counts most in a row decides its place, then the tie.
        strength = vals * weight[cols]
        by_row = np.lexsort((-strength, rows))
        first = np.ones(len(rows), bool)
        first[1:] = rows[by_row][1:] != rows[by_row][:-1]
        top = np.zeros(count, np.int64)
        top[rows[by_row][first]] = cols[by_row][first]
        self.order = np.lexsort((tie, top))
        place = np.empty(count, np.int64)
        place[self.order] = np.arange(count)
        rows = place[rows]
        by_place = np.argsort(rows, kind="stable")
        self.rows, self.cols, self.vals = rows[by_place], cols[by_place], vals[by_place]
        self.starts = np.searchsorted(self.rows, np.arange(count + 1))
        self.count = count


def _leaves(count: int, size: int) -> int:
    """A power of two of leaves that hold ``count`` rows."""
    return 1 << max(0, math.ceil(math.log2(max(1, math.ceil(count / size)))))


class _DocTree:
    """Coordinate maxima, smallest ids and rows of the nodes; level 0 is the root."""

    def __init__(self, v: _Vectors, columns: int, ids: np.ndarray):
        self.v, self.ids = v, ids[v.order]
        leaves = max(1, math.ceil(v.count / _DOC_LEAF))
        top = np.zeros((leaves, columns))
        np.maximum.at(top, (v.rows // _DOC_LEAF, v.cols), v.vals.astype(float))
        least = np.minimum.reduceat(self.ids, np.arange(0, v.count, _DOC_LEAF))
        self.levels = [(top, least)]
        while len(self.levels[0][0]) > 1:
            top, least = self.levels[0]
            at = np.arange(0, len(top), 2)
            self.levels.insert(0, (np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        both = np.concatenate([2 * nodes, 2 * nodes + 1])
        return np.sort(both[both < len(self.levels[level + 1][0])])

    def dense(self, leaves: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of some leaves over the columns that ``place`` numbers, and their row numbers."""
        rows = np.concatenate([np.arange(x * _DOC_LEAF, min((x + 1) * _DOC_LEAF, self.v.count)) for x in leaves])
        starts, ends = self.v.starts[rows], self.v.starts[rows + 1]
        sizes = ends - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        col, row = place[self.v.cols[at]], np.repeat(np.arange(len(rows)), sizes)
        out = np.zeros((len(rows), width))
        out[row[col >= 0], col[col >= 0]] = self.v.vals[at][col >= 0]
        return out, rows


class _Search:
    """One block of items against one block of documents."""

    def __init__(self, docs: _DocTree, items: _Vectors, columns: int, k: int, floor: np.ndarray, floor_id: np.ndarray):
        self.docs, self.items, self.columns, self.k = docs, items, columns, k
        # A document enters if its score is above an item's floor, or equal with an id up to the floor's.
        self.floor, self.floor_id = floor[items.order], floor_id[items.order]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * items.count
        self.batches = 0
        if items.count and docs.v.count:
            self._visit(0, _leaves(items.count, _ITEM_LEAF) * _ITEM_LEAF, 0, np.array([0]))

    def _maxima(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns of items a to b and their largest coordinates."""
        s, e = self.items.starts[a], self.items.starts[b]
        cols, at = np.unique(self.items.cols[s:e], return_inverse=True)
        vals = np.zeros(len(cols))
        np.maximum.at(vals, at, self.items.vals[s:e].astype(float))
        return cols, vals

    def _alive(self, bound: np.ndarray, least_id: np.ndarray, a: int, b: int) -> np.ndarray:
        weakest = self.floor[a:b].min()
        latest = self.floor_id[a:b][self.floor[a:b] == weakest].max()
        return (bound > weakest) | ((bound == weakest) & (least_id <= latest))

    def _bounds(self, level: int, nodes: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        bound = self.docs.levels[level][0][nodes[:, None], cols] @ vals
        # Whole numbers are exact in doubles up to 2^53; beyond, the bound is widened.
        return bound if bound.max(initial=0) < 2**53 else bound * (1 + 1e-9)

    def _visit(self, a: int, b: int, level: int, nodes: np.ndarray) -> None:
        """Items a to b (a node of their tree) against nodes of one level of the documents' tree."""
        end = min(b, self.items.count)
        if a >= end:
            return
        cols, vals = self._maxima(a, end)
        bound = self._bounds(level, nodes, cols, vals)
        alive = self._alive(bound, self.docs.levels[level][1][nodes], a, end)
        nodes, bound = nodes[alive], bound[alive]
        if not len(nodes):
            return
        if b - a > _ITEM_LEAF:
            level, nodes = (level, nodes) if level + 1 == len(self.docs.levels) else (level + 1, self.docs.children(level, nodes))
            self._visit(a, (a + b) // 2, level, nodes)
            self._visit((a + b) // 2, b, level, nodes)
        elif level + 1 < len(self.docs.levels):
            self._visit(a, b, level + 1, self.docs.children(level, nodes))
        else:
            self._score(a, end, nodes, bound, cols)

    def _score(self, a: int, b: int, leaves: np.ndarray, bound: np.ndarray, cols: np.ndarray) -> None:
        """Exact scores, the most promising leaves first; what the floors then exclude is left out."""
        place = np.full(self.columns, -1)
        place[cols] = np.arange(len(cols))
        s, e = self.items.starts[a], self.items.starts[b]
        q = np.zeros((b - a, len(cols)))
        q[self.items.rows[s:e] - a, place[self.items.cols[s:e]]] = self.items.vals[s:e]
        order = np.argsort(-bound, kind="stable")
        leaves, bound = leaves[order], bound[order]
        least = self.docs.levels[-1][1]
        while len(leaves):
            now, leaves = leaves[:_BATCH], leaves[_BATCH:]
            exact = bound[0] < 2**53
            bound = bound[_BATCH:]
            x, rows = self.docs.dense(now, place, len(cols))
            scores = (x @ q.T).astype(np.int64) if exact else x.astype(np.int64) @ q.astype(np.int64).T
            self.batches += 1
            for i in range(a, b):
                self._enter(i, scores[:, i - a], self.docs.ids[rows])
            alive = self._alive(bound, least[leaves], a, b)
            leaves, bound = leaves[alive], bound[alive]

    def _enter(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores > 0) & ((scores > self.floor[i]) | ((scores == self.floor[i]) & (ids <= self.floor_id[i])))
        if not good.any():
            return
        scores, ids = np.concatenate([self.best[i][0], scores[good]]), np.concatenate([self.best[i][1], ids[good]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.best[i] = scores[order], ids[order]
        if len(order) == self.k:
            # Those that come later must be better than the kth.
            kth, kth_id = self.best[i][0][-1], self.best[i][1][-1]
            self.floor[i], self.floor_id[i] = kth, kth_id - 1 if kth_id > np.iinfo(np.int64).min else kth_id


def _sparse(terms: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Row numbers, codes and the terms that the codes stand for."""
    lists = terms.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return rows, flat.indices.to_numpy().astype(np.int64), flat.dictionary.to_pylist()


def search_block(docs: pa.Table, items: pa.Table, k: int, documents: int, length: int) -> tuple[pa.Table, int]:
    """``item, id, score``: up to ``k`` documents of the block for each item; and the batches scored."""
    item_rows, item_cols, names = _sparse(items["terms"])
    q = items["weights"].combine_chunks().flatten().to_numpy().astype(np.int64)
    of_term = {t: c for c, t in enumerate(names)}
    rows, codes, terms = _sparse(docs["terms"])
    col = np.array([of_term.get(t, -1) for t in terms] or [0], np.int64)[codes]
    tf, n = docs["counts"].combine_chunks().flatten().to_numpy().astype(np.int64), docs["n"].to_numpy().astype(np.int64)
    m = 100 - 25 + (25 * n * documents) // length
    use = col >= 0
    rows, col, tf = rows[use], col[use], tf[use]
    x = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
    ids = docs["id"].fill_null(_LAST).to_numpy()
    heaviest = np.zeros(len(names), np.int64)
    np.maximum.at(heaviest, item_cols, q)
    tree = _DocTree(_Vectors(rows, col, x, len(ids), heaviest.astype(float), m), len(names), ids)
    held = _Vectors(item_rows, item_cols, q, items.num_rows, np.ones(len(names)), np.arange(items.num_rows))
    floor, floor_id = items["floor"].to_numpy().astype(np.int64), items["floor_id"].to_numpy().astype(np.int64)
    found = _Search(tree, held, len(names), k, floor, floor_id)
    keys = items["item"].to_numpy()[held.order]
    out_ids = np.concatenate([b[1] for b in found.best])
    out = {
        "item": pa.array(np.repeat(keys, [len(b[0]) for b in found.best]), pa.int64()),
        "id": pa.array(out_ids, pa.int64(), mask=out_ids == _LAST),
        "score": pa.array(np.concatenate([b[0] for b in found.best]), pa.int64()),
    }
    return pa.table(out), found.batches


def _search(vectors: DataFrame, items: DataFrame, doc_blocks: int, item_blocks: int, k: int, documents: int, length: int) -> DataFrame:
    """Best ``k`` per block of documents, of ``item, id, score``."""
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select(F.pmod("row", F.lit(doc_blocks)).cast("int").alias("d"), number(item_blocks).alias("i"), "id", "n", "terms", "counts")
    right = items.select(number(doc_blocks).alias("d"), F.pmod(F.xxhash64("item"), F.lit(item_blocks)).cast("int").alias("i"), "item", "terms", "weights", "floor", "floor_id")

    def run(docs: pa.Table, held: pa.Table) -> pa.Table:
        if not docs.num_rows or not held.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("item", "id", "score")})
        return search_block(docs, held, k, documents, length)[0]

    return left.groupBy("d", "i").cogroup(right.groupBy("d", "i")).applyInArrow(run, "item long, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    doc_entries: int = DOC_ENTRIES, item_entries: int = ITEM_ENTRIES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item, with scores above 0.

    The score of a document is the sum, over the item's terms with repeats, of
    ``w * ((10^9 tf) div (1000 tf + 12 m))`` with ``w = floor(1000 ln((2N+2)/(2df+1)))``
    and ``m = 75 + (25 n N) div L``; N counts the documents with a term.  Equal
    scores go by ascending id, a null id last.  Ids of documents are whole numbers.

    Each document row is a document of its own, rows with equal ids and repeated
    rows too; item rows that repeat id and text are one item, and items with equal
    ids but other texts are ranked each by itself.  Null and empty texts have no
    terms: such items get no rows.  Very long texts are read whole; further columns
    are not read; empty tables give an empty one.
    """
    spark, scratch = docs.sparkSession, Scratch()
    asked = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{item_text_col}`").alias("text")).distinct()
    held = scratch.stage(_counted(asked).where("n > 0").withColumn("item", F.monotonically_increasing_id()), "lex-items")
    bits = spark.sparkContext.broadcast(_filter_bits(held))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    vectors = scratch.stage(_counted(rows, bits).where("n > 0").withColumn("row", F.monotonically_increasing_id()), "lex-vectors")
    bits.destroy()
    size = vectors.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("length"), F.sum(F.size("terms")).alias("entries")).first()
    documents, length = size.documents, size.length or 1
    # df of the terms that passed the filter; the join leaves those of items.
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1))).cast("long")
    pairs = held.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("c"))
    weighted = pairs.join(df, "term").select("item", "term", (F.col("c") * weight).alias("weight")).where("weight > 0")
    sides = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    sides = scratch.stage(sides, "lex-weights")
    item_blocks = max(1, math.ceil((sides.agg(F.sum(F.size("terms"))).first()[0] or 0) / item_entries))
    doc_blocks = max(1, math.ceil((size.entries or 0) / doc_entries))
    usable = vectors.where(F.size("terms") > 0)
    open_floor = sides.withColumns({"floor": F.lit(0).cast("long"), "floor_id": F.lit(int(np.iinfo(np.int64).min)).cast("long")})
    pilot = usable.where(F.pmod(F.xxhash64("row"), F.lit(PILOT)) == 0)
    first = _search(pilot, open_floor, math.ceil(doc_blocks / PILOT), item_blocks, k, documents, length)
    reached = _ranked(first, k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"), F.coalesce("id", F.lit(int(_LAST))).alias("floor_id"))
    floors = scratch.stage(open_floor.drop("floor", "floor_id").join(reached, "item", "left").withColumns({"floor": F.coalesce("floor", F.lit(0).cast("long")), "floor_id": F.coalesce("floor_id", F.lit(int(np.iinfo(np.int64).min)).cast("long"))}), "lex-floors")
    found = _ranked(_search(usable, floors, doc_blocks, item_blocks, k, documents, length), k)
    out = found.join(held.select("item", F.col("id").alias("item_id")), "item")
    done = stage(out.select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score"), "lex-ranked").df
    scratch.clear()
    return done


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_ranked_search": op11_ranked_search}

_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE = {
    "op11_ranked_search": f"""
    WITH dt AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
    size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM dt GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM size),
    damped AS (SELECT doc_id, 100 - 25 + ((25 * n * docs) // total) AS m FROM size, whole),
    asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
    freq AS (SELECT term, count(*) AS df FROM dt WHERE term IN (SELECT term FROM asked) GROUP BY term),
    weight AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM freq, whole),
    scored AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
               FROM asked JOIN weight USING (term) JOIN dt USING (term) JOIN damped USING (doc_id) GROUP BY ALL),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 20"""
}
