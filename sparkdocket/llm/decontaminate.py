"""Benchmark decontamination by Wu-Manber multi-pattern search.

The alphabet is words, not characters.  Every benchmark item gives windows of
``window`` consecutive words; an item with fewer words is one window.  Windows
of one length share two tables.  The shift table has, for the hash of a block of
two words, the least distance by which the search may move on (colliding blocks
share the smaller).  A block at distance 0 leads to the bucket of windows with
that hash at their end and that of their first block at their beginning (the
prefix table tells at once whether there are any), and the words themselves are
then compared.

The tables are numpy arrays, made for at most ``block_words`` benchmark words at a
time and checked against ``table_bytes`` before they are broadcast.  The benchmark
passes through the driver one block at a time.  One block is a narrow pass over
the documents; of more blocks each is a pass of its own, whose broadcast is freed
before the next, and their few hits meet in a grouping by row number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.columns import add_columns, texts_as_bytes
from sparkdocket.plans.staging import stage

#: Words of lower-cased UTF-8: any byte that is not ASCII punctuation, space or control.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; a null has none."""
    return _WORD.findall(text.lower()) if text else []


class WordHashes(dict):
    """64-bit hashes of words, kept for words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _block_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the blocks of ``size`` (1 or 2) words that end at each word but the first size - 1."""
    with np.errstate(over="ignore"):
        out = h if size == 1 else h[1:] + h[:-1] * _MIX
        out = (out ^ (out >> np.uint64(31))) * _MIX
        return out ^ (out >> np.uint64(29))


def _both(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One hash of a window's first and last blocks."""
    with np.errstate(over="ignore"):
        out = (first ^ (last * _MIX)) * _MIX
        return out ^ (out >> np.uint64(32))


class _Windows:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, n: int, starts: np.ndarray, owners: np.ndarray, hashes: np.ndarray):
        self.n, self.block = n, min(2, n)
        self.bits = max(10, min(22, int(np.ceil(np.log2(8 * len(starts) * (n - self.block + 1))))))
        self.shift = np.full(1 << self.bits, n - self.block + 1, np.uint8 if n < 250 else np.int32)
        blocks = _block_hashes(hashes, self.block) if len(hashes) >= self.block else np.zeros(0, np.uint64)
        for back in range(n - self.block, -1, -1):  # the last writes are the smallest
            self.shift[self.slots(blocks[starts + n - self.block - back])] = back
        keys = _both(blocks[starts], blocks[starts + n - self.block])
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts, self.owners = keys[order], starts[order].astype(np.int32), owners[order].astype(np.int32)
        self.prefix = np.zeros(1 << self.bits, np.uint8)
        self.prefix[self.slots(keys)] = 1

    def slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.shift, self.prefix, self.keys, self.starts, self.owners))


class WindowTable:
    """The windows of some items, to be searched for in documents."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.items = [i for i, _ in items]
        every = [w for _, words in items for w in words]
        self.text = b" ".join(every)
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in every), np.uint64, len(every))
        counts = np.array([len(words) for _, words in items], np.int64)
        begins = np.cumsum(counts) - counts
        by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (begin, count) in enumerate(zip(begins.tolist(), counts.tolist(), strict=True)):
            if count:
                n = min(window, count)
                starts = np.arange(begin, begin + count - n + 1)
                by_length.setdefault(n, []).append((starts, np.full(len(starts), k)))
        self.classes = [_Windows(n, np.concatenate([s for s, _ in got]), np.concatenate([o for _, o in got]), hashes) for n, got in sorted(by_length.items())]

    def nbytes(self) -> int:
        return len(self.text) + self.at.nbytes + sum(c.nbytes() for c in self.classes)

    def search(self, words: list[bytes], known: dict | None = None) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges [start, end) that lie in occurrences, and the items that occur."""
        found: set[int] = set()
        ranges: list[tuple[int, int]] = []
        known = WordHashes() if known is None else known
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for c in self.classes:
            n, last, size = c.n, c.n - 1, len(words)
            if size < n:
                continue
            blocks = _block_hashes(hashes, c.block)
            keys = _both(blocks[: size - n + 1], blocks[n - c.block :])
            shifts, some, lag = c.shift[c.slots(blocks)], c.prefix[c.slots(keys)].tobytes(), c.block - 1
            shifts = shifts.tobytes() if shifts.dtype == np.uint8 else shifts.tolist()
            while last < size:
                step = shifts[last - lag]
                if step:
                    last += step
                    continue
                first = last - n + 1
                if some[first]:
                    w, key = int(np.searchsorted(c.keys, keys[first])), keys[first]
                    here = b" ".join(words[first : last + 1])
                    while w < len(c.keys) and c.keys[w] == key:
                        begin = self.at[c.starts[w]]
                        if self.text[begin : self.at[c.starts[w] + n] - 1] == here:
                            found.add(int(c.owners[w]))
                            ranges.append((first, last + 1))
                        w += 1
                last += 1
        return _merge(ranges), {self.items[k] for k in found}


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in blocks of bounded size, streamed to the driver one partition at a time.

    An item of more words than a block holds is a block of its own.
    """
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for row in rows.where("i IS NOT NULL AND t IS NOT NULL").toLocalIterator():
        words = words_of(bytes(row["t"]))
        if words:
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((row["i"], words))
            size += len(words)
    if block:
        yield block


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FIELDS = [
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN)),
]


def _searcher(table, text_col: str):
    """What a task of a pass computes for each batch of texts."""
    arrow_span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def per_task():
        known = WordHashes()
        return lambda batch: compute(batch, known)

    def compute(batch: pa.RecordBatch, known: WordHashes) -> list[pa.Array]:
        n_words, n_hit, items, spans = [], [], [], []
        for text in texts_as_bytes(batch, text_col):
            words = words_of(text)
            ranges, found = table.value.search(words, known) if words else ([], set())
            n_words.append(len(words))
            n_hit.append(sum(b - a for a, b in ranges))
            items.append(sorted(found))
            spans.append([{"start": a, "end": b} for a, b in ranges])
        return [
            pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
            pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(arrow_span)),
        ]

    return per_task


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_words: int = 500_000,
    table_bytes: int = 64 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``n_words long, n_hit long, item_ids array<string>, spans array<struct<start,end>>``.

    ``spans`` are word ranges covered by benchmark windows.  Null or wordless
    texts and an empty benchmark give zeros and empty arrays.  Items with a null
    id are ignored; rows that repeat an item id pool their windows.  Repeated
    documents are judged each for itself; a clashing input column is replaced.
    ``keep`` names the input columns to return (all where None).

    A block whose tables exceed ``table_bytes`` is halved until they do not; a
    single item that exceeds them alone is refused.
    """
    spark: SparkSession = docs.sparkSession
    new = {f.name for f in _FIELDS}
    through = [c for c in docs.columns if c.lower() not in new and (keep is None or c in keep)]

    def tables() -> Iterator[WindowTable]:
        for block in _blocks(benchmark, item_col, item_text_col, block_words):
            waiting = [block]
            while waiting:
                part = waiting.pop(0)
                table = WindowTable(part, window)
                if table.nbytes() <= table_bytes:
                    yield table
                elif len(part) == 1:
                    raise ValueError(f"benchmark item {part[0][0]!r} needs {table.nbytes()} bytes of tables; raise table_bytes")
                else:
                    waiting = [part[: len(part) // 2], part[len(part) // 2 :], *waiting]

    made = tables()
    first, second = next(made, None) or WindowTable([], window), next(made, None)
    if second is None:
        only = spark.sparkContext.broadcast(first)
        return add_columns(docs, _FIELDS, keep=through, per_task=_searcher(only, text_col))
    slim = docs.select(*[F.col(c).alias(f"own_{k}") for k, c in enumerate(through)], F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    numbered = stage(slim, "leak-docs").df
    passes: list[DataFrame] = []
    words = None
    while first is not None:
        shared = spark.sparkContext.broadcast(first)
        hits = add_columns(numbered.select("_row", "_text"), _FIELDS, keep=["_row"], per_task=_searcher(shared, "_text"))
        if words is None:  # the first pass counts the words of all rows
            words = stage(hits, "leak-pass").df
            passes.append(words.where("n_hit > 0"))
        else:
            passes.append(stage(hits.where("n_hit > 0"), "leak-pass").df)
        shared.unpersist()
        first, second = second, next(made, None)
    rest = passes[0].select("_row", "item_ids", "spans")
    for p in passes[1:]:
        rest = rest.union(p.select("_row", "item_ids", "spans"))
    # As many rows per document as there are blocks, at most.
    flat = rest.groupBy("_row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("all"))
    start = F.array().cast("array<struct<start:int,end:int>>")

    def joined(done, x):
        last = F.element_at(done, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        overlap = (F.size(done) > 0) & (x["start"] <= F.coalesce(F.try_element_at(done, F.lit(-1))["end"], F.lit(-1)))
        return F.when(overlap, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    merged = flat.select("_row", "item_ids", F.aggregate("all", start, joined).alias("spans"))
    merged = merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"])))
    none = F.array().cast("array<string>")
    out = numbered.join(words.select("_row", "n_words"), "_row").join(merged, "_row", "left")
    own = [F.col(f"own_{k}").alias(c) for k, c in enumerate(through)]
    return out.select(*own, "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("spans", start).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """Documents in which no benchmark window occurs, with their own columns only.

    The text goes to Python once and comes back with the document's other columns.
    """
    own = [F.col(c).alias(f"_{k}") for k, c in enumerate(docs.columns)]
    judged = find_contamination(docs.select(*own), benchmark, text_col=f"_{docs.columns.index(text_col)}", **options)
    return judged.where("n_hit = 0").select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLE = {
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT item_id, ws, least(10, len(ws)) AS l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p
       FROM i WHERE len(ws) > 0),
iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(ws[p:p + l - 1], ' ') AS k, l FROM ip),
ls AS (SELECT DISTINCT l FROM iw),
dp AS (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, ls WHERE len(ws) >= l),
dw AS (SELECT r, p, l, array_to_string(ws[p:p + l - 1], ' ') AS k FROM dp),
m AS (SELECT DISTINCT r, p, l, item FROM dw JOIN iw USING (k, l)),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM m) GROUP BY r),
s AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN s USING (r)
""",
}
