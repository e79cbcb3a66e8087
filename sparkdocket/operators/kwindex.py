"""A written keyword index: immutable segments, tombstones, merges.

Tables of the store (see ``plans.segments``)::

    postings/seg=N/bucket=B   item, field, term, tf, len, positions; a bucket has the terms of one hash
    docs/seg=N                item, fingerprint, lens (tokens of each field that has any)

The manifest has statistics and the tokenizer's fingerprint.  A query reads the
buckets of its terms; inside a bucket files are sorted by term, so that most of
their row groups are skipped.  ``len`` stands in each posting and the statistics in the manifest: to
score, nothing else is read.  A frequent term's postings are dealt over ``spread``
files by item, and over more where a change has many tokens.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdocket.operators import kwquery
from sparkdocket.operators.keyword import LONGEST, TOKEN, changed, fingerprints, terms_of, tokens_of
from sparkdocket.plans.segments import SegmentStore, StaleStore
from sparkdocket.plans.staging import Scratch

#: What an index must have been tokenized with to be searched.
TOKENIZER = hashlib.sha256(f"{TOKEN}|{LONGEST}".encode()).hexdigest()[:16]
#: Leaves of a query that share a column of bits.
_BITS = 60
#: Tokens whose postings one file holds, about.
_TOLD = 2_000_000


def _lengths(texts: DataFrame, key: str) -> DataFrame:
    """``key, lens`` of ``key`` and a lower-cased text for each field: the number of tokens of each field that has any."""
    names = [c for c in texts.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
            lens = [[{"field": n, "len": size} for n, t in zip(names, row, strict=True) if (size := len(terms_of(t)))] for row in zip(*fields, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(key)), pa.array(lens, pa.list_(pa.struct([("field", pa.string()), ("len", pa.int32())])))], names=[key, "lens"])

    return texts.mapInArrow(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, lens array<struct<field: string, len: int>>")


def _entries(texts: DataFrame, key: str) -> DataFrame:
    """``key, field, term, tf, len, positions`` of ``key`` and a lower-cased text for each field: one row per term of a field.

    The rows of a batch come in order of terms, so that the sort after the shuffle meets sorted runs.
    """
    names = [c for c in texts.columns if c != key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.schema.get_field_index(key))
            for name in names:
                told = [terms_of(t) for t in b.column(b.schema.get_field_index(name)).to_pylist()]
                sizes = np.array([*map(len, told)], np.int64)
                ends = np.cumsum(sizes)
                words = pa.array(list(chain.from_iterable(told)), pa.string()).dictionary_encode()
                if not len(words):
                    continue
                rank = np.empty(len(words.dictionary), np.int64)
                rank[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(rank))
                row = np.repeat(np.arange(len(told)), sizes)
                group = rank[words.indices.to_numpy()] * len(told) + row
                order = np.argsort(group, kind="stable")
                group = group[order]
                first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                place = (order - np.repeat(ends - sizes, sizes)[order]).astype(np.int32)
                rows = row[order[first]]
                bounds = np.append(first, len(order)).astype(np.int32)
                out = [own.take(pa.array(rows)), pa.repeat(name, len(rows)), words.dictionary.take(words.indices.take(pa.array(order[first]))), pa.array(np.diff(bounds)), pa.array(sizes[rows].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(bounds), pa.array(place))], names=[key, "field", "term", "tf", "len", "positions"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.mapInArrow(run, f"`{key}` {kind}, field string, term string, tf int, len int, positions array<int>")


@dataclass
class KeywordIndex(SegmentStore):
    """An index of items with unique ids in ``key``."""

    buckets: int = 64
    spread: int = 4
    stats: dict[str, list[int]] = field(default_factory=dict)
    tokenizer: str = ""

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, buckets: int = 64, spread: int = 4) -> KeywordIndex:
        """An empty index, which its first change writes."""
        return cls(spark, path.rstrip("/"), key, buckets=buckets, spread=spread, tokenizer=TOKENIZER)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KeywordIndex:
        """The index at a path as its latest manifest says."""
        found = cls._opened(spark, path)
        if found.tokenizer != TOKENIZER:
            raise StaleStore(f"{path} was tokenized in another way; build it anew")
        return found

    # Reading

    def documents(self) -> DataFrame:
        """``key, fingerprint, lens, seg`` of the items in the index."""
        return self.alive(self.rows("docs"))

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """``key, field, term, tf, len, positions, seg``: all, or those of some terms, whose buckets alone are read."""
        rows = self.rows("postings")
        if terms is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket()).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return self.alive(rows).drop("bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    # Changing

    def upsert(self, items: DataFrame, fields: dict[str, Column], *, parts: list[Column] | None = None, orphans: bool = True) -> KeywordIndex:
        """Add new items and replace those whose fingerprint (of ``parts``, else of all fields) has changed.

        With ``orphans``, ``items`` is all there is: other items of the index are removed.
        """
        scratch = Scratch()
        now = fingerprints(items, self.key, parts if parts is not None else list(fields.values()))
        texts = items.select(self.key, *[F.lower(F.coalesce(c, F.lit(""))).alias(n) for n, c in fields.items()])
        gone = None
        if self.segments:
            change = changed(now, self.documents().select(self.key, "fingerprint"), self.key)
            change = scratch.stage(change.join(now, self.key, "left"), "kw-change")
            now = change.where(F.col("change").isin("add", "update")).select(self.key, "fingerprint")
            gone = change.where(F.col("change").isin("update", *(["remove"] if orphans else []))).select(self.key)
            texts = scratch.stage(texts.join(now.select(self.key), self.key, "left_semi"), "kw-texts")
        done = self._commit(now.join(_lengths(texts, self.key), self.key, "left"), _entries(texts, self.key), gone)
        scratch.clear()
        return done

    def delete(self, keys: DataFrame) -> KeywordIndex:
        """Remove the items of ``key``."""
        return self._commit(None, None, keys.select(self.key).distinct())

    def merge(self) -> KeywordIndex:
        """One segment of all that counts; tombstones go."""
        if not self.items:
            return self
        docs, rows = self.documents().drop("seg"), self.postings().drop("seg")
        return self._commit(docs, rows, None, instead=True)

    def _commit(self, docs: DataFrame | None, rows: DataFrame | None, gone: DataFrame | None, instead: bool = False) -> KeywordIndex:
        new = replace(self)
        if docs is not None:
            new.write("docs", docs)
            # Postings of a term are dealt by item over a few files of its bucket, more where there are many: a task sorts about as much at any size.
            told = new.written("docs").select(F.explode("lens").alias("l")).agg(F.sum("l.len")).first()[0] or 0
            spread = max(self.spread, math.ceil(told / (self.buckets * _TOLD)))
            part = F.pmod(F.xxhash64(self.key), F.lit(spread)).cast("int")
            dealt = rows.withColumn("bucket", self._bucket()).repartitionById(self.buckets * spread, F.col("bucket") * spread + part).sortWithinPartitions("bucket", "term", self.key)
            new.write("postings", dealt, "bucket")
        new.publish(added=docs is not None, gone=gone, instead=instead)
        return new

    def measure(self) -> None:
        docs = self.documents()
        sizes = docs.select(F.explode("lens").alias("l")).groupBy("l.field").agg(F.count(F.lit(1)).alias("n"), F.sum("l.len").alias("total")).collect()
        self.stats, self.items = {r.field: [r.n, r.total] for r in sizes}, docs.count()

    # Searching

    def _phrase_hits(self, slim: DataFrame, node: tuple) -> DataFrame:
        """Items where the phrase stands, by the fewest places that its words span."""
        _, where, terms, slop = node
        rows = slim.where(kwquery.term_condition(node)).select(self.key, "field", "term", F.explode("positions").alias("pos"))
        if slop == 0:
            starts = [rows.where(F.col("term") == t).select(self.key, "field", (F.col("pos") - n).alias("start")) for n, t in enumerate(terms)]
            return reduce(DataFrame.union, starts).groupBy(self.key, "field", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).select(self.key)
        # The latest start of the first words that ends before each place: one sort of the item's places serves all words.
        before = Window.partitionBy(self.key, "field").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("start", F.when(F.col("term") == terms[0], F.col("pos")))
        for t in terms[1:]:
            rows = rows.withColumn("start", F.when(F.col("term") == t, F.max("start").over(before)))
        return rows.where(F.col("pos") - F.col("start") - (len(terms) - 1) <= slop).select(self.key)

    def matching(self, query) -> DataFrame:
        """The distinct items that satisfy the query (a text, clauses or a tree)."""
        self.usable()
        tree = kwquery.tree_of(query)
        parts = kwquery.leaves(tree)
        slim = self.postings(sorted({t for p in parts for t in ([p[2]] if p[0] == "term" else p[2])}))
        width = math.ceil(len(parts) / _BITS)
        bit = lambda n: F.lit(1 << (n % _BITS)).cast("long")
        none = F.lit(0).cast("long")
        singles = [(n, p) for n, p in enumerate(parts) if p[0] == "term"]

        def met_by_row(column: int) -> Column:
            own = [F.when(kwquery.term_condition(p), bit(n)).otherwise(none) for n, p in singles if n // _BITS == column]
            return reduce(Column.bitwiseOR, own, none).alias(f"b{column}")

        found = [slim.select(self.key, *[met_by_row(c) for c in range(width)])] if singles else []
        for n, p in enumerate(parts):
            if p[0] == "phrase":
                found.append(self._phrase_hits(slim, p).select(self.key, *[(bit(n) if n // _BITS == c else none).alias(f"b{c}") for c in range(width)]))
        bits = reduce(DataFrame.union, found).groupBy(self.key).agg(*[F.bit_or(f"b{c}").alias(f"b{c}") for c in range(width)])
        if kwquery.holds(tree, lambda leaf: False):
            # Items without any of the terms may satisfy it too.
            bits = self.documents().select(self.key).join(bits, self.key, "left").na.fill(0)
        number = {p: n for n, p in enumerate(parts)}
        met = lambda leaf: F.col(f"b{number[leaf] // _BITS}").bitwiseAND(bit(number[leaf])) != 0
        return bits.where(kwquery.holds(tree, met)).select(self.key)

    def search(self, query, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """``key, score``: items that satisfy the query, by BM25 over fields and the terms that are not negated.

        An item that satisfies it without any such term has score 0.
        """
        self.usable()
        tree = kwquery.tree_of(query)
        wanted = sorted(kwquery.scoring_terms(tree))
        hits = self.matching(tree)
        if not wanted:
            return hits.select(self.key, F.lit(0.0).alias("score"))
        scope = reduce(lambda a, c: a | c, [(F.col("term") == t) & ((F.col("field") == f) if f else F.lit(True)) for f, t in wanted])
        tf = self.postings(sorted({t for _, t in wanted})).where(scope).select(self.key, "field", "term", "tf", "len")
        df = F.broadcast(tf.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df")))  # a row per field and term of the query
        stats = F.broadcast(self.spark.createDataFrame([(f, n, total / n) for f, (n, total) in self.stats.items()], "field string, n long, mean double"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
        scored = tf.join(df, ["field", "term"]).join(stats, "field").groupBy(self.key).agg(F.round(F.sum(part), 6).alias("score"))
        return hits.join(scored, self.key, "left").select(self.key, F.coalesce("score", F.lit(0.0)).alias("score"))

    def windows(self, query, field: str) -> DataFrame:
        """``key, start, end`` of the hits that hold all of the query's terms in a field: the shortest stretch of places with each of them.

        Of equally short ones the first.  ``end`` is the last place.  Terms under NOT do not count.
        """
        terms = sorted({t for f, t in kwquery.scoring_terms(kwquery.tree_of(query)) if f in ("", field)})
        rows = self.postings(terms).where(F.col("field") == field).join(self.matching(query), self.key, "left_semi").select(self.key, "term", F.explode("positions").alias("pos"))
        # Where each term stood last, up to here: one sort of the item's places serves all terms.
        here = Window.partitionBy(self.key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(here) for t in terms]
        start = F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in last]), last[0] if len(last) == 1 else F.least(*last))
        spans = rows.withColumn("start", start).where("start IS NOT NULL")
        best = F.min(F.struct((F.col("pos") - F.col("start")).alias("long"), "start", F.col("pos").alias("end"))).alias("w")
        return spans.groupBy(self.key).agg(best).select(self.key, "w.start", "w.end")


def snippets(items: DataFrame, windows: DataFrame, key: str, text: Column, around: int = 3) -> DataFrame:
    """``key, snippet``: the terms of each window and ``around`` of them on both sides."""
    terms = tokens_of(text)
    first = F.greatest(F.col("start") - around, F.lit(0))
    return items.join(windows, key).select(key, F.array_join(F.slice(terms, first + 1, F.col("end") + around + 1 - first), " ").alias("snippet"))
