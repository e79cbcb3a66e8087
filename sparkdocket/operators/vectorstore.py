"""A written store of vectors in cells, with exact search by triangle bounds.

Tables of the store (see ``plans.segments``)::

    vectors/seg=N/cell=C   item, ordinal, vector (unit length), angle to the cell's centre
    docs/seg=N             item, fingerprint

The centres of the cells are fitted on a bounded sample when the store is first
filled and stand in the manifest's table ``centres``; every vector goes to its
nearest centre.  All vectors of a cell lie within the cell's radius, an angle, so
none can be nearer to a query than the centre's angle less that radius: a cell
whose bound does not reach the query's kth score is left out, and the result is
exact.  That kth score comes from a first search of the query's best cells.

Queries are a table.  Pairs of a query and a cell meet the cell's vectors in
blocks of bounded size on both sides, one matrix product a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkdocket.operators.keyword import changed, fingerprints
from sparkdocket.plans.segments import SegmentStore, StaleStore, StoreMissing
from sparkdocket.plans.staging import Scratch

#: Rows of a block of vectors and of queries, about.
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
#: Largest table of centres that goes to the tasks, in numbers (32 MB).
MOST_CENTRES = 4_000_000
#: Scores have six digits; bounds are compared with that much room.
_ROOM = 2e-6


def unit_rows(column: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows (not null, of ``dims`` finite numbers, not zero) and their vectors at unit length."""
    rows = column.to_pylist()
    at = [k for k, r in enumerate(rows) if r is not None and len(r) and (dims is None or len(r) == dims) and None not in r]
    v = np.array([rows[k] for k in at], np.float64).reshape(len(at), -1 if at else 0)
    with np.errstate(all="ignore"):
        largest = np.abs(v).max(axis=1, initial=0)
        fine = np.isfinite(largest) & (largest > 0)
        v = v[fine] / largest[fine, None]
        return np.array(at, np.int64)[fine], v / np.linalg.norm(v, axis=1, keepdims=True)


def _listed(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * (v.shape[1] if v.ndim == 2 else 0), pa.int32()), pa.array(v.ravel(), pa.float64()))


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of unit length by spherical k-means; the first ones are spread over the sample."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 0] = sums[size > 0] / size[size > 0, None]
    return centres


@dataclass
class VectorStore(SegmentStore):
    """A store of the vectors of one model; an item has one or more, told apart by their ordinals."""

    model: str = ""
    cells: int = 64
    dims: int = 0

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: str, model: str, cells: int = 64) -> VectorStore:
        """An empty store, which its first change writes.  ``cells`` is best near the square root of the vectors' number."""
        return cls(spark, path.rstrip("/"), key, model=model, cells=cells)

    @classmethod
    def open(cls, spark: SparkSession, path: str, model: str) -> VectorStore:
        found = cls._opened(spark, path)
        if found.model != model:
            raise StaleStore(f"{path} holds vectors of {found.model!r}, not of {model!r}")
        return found

    # Changing

    def upsert(self, vectors: DataFrame, *, vector: str = "vector", ordinal: str | None = None, orphans: bool = True, sample: int = 20_000) -> VectorStore:
        """Add new items and replace those of which a vector has changed.

        With ``orphans``, ``vectors`` is all there is: other items of the store are
        removed.  The first change fits the centres on about ``sample`` vectors, chosen by hash, and
        sets the number of dimensions: the commonest of the sample.  Null and zero vectors, those of
        other lengths and those that hold null or non-finite numbers are not stored.
        """
        scratch = Scratch()
        new = replace(self)
        rows = vectors.where(F.col(self.key).isNotNull()).select(self.key, (F.col(ordinal) if ordinal else F.lit(0)).cast("int").alias("ordinal"), F.col(vector).cast("array<double>").alias("vector"))
        rows = scratch.stage(rows, "vec-given")
        if not self.dims:
            new._fit(rows, sample)
        # An item's fingerprint: its vectors' digests in order.
        each = F.struct("ordinal", F.sha2(F.to_json("vector"), 256).alias("digest"))
        whole = rows.groupBy(self.key).agg(F.sort_array(F.collect_list(each)).alias("v"))
        now = fingerprints(whole, self.key, [F.to_json("v")])
        change = changed(now, self.documents(), self.key) if self.segments else now.select(self.key, F.lit("add").alias("change"))
        change = scratch.stage(change.join(now, self.key, "left"), "vec-change")
        fresh = change.where(F.col("change").isin("add", "update"))
        new.write("docs", fresh.select(self.key, "fingerprint"))
        told = rows.join(fresh.select(self.key), self.key, "left_semi")
        new.write("vectors", new._placed(told), "cell")
        new.publish(added=True, gone=change.where(F.col("change").isin("update", *(["remove"] if orphans else []))))
        scratch.clear()
        return new

    def delete(self, keys: DataFrame) -> VectorStore:
        """Remove the items of ``key``."""
        new = replace(self)
        new.publish(added=False, gone=keys.select(self.key).distinct())
        return new

    def merge(self) -> VectorStore:
        """One segment of all that counts; tombstones go.  Centres stay."""
        if not self.items:
            return self
        new = replace(self)
        new.write("docs", self.documents().drop("seg"))
        new.write("vectors", self.vectors().drop("seg").repartition("cell"), "cell")
        new.publish(added=True, instead=True)
        return new

    def _fit(self, rows: DataFrame, sample: int) -> None:
        n = rows.count()
        part = rows.where(F.pmod(F.xxhash64("vector"), F.lit(1_000_003)) <= int(min(1.0, sample / max(n, 1)) * 1_000_003)).select("vector").limit(2 * sample)
        column = part.toArrow()["vector"].combine_chunks()
        lengths = np.array([len(r) for r in column.to_pylist() if r])
        if not len(lengths):
            raise ValueError("no vectors to fit the cells on")
        self.dims = int(np.bincount(lengths).argmax())
        if self.cells * self.dims > MOST_CENTRES:
            raise ValueError(f"{self.cells} cells of {self.dims} dimensions are too many to send to the tasks")
        units = unit_rows(column, self.dims)[1]
        if not len(units):
            raise ValueError("no vectors to fit the cells on")
        centres = fit_centres(units[np.lexsort(units.T)], self.cells)
        table = pa.table({"cell": pa.array(range(len(centres)), pa.int32()), "centre": _listed(centres)})
        self.spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

    def _centres(self) -> np.ndarray:
        """At most MOST_CENTRES numbers."""
        table = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").toArrow()
        return np.array(table["centre"].to_pylist(), np.float64)

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Usable rows at unit length with their cell and the angle to its centre."""
        shared, dims, key = self.spark.sparkContext.broadcast(self._centres()), self.dims, self.key

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, v = unit_rows(b.column(2), dims)
                if not len(at):
                    continue
                near = v @ shared.value.T
                cell = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(at)), cell], -1, 1))
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), _listed(v), pa.array(angle), pa.array(cell, pa.int32())], names=[key, "ordinal", "vector", "angle", "cell"])

        kind = rows.schema[key].dataType.simpleString()
        return rows.mapInArrow(run, f"`{key}` {kind}, ordinal int, vector array<double>, angle double, cell int").repartition("cell", F.pmod(F.xxhash64(key), F.lit(8)))

    def measure(self) -> None:
        self.items = self.documents().count()

    # Reading

    def documents(self) -> DataFrame:
        """``key, fingerprint, seg`` of the items in the store."""
        return self.alive(self.rows("docs"))

    def vectors(self) -> DataFrame:
        """``key, ordinal, vector, angle, cell, seg``."""
        return self.alive(self.rows("vectors"))

    # Searching

    def search(self, queries: DataFrame, *, query_key: str = "query_id", vector: str = "vector", best: int | None = 50, min_score: float = -1.0, eligible: DataFrame | None = None, first_cells: int = 2) -> DataFrame:
        """``query_id, key, score, ordinal``: each query's ``best`` items by cosine (None: all of at least ``min_score``).

        An item's score is that of its best vector (ties: the lowest ordinal), to six
        digits; equal scores go by key.  Of ``eligible`` items only, where given: they
        are cut down before anything is scored.  Queries that could not be stored match
        nothing; equal query ids are not told apart.
        """
        self.usable()
        scratch = Scratch()
        sized = self.vectors() if eligible is None else self.vectors().join(eligible.select(self.key).distinct(), self.key, "left_semi")
        # A row per cell: how far its vectors reach and in how many blocks they are.
        shape = sized.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / VECTOR_BLOCK).cast("int").alias("blocks"))
        held = {r.cell: (r.radius, r.blocks) for r in shape.collect()}
        shape = F.broadcast(self.spark.createDataFrame([(c, b) for c, (_, b) in held.items()] or [(-1, 1)], "cell int, blocks int"))
        asked = scratch.stage(queries.select(F.col(query_key).alias("query_id"), F.col(vector).cast("array<double>").alias("vector")), "vec-asked")
        scored = lambda pairs: self._scored(sized, pairs, shape, best, min_score, scratch)
        if best is None:
            found = self._by_item(scored(self._pairs(asked.withColumn("floor", F.lit(float(min_score))), held)))
        else:
            first = scratch.stage(self._by_item(scored(self._pairs(asked.withColumn("floor", F.lit(-2.0)), held, first=first_cells))), "vec-first")
            floors = self._ranked(first, best).where(F.col("_n") == best).select("query_id", F.col("score").alias("floor"))
            later = asked.join(floors, "query_id", "left").withColumn("floor", F.greatest(F.coalesce("floor", F.lit(-2.0)), F.lit(float(min_score))))
            rest = scored(self._pairs(later, held, after=first_cells))
            found = self._ranked(self._by_item(first.unionByName(rest)), best).where(F.col("_n") <= best).drop("_n")
        done = scratch.stage(found.select("query_id", self.key, "score", "ordinal"), "vec-found")
        for table in scratch.tables[:-1]:
            table.drop()
        return done

    def _ranked(self, found: DataFrame, best: int) -> DataFrame:
        return found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), self.key)))

    def _by_item(self, found: DataFrame) -> DataFrame:
        """The best vector of each query and item."""
        first = F.min(F.struct((-F.col("score")).alias("less"), "ordinal")).alias("f")
        return found.groupBy("query_id", self.key).agg(first).select("query_id", self.key, (-F.col("f.less")).alias("score"), F.col("f.ordinal").alias("ordinal"))

    def _pairs(self, asked: DataFrame, held: dict, first: int | None = None, after: int = 0) -> DataFrame:
        """``query_id, vector, cell``: cells whose bound reaches the floor, the ``first`` ones of each query or those ``after`` them."""
        numbers = sorted(held)
        centres, radii, dims = self._centres()[numbers], np.array([held[c][0] for c in numbers]), self.dims
        shared = self.spark.sparkContext.broadcast((centres, radii, np.array(numbers, np.int32)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, radii, numbers = shared.value
            for b in batches:
                at, v = unit_rows(b.column(1), dims)
                if not len(at) or not len(numbers):
                    continue
                angle = np.arccos(np.clip(v @ centres.T, -1, 1))
                bound = np.cos(np.maximum(0.0, angle - radii))
                order = np.argsort(-bound, axis=1, kind="stable")[:, after:first]
                reach = np.take_along_axis(bound, order, axis=1) >= b.column(2).to_numpy(zero_copy_only=False)[at][:, None] - _ROOM
                row, col = np.nonzero(reach)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[row])), _listed(v[row]), pa.array(numbers[order[row, col]], pa.int32())], names=["query_id", "vector", "cell"])

        kind = asked.schema["query_id"].dataType.simpleString()
        return asked.select("query_id", "vector", "floor").mapInArrow(run, f"query_id {kind}, vector array<double>, cell int")

    def _scored(self, sized: DataFrame, pairs: DataFrame, shape: DataFrame, best: int | None, min_score: float, scratch: Scratch) -> DataFrame:
        """``query_id, key, ordinal, score`` of the pairs' best items of each block."""
        pairs = scratch.stage(pairs, "vec-pairs")
        crowd = pairs.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("crowds"))
        shape = F.broadcast(shape.join(crowd, "cell"))  # a row per cell
        number = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = sized.join(shape, "cell").withColumn("block", F.pmod(F.xxhash64(self.key, "ordinal"), F.col("blocks")).cast("int")).withColumn("crowd", number("crowds"))
        right = pairs.join(shape, "cell").withColumn("crowd", F.pmod(F.xxhash64("query_id"), F.col("crowds")).cast("int")).withColumn("block", number("blocks"))
        on, key = ["cell", "block", "crowd"], self.key
        left, right = left.select(*on, key, "ordinal", "vector"), right.select(*on, "query_id", "vector")

        def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
            matrix = lambda t: np.array(t["vector"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            q_at, v_at, out = [], [], []
            if vectors.num_rows and queries.num_rows:
                score = np.round(matrix(queries) @ matrix(vectors).T, 6)
                keys, ordinals = vectors[key].to_pandas(), vectors["ordinal"].to_numpy()
                codes = keys.factorize(sort=True)[0]
                for q in range(len(score)):
                    hit = np.nonzero(score[q] >= min_score)[0]
                    hit = hit[np.lexsort((ordinals[hit], codes[hit], -score[q][hit]))]
                    # The best vector of each item, in order of score and key.
                    hit = hit[np.sort(np.unique(codes[hit], return_index=True)[1])][:best]
                    q_at.append(np.full(len(hit), q))
                    v_at.append(hit)
                    out.append(score[q][hit])
            q_at, v_at = (pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (q_at, v_at))
            return pa.table({"query_id": queries["query_id"].take(q_at), key: vectors[key].take(v_at), "ordinal": vectors["ordinal"].take(v_at), "score": pa.array(np.concatenate(out) if out else [], pa.float64())})

        kinds = f"query_id {pairs.schema['query_id'].dataType.simpleString()}, `{key}` {sized.schema[key].dataType.simpleString()}, ordinal int, score double"
        return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, kinds)


__all__ = ["StaleStore", "StoreMissing", "VectorStore", "fit_centres"]
