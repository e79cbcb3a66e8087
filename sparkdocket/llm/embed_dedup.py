"""Near-duplicate embeddings: spherical k-means cells and blocked cosine products.

1. Rows whose vectors are equal form one node with a multiplicity.
2. Spherical k-means is fitted for each vector length on a bounded sample of its
   nodes.  The number of cells grows with the number of nodes, so that a cell keeps
   its size; where it would exceed ``max_cells``, each cell is divided once more by
   centres fitted in tasks on a bounded sample of that cell.
3. A node is at home in the cell of its nearest centre and a guest in each cell of
   lower number whose centre is nearly as near: for two vectors at the threshold,
   the difference of their products with two centres has a standard deviation of
   |x - y| |c - d| / sqrt(e), e being the number of dimensions over which the
   vectors spread inside their cells; ``margin`` of these are allowed.
4. The nodes of a cell are dealt into blocks of ``block_rows``, those at home apart
   from guests, and each block is packed into one row.  A task multiplies a pair of
   blocks (home with home, home with guests) and returns a row per node, never the
   pairs: the number of links and the smallest node reached inside the task, which
   keeps connectivity.
5. Connected components over those edges; the smallest id of each is kept.

Each pair of nodes is compared in one place only (both at home there, or one at
home and the other a guest from a cell of higher number), so counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.columns import small_batches
from sparkdocket.operators.graph import connected_components
from sparkdocket.plans.staging import stage


def fit_spherical_kmeans(rows: np.ndarray, cells: int, iterations: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means over unit rows; empty cells take a far row."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(rows)))
    centres = rows[np.sort(rng.choice(len(rows), cells, replace=False))].copy()
    for _ in range(iterations):
        near = rows @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        norms = np.linalg.norm(sums, axis=1)
        empty = norms < 1e-12
        centres[~empty] = sums[~empty] / norms[~empty, None]
        if empty.any():
            far = np.argsort(near.max(axis=1))[: int(empty.sum())]
            centres[empty] = rows[far]
    return centres


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def spread(unit: np.ndarray, centres: np.ndarray) -> float:
    """The number of dimensions over which vectors spread inside their cells (participation ratio)."""
    near = unit @ centres.T
    home = near.argmax(axis=1)
    rest = unit - near[np.arange(len(unit)), home][:, None] * centres[home]
    moments = rest.T @ rest
    return float(max(1.0, np.trace(moments) ** 2 / max((moments**2).sum(), 1e-300)))


def cells_of(unit: np.ndarray, centres: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, at home) of every visit: each row's home first, then the cells visited as guest."""
    rows, cells, at_home = [], [], []
    for at in range(0, len(unit), 2048):
        near = unit[at : at + 2048] @ centres.T
        home = near.argmax(axis=1)
        best = near[np.arange(len(home)), home]
        gap = np.sqrt(np.maximum(0, 2 - 2 * (centres[home] @ centres.T)))
        guest = (best[:, None] - near) <= slack * gap
        guest &= np.arange(len(centres))[None, :] < home[:, None]
        r, c = np.nonzero(guest)
        rows.append(at + np.concatenate([np.arange(len(home)), r]))
        cells.append(np.concatenate([home, c]))
        at_home.append(np.arange(len(home) + len(r)) < len(home))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(at_home)


def _slack(margin: float, threshold: float, dims: float) -> float:
    return margin * np.sqrt(2 - 2 * threshold) / np.sqrt(dims)


def _smallest_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes and links (a, b): the smallest node that each reaches."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def link_embeddings(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    cell_rows: int = 1000,
    max_cells: int = 4096,
    sample_rows: int = 20_000,
    margin: float = 2.0,
    block_rows: int = 1500,
) -> DataFrame:
    """Return ``id, n_links long, component_id, kept boolean``, one row per input row.

    Cosines are in double precision.  Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do vectors of different
    length with each other; every length is compared.  Rows that repeat an id are
    separate vectors and link if equal.  A null id is never the smallest; a vector
    alone with a null id has a null component.  An empty table gives an empty
    result; other columns are left out.

    ``sample_rows`` bounds the rows on which centres are fitted (for each length,
    and for each cell that is divided); all rows are assigned and compared.
    """
    spark: SparkSession = vectors.sparkSession
    element = vectors.schema[vector_col].dataType.elementType
    kind, width = ("float", np.float32) if isinstance(element, T.FloatType) else ("double", np.float64)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v")).withColumn("rid", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("ok", F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))), "vec-rows").df
    nodes = stage(
        rows.where("ok").groupBy("v").agg(F.min("rid").alias("node"), F.min("id").alias("low"), F.count(F.lit(1)).alias("copies")).withColumn("dim", F.size("v")), "vec-nodes"
    ).df
    # The distinct lengths of vectors are few.
    totals = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().collect()}
    centres, slacks = _fitted(nodes, totals, width, cell_rows, max_cells, sample_rows, margin, threshold)
    shared = spark.sparkContext.broadcast((centres, slacks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, slack = shared.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim)) if (dims != dim).any() else b
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)
                if dim in fitted:
                    row, cell, home = cells_of(unit_rows(v), fitted[dim], slack[dim])
                else:
                    row, cell, home = np.arange(len(v)), np.zeros(len(v), int), np.ones(len(v), bool)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(np.zeros(len(row), np.int32)),
                        part.column("node").take(take), part.column("copies").take(take), pa.array(home), pa.array(home),
                        pa.array([x.tobytes() for x in v.astype(width)], pa.binary()).take(take),
                    ],
                    names=_MEMBER.fieldNames(),
                )

    members = stage(nodes.select("dim", "node", "copies", "v").mapInArrow(assign, _MEMBER), "vec-cells")
    if any(n > cell_rows * max_cells for n in totals.values()):
        fine = stage(_divided(members.df, width, cell_rows, sample_rows, margin, threshold), "vec-fine")
        members.drop()
        members = fine
    with small_batches(spark, rows=4, size=4 << 20):
        found = stage(_compared(members.df, width, block_rows, threshold), "vec-links")
    members.drop()
    counts = found.df.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.df.select(F.col("node").alias("src"), F.col("low").alias("dst")))
    rooted = nodes.join(counts, "node", "left").join(parts.withColumnRenamed("vertex", "node"), "node", "left").select(
        "v", "low", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")
    )
    rooted = stage(rooted, "vec-rooted").df
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_vector = rooted.join(lowest, "root").select("v", "n_links", "component_id")
    # One row of the right side per vector: where very many rows share a vector, Spark may split them.
    good = rows.where("ok").join(by_vector, "v").select("id", "n_links", "component_id")
    bad = rows.where("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.union(bad).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


_MEMBER = T.StructType(
    [
        T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("fine", T.IntegerType()), T.StructField("node", T.LongType()),
        T.StructField("copies", T.LongType()), T.StructField("outer", T.BooleanType()), T.StructField("home", T.BooleanType()), T.StructField("raw", T.BinaryType()),
    ]
)


def _fitted(nodes: DataFrame, totals: dict[int, int], width: type, cell_rows: int, max_cells: int, sample_rows: int, margin: float, threshold: float) -> tuple[dict, dict]:
    """Centres and slack for each length that needs more than one cell."""
    large = {d: n for d, n in totals.items() if round(n / cell_rows) > 1}
    centres, slacks, everything = {}, {}, sum(totals.values())
    for d, n in large.items():
        most = max(sample_rows // 10, sample_rows * n // everything)
        part = int(min(1.0, 1.2 * most / n) * 1_000_000)
        sample = nodes.where((F.col("dim") == d) & (F.pmod(F.xxhash64("node"), F.lit(1_000_000)) <= part)).select("v", F.xxhash64("node", F.lit(1)).alias("h"))
        got = sample.orderBy("h").limit(most).select("v").toArrow().column("v").combine_chunks()
        unit = unit_rows(got.flatten().to_numpy(zero_copy_only=False).astype(width).reshape(len(got), d))
        centres[d] = fit_spherical_kmeans(unit, min(max_cells, round(n / cell_rows)))
        slacks[d] = _slack(margin, threshold, spread(unit, centres[d]))
    return centres, slacks


def _divided(members: DataFrame, width: type, cell_rows: int, sample_rows: int, margin: float, threshold: float) -> DataFrame:
    """The members of each cell assigned to finer cells, whose centres are fitted on a bounded sample of the cell.

    A pair is compared in a cell if one of it is at home there (``outer``); within
    the cell, in the finer cell where one of it is at home.
    """
    sizes = members.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("size"))
    sizes = stage(sizes, "vec-sizes").df
    share = (F.least(F.lit(1.0), F.lit(1.2 * sample_rows) / F.col("size")) * 1_000_000).cast("long")
    sample = members.join(sizes, ["dim", "cell"]).where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1_000_000)) <= share).select("dim", "cell", "size", "raw")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, size = int(pdf["dim"].iloc[0]), int(pdf["size"].iloc[0])
        unit = unit_rows(np.frombuffer(b"".join(pdf["raw"]), width).reshape(len(pdf), dim))
        fine = fit_spherical_kmeans(unit, max(1, round(size / cell_rows)))
        return pd.DataFrame({"dim": [dim], "cell": pdf["cell"].iloc[:1].to_numpy(), "slack": [_slack(margin, threshold, spread(unit, fine))], "centres": [fine.tobytes()]})

    fine = stage(sample.groupBy("dim", "cell").applyInPandas(fit, "dim int, cell int, slack double, centres binary"), "vec-centres").df
    # Members of a cell go to tasks in parts, each with the cell's centres.
    parts = F.ceil(F.col("size") / (20 * cell_rows)).cast("int")
    left = members.join(sizes, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), parts).cast("int")).drop("size")
    right = fine.join(sizes, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("size")

    def assign(own: pd.DataFrame, of_cell: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(of_cell):
            return own.iloc[:0].drop(columns="part")
        dim = int(own["dim"].iloc[0])
        unit = unit_rows(np.frombuffer(b"".join(own["raw"]), width).reshape(len(own), dim))
        row, cell, home = cells_of(unit, np.frombuffer(of_cell["centres"].iloc[0], np.float64).reshape(-1, dim), float(of_cell["slack"].iloc[0]))
        out = own.drop(columns="part").iloc[row].copy()
        out["fine"], out["home"] = cell.astype(np.int32), home
        return out

    return left.groupBy("dim", "cell", "part").cogroup(right.groupBy("dim", "cell", "part")).applyInPandas(assign, _MEMBER)


def _compared(members: DataFrame, width: type, block_rows: int, threshold: float) -> DataFrame:
    """``node, links, low``: what each node links with inside a pair of blocks, and the smallest node it reaches there."""
    key = ["dim", "cell", "fine"]
    sizes = members.groupBy(*key).agg(
        *[F.greatest(F.ceil(F.count_if(F.col("home") == h) / block_rows).cast("int"), F.lit(least)).alias(n) for n, h, least in (("homes", True, 1), ("guests", False, 0))]
    )
    sizes = stage(sizes, "vec-blocks").df
    hashed = F.xxhash64("node", F.lit(4))
    block = F.when(F.col("home"), F.pmod(hashed, F.col("homes"))).otherwise(F.col("homes") + F.pmod(hashed, F.greatest("guests", F.lit(1)))).cast("int")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        first = pdf.iloc[:1]
        return pd.DataFrame({
            **{c: first[c].to_numpy() for c in ("dim", "cell", "fine", "block", "homes", "guests")}, "node": [pdf["node"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()],
            "outer": [pdf["outer"].to_numpy(bool).tobytes()], "raw": [b"".join(pdf["raw"])],
        })

    blob = ["node", "copies", "outer", "raw"]
    packed = members.join(sizes, key).withColumn("block", block).groupBy(*key, "block").applyInPandas(
        pack, "dim int, cell int, fine int, block int, homes int, guests int, " + ", ".join(f"{c} binary" for c in blob)
    )
    packed = stage(packed, "vec-packed").df
    # Pairs (i, j): i at home, j at home and not below i, or j a guest.
    i_side = packed.where("block < homes").withColumn("j", F.explode(F.sequence(F.col("block"), F.col("homes") + F.col("guests") - 1))).withColumn("i", F.col("block"))
    to_j = F.least(F.col("block"), F.col("homes") - 1)
    j_side = packed.withColumn("i", F.explode(F.sequence(F.lit(0), to_j))).withColumn("j", F.col("block"))
    ends = [*key, "i", "j"]
    pairs = i_side.select(*ends, *[F.col(c).alias(f"{c}_i") for c in blob]).join(j_side.select(*ends, *[F.col(c).alias(f"{c}_j") for c in blob]), ends)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                at = {n: b.column(n)[k].as_py() for n in b.schema.names}
                sides = []
                for s in "ij":
                    node = np.frombuffer(at[f"node_{s}"], np.int64)
                    unit = unit_rows(np.frombuffer(at[f"raw_{s}"], width).reshape(len(node), at["dim"]))
                    sides.append((node, np.frombuffer(at[f"copies_{s}"], np.int64), np.frombuffer(at[f"outer_{s}"], bool), unit))
                (node, copies, outer, unit), (node2, copies2, outer2, unit2) = sides
                hit = unit @ unit2.T >= threshold
                if not outer.all():
                    hit &= outer[:, None] | outer2[None, :]
                r, c = np.nonzero(hit)
                if at["i"] == at["j"]:
                    r, c = r[r < c], c[r < c]
                    n = len(node)
                else:
                    node, n = np.concatenate([node, node2]), len(node) + len(node2)
                    c = c + len(copies)
                    copies = np.concatenate([copies, copies2])
                if len(r):
                    links = np.bincount(r, copies[c], n) + np.bincount(c, copies[r], n)
                    order = np.argsort(node, kind="stable")
                    rank = np.empty(n, np.int64)
                    rank[order] = np.arange(n)
                    low = _smallest_reached(n, rank[r], rank[c])
                    has = np.nonzero(links)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(node[has]), pa.array(links[has].astype(np.int64)), pa.array(node[order][low[rank[has]]])], names=["node", "links", "low"])

    return pairs.drop("cell", "fine").mapInArrow(compare, "node long, links long, low long")


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op8_embedding_neardup": op8_embedding_neardup}
ORACLE = {
    "op8_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT id, min(reach) AS component_id FROM r GROUP BY id),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN d ON d.a = vec_id
""",
}
