"""Bounded, reproducible samples of labelled texts for models fitted on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdocket.llm.columns import add_columns
from sparkdocket.llm.textfeat import FeatureSpace, sparse_rows

_PARTS = 1_000_003


class FeatureRows(Sequence):
    """Sparse rows as they came, four bytes a number; only the row that is asked for is widened for the arithmetic."""

    def __init__(self) -> None:
        self.narrow: list[tuple[np.ndarray, np.ndarray]] = []

    def __len__(self) -> int:
        return len(self.narrow)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        idx, cnt = self.narrow[k]
        return idx.astype(np.int64), cnt.astype(np.float64)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds).cast("long"))


def sample_by_hash(rows: DataFrame, per_class: int, *, key: str, label: str) -> DataFrame:
    """About ``per_class`` rows of each label: those whose key's hash falls in a range
    sized by the label's count.  Every row is kept where a label has no more."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().collect()
    h = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(_PARTS))
    wanted = F.lit(False)
    for r in counts:
        wanted = wanted | ((F.col(label) == F.lit(r[label])) & (h <= int(min(1.0, per_class / r["count"]) * _PARTS)))
    return rows.where(wanted)


def collect_features(
    sample: DataFrame, space: FeatureSpace, per_class: int, *, key: str, label: str, text: str = "text", distinct: bool = False, snippets: tuple[int, ...] = ()
) -> tuple[FeatureRows, list, np.ndarray, dict[int, tuple[list, list]]]:
    """Sparse rows (made on the executors), labels, and which rows are held back (a fifth, by hash).

    At most ``per_class`` rows of each label.  Of each text held back there are also
    ``snippets``: for each number of words the features of two stretches of the
    text that long, as rows and labels by that number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, hashes = b.column("text").to_pylist(), b.column("h").to_pylist()
            rows, sizes, at = sparse_rows(space, texts, distinct), [0] * len(texts), [*range(len(texts))]
            for k, (t, h) in enumerate(zip(texts, hashes, strict=True)):
                words = (t or "").split() if h % 5 == 4 else []
                for n in snippets:
                    for turn in range(2 if len(words) >= n else 0):
                        begin = (h // 5 + turn * 7919) % (len(words) - n + 1)
                        rows += sparse_rows(space, [" ".join(words[begin : begin + n])], distinct)
                        sizes.append(n)
                        at.append(k)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("label").take(take), b.column("h").take(take), pa.array(sizes, pa.int32()),
                    pa.array([i.astype(np.uint32).tobytes() for i, _ in rows], pa.binary()),
                    pa.array([c.astype(np.float32).tobytes() for _, c in rows], pa.binary()),
                ],
                names=["label", "h", "size", "idx", "cnt"],
            )

    kind = sample.schema[label].dataType.simpleString()
    slim = sample.where(F.col(text).isNotNull()).select(F.col(label).alias("label"), F.xxhash64(key, F.lit(5)).alias("h"), F.col(text).alias("text"))
    got = slim.mapInArrow(run, f"label {kind}, h long, size int, idx binary, cnt binary").toArrow()
    sizes, hashes, named = (got.column(c).to_pylist() for c in ("size", "h", "label"))
    # Views of the batches' own bytes.
    features, counts = ([np.frombuffer(x.as_buffer(), number) for x in got.column(c)] for c, number in (("idx", np.uint32), ("cnt", np.float32)))
    place = lambda k: (sizes[k], hashes[k], str(named[k]))
    order = [k for _, alike in groupby(sorted(range(got.num_rows), key=place), place) for k in sorted(alike, key=lambda k: features[k].tobytes())]
    rows, labels, held, short, left = FeatureRows(), [], [], {n: ([], []) for n in snippets}, {}
    for k in order:
        row = (features[k], counts[k])
        if sizes[k]:
            short[sizes[k]][0].append(row)
            short[sizes[k]][1].append(named[k])
            continue
        left[named[k]] = left.get(named[k], per_class) - 1
        if left[named[k]] >= 0:
            rows.narrow.append(row)
            labels.append(named[k])
            held.append(hashes[k] % 5 == 4)
    return rows, labels, np.array(held, bool), short


def score_texts(
    docs: DataFrame,
    model: Broadcast,
    fields: list[T.StructField],
    results: Callable[[np.ndarray, np.ndarray, list[str | None]], list[pa.Array]],
    *,
    text: str = "text",
    keep: list[str] | None = None,
    distinct: bool = False,
) -> DataFrame:
    """Append what ``results(probabilities, numbers of words, texts)`` makes for each batch of texts.

    The words met are kept for the time of a task.
    """

    def per_task() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        scorer = model.value.scorer()

        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            column, parts = batch.column(batch.schema.get_field_index(text)), []
            for at in range(0, batch.num_rows, 500):  # few texts at a time are Python strings
                texts = column.slice(at, 500).to_pylist()
                sums, counts = scorer.sums(texts, distinct)
                parts.append(results(model.value.probabilities(sums), counts, texts))
            return [pa.concat_arrays(arrays) for arrays in zip(*parts, strict=True)]

        return compute

    return add_columns(docs, fields, keep=keep, per_task=per_task)
