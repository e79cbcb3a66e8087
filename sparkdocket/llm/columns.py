"""Helpers for operators that add columns inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def add_columns(
    df: DataFrame,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]] | None = None,
    keep: list[str] | None = None,
    *,
    per_task: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]] | None = None,
) -> DataFrame:
    """Append ``fields`` to ``df`` batch by batch, with no shuffle.

    ``compute`` gets each Arrow batch and returns one array per field.  Columns
    of ``df`` whose names clash with a new field are replaced by it (names
    compare without case, as Spark does).  ``keep`` limits what passes through.
    ``per_task`` makes ``compute`` anew for each task, so that what it holds goes
    with the task.
    """
    new = {f.name.lower() for f in fields}
    through = [f for f in df.schema.fields if f.name.lower() not in new and (keep is None or f.name in keep)]
    names = [f.name for f in through]
    out = T.StructType([*through, *fields])
    new_names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_batch = compute if per_task is None else per_task()
        for batch in batches:
            if batch.num_rows:
                made = of_batch(batch)
                cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*names, *new_names])

    return df.mapInArrow(run, out)


def texts_as_bytes(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: int = 2 << 20):
    """Small Arrow batches for the jobs that run inside; the session's settings return after."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
