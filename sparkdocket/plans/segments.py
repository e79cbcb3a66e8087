"""Stores of immutable segments with tombstones, named by a manifest.

Folders below a store's path::

    <table>/seg=N            rows that change N added; those of an item count until a later change removes or replaces it
    dead/seg=N               items whose rows in earlier segments no longer count
    manifests/version=N      which segments count, and what else the store must know

A change writes its segment and then a new manifest, so readers see all of it or
nothing; a task or driver that is lost leaves only files that no manifest names,
which the next change of that number writes over.  There is one writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class StoreMissing(LookupError):
    """There is no store at the path, or it holds no items."""


class StaleStore(LookupError):
    """The store was made in another way and must be built anew."""


@dataclass
class SegmentStore:
    """A store of items with unique ids in ``key``."""

    spark: SparkSession
    path: str
    key: str
    version: int = 0
    segments: list[int] = field(default_factory=list)
    killers: list[int] = field(default_factory=list)
    items: int = 0

    @classmethod
    def _opened(cls, spark: SparkSession, path: str):
        path = path.rstrip("/")
        try:
            last = spark.read.schema("manifest string, version int").json(f"{path}/manifests").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            raise StoreMissing(f"no store at {path}") from e
        if last is None:
            raise StoreMissing(f"no store at {path}")
        return cls(spark, path, **json.loads(last.manifest))

    def usable(self) -> None:
        if not self.items:
            raise StoreMissing(f"the store at {self.path} holds no items")

    def rows(self, name: str) -> DataFrame:
        """A table's rows in the segments that count, whatever later segments removed."""
        return self.spark.read.parquet(f"{self.path}/{name}").where(F.col("seg").isin(self.segments))

    def alive(self, rows: DataFrame) -> DataFrame:
        """Without rows of items that a later segment has removed or replaced."""
        if not self.killers:
            return rows
        dead = self.spark.read.parquet(f"{self.path}/dead").where(F.col("seg").isin(self.killers)).select(F.col(self.key).alias("_dead"), F.col("seg").alias("_by"))
        return rows.join(dead, (F.col(self.key) == F.col("_dead")) & (F.col("seg") < F.col("_by")), "left_anti")

    def write(self, name: str, rows: DataFrame, *by: str) -> None:
        """Write a table of the segment that the next manifest names."""
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/seg={self.version + 1}")

    def written(self, name: str) -> DataFrame:
        """What ``write`` has put into a table for the next manifest."""
        return self.spark.read.parquet(f"{self.path}/{name}/seg={self.version + 1}")

    def publish(self, *, added: bool, gone: DataFrame | None = None, instead: bool = False) -> None:
        """Go on to the next version, whose tables are written; ``instead`` of all earlier segments."""
        n = self.version + 1
        if instead:
            self.segments, self.killers = [], []
        if added:
            self.segments = [*self.segments, n]
        if gone is not None:
            gone.select(self.key).write.mode("overwrite").parquet(f"{self.path}/dead/seg={n}")
            if not self.spark.read.parquet(f"{self.path}/dead/seg={n}").isEmpty():
                self.killers = [*self.killers, n]
        self.version = n
        self.measure()
        said = {k: v for k, v in vars(self).items() if k not in ("spark", "path")}
        self.spark.createDataFrame([(json.dumps(said),)], "manifest string").coalesce(1).write.mode("overwrite").json(f"{self.path}/manifests/version={n}")

    def measure(self) -> None:
        """Set what the manifest says of the live rows."""
        raise NotImplementedError
