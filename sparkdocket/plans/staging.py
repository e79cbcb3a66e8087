"""Written tables that cut lineage, kept where every executor can read them.

The folder is the cluster's ``spark.checkpoint.dir``.  On one machine (a local
master) a temporary folder stands in for it where it is unset; on a cluster that
would be a folder of the driver alone, so there it must be set.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sparkdocket-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


@dataclass
class Staged:
    """A table written once to the shared folder and read back."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files.  Only for tables that no returned plan still reads."""
        spark = self.df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def stage(df: DataFrame, label: str, codec: str = "lz4_raw") -> Staged:
    """Write ``df`` as Parquet to the shared folder; later steps read the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # Small row groups: a writer buffers one per open file.  The codec needs no memory outside the heap to speak of.
    df.write.option("compression", codec).option("parquet.block.size", 32 << 20).parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path), path)


class Scratch:
    """Tables that a computation stages on its way; ``clear`` deletes them once its result is written."""

    def __init__(self) -> None:
        self.tables: list[Staged] = []

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(stage(df, label))
        return self.tables[-1].df

    def clear(self) -> None:
        for table in self.tables:
            table.drop()
        self.tables = []
