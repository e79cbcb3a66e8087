"""What a session needs before this package's queries run on a cluster.

The package's sources go to the executors, so that tasks can import it anywhere.
Arrow batches are kept small where the session does not set their size: texts are
long, and an executor holds several batches outside its heap at once.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

_SENT: set[str] = set()
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application's Python files, once."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="sparkdocket-")), "sparkdocket.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _SENT.add(app)


def shipped(query: Callable) -> Callable:
    """The same query, which first sees to it that the executors have the package."""

    @wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        for name, value in _BATCHES.items():
            if spark.conf.get(name, None) is None:
                spark.conf.set(name, value)
        return query(spark, *args)

    return run
