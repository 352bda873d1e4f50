"""Written stage results in the folder all executors share."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

import prodlens
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodlens.common import new_work_path


_SHIPPED: set[str] = set()


def ship_package(spark) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(prodlens.__file__).resolve().parents[1]
        packed = shutil.make_archive(f"{tempfile.mkdtemp()}/prodlens", "zip", root, "prodlens")
        spark.sparkContext.addPyFile(packed)
        _SHIPPED.add(app)


class Stages:
    """Writes intermediate tables of one operator and removes those that are done with."""

    def __init__(self, spark, name: str):
        ship_package(spark)
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, label: str, df: DataFrame) -> DataFrame:
        path = self.paths[label] = new_work_path(self.spark, f"{self.name}-{label}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Delete tables that no later plan reads."""
        for label in labels:
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(self.paths.pop(label))
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def broadcast_ids(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Broadcast a one-column table of numbers if a count shows at most ``most`` rows (some
    tens of MB as a hash table); the planner shuffles a longer one."""
    return F.broadcast(df) if df.count() <= most else df
