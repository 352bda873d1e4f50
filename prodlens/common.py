"""Helpers shared by the operators: key packing, size-checked broadcast, reliable cut points."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAR_FUTURE = "9999-12-31"

# A side is broadcast only if its rows and the bytes of its values are at most these.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 16_000_000


def pack(keys: list[str]) -> Column:
    """One struct for a list of group keys.

    Struct equality treats NULL fields as equal, so groups whose key is NULL survive a
    join on the packed key without a null-safe rewrite, and the same hash partitioning
    serves the aggregate, the window and the join.
    """
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def finite(c: Column | str) -> Column:
    """The value as double, with NaN and infinities turned into NULL (missing)."""
    v = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), v)


def broadcast_if_small(df: DataFrame, size: tuple[int, int]) -> DataFrame:
    """Broadcast ``df`` if ``size``, its rows and the bytes of its values, proves it small;
    otherwise leave the join to the adaptive planner."""
    return F.broadcast(df) if size[0] <= BROADCAST_ROWS and size[1] <= BROADCAST_BYTES else df


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    Only where driver and executors are one process on one machine, and the session names
    none, is a folder of its own set up. On a cluster that would lose rows, so it is refused.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if shared is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="prodlens-")
        spark.conf.set("spark.checkpoint.dir", shared)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared)
    return shared


def _own_folder(spark: SparkSession) -> str:
    return f"{work_dir(spark).rstrip('/')}/prodlens-{spark.sparkContext.applicationId}"


def new_work_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used. The folder carries the
    application's id, so what an application left behind can be told apart and removed."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_work(spark: SparkSession) -> None:
    """Remove every table this application has pinned. Results that still read one are lost, so
    this is for the end of a run, after its results are written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def pin(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and return the table.

    Operators that pass over their input several times then read a pruned Parquet scan
    instead of repeating the plan, and a lost executor costs a re-read, not a recomputation.
    """
    path = new_work_path(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opener() -> Callable:
    """A function that gives the pyarrow file system and the place in it of a path as Spark writes it. It goes to
    the executors by value, so they need no copy of this package."""

    def opened(path: str):
        from urllib.parse import quote

        from pyarrow.fs import FileSystem

        whole = path if "://" in path else path.replace("file:/", "file:///", 1)
        return FileSystem.from_uri(quote(whole, safe=":/@"))

    return opened


def streamable(path: str) -> bool:
    """Whether tasks can read ranges of files there; a store may be one that only Spark's readers know."""
    try:
        opener()(path)
    except Exception:  # whatever the file system says, Spark's readers remain
        return False
    return True
