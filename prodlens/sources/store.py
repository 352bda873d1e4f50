"""Tables kept for a session: clustered by an entity, or plain, written once and read by every query.

A clustered table is hash-partitioned into buckets of the entity and registered with its bucketing, so
joins and aggregates on the entity read it without a shuffle. A table is built when it
is first asked for. It belongs to the state of the files it was made from: when one is added, removed or
rewritten, a new store is opened and the tables are built anew. ``clear_work`` removes the files; a table
whose files are gone is built again too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from prodlens.common import new_work_path


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def files_state(spark: SparkSession, paths: Sequence[str]) -> tuple:
    """Bytes, files and the folder's time of change for each path, without listing files to the driver."""
    found = []
    for place in paths:
        path, fs = _path(spark, place)
        if not fs.exists(path):
            found.append((place, None))
            continue
        summary = fs.getContentSummary(path)
        found.append((place, summary.getLength(), summary.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return tuple(found)


class EntityStore:
    """Kept tables of one state of the inputs. ``buckets`` defaults to the number of shuffle partitions, so that
    a clustered table meets a shuffled one without a second shuffle."""

    def __init__(self, spark: SparkSession, key: str, buckets: int | None = None):
        self.spark, self.key = spark, key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.built: dict[str, tuple[str, Callable[[], DataFrame]]] = {}

    def _reuse(self, label: str) -> DataFrame | None:
        if label not in self.built:
            return None
        place, read = self.built[label]
        path, fs = _path(self.spark, f"{place}/_SUCCESS")
        return read() if fs.exists(path) else None

    def clustered(self, label: str, build: Callable[[], DataFrame], order: Sequence[str], aligned: bool = False) -> DataFrame:
        """The table ``label`` in buckets of the entity, sorted by ``order`` in each file.

        Rows are dealt by entity before they are written, so a bucket is one file; ``aligned`` says that
        ``build`` joins clustered tables only and its rows lie so already. The rows of one entity meet in
        one task: combine raw rows to what an entity can have boundedly many of (days, months) before.
        """
        if (kept := self._reuse(label)) is not None:
            return kept
        df, name = build(), f"kept_{label}_{uuid.uuid4().hex}"
        place = new_work_path(self.spark, label)
        dealt = df if aligned else df.repartition(self.buckets, self.key)
        # Parquet in the shared folder; the catalog of the session knows the buckets
        writer = dealt.write.format("parquet").option("path", place).option("compression", "zstd")
        writer.bucketBy(self.buckets, self.key).sortBy(*order).saveAsTable(name)
        self.built[label] = (place, lambda: self.spark.table(name))
        return self.spark.table(name)

    def kept(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table ``label`` as plain Parquet."""
        if (kept := self._reuse(label)) is not None:
            return kept
        df, place = build(), new_work_path(self.spark, label)
        df.write.parquet(place)
        schema = df.schema
        self.built[label] = (place, lambda: self.spark.read.schema(schema).parquet(place))
        return self.built[label][1]()

    def folder(self, label: str, write: Callable[[str], None]) -> str:
        """The path of a layout that ``write`` makes once."""
        if self._reuse(label) is None:
            place = new_work_path(self.spark, label)
            write(place)
            self.built[label] = (place, lambda: self.spark.read.parquet(place))
        return self.built[label][0]

    def close(self) -> None:
        """Remove the kept tables and their files."""
        for place, read in self.built.values():
            path, fs = _path(self.spark, place)
            fs.delete(path, True)
        for table in self.spark.catalog.listTables(pattern="kept_*"):
            if any(table.name.startswith(f"kept_{label.lower()}_") for label in self.built):
                self.spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
        self.built.clear()


_OPEN: dict[tuple[str, str], tuple[tuple, EntityStore]] = {}


def open_store(spark: SparkSession, root: str, paths: Sequence[str], key: str) -> EntityStore:
    """The session's store for ``root``; a new one if the files at ``paths`` have changed since."""
    name = (spark.sparkContext.applicationId, root)
    state = files_state(spark, paths)
    if name in _OPEN and _OPEN[name][0] == state and _OPEN[name][1].spark is spark:
        return _OPEN[name][1]
    store = EntityStore(spark, key)
    _OPEN[name] = (state, store)
    return store
