"""Tables published together by a pointer that readers follow.

New files never replace old ones: a build, or a refresh of some partitions, writes beside what is there
and then publishes a numbered pointer, a small JSON file that names the folders of every table. Readers
take the pointer with the highest number. It appears by one rename, so a reader finds either the whole old
set or the whole new one, and whatever fails before leaves the old set as it was. One publisher at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.plans.enrich import MONTH, WELL

POINTERS = "_releases"
RELEASE = "release"


class ReleaseError(RuntimeError):
    """A set of tables cannot be published or found."""


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def new_release() -> str:
    return f"r{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, out: str) -> list[int]:
    path, fs = _path(spark, f"{out}/{POINTERS}")
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def _pointer(out: str, number: int) -> str:
    return f"{out}/{POINTERS}/{number:010d}.json"


def _read(spark: SparkSession, out: str, number: int) -> dict[str, list[str]]:
    return json.loads(spark.read.text(_pointer(out, number), wholetext=True).first()["value"])


def published(spark: SparkSession, out: str) -> dict[str, list[str]]:
    """The folders of each table of the newest release, relative to ``out``; empty before the first."""
    numbers = _numbers(spark, out.rstrip("/"))
    return _read(spark, out.rstrip("/"), numbers[-1]) if numbers else {}


def publish(spark: SparkSession, out: str, tables: Mapping[str, Sequence[str]]) -> int:
    """Publish the folders of ``tables``; tables not named stay as they are. Returns the release's number."""
    out = out.rstrip("/")
    number = (_numbers(spark, out) or [0])[-1] + 1
    record = {**published(spark, out), **{name: list(places) for name, places in tables.items()}}
    aside, fs = _path(spark, f"{out}/{POINTERS}/.{new_release()}")
    stream = fs.create(aside, False)
    stream.write(bytearray(json.dumps(record, indent=1).encode()))
    stream.close()
    pointer = _path(spark, _pointer(out, number))[0]
    if fs.exists(pointer) or not fs.rename(aside, pointer):
        raise ReleaseError(f"release {number} of {out} was published by somebody else meanwhile")
    return number


def places(spark: SparkSession, out: str, name: str) -> list[str]:
    """The folders that hold a published table."""
    found = published(spark, out)
    if name not in found:
        raise ReleaseError(f"{out} has no published table {name!r}, only {sorted(found)}")
    return [f"{out.rstrip('/')}/{place}" for place in found[name]]


def place(spark: SparkSession, out: str, name: str) -> str:
    """The folder of a published table that has no partitions of its own releases."""
    found = places(spark, out, name)
    if len(found) != 1:
        raise ReleaseError(f"{name!r} lies in {len(found)} folders; use open_table")
    return found[0]


def open_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A published Parquet table. One refreshed by partitions keeps its partition column, and filters on
    that prune folders."""
    found = places(spark, out, name)
    if f"/{RELEASE}=" not in found[0]:
        return spark.read.parquet(*found)
    return spark.read.option("basePath", f"{out.rstrip('/')}/{name}").parquet(*found).drop(RELEASE)


def refresh(
    spark: SparkSession, rows: DataFrame, out: str, name: str, by: str = "anio",
    order: Sequence[str] = (WELL, MONTH), partitions: int | None = None,
) -> int | None:
    """Replace those partitions of a table that ``rows`` has rows of, and publish the result.

    Only these are written; the others stay in the folders that hold them. Files are range-partitioned by
    ``by`` and ``order``, so one large year is written by many tasks. Returns the release's number; rows
    that are empty change nothing and give None.
    """
    out, release = out.rstrip("/"), new_release()
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.withColumn(RELEASE, F.lit(release))
        .repartitionByRange(n, by, *order)
        .sortWithinPartitions(by, *order)
        .write.partitionBy(by, RELEASE)
        .option("compression", "zstd")
        .mode("append")
        .parquet(f"{out}/{name}")
    )
    pattern, fs = _path(spark, f"{out}/{name}/{by}=*/{RELEASE}={release}")
    folders = [status.getPath() for status in fs.globStatus(pattern) or []]
    new = {path.getParent().getName(): f"{name}/{path.getParent().getName()}/{path.getName()}" for path in folders}
    if not new:
        return None
    kept = {place.split("/")[1]: place for place in published(spark, out).get(name, [])}
    return publish(spark, out, {name: [p for _, p in sorted({**kept, **new}.items())]})


def forget(spark: SparkSession, out: str, keep: int = 2) -> int:
    """Remove releases but the newest ``keep`` and the folders that only they name; returns how many folders
    went. Readers that opened a table of a removed release lose it."""
    out = out.rstrip("/")
    numbers = _numbers(spark, out)
    old, new = numbers[: -max(keep, 1)], numbers[-max(keep, 1) :]
    named = lambda some: {p for n in some for places in _read(spark, out, n).values() for p in places}
    gone = named(old) - named(new)
    for target in [_pointer(out, n) for n in old] + [f"{out}/{p}" for p in gone]:
        path, fs = _path(spark, target)
        fs.delete(path, True)
    return len(gone)
