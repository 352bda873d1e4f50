"""Intake of raw yearly files: identify, de-duplicate, report gaps, lay out by year."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prodlens.common import new_work_path, opener, streamable
from prodlens.plans.enrich import MONTH, WELL


class IntakeError(ValueError):
    """The raw files cannot be laid out by year."""


def file_name(path: str = "path"):
    return F.element_at(F.split(F.col(path), "/"), -1)


# Files from this size on are hashed in ranges; a shorter one is one record of a scan.
STREAM_FROM = 64_000_000
RANGE_BYTES = 8_000_000
# a record of Spark's binary reader ends here
LARGEST_RECORD = 2**31 - 16


def stream_digests(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Adds ``sha256`` to files given by ``path``: each is read in ranges by one task, which feeds them to one
    digest, so memory is one range whatever the file's size."""
    schema, opened = files.schema.add("sha256", "string"), opener()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    while part := file.read(range_bytes):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    # files are dealt out one by one, not by the size of their names
    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "path").mapInArrow(digests, schema)


def file_manifest(
    spark: SparkSession, paths: Sequence[str], hashes: bool = True, stream_from: int = STREAM_FROM
) -> DataFrame:
    """``(path, uri, file, bytes, sha256)`` of every file below the paths, hashed on the executors.

    ``path`` can be given to a reader; ``uri`` is the form in which Spark reports the file of
    a row. Empty files are left out, as Spark's readers do.

    Files of ``stream_from`` bytes or more are hashed in ranges, whatever their size. In a store that only
    Spark can read every file is one record; one of 2 GB or more is refused there. Without
    ``hashes`` no content is read.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    )
    cols = [
        "path",
        F.col("_metadata.file_path").alias("uri"),
        file_name().alias("file"),
        F.col("length").alias("bytes"),
    ]
    if not hashes:
        return files.select(*cols)
    first = files.select("path").first()
    if first is None or not streamable(first.path):
        stream_from = LARGEST_RECORD
    large = files.where(F.col("length") >= stream_from).select(*cols)
    # the border is pushed to the reader, which skips the content of larger files
    small = files.where(F.col("length") < stream_from).select(*cols, F.sha2("content", 256).alias("sha256"))
    if stream_from == LARGEST_RECORD and (n := large.count()):
        raise IntakeError(f"{n} files of 2 GB or more are in a store that cannot be read in ranges")
    return small.unionByName(stream_digests(large))


def identify_partitions(files: DataFrame, at: str = MONTH) -> DataFrame:
    """``(uri, n_rows, first_date, last_date, year, one_year)`` for each file, by its own dates."""
    per_file = files.groupBy(F.col("_metadata.file_path").alias("uri")).agg(
        F.count("*").alias("n_rows"), F.min(at).alias("first_date"), F.max(at).alias("last_date")
    )
    lo, hi = F.year("first_date"), F.year("last_date")
    return per_file.withColumn("year", lo).withColumn("one_year", lo == hi)


def footer_dates(files: DataFrame, at: str = MONTH) -> DataFrame:
    """Adds ``n_rows``, ``first_date`` and ``last_date`` to Parquet files given by ``path``, from their footers:
    no column is read. A file with a row group that states no limits has NULL dates and ``stated`` false."""
    schema = files.schema.add("n_rows", "long").add("first_date", "date").add("last_date", "date").add("stated", "boolean")
    opened = opener()

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime

        import pyarrow.parquet as pq

        def day(value):
            return value.date() if isinstance(value, datetime.datetime) else value

        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, place = opened(path)
                with system.open_input_file(place) as file:
                    footer = pq.ParquetFile(file).metadata
                names = [footer.schema.column(i).path for i in range(footer.num_columns)]
                groups = [footer.row_group(i) for i in range(footer.num_row_groups)]
                stats = [g.column(names.index(at)).statistics for g in groups if g.num_rows]
                # a group of NULLs alone has no limits, but says so
                blank = [s is not None and s.has_null_count and s.null_count == g.num_rows for s, g in zip(stats, (g for g in groups if g.num_rows))]
                some = [s for s, b in zip(stats, blank) if not b]
                stated = all(s is not None and s.has_min_max for s in some)
                lows, highs = ([day(s.min) for s in some], [day(s.max) for s in some]) if stated else ([], [])
                found.append((footer.num_rows, min(lows, default=None), max(highs, default=None), stated))
            columns = [pa.array(c, k) for c, k in zip(zip(*found), (pa.int64(), pa.date32(), pa.date32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    n = max(1, min(files.count(), 10_000))
    return files.repartition(n, "path").mapInArrow(limits, schema)


def identify_files(spark: SparkSession, paths: Sequence[str], at: str = MONTH) -> DataFrame:
    """What ``identify_partitions`` says of the files below ``paths``, from their footers. Files whose footers
    lack the limits are scanned, and so is everything in a store that only Spark's readers know."""
    files = file_manifest(spark, paths, hashes=False).where(F.col("file").endswith(".parquet")).select("path", "uri")
    first = files.select("path").first()
    if first is None or not streamable(first.path):
        return identify_partitions(spark.read.parquet(*paths), at)
    # written once: the footers are read by one job, and whether some must be scanned by the next
    log = new_work_path(spark, "footers")
    footer_dates(files, at).write.parquet(log)
    seen = spark.read.parquet(log)
    columns = ["uri", "n_rows", "first_date", "last_date"]
    found = seen.where("stated").select(*columns)
    if unstated := [r.path for r in seen.where("NOT stated").select("path").collect()]:
        scanned = identify_partitions(spark.read.parquet(*unstated), at)
        found = found.unionByName(scanned.select(*columns[:2], *[F.col(c).cast("date").alias(c) for c in columns[2:]]))
    lo, hi = F.year("first_date"), F.year("last_date")
    return found.where("n_rows > 0").withColumn("year", lo).withColumn("one_year", lo == hi)


def require_year_files(identified: DataFrame) -> DataFrame:
    """Refuse files that span two years."""
    bad = identified.where(~F.coalesce("one_year", F.lit(False)))
    if n := bad.count():
        named = [r.uri for r in bad.orderBy("uri").limit(20).collect()]
        raise IntakeError(f"{n} files are not of one year, among them {named}")
    return identified


def resolve_duplicates(identified: DataFrame, manifest: DataFrame) -> DataFrame:
    """One file per year, with what was done about the others in ``note``.

    Files with equal bytes are copies. Files that differ leave the one with most rows; of
    equally long ones the first by path.
    """
    both = identified.join(manifest.select("uri", "path", "bytes", "sha256"), "uri")
    year = Window.partitionBy("year")
    ranked = both.withColumn(
        "place", F.row_number().over(year.orderBy(F.col("n_rows").desc(), "path"))
    ).withColumn("files", F.count("*").over(year))
    kinds = both.groupBy("year").agg(F.countDistinct("sha256").alias("kinds"))
    note = (
        F.when(F.col("files") == 1, "single")
        .when(F.col("kinds") == 1, "identical copies, kept one")
        .otherwise("files differ, kept the largest")
    )
    return ranked.join(kinds, "year").withColumn("note", note).withColumn("kept", F.col("place") == 1)


def year_coverage(rows: DataFrame, at: str = MONTH) -> DataFrame:
    """``(year, n_rows, first_date, last_date, is_gap)`` for every year from first to last."""
    found = rows.groupBy(F.year(at).alias("year")).agg(
        F.count("*").alias("n_rows"), F.min(at).alias("first_date"), F.max(at).alias("last_date")
    )
    span = rows.agg(F.min(F.year(at)).alias("lo"), F.max(F.year(at)).alias("hi"))
    years = span.where(F.col("lo").isNotNull()).select(F.explode(F.sequence("lo", "hi")).alias("year"))
    return years.join(found, "year", "left").select(
        "year",
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        "first_date",
        "last_date",
        F.col("n_rows").isNull().alias("is_gap"),
    )


def missing_years(rows: DataFrame, at: str = MONTH) -> DataFrame:
    return year_coverage(rows, at).where("is_gap").select("year")


def write_by_year(
    rows: DataFrame, path: str, at: str = MONTH, partitions: int | None = None, max_rows_per_file: int = 20_000_000
) -> None:
    """Rewrite as ``anio=YYYY/``, replacing what was there.

    Range partitioning by year, well and month spreads a year that holds most rows over many
    tasks and leaves each file with a narrow range of wells.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.withColumn("anio", F.year(at))
        .repartitionByRange(n, "anio", WELL, at)
        .sortWithinPartitions("anio", WELL, at)
        .write.partitionBy("anio")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", max_rows_per_file)
        .mode("overwrite")
        .parquet(path)
    )


def partition_probe(panel: DataFrame, key: str = "anio") -> DataFrame:
    """Rows per partition value; raise if the key did not become a column or is NULL somewhere."""
    if key not in panel.columns:
        raise IntakeError(f"partition key {key!r} is not a column")
    counts = panel.groupBy(key).agg(F.count("*").alias("n_rows"))
    if not counts.where(F.col(key).isNull()).isEmpty():
        raise IntakeError(f"partition key {key!r} is NULL for some rows")
    return counts


def ingest(spark: SparkSession, paths: Sequence[str], out: str, at: str = MONTH) -> DataFrame:
    """Raw yearly files to the by-year layout; returns the manifest of what was kept and why.

    Raises on files spanning years and on missing years, before anything is written to ``out``.
    """
    identified = require_year_files(identify_files(spark, paths, at))
    decided = resolve_duplicates(identified, file_manifest(spark, paths))
    # the decision is written once, so that reading the kept files and reporting agree
    log = new_work_path(spark, "intake")
    decided.write.parquet(log)
    decided = spark.read.parquet(log)
    kept = [r.path for r in decided.where("kept").select("path").collect()]
    rows = spark.read.parquet(*kept)
    gaps = [r.year for r in missing_years(rows, at).collect()]
    if gaps:
        raise IntakeError(f"missing years: {gaps}")
    write_by_year(rows, out, at)
    partition_probe(spark.read.parquet(out))
    return decided
