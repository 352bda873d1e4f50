"""Writers: sorted Parquet, entity shards, JSON summary, label sidecar, CSV export, manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prodlens.operators.encode import require_labels
from prodlens.plans.enrich import MONTH, WELL
from prodlens.sources.intake import STREAM_FROM, file_manifest

BUCKETS = 256
MAX_ROWS_PER_FILE = 20_000_000


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def write_sorted(
    df: DataFrame, path: str, order: Sequence[str], partitions: int | None = None,
    max_rows_per_file: int = MAX_ROWS_PER_FILE,
) -> None:
    """ZSTD Parquet in global order of ``order``: file and row-group limits then prune reads."""
    (
        df.repartitionByRange(_partitions(df, partitions), *order)
        .sortWithinPartitions(*order)
        .write.option("compression", "zstd")
        .option("maxRecordsPerFile", max_rows_per_file)
        .mode("overwrite")
        .parquet(path)
    )


def bucket_of(key: str = WELL, buckets: int = BUCKETS):
    return F.pmod(F.col(key), F.lit(buckets)).cast("int")


def write_sharded(
    df: DataFrame, path: str, key: str = WELL, at: str = MONTH, buckets: int = BUCKETS,
    partitions: int | None = None, max_rows_per_file: int = MAX_ROWS_PER_FILE,
) -> None:
    """Entity shards ``bucket=<id mod buckets>/`` sorted by id and date, in one pass.

    Range partitioning by (bucket, id, date) cuts a bucket that holds a large part of the rows
    into several files instead of one task, and each file still covers a narrow range of ids.
    Each row group has a Bloom filter of its ids beside its limits, so a lookup reads only those that
    hold its entity.
    """
    (
        df.withColumn("bucket", bucket_of(key, buckets))
        .repartitionByRange(_partitions(df, partitions), "bucket", key, at)
        .sortWithinPartitions("bucket", key, at)
        .write.partitionBy("bucket")
        .option("compression", "zstd")
        .option(f"parquet.bloom.filter.enabled#{key}", "true")
        .option("maxRecordsPerFile", max_rows_per_file)
        .mode("overwrite")
        .parquet(path)
    )


def write_summary(sections: Mapping[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path.rstrip('/')}/{name}")


def write_findings(found: DataFrame, path: str) -> None:
    """Findings as JSON lines and as a Markdown table."""
    folder = path.rstrip("/")
    found.write.mode("overwrite").json(f"{folder}/json")
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    names = ["check_name", "subject", "key", "value", "status"]
    head = found.sparkSession.range(2).select(
        F.col("id").alias("place"),
        F.when(F.col("id") == 0, line(*[F.lit(n) for n in names]))
        .otherwise(line(*[F.lit("---")] * len(names)))
        .alias("value"),
    )
    shown = [F.coalesce(F.col(n).cast("string"), F.lit("NULL")) for n in names]
    body = found.select(
        F.lit(2).cast("long").alias("place"), line(*shown).alias("value")
    )
    head.unionByName(body).orderBy("place", "value").select("value").write.mode("overwrite").text(
        f"{folder}/markdown"
    )


def write_labels(labels: DataFrame, path: str, dims: Sequence[str]) -> None:
    """The label sidecar; refused while a dimension has no labels."""
    require_labels(labels, list(dims))
    labels.orderBy("dim", "code").write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, citation: str | None = None) -> None:
    """CSV with a header. The citation goes into ``_CITATION`` beside the data, because comment
    lines inside the files would break readers that split them."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    if citation:
        lines = [(line,) for line in citation.split("\n")]
        spark = df.sparkSession
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(
            f"{path.rstrip('/')}/_CITATION"
        )


def build_manifest(
    spark: SparkSession, outputs: Mapping[str, str], hashes: bool = True, stream_from: int = STREAM_FROM
) -> DataFrame:
    """``(output, path, uri, file, bytes, sha256)`` of everything a build wrote."""
    out = None
    for name, path in outputs.items():
        part = file_manifest(spark, [path], hashes, stream_from).withColumn("output", F.lit(name))
        part = part.where(~F.col("file").startswith("_") & ~F.col("file").startswith("."))
        out = part if out is None else out.unionByName(part)
    return out


def with_rows(manifest: DataFrame, spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """The manifest with the row count of each Parquet output; NULL for the others."""
    return manifest.join(output_rows(spark, tables), "output", "left")


def output_rows(spark: SparkSession, outputs: Mapping[str, str]) -> DataFrame:
    """``(output, n_rows)`` of Parquet outputs, from the file footers."""
    out = None
    for name, path in outputs.items():
        part = spark.read.parquet(path).agg(F.count("*").alias("n_rows")).withColumn("output", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
