"""Where the panel tables are read from. Stages ask a source for a table by name."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodlens.common import opener, pin, streamable

# The tables a source must provide, and the one split by year.
TABLES = ("wells", "well_events", "well_operator_history", "monthly_production")
PANEL = "monthly_production"


class MissingTables(FileNotFoundError):
    """Some tables of the source have no files."""


def check_table(name: str) -> str:
    """Only known names reach a path or a query."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; expected one of {TABLES}")
    return name


class Source(Protocol):
    name: str

    def table(self, spark: SparkSession, name: str) -> DataFrame: ...

    def ensure_available(self, spark: SparkSession) -> None: ...

    def fingerprint(self, spark: SparkSession) -> DataFrame: ...


def _located(spark: SparkSession, path: str):
    """The cluster's file system for a path, and the path in its terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if the path is a file, or a folder with a file somewhere below it."""
    fs, p = _located(spark, path)
    return fs.exists(p) and fs.listFiles(p, True).hasNext()


def read_small_text(spark: SparkSession, path: str) -> str:
    """A small text file such as a list of files. Spark's readers skip names that begin with ``_``."""
    fs, p = _located(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass(frozen=True)
class ParquetSource:
    """``<root>/<table>.parquet`` and ``<root>/monthly_production/anio=YYYY/``."""

    root: str
    name: str = "parquet"

    def path(self, table: str) -> str:
        check_table(table)
        root = self.root.rstrip("/")
        return f"{root}/{PANEL}" if table == PANEL else f"{root}/{table}.parquet"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.path(name))

    def ensure_available(self, spark: SparkSession) -> None:
        missing = [t for t in TABLES if not path_exists(spark, self.path(t))]
        if missing:
            raise MissingTables(f"no files for {missing} under {self.root}")

    def fingerprint(self, spark: SparkSession) -> DataFrame:
        """Bytes and hash of every file of every table."""
        from prodlens.sources.intake import file_manifest

        return file_manifest(spark, [self.path(t) for t in TABLES])


@dataclass(frozen=True)
class FileListSource:
    """The yearly files named one by one, for stores that cannot list a folder.

    ``base`` is any URI Spark can read (``s3a://``, ``hdfs://``, ``file:``). The list comes
    from ``files`` or from ``<base>/monthly_production/_files.json``.
    """

    base: str
    files: tuple[str, ...] = ()
    name: str = "file_list"

    def panel_files(self, spark: SparkSession) -> list[str]:
        folder = f"{self.base.rstrip('/')}/{PANEL}"
        listed = self.files
        if not listed:
            listed = tuple(json.loads(read_small_text(spark, f"{folder}/_files.json")))
        return [f"{folder}/{f}" for f in listed]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        check_table(name)
        base = self.base.rstrip("/")
        if name != PANEL:
            return spark.read.parquet(f"{base}/{name}.parquet")
        # basePath makes the year in each file's folder a column
        return spark.read.option("basePath", f"{base}/{PANEL}").parquet(*self.panel_files(spark))

    def ensure_available(self, spark: SparkSession) -> None:
        """Reads the footers, so a block page in place of a file fails here."""
        missing = []
        for t in TABLES:
            try:
                self.table(spark, t).schema
            except Exception as e:  # noqa: BLE001 - reported with the table's name
                missing.append(f"{t}: {str(e).splitlines()[0]}")
        if missing:
            raise MissingTables(f"cannot read from {self.base}: {missing}")

    def fingerprint(self, spark: SparkSession) -> DataFrame:
        from prodlens.sources.intake import file_manifest

        singles = [f"{self.base.rstrip('/')}/{t}.parquet" for t in TABLES if t != PANEL]
        return file_manifest(spark, [*singles, *self.panel_files(spark)])


@dataclass(frozen=True)
class JdbcSource:
    """Tables of a SQL database, read in parallel ranges of the well id."""

    url: str
    schema: str = "public"
    properties: Mapping[str, str] = field(default_factory=dict)
    key: str = "idpozo"
    lower: int | None = None
    upper: int | None = None
    partitions: int = 64
    name: str = "jdbc"

    def options(self, table: str) -> dict[str, str]:
        """Reader options, with the key's range split over the partitions."""
        if self.lower is None or self.upper is None:
            raise ValueError("bounds of the key are needed, or one task would read the whole table")
        return {
            **self._connection(f"{self.schema}.{check_table(table)}"),
            "partitionColumn": self.key,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }

    def _connection(self, what: str) -> dict[str, str]:
        return {"url": self.url, "dbtable": what, **self.properties}

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """Bounds that are not given are asked of the database first."""
        if not self.url:
            raise ValueError("no database URL is configured")
        source = self
        if self.lower is None or self.upper is None:
            asked = f"(SELECT min({self.key}) AS lo, max({self.key}) AS hi FROM {self.schema}.{check_table(name)}) AS bounds"
            row = spark.read.format("jdbc").options(**self._connection(asked)).load().first()
            lower, upper = row[0] or 0, (row[1] or 0) + 1
            source = replace(self, lower=lower if self.lower is None else self.lower, upper=upper if self.upper is None else self.upper)
        return spark.read.format("jdbc").options(**source.options(name)).load()

    def ensure_available(self, spark: SparkSession) -> None:
        for t in TABLES:
            self.table(spark, t).schema

    def fingerprint(self, spark: SparkSession) -> DataFrame:
        """A database has no files: the row count of each table stands in."""
        parts = [self.table(spark, t).agg(F.count("*").alias("n_rows")).withColumn("path", F.lit(t)) for t in TABLES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


DRIVERS = {"parquet": ParquetSource, "file_list": FileListSource, "jdbc": JdbcSource}


def open_source(config: Mapping[str, Any], driver: str | None = None) -> Source:
    """The source named in ``config["driver"]``, with the options under its name."""
    driver = driver or config["driver"]
    if driver not in DRIVERS:
        raise ValueError(f"unknown source driver {driver!r}; expected one of {sorted(DRIVERS)}")
    return DRIVERS[driver](**config.get(driver, {}))


def register_views(spark: SparkSession, source: Source, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """Temp views over the source: names, not copies. Missing tables are reported first."""
    source.ensure_available(spark)
    found = {}
    for t in tables:
        found[t] = source.table(spark, check_table(t))
        found[t].createOrReplaceTempView(t)
    return found


_TYPES = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def _schema(**types: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in types.items()])


JOBS_SCHEMA = _schema(
    idpozo="long",
    longitud_rama_horizontal_m="double",
    cantidad_fracturas="int",
    arena_bombeada_nacional_tn="double",
    arena_bombeada_importada_tn="double",
    agua_inyectada_m3="double",
    presion_maxima_psi="double",
    potencia_equipos_fractura_hp="double",
    fecha_inicio_fractura="string",
    fecha_fin_fractura="string",
    tipo_terminacion="string",
    formacion_productiva="string",
)
REGISTER_SCHEMA = _schema(idpozo="long", anio="int", mes="int")
REGISTRY_SCHEMA = _schema(idpozo="long", geojson="string")

BAD_LINE = "_bad_line"
# the beginning of a file that is read for its header
HEAD_BYTES = 65_536


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, drop_malformed: bool = False) -> DataFrame:
    """CSV with a header. With a schema the columns are taken by name from files that may hold
    more of them, in any order; without one the types are inferred and all files must have the
    same header. ``drop_malformed`` skips bad rows, and every column of the file is then parsed
    so that a bad row is noticed."""
    layouts = csv_layouts(spark, path)
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED").option("columnPruning", False)
    if schema is None:
        if len(layouts) > 1:
            raise ValueError(f"{path} has files with {len(layouts)} different headers; give a schema")
        return reader.option("inferSchema", True).csv(path)
    known, out = {f.name: f for f in schema.fields}, None
    for header, files in layouts.items():
        missing = [n for n in known if n not in header]
        if missing:
            raise ValueError(f"{files[0]} has no columns {missing}")
        full = T.StructType([known.get(h, T.StructField(h, T.StringType())) for h in header])
        part = reader.schema(full).csv(files).select(*known)
        out = part if out is None else out.unionByName(part)
    return out


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the schema, and ``(file, line)`` of those that do not, so that nothing vanishes
    uncounted. Files are parsed once and written once; both tables read what was written."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("columnPruning", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_LINE)
    known, out = {f.name: f for f in schema.fields}, None
    for header, files in csv_layouts(spark, path).items():
        if missing := [n for n in known if n not in header]:
            raise ValueError(f"{files[0]} has no columns {missing}")
        full = T.StructType([*[known.get(h, T.StructField(h, T.StringType())) for h in header], T.StructField(BAD_LINE, T.StringType())])
        part = reader.schema(full).csv(files).select(*known, BAD_LINE, F.col("_metadata.file_path").alias("file"))
        out = part if out is None else out.unionByName(part)
    parsed = pin(out)
    return parsed.where(F.col(BAD_LINE).isNull()).select(*known), parsed.where(F.col(BAD_LINE).isNotNull()).select("file", F.col(BAD_LINE).alias("line"))


def bad_lines_by_file(bad: DataFrame) -> DataFrame:
    return bad.groupBy("file").agg(F.count("*").alias("n_bad"))


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """What to read for each header that occurs below a path: the path itself if there is one header,
    otherwise the files that have it."""
    heads = _heads(spark, path)
    layouts: dict[tuple[str, ...], list[str]] = {}
    found = [r["head"] for r in heads.select("head").distinct().collect()]
    if not found:
        raise ValueError(f"{path} has no rows")
    names = {head: tuple(next(csv.reader([head.removeprefix("\ufeff")]))) for head in found}
    if len(set(names.values())) == 1:
        return {names[found[0]]: [path]}
    for r in heads.groupBy("head").agg(F.sort_array(F.collect_list("f")).alias("files")).collect():
        layouts.setdefault(names[r["head"]], []).extend(r["files"])
    return dict(sorted(((k, sorted(v)) for k, v in layouts.items()), key=lambda kv: kv[1]))


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """``(f, head)``: the first line of each file. Only the beginning of a file is read, on the executors; in stores
    that only Spark reads, and of compressed files, all lines are."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("f"), "path")
    first = files.first()
    if first is None:
        return files.select("f", F.lit("").alias("head")).limit(0)
    packed = files.where(F.lower("path").rlike(r"\.(gz|bz2|zst|lz4|deflate|snappy|xz)$"))
    if streamable(first.path) and packed.isEmpty():
        opened = opener()

        def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines = []
                for place in batch.column("path").to_pylist():
                    system, name = opened(place)
                    with system.open_input_file(name) as file:
                        line = b""
                        while b"\n" not in line and (part := file.read(HEAD_BYTES)):
                            line += part
                    lines.append(line.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column("f"), pa.array(lines, pa.string())], names=["f", "head"])

        return pin(files.mapInArrow(heads, "f string, head string").where("head <> ''"))
    # the first row of a file has the smallest start among its records
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), "value")
    numbered = lines.withColumn("row", F.monotonically_increasing_id()).where("at = 0")
    return pin(numbered.groupBy("f").agg(F.min_by("value", "row").alias("head")))
