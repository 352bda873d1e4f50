"""Data-quality checks. Each returns a table; ``findings`` puts them in one list with a status.

Checks over the same table are folded into one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.common import pin
from prodlens.functions.dates import days_in_month, hours_in_month, year_month
from prodlens.functions.geo import COUNTRY_BOX, Box, box_class, geojson_coordinate, wkb_prefix, wkb_srid
from prodlens.operators.aggregates import dedupe_groups
from prodlens.operators.ranking import exact_quantiles
from prodlens.plans.enrich import MONTH, WELL

# Basins with their suffix in the official columns, and the column patterns.
BASINS = {
    "AUSTRAL": "austral",
    "GOLFO SAN JORGE": "gsj",
    "NEUQUINA": "neuquina",
    "NOROESTE": "noroeste",
    "CUYANA": "cuyana",
}
OFFICIAL_COLUMNS = {"oil": "cuenca_{}", "gas": "produccion_gas_natural_cuenca_{}"}
SUBTYPE_COLUMNS = {
    ("oil", "SHALE"): "shale",
    ("oil", "TIGHT"): "tight",
    ("gas", "SHALE"): "produccion_shale_gas",
    ("gas", "TIGHT"): "produccion_tight_gas",
}
FLUID_COLUMNS = {"oil": "prod_pet", "gas": "prod_gas"}
CHECKED_COLUMNS = ("prod_pet", "prod_gas", "prod_agua", "tef")


class QualityGateError(RuntimeError):
    """At least one check failed."""


def row_counts(tables: Mapping[str, DataFrame], documented: Mapping[str, int]) -> DataFrame:
    """Rows per table beside the documented number."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(documented.get(name)).cast("long").alias("documented"),
        )
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("delta", F.col("n_rows") - F.col("documented"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Number of distinct child keys without a parent. Child keys are distinct before the join."""
    keys = child.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.join(parent.select(key), key, "left_anti").agg(F.count("*").alias("orphans"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number of keys that occur more than once."""
    return dedupe_groups(df, keys).agg(F.count("*").alias("duplicates"))


def _unpivot(wide: DataFrame, index: str, columns: Mapping[tuple[str, str], str]) -> DataFrame:
    """``(fluid, series, ym, theirs)`` from one column per series."""
    cells = F.array(
        *[
            F.struct(
                F.lit(fluid).alias("fluid"),
                F.lit(series).alias("series"),
                F.col(col).cast("double").alias("theirs"),
            )
            for (fluid, series), col in columns.items()
            if col in wide.columns
        ]
    )
    return wide.select(F.col(index).alias("ym"), F.explode(cells).alias("x")).select("ym", "x.*")


def _own_sums(production: DataFrame, wells: DataFrame, attribute: str, series: Sequence[str]) -> DataFrame:
    """``(fluid, series, ym, mine)`` for all series and both fluids from one pass over the fact."""
    side = wells.where(F.col(attribute).isin(list(series))).select(WELL, F.col(attribute).alias("series"))
    sums = (
        production.select(WELL, MONTH, *FLUID_COLUMNS.values())
        .join(side, WELL)
        .groupBy("series", year_month(MONTH).alias("ym"))
        .agg(*[F.sum(c).alias(f) for f, c in FLUID_COLUMNS.items()])
    )
    cells = F.array(
        *[F.struct(F.lit(f).alias("fluid"), F.col(f).alias("mine")) for f in FLUID_COLUMNS]
    )
    return sums.select("series", "ym", F.explode(cells).alias("x")).select("series", "ym", "x.*")


def official_series(oil: DataFrame, gas: DataFrame, columns: Mapping[tuple[str, str], str], index: str = "indice_tiempo") -> DataFrame:
    by_fluid = lambda f: {k: v for k, v in columns.items() if k[0] == f}
    return _unpivot(oil, index, by_fluid("oil")).unionByName(_unpivot(gas, index, by_fluid("gas")))


def reconcile(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Months in common, both totals, their difference in percent and the worst month."""
    off = F.abs(F.col("mine") - F.col("theirs")) / F.nullif(F.col("theirs"), F.lit(0.0))
    total = lambda c: F.sum(c)
    return (
        mine.join(theirs, ["fluid", "series", "ym"])
        .groupBy("fluid", "series")
        .agg(
            F.count("*").alias("months"),
            total("mine").alias("own_total"),
            total("theirs").alias("official_total"),
            ((total("mine") - total("theirs")) / F.nullif(total("theirs"), F.lit(0.0)) * 100).alias("diff_pct"),
            (F.max(off) * 100).alias("worst_month_pct"),
        )
    )


def reconcile_basins(
    production: DataFrame,
    wells: DataFrame,
    oil: DataFrame,
    gas: DataFrame,
    basins: Mapping[str, str] = BASINS,
) -> DataFrame:
    """Own monthly sums by basin against the official series."""
    columns = {(f, b): t.format(s) for f, t in OFFICIAL_COLUMNS.items() for b, s in basins.items()}
    mine = _own_sums(production, wells, "cuenca", list(basins))
    return reconcile(mine, official_series(oil, gas, columns))


def reconcile_subtypes(production: DataFrame, wells: DataFrame, oil: DataFrame, gas: DataFrame) -> DataFrame:
    """Own shale and tight sums against the official columns."""
    mine = _own_sums(production, wells, "sub_tipo_recurso", sorted({s for _, s in SUBTYPE_COLUMNS}))
    return reconcile(mine, official_series(oil, gas, SUBTYPE_COLUMNS)).drop("worst_month_pct")


def unit_rederivation(oil: DataFrame, months: int | None = None, index: str = "indice_tiempo") -> DataFrame:
    """Days, total per day and the implied barrels per cubic metre, month by month.

    ``months`` keeps only the first ones, as the published check does with four.
    """
    first = F.to_date(F.concat(F.col(index), F.lit("-01")))
    rows = oil.orderBy(index).limit(months) if months else oil
    daily = F.col("total") / F.col("days")
    return rows.withColumn("days", days_in_month(first)).select(
        F.col(index).alias("ym"),
        "days",
        "total",
        daily.alias("derived_daily"),
        F.col("total_diario").alias("published_daily"),
        (F.col("kbbl_diario") * 1000 / F.nullif(daily, F.lit(0.0))).alias("factor"),
    )


def gas_unit_ratio(gas: DataFrame, months: int | None = None, index: str = "indice_tiempo") -> DataFrame:
    """Total per day against the published daily gas figure: 1000 shows the scale of the unit."""
    first = F.to_date(F.concat(F.col(index), F.lit("-01")))
    rows = gas.orderBy(index).limit(months) if months else gas
    per_day = F.col("produccion_gas_natural_total") / days_in_month(first)
    return rows.select(
        F.col(index).alias("ym"),
        per_day.alias("per_day"),
        (per_day / F.nullif(F.col("produccion_gas_natural_total_diario"), F.lit(0.0))).alias("scale"),
    )


def mean_factor(rederived: DataFrame, configured: float) -> DataFrame:
    """Mean implied factor and how far, in percent, it is from the configured one."""
    m = F.avg("factor")
    return rederived.agg(
        m.alias("factor"), (F.abs(m - configured) / configured * 100).alias("off_pct")
    )


def negative_census(production: DataFrame, cols: Sequence[str] = CHECKED_COLUMNS) -> DataFrame:
    """Negative values per column; they are corrections and are kept."""
    return _census(production, cols, {"negative": lambda c: F.col(c) < 0})


def null_zero_census(production: DataFrame, cols: Sequence[str] = CHECKED_COLUMNS) -> DataFrame:
    """Missing and declared-zero values per column, and percent missing, in one pass."""
    tests = {"n_null": lambda c: F.col(c).isNull(), "n_zero": lambda c: F.col(c) == 0}
    out = _census(production, cols, tests, with_rows=True)
    return out.select(
        "column_name", "n_null", "n_zero", (F.col("n_null") / F.col("n_rows") * 100).alias("pct_null")
    )


def _census(df: DataFrame, cols: Sequence[str], tests: Mapping[str, object], with_rows: bool = False) -> DataFrame:
    """One aggregate over all columns, then one row per column."""
    counts = [F.count_if(t(c)).alias(f"{n}_{c}") for c in cols for n, t in tests.items()]
    row = df.agg(F.count("*").alias("_rows"), *counts)
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{n}_{c}").alias(n) for n in tests],
                *([F.col("_rows").alias("n_rows")] if with_rows else []),
            )
            for c in cols
        ]
    )
    return row.select(F.explode(cells).alias("x")).select("x.*")


def ceiling_check(production: DataFrame, hours: str = "tef", at: str = MONTH) -> DataFrame:
    """Largest declared hours and the rows above what their own month holds."""
    return production.agg(
        F.max(hours).alias("max_hours"),
        F.count_if(F.col(hours) > hours_in_month(at)).alias("rows_over_ceiling"),
    )


def srid_histogram(wells: DataFrame, geom: str = "geom") -> DataFrame:
    """Geometry headers, how often they occur, and the spatial reference they name."""
    return (
        wells.where(F.col(geom).isNotNull())
        .groupBy(wkb_prefix(geom).alias("prefix"))
        .agg(F.count("*").alias("n"))
        .withColumn("srid", F.when(F.length("prefix") >= 18, wkb_srid("prefix")))
    )


def registry_points(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("geojson").isNotNull()).select(
        WELL,
        geojson_coordinate("geojson", 0).alias("reg_lon"),
        geojson_coordinate("geojson", 1).alias("reg_lat"),
    )


def coordinate_agreement(
    wells: DataFrame, points: DataFrame, lon: str = "coordenadax", lat: str = "coordenaday"
) -> DataFrame:
    """Deviation bands of two coordinate sources. A missing coordinate has its own band, so
    the bands add up to the matched rows."""
    dlon, dlat = F.abs(F.col(lon) - F.col("reg_lon")), F.abs(F.col(lat) - F.col("reg_lat"))
    dev = wells.join(points, WELL).select(
        dlon.alias("dlon"), dlat.alias("dlat"), F.greatest(dlon, dlat).alias("dev")
    )
    dev = pin(dev)  # read for the bands, the bucket limits and the quantile
    in_band = lambda lo, hi: F.count_if((F.col("dev") >= lo) & (F.col("dev") < hi))
    bands = dev.agg(
        F.count("*").alias("matched"),
        F.count_if(F.col("dev").isNull()).alias("no_coordinate"),
        F.count("dev").alias("comparable"),
        F.count_if(F.col("dev") < 1e-9).alias("identical"),
        in_band(1e-9, 1e-4).alias("under_10m"),
        in_band(1e-4, 1e-2).alias("under_1km"),
        F.count_if(F.col("dev") >= 1e-2).alias("over_1km"),
        F.max("dev").alias("max_deg"),
        F.max("dlon").alias("max_dlon"),
        F.max("dlat").alias("max_dlat"),
    )
    p99 = exact_quantiles(dev, [], ["dev"], [0.99]).select("dev_p99").scalar()
    return bands.withColumn("p99_deg", p99)


def coordinate_bounds(wells: DataFrame, lon: str = "coordenadax", lat: str = "coordenaday", box: Box = COUNTRY_BOX) -> DataFrame:
    place = box_class(F.col(lon), F.col(lat), box)
    return wells.agg(
        F.count_if(place == "missing").alias("missing"),
        F.count_if(place == "outside").alias("out_of_bounds"),
    )


def coverage_by(wells: DataFrame, side: DataFrame, key: str, by: str) -> DataFrame:
    """Wells per class and how many of them occur in a side table."""
    present = side.select(F.col(key).alias("_k")).distinct()
    return (
        wells.join(present, F.col(key) == F.col("_k"), "left")
        .groupBy(by)
        .agg(F.count("*").alias("wells"), F.count("_k").alias("covered"))
        .withColumn("coverage_pct", F.col("covered") / F.col("wells") * 100)
    )


def register_coverage(wells: DataFrame, side: DataFrame, key: str = WELL) -> DataFrame:
    """Wells and how many occur in a register, duplicates in the register counted once."""
    present = side.select(F.col(key).alias("_k")).distinct()
    return wells.join(present, F.col(key) == F.col("_k"), "left").agg(
        F.count("*").alias("wells"), F.count("_k").alias("matched")
    )


def threshold_bands(jobs: DataFrame, length: str = "longitud_rama_horizontal_m", key: str = WELL) -> DataFrame:
    """How many wells sit near the classification cut: per-well maximum length in bands."""
    top = F.col("top")
    return jobs.groupBy(key).agg(F.max(length).alias("top")).agg(
        F.count_if(top.isNull() | (top == 0)).alias("zero_or_null"),
        F.count_if((top > 0) & (top < 150)).alias("from_0_to_150"),
        F.count_if((top >= 150) & (top < 600)).alias("from_150_to_600"),
        F.count_if(top >= 600).alias("from_600"),
    )


def totals_agree(a: DataFrame, b: DataFrame, pairs: Mapping[str, tuple[str, str]], tolerance: float = 1e-9) -> DataFrame:
    """Sums of two tables side by side with the relative difference; both tables are read once."""
    sums = lambda df, i: df.agg(
        F.struct(*[F.sum(p[i]).alias(n) for n, p in pairs.items()])
    ).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("measure"),
                F.col("a")[n].alias("left_total"),
                F.col("b")[n].alias("right_total"),
            )
            for n in pairs
        ]
    )
    spark = a.sparkSession
    both = spark.range(1).select(sums(a, 0).alias("a"), sums(b, 1).alias("b"))
    rel = F.abs(F.col("left_total") - F.col("right_total")) / F.nullif(F.abs(F.col("left_total")), F.lit(0.0))
    same = F.coalesce(
        F.col("rel_diff") < tolerance, F.col("left_total").eqNullSafe(F.col("right_total"))
    )
    return (
        both.select(F.explode(cells).alias("x"))
        .select("x.*")
        .withColumn("rel_diff", rel)
        .withColumn("ok", same)
    )


CUBE_TOTALS = {"oil": ("prod_pet", "oil_m3"), "gas": ("prod_gas", "gas_e3m3")}


def cube_matches_source(fact: DataFrame, cube: DataFrame) -> DataFrame:
    return totals_agree(fact, cube, CUBE_TOTALS)


def cubes_match(cube: DataFrame, block: DataFrame) -> DataFrame:
    """Oil of both cubes; wells without a block are missing from the second by design."""
    return totals_agree(cube, block, {"oil": ("oil_m3", "oil_m3")}, tolerance=1e-8)


def budget_check(manifest: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Bytes of each named output against its limit. ``manifest`` has ``output`` and ``bytes``."""
    spark = manifest.sparkSession
    wanted = spark.createDataFrame(list(limits.items()), "output string, limit long")
    used = manifest.groupBy("output").agg(F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest_file"))
    return F.broadcast(wanted).join(used, "output", "left").withColumn(
        "ok", F.coalesce(F.col("bytes") <= F.col("limit"), F.lit(False))
    )


def findings(check: str, table: DataFrame, subject: Column | None = None, ok: Column | None = None) -> DataFrame:
    """One row per figure: ``(check_name, subject, key, value, status)``.

    Status is ``pass`` or ``fail`` where the check has a rule, otherwise ``info``.
    """
    status = F.lit("info") if ok is None else F.when(ok, "pass").otherwise("fail")
    numeric = [f.name for f in table.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "decimal")]
    cells = F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in numeric]
    )
    return table.select(
        F.lit(check).alias("check_name"),
        (F.lit("all") if subject is None else subject.cast("string")).alias("subject"),
        F.explode(cells).alias("x"),
        status.alias("status"),
    ).select("check_name", "subject", "x.key", "x.value", "status")


def verify(
    tables: Mapping[str, DataFrame],
    oil: DataFrame,
    gas: DataFrame,
    jobs: DataFrame,
    register: DataFrame,
    registry: DataFrame | None = None,
    basins: Mapping[str, str] = BASINS,
    documented: Mapping[str, int] | None = None,
    configured_factor: float = 6.28981,
) -> DataFrame:
    """All checks as one findings table."""
    wells, production = tables["wells"], tables["monthly_production"]
    history, events = tables["well_operator_history"], tables["well_events"]
    name = lambda s: F.lit(s)
    children = {
        "monthly_production": production,
        "well_events": events,
        "well_operator_history": history,
    }
    grains = {
        "monthly_production": (production, [WELL, MONTH]),
        "well_operator_history": (history, [WELL, "valid_from"]),
        "wells": (wells, [WELL]),
    }
    parts = [findings("row_counts", row_counts(tables, documented or {}), F.col("table_name"))]
    parts += [
        findings("orphans", orphans(c, wells, WELL), name(t), F.col("orphans") == 0)
        for t, c in children.items()
    ]
    parts += [
        findings("duplicate_keys", duplicate_keys(df, k), name(t), F.col("duplicates") == 0)
        for t, (df, k) in grains.items()
    ]
    parts += [
        # the grain of the events is reported, not enforced: ties have a declared order
        findings("event_ties", duplicate_keys(events, [WELL, "event_date"])),
        findings("reconciliation", reconcile_basins(production, wells, oil, gas, basins), F.concat_ws(":", "fluid", "series")),
        findings("unconventional_split", reconcile_subtypes(production, wells, oil, gas), F.concat_ws(":", "fluid", "series")),
        findings("bbl_per_m3", mean_factor(unit_rederivation(oil), configured_factor), None, F.col("off_pct") < 0.01),
        findings("negatives", negative_census(production), F.col("column_name")),
        findings("hours", ceiling_check(production)),
        findings("nulls", null_zero_census(production), F.col("column_name")),
        findings("bounds", coordinate_bounds(wells)),
        findings("job_coverage", coverage_by(wells, jobs, WELL, "tipo_recurso"), F.coalesce("tipo_recurso", F.lit("(null)"))),
        findings("threshold_bands", threshold_bands(jobs)),
        findings("register_coverage", register_coverage(wells, register)),
    ]
    if "geom" in wells.columns:
        parts.append(findings("srid", srid_histogram(wells), F.col("prefix")))
    if registry is not None:
        parts.append(findings("geojson_agreement", coordinate_agreement(wells, registry_points(registry))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gate(found: DataFrame) -> DataFrame:
    """Raise if any finding failed, with their number and up to fifty names."""
    failed = found.where(F.col("status") == "fail")
    if n := failed.count():
        named = "; ".join(f"{r.check_name}/{r.subject}/{r.key}={r.value}" for r in failed.limit(50).collect())
        raise QualityGateError(f"{n} failed findings: {named}")
    return found
