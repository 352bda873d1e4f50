"""The whole build: enrichment, cubes, curves, shards, labels, summary, manifest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from prodlens.operators.aggregates import code_names
from prodlens.operators.encode import encode, label_table
from prodlens.operators.temporal import RowGuard
from prodlens.plans.cubes import (
    BLOCK_DIMS,
    CUBE_DIMS,
    agg_block,
    agg_monthly,
    well_history,
    wells_slim,
)
from prodlens.plans.curves import CURVE_DIMS, curve_rows, type_curve
from prodlens.plans.enrich import MONTH, WELL, prod_monthly, well_attrs
from prodlens.plans.quality import QualityGateError, budget_check, cube_matches_source, cubes_match
from prodlens.plans.summary import summary_sections
from prodlens.sources import releases
from prodlens.sources.sinks import (
    build_manifest,
    write_labels,
    with_rows,
    write_sharded,
    write_sorted,
    write_summary,
)

# Dimension set and label prefix of each coded table.
CODED = {"agg_monthly": (CUBE_DIMS, ""), "agg_block": (BLOCK_DIMS, "block_"), "typecurve": (CURVE_DIMS, "tc_")}
ORDERS = {
    "agg_monthly": [MONTH, "cuenca"],
    "agg_block": [MONTH, "cuenca", "area"],
    "typecurve": ["trajectory", "subtype", "cuenca", "vintage", "month_on_prod"],
}


@dataclass(frozen=True)
class BuildInputs:
    wells: DataFrame
    history: DataFrame
    events: DataFrame
    production: DataFrame
    jobs: DataFrame
    register: DataFrame


def build(
    spark: SparkSession,
    inputs: BuildInputs,
    out: str,
    event_tie_break: list[str] | None = None,
    limits: Mapping[str, int] | None = None,
    block_must_match: bool = False,
    findings: DataFrame | None = None,
) -> DataFrame:
    """Write every table under ``out`` and return the manifest.

    Everything is written to a folder of its own below ``out``. Only after all gates have passed does one
    pointer publish all tables together (``sources.releases``; read them with its ``open_table`` and
    ``place``), so there is no moment without tables and a failed build leaves the last good one as it was.

    The fact, the attributes and the cubes are written before they are used again, so no
    later step repeats a temporal join. Gates: rows before and after
    the temporal joins, counted as they are written; cube against source at 1e-9; both cubes, if
    every well has a block; bytes against ``limits``. ``findings`` of the checks become a
    section of the summary.
    """
    out = out.rstrip("/")
    folder = f"releases/{releases.new_release()}"
    at = lambda name: f"{out}/{folder}/{name}"

    attrs = well_attrs(
        inputs.wells, inputs.history, inputs.events, inputs.register, inputs.production,
        inputs.jobs, event_tie_break=event_tie_break,
    )
    attrs.write.mode("overwrite").parquet(at("well_attrs"))
    guard = RowGuard("prod_monthly")
    fact = prod_monthly(inputs.production, inputs.history, inputs.events, event_tie_break, guard=guard)
    fact.write.mode("overwrite").parquet(at("prod_monthly"))
    guard.check(inputs.production, spark.read.parquet(at("prod_monthly")))
    attrs, fact = spark.read.parquet(at("well_attrs")), spark.read.parquet(at("prod_monthly"))

    tables = {
        "agg_monthly": agg_monthly(fact, attrs),
        "agg_block": agg_block(fact, attrs),
        "typecurve": type_curve(curve_rows(fact, attrs)),
    }
    labels = None
    for name, df in tables.items():
        dims, prefix = CODED[name]
        df.write.mode("overwrite").parquet(at(f"plain/{name}"))
        plain = spark.read.parquet(at(f"plain/{name}"))
        tables[name] = plain
        found = label_table(plain, dims, prefix)
        labels = found if labels is None else labels.unionByName(found)
        # sorted by label, then coded: codes follow label order, so the order is the same
        write_sorted(encode(plain, dims, found, prefix), at(name), ORDERS[name])

    cube, block = tables["agg_monthly"], tables["agg_block"]
    checks = cube_matches_source(fact, cube)
    if block_must_match:
        checks = checks.unionByName(cubes_match(cube, block))
    bad = checks.where("NOT ok").collect()
    if bad:
        raise QualityGateError(f"cube totals differ from their source: {bad}")

    write_labels(labels, at("dims"), [prefix + d for dims, prefix in CODED.values() for d in dims])
    code_names(attrs, "formprod", "formacion").write.mode("overwrite").json(at("formation_names"))
    write_sorted(wells_slim(attrs), at("wells_slim"), ["cuenca", WELL])
    write_sharded(well_history(fact), at("wells"))
    write_summary(summary_sections(attrs, cube, findings), at("summary"))

    published = ["agg_monthly", "agg_block", "typecurve", "wells_slim", "wells", "dims", "formation_names", "summary"]
    if limits:
        sizes = build_manifest(spark, {n: at(n) for n in published}, hashes=False)
        over = budget_check(sizes, limits).where("NOT ok").collect()
        if over:
            raise QualityGateError(f"outputs over their limit: {over}")
    parquet = {n: at(n) for n in published[:5]}
    manifest = with_rows(build_manifest(spark, {n: at(n) for n in published}), spark, parquet)
    manifest.write.mode("overwrite").json(at("manifest"))
    tables_of = [*published, "well_attrs", "prod_monthly", "manifest"]
    releases.publish(spark, out, {n: [f"{folder}/{n}"] for n in tables_of})
    return spark.read.json(at("manifest"))
