"""Structured queries: a spec of filters, groups, measures, order and limit becomes a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prodlens.operators.filters import (
    apply_filters,
    is_active,
    split_filters,
    unmatched_values,
    unsupported_filters,
)

AGGREGATES = ("sum", "mean", "count", "countDistinct")

# Dimensions that only the block cube carries.
BLOCK_ONLY = ("area", "yacimiento", "name_marker", "trajectory_class")


@dataclass(frozen=True)
class Measure:
    name: str
    col: str | None = None
    agg: str = "sum"

    @classmethod
    def of(cls, m: Measure | Mapping[str, Any]) -> Measure:
        return m if isinstance(m, Measure) else cls(m["as"], m.get("col"), m.get("agg", "sum"))


@dataclass(frozen=True)
class QuerySpec:
    """``filters`` maps a column to allowed values or to ``{"min": …, "max": …}``."""

    source: str
    filters: Mapping[str, Any] = field(default_factory=dict)
    group_by: tuple[str, ...] = ()
    measures: tuple[Measure, ...] = ()
    order_by: str | None = None
    order: str = "desc"
    limit: int | None = None

    @classmethod
    def from_dict(cls, d: Mapping[str, Any]) -> QuerySpec:
        """From the JSON form with ``groupBy``, ``orderBy`` and measures ``{as, col, agg}``."""
        return cls(
            source=d["source"],
            filters=dict(d.get("filters") or {}),
            group_by=tuple(d.get("groupBy") or ()),
            measures=tuple(Measure.of(m) for m in d.get("measures") or ()),
            order_by=d.get("orderBy"),
            order=d.get("order") or "desc",
            limit=d.get("limit"),
        )


class SpecError(ValueError):
    """The spec does not fit the source."""


@dataclass
class QueryEngine:
    """Named sources and the compiler from spec to DataFrame.

    ``strict`` refuses filters on absent columns; otherwise they are left out and must be
    asked for with ``report``. ``zero_fill_sum`` makes the sum of nothing 0 instead of NULL.
    """

    sources: dict[str, DataFrame] = field(default_factory=dict)
    strict: bool = True
    zero_fill_sum: bool = False

    def register(self, name: str, df: DataFrame) -> None:
        self.sources[name] = df

    def source(self, name: str) -> DataFrame:
        if name not in self.sources:
            raise SpecError(f"source {name!r} is not registered; known: {sorted(self.sources)}")
        return self.sources[name]

    def check(self, spec: QuerySpec) -> DataFrame:
        """Validate against the schema; nothing is run."""
        df = self.source(spec.source)
        problems = [f"no column {g!r} to group by" for g in spec.group_by if g not in df.columns]
        for m in spec.measures:
            if m.agg not in AGGREGATES:
                problems.append(f"unknown aggregate {m.agg!r}")
            elif m.agg != "count" and m.col not in df.columns:
                problems.append(f"no column {m.col!r} to measure")
        names = [*spec.group_by, *(m.name for m in spec.measures)]
        outputs = set(names)
        problems += [f"two outputs named {n!r}" for n in sorted(outputs) if names.count(n) > 1]
        if spec.limit is not None and spec.limit < 0:
            problems.append(f"negative limit {spec.limit}")
        if spec.order_by is not None and spec.order_by not in outputs:
            problems.append(f"cannot order by {spec.order_by!r}")
        if spec.order not in ("asc", "desc"):
            problems.append(f"unknown order {spec.order!r}")
        if self.strict:
            problems += [f"no column {c!r} to filter" for c in unsupported_filters(df, spec.filters)]
        if problems:
            raise SpecError("; ".join(problems))
        return df

    def _measure(self, m: Measure) -> Column:
        if m.agg == "count":
            return F.count("*").alias(m.name)
        c = F.col(m.col)
        if m.agg == "sum":
            total = F.sum(c)
            total = F.coalesce(total, F.lit(0)) if self.zero_fill_sum else total
            return total.alias(m.name)
        return (F.avg(c) if m.agg == "mean" else F.countDistinct(c)).alias(m.name)

    def compile(self, spec: QuerySpec | Mapping[str, Any]) -> DataFrame:
        """A lazy DataFrame. NULL measures come last in descending and first in ascending order;
        ties follow the group columns, so a limit always keeps the same rows. A limit of 0 is no
        limit, as none is."""
        spec = spec if isinstance(spec, QuerySpec) else QuerySpec.from_dict(spec)
        source = self.check(spec)
        rows = apply_filters(source, split_filters(source, spec.filters)[0])
        aggs = [self._measure(m) for m in spec.measures]
        if spec.group_by:
            out = rows.groupBy(*spec.group_by)
            out = out.agg(*aggs) if aggs else rows.select(*spec.group_by).distinct()
        else:
            out = rows.agg(*aggs)
        if spec.order_by:
            c = F.col(spec.order_by)
            first = c.asc_nulls_first() if spec.order == "asc" else c.desc_nulls_last()
            out = out.orderBy(first, *[g for g in spec.group_by if g != spec.order_by])
        return out.limit(spec.limit) if spec.limit else out

    def rows(self, source: str, filters: Mapping[str, Any]) -> DataFrame:
        """The underlying rows that pass the filters, not aggregated."""
        df = self.check(QuerySpec(source, filters))
        return apply_filters(df, split_filters(df, filters)[0])

    def report(self, source: str, filters: Mapping[str, Any]) -> tuple[list[str], DataFrame]:
        """Filters that cannot be applied, and requested values that do not occur."""
        df = self.source(source)
        return unsupported_filters(df, filters), unmatched_values(df, filters)


def with_time_range(filters: Mapping[str, Any], column: str | None, span: Mapping[str, Any] | None):
    """Fold a time range into the filters; sources without a time column pass ``None``."""
    return {**filters, column: dict(span)} if column and span else dict(filters)


def pick_cube(dim: str, filters: Mapping[str, Any]) -> str:
    """``block`` if the breakdown or an active filter needs a dimension only that cube has."""
    needed = {dim, *(n for n, s in filters.items() if is_active(s))}
    return "block" if needed & set(BLOCK_ONLY) else "cube"
