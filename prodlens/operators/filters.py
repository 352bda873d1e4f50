"""Filters as data: lists of allowed values, closed ranges, and reports on what was not applied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prodlens.functions.text import folded_contains

Range = Mapping[str, Any]
Filters = Mapping[str, Any]


def is_active(selection: Any) -> bool:
    """A missing selection or an empty list constrains nothing."""
    return selection is not None and not (isinstance(selection, (list, tuple)) and not selection)


def one_of(col: str, values: Sequence[Any]) -> Column:
    """Membership; values that do not occur simply match nothing."""
    return F.col(col).isin(list(values))


def in_range(col: str, low: Any = None, high: Any = None) -> Column:
    """Closed range with open ends. NULL never passes, even with both ends open."""
    c = F.col(col)
    test = c.isNotNull()
    if low is not None:
        test = test & (c >= F.lit(low))
    if high is not None:
        test = test & (c <= F.lit(high))
    return test


def condition(col: str, selection: Any) -> Column:
    if isinstance(selection, Mapping):
        return in_range(col, selection.get("min"), selection.get("max"))
    return one_of(col, selection)


class FilterError(ValueError):
    """A filter names a column that the table does not have."""


def apply_filters(df: DataFrame, filters: Filters) -> DataFrame:
    """Rows passing every active filter; a filter on an absent column is refused.

    Where such filters are to be reported and not refused, ``split_filters`` takes them out first.
    """
    if absent := unsupported_filters(df, filters):
        raise FilterError(f"no columns {absent} to filter")
    for name, selection in filters.items():
        if is_active(selection):
            df = df.where(condition(name, selection))
    return df


def split_filters(df: DataFrame, filters: Filters) -> tuple[dict[str, Any], list[str]]:
    """The filters the table can apply, and the names of the active ones it cannot."""
    absent = unsupported_filters(df, filters)
    return {n: s for n, s in filters.items() if n not in absent}, absent


def unsupported_filters(df: DataFrame, filters: Filters) -> list[str]:
    """Active filters that name a column the table does not have."""
    return [n for n, s in filters.items() if is_active(s) and n not in df.columns]


def unmatched_values(df: DataFrame, filters: Filters) -> DataFrame:
    """Requested (column, value) pairs that do not occur in the table.

    The requested pairs are the only rows built on the driver. One pass over the table
    marks which of them occur; no domain is collected.
    """
    asked = [
        (name, str(v))
        for name, sel in filters.items()
        if isinstance(sel, (list, tuple)) and sel and name in df.columns
        for v in sel
    ]
    schema = T.StructType(
        [T.StructField("dim", T.StringType()), T.StructField("value", T.StringType())]
    )
    wanted = df.sparkSession.createDataFrame(asked, schema)
    names = sorted({d for d, _ in asked})
    if not names:
        return wanted
    present = (
        df.select(
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("dim"), F.col(n).cast("string").alias("value"))
                        for n in names
                    ]
                )
            ).alias("x")
        )
        .select("x.dim", "x.value")
        .join(F.broadcast(wanted), ["dim", "value"], "left_semi")
        .distinct()
    )
    return wanted.join(present, ["dim", "value"], "left_anti")


def filter_report(df: DataFrame, filters: Filters) -> DataFrame:
    """One table of both problems: ``unsupported`` columns and ``unmatched`` values."""
    schema = "problem string, dim string, value string"
    absent = [("unsupported", n, None) for n in unsupported_filters(df, filters)]
    return df.sparkSession.createDataFrame(absent, schema).unionByName(
        unmatched_values(df, filters).select(F.lit("unmatched").alias("problem"), "dim", "value")
    )


def search_values(values: DataFrame, col: str, term: str, selected: Sequence[Any] = ()) -> DataFrame:
    """Rows of a domain whose value contains the term, case and accents ignored.

    Selected values are always kept, so a filter can never be active and invisible; an empty
    term keeps everything.
    """
    if not term.strip():
        return values
    found = folded_contains(col, term)
    return values.where(found | one_of(col, selected) if selected else found)


def narrow(filters: Filters, col: str, values: Sequence[Any]) -> dict[str, Any] | None:
    """Intersect a fixed set with the user's own selection of ``col``, a list or a range.

    ``None`` means the intersection is empty and no row can match, which is not the same as
    an empty list, which would constrain nothing.
    """
    chosen = filters.get(col)
    if isinstance(chosen, Mapping):
        low, high = chosen.get("min"), chosen.get("max")
        keep = [v for v in values if (low is None or v >= low) and (high is None or v <= high)]
    else:
        keep = [v for v in chosen if v in values] if is_active(chosen) else list(values)
    return {**filters, col: keep} if keep else None


def apply_narrowed(df: DataFrame, filters: Filters | None) -> DataFrame:
    """``apply_filters`` for the result of ``narrow``."""
    return df.where(F.lit(False)) if filters is None else apply_filters(df, filters)
