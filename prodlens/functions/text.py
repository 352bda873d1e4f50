"""Text helpers for labels and searching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_REPORTED = "No informado"
NO_DATA = "(sin dato)"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def or_label(c: Column | str, label: str = NOT_REPORTED) -> Column:
    """NULL shown as a label."""
    return F.coalesce(_c(c), F.lit(label))


def title_case(c: Column | str) -> Column:
    """Lower case with a capital after a start, blank, hyphen, slash or opening bracket."""
    parts = F.split(F.lower(_c(c)), r"(?<=[\s\-/(])")
    return F.array_join(F.transform(parts, lambda p: F.initcap(p)), "")


def folded_contains(c: Column | str, term: str) -> Column:
    """Substring test that ignores case and accents."""
    folding = "UNICODE_CI_AI"
    return F.contains(F.collate(_c(c), folding), F.collate(F.lit(term.strip()), folding))
