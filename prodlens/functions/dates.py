"""Month arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: first month of the month index.
EPOCH_YEAR = 2006


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c: Column | str) -> Column:
    """First day of the month, for dates and zone-less timestamps alike."""
    return F.trunc(_c(c).cast("date"), "MM")


def year_month(c: Column | str) -> Column:
    """``YYYY-MM`` text of a date."""
    return F.date_format(_c(c), "yyyy-MM")


def hours_in_month(c: Column | str) -> Column:
    """Hours available in the month of a date."""
    return F.dayofmonth(F.last_day(_c(c))) * F.lit(24)


def days_in_month(c: Column | str) -> Column:
    return F.dayofmonth(F.last_day(_c(c)))


def months_between_starts(a: Column | str, b: Column | str) -> Column:
    """Month boundaries crossed from ``a`` to ``b``."""
    a, b = _c(a), _c(b)
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def month_index(c: Column | str, epoch_year: int = EPOCH_YEAR) -> Column:
    """Months since January of ``epoch_year``; NULL stays NULL."""
    c = _c(c)
    return (F.year(c) - epoch_year) * 12 + F.month(c) - 1


def month_of_index(idx: Column | str, epoch_year: int = EPOCH_YEAR) -> Column:
    """The first day of the month an index stands for."""
    return F.add_months(F.lit(f"{epoch_year}-01-01").cast("date"), _c(idx))


def month_label(idx: Column | str, epoch_year: int = EPOCH_YEAR) -> Column:
    return year_month(month_of_index(idx, epoch_year))


def date_from_parts(year: Column | str, month: Column | str) -> Column:
    return F.make_date(_c(year), _c(month), F.lit(1))


def clamp_hours(hours: Column | str, at: Column | str, missing_is_full: bool = False) -> Column:
    """Hours cut to what the month holds.

    NULL stays NULL because no declaration is not a full month; ``missing_is_full`` counts it
    as one all the same.
    """
    h, ceiling = _c(hours), hours_in_month(at).cast("double")
    return F.least(h, ceiling) if missing_is_full else F.when(h > ceiling, ceiling).otherwise(h)
