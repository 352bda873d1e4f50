"""Units and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors to oilfield units.
M3_TO_BBL = 6.28981
E3M3_TO_MCF = 35.3147
M_TO_FT = 3.28084

# Measure kind -> factor. Kinds that are not listed are left as stored.
FACTORS = {"oil": M3_TO_BBL, "water": M3_TO_BBL, "gas": E3M3_TO_MCF, "length": M_TO_FT}


def to_oilfield(c: Column | str, kind: str) -> Column:
    """Display conversion; nothing is stored converted."""
    c = F.col(c) if isinstance(c, str) else c
    return c * F.lit(FACTORS[kind]) if kind in FACTORS else c


def ratio(numerator: Column, denominator: Column, scale: float = 1.0) -> Column:
    """``numerator * scale / denominator``, NULL where the denominator is zero or missing."""
    top = numerator if scale == 1.0 else numerator * F.lit(scale)
    return top / F.nullif(denominator, F.lit(0.0))


def or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))
