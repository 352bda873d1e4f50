"""Panel analytics on Spark: one row per entity per month, with attributes that change over time."""

__version__ = "0.1.0"
