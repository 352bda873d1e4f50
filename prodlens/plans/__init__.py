"""Derived tables built from the operators: enrichment, cubes, curves, summary, quality, spec queries."""
