"""Readers, intake of raw partitions, sinks and point lookups."""
