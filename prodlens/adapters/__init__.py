"""Mappings from other schemas onto the panel tables."""
