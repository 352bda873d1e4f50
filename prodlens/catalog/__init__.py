"""Registered queries over the star schema and the SQL that states the same results."""
