"""Table operators: filters, temporal joins, distributed ranking, encoding, statistics."""
