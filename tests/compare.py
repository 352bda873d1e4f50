"""Run registered queries in Spark and their SQL in DuckDB and report differences.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return (2, f"{0.0 if f == 0 else f:.12g}")
    return (3, str(v))


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, oracle, sf_dir):
    """``None`` if both engines agree, otherwise what differs."""
    df = query(spark, sf_dir)
    got_cols, got = canonical([tuple(r) for r in df.collect()], df.columns)
    if oracle is None:
        return None if got else "no rows"
    cur = con.execute(oracle)
    cols = [d[0] for d in cur.description]
    want_cols, want = canonical(cur.fetchall(), cols)
    if got_cols != want_cols:
        return f"columns {got_cols} against {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from prodlens.common import clear_work

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(argv) > 1 and name not in argv[1:]:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - reported per query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        clear_work(spark)
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:<26}{time.time() - start:7.2f}s  {problem or ''}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
