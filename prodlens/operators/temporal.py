"""Joins that depend on time: closed intervals, as-of, latest row, and their guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from prodlens.common import FAR_FUTURE


class RowGuardError(ValueError):
    """A temporal join would change, or has changed, the number of rows."""


def _open_end(end: str):
    return F.coalesce(F.col(end), F.lit(FAR_FUTURE).cast("date"))


def interval_join(
    fact: DataFrame,
    spans: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    cols: dict[str, str],
    slice_unit: str | None = None,
) -> DataFrame:
    """Left join of a dated fact with the spans in force on its date (both ends included).

    ``cols`` maps span columns to output names. A NULL ``end`` is an open span. Where spans
    of one key overlap the fact row is repeated, as an SQL range join would do.

    The key equality makes this a hash or sort-merge join. On a monthly panel a key has at
    most one row per month, so no key can grow with the data. For facts without that bound,
    ``slice_unit`` (``year``, ``month``) joins on (key, slice) instead, which cuts a hot key
    into one group per slice of time; each span is repeated once per slice it covers.
    """
    side = spans.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.col(start).alias("_from"),
        _open_end(end).alias("_to"),
        *[F.col(c).alias(o) for c, o in cols.items()],
    )
    on = (F.col(key) == F.col("_key")) & F.col(at).between(F.col("_from"), F.col("_to"))
    if slice_unit is None:
        return fact.join(side, on, "left").drop("_key", "_from", "_to")
    last = fact.agg(F.max(at)).scalar()
    first = fact.agg(F.min(at)).scalar()
    cut = lambda c: F.trunc(c, slice_unit)
    lo, hi = F.greatest("_from", first), F.least("_to", last)
    sliced = side.where(lo <= hi).withColumn(
        "_slice",
        F.explode(F.sequence(cut(lo), cut(hi), F.expr(f"interval 1 {slice_unit}"))),
    )
    tagged = fact.withColumn("_fslice", cut(F.col(at)))
    return tagged.join(sliced, on & (F.col("_fslice") == F.col("_slice")), "left").drop(
        "_key", "_from", "_to", "_slice", "_fslice"
    )


def latest_per_date(
    events: DataFrame, key: str, at: str, cols: list[str], tie_break: list[str] | None = None
) -> DataFrame:
    """One state per key and date; the highest ``tie_break`` wins, else the highest state.

    Combined before the shuffle, so a key with very many events sends one row per date and
    map task.
    """
    state = F.struct(*cols)
    best = F.max_by(state, F.struct(*tie_break, *cols)) if tie_break else F.max(state)
    return (
        events.where(F.col(key).isNotNull() & F.col(at).isNotNull())
        .groupBy(key, at)
        .agg(best.alias("_state"))
    )


def asof_join(
    fact: DataFrame,
    events: DataFrame,
    key: str,
    at: str,
    event_at: str,
    cols: dict[str, str],
    tie_break: list[str] | None = None,
    strategy: str = "spans",
    slice_unit: str = "year",
) -> DataFrame:
    """Left join of each fact row with the latest event at or before its date.

    ``spans``: events become half-open spans with ``lead`` and join on the key; right for a
    panel, where key and date are unique, because the fact keeps its partitioning by key.

    ``fill``: facts and events are sorted together and the last state is carried forward.
    The sort runs inside (key, slice of time): the state entering each slice is found on the
    per-slice summary first, so a key with any number of rows is spread over its slices.
    """
    states = latest_per_date(events, key, event_at, list(cols), tie_break)
    names = [F.col("_state")[c].alias(o) for c, o in cols.items()]
    if strategy == "spans":
        by_key = Window.partitionBy(key).orderBy(event_at)
        side = states.select(
            F.col(key).alias("_key"),
            F.col(event_at).alias("_from"),
            F.lead(event_at).over(by_key).alias("_until"),
            "_state",
        )
        on = (
            (F.col(key) == F.col("_key"))
            & (F.col(at) >= F.col("_from"))
            & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
        )
        joined = fact.join(side, on, "left")
        return joined.select(*[joined[c] for c in fact.columns], *names)
    if strategy != "fill":
        raise ValueError(f"unknown as-of strategy {strategy!r}")

    cut = F.date_trunc(slice_unit, "_t")
    probes = fact.withColumn("_t", F.col(at).cast("timestamp_ntz")).withColumn("_kind", F.lit(2))
    changes = states.select(
        key, F.col(event_at).cast("timestamp_ntz").alias("_t"), "_state", F.lit(1).alias("_kind")
    )
    probe_slices = (
        probes.select(key, cut.alias("_slice")).where(F.col(key).isNotNull()).distinct()
    )
    change_slices = changes.groupBy(key, cut.alias("_slice")).agg(
        F.max_by("_state", "_t").alias("_state")
    )
    summary = (
        probe_slices.unionByName(change_slices, allowMissingColumns=True)
        .groupBy(key, "_slice")
        .agg(F.first("_state", ignorenulls=True).alias("_state"))
    )
    earlier = (
        Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    entering = summary.select(
        key,
        F.col("_slice").cast("timestamp_ntz").alias("_t"),
        F.last("_state", ignorenulls=True).over(earlier).alias("_state"),
        F.lit(0).alias("_kind"),
    ).where(F.col("_state").isNotNull())
    so_far = (
        Window.partitionBy(key, "_slice")
        .orderBy("_t", "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    together = (
        probes.unionByName(changes, allowMissingColumns=True)
        .unionByName(entering, allowMissingColumns=True)
        .withColumn("_slice", cut)
        .withColumn("_state", F.last("_state", ignorenulls=True).over(so_far))
        .where(F.col("_kind") == 2)
        .withColumn(
            "_state", F.when(F.col(key).isNotNull() & F.col(at).isNotNull(), F.col("_state"))
        )
    )
    return together.select(*fact.columns, *names)


def latest_row(
    df: DataFrame, key: str, at: str, cols: dict[str, str], tie_break: list[str] | None = None
) -> DataFrame:
    """The row with the greatest date per key, combined before the shuffle. The buffer is a struct,
    so Spark sorts each side of the shuffle by key; no window and no sort by date is needed."""
    best = F.max_by(F.struct(*cols), F.struct(at, *(tie_break or []), *cols)).alias("_row")
    picked = df.groupBy(key).agg(best)
    return picked.select(key, *[F.col("_row")[c].alias(o) for c, o in cols.items()])


def overlapping_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that begin before an earlier span of the same key has ended."""
    earlier = (
        Window.partitionBy(key)
        .orderBy(start, F.coalesce(F.col(end), F.lit(FAR_FUTURE).cast("date")))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        spans.select(key, start, end)
        .withColumn("reaches", F.max(_open_end(end)).over(earlier))
        .where(F.col("reaches") >= F.col(start))
    )


def require_disjoint_spans(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Return ``spans`` unchanged, or raise and name some keys whose spans overlap."""
    bad = overlapping_spans(spans, key, start, end).select(key).distinct()
    if n := bad.count():
        named = sorted(r[0] for r in bad.limit(20).collect())
        raise RowGuardError(f"overlapping spans for {n} values of {key}, among them {named}")
    return spans


class RowGuard:
    """Counts rows before and after a temporal join in the job that writes its result.

    The counts are taken as rows pass by, so the join is executed once. Tasks that run again may count
    twice; counts that agree are believed, and others are taken again from both tables.
    """

    def __init__(self, what: str):
        self.what, self.seen = what, (Observation(), Observation())

    def before(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen[0], F.count(F.lit(1)).alias("n"))

    def after(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen[1], F.count(F.lit(1)).alias("n"))

    def check(self, before: DataFrame, written: DataFrame) -> int:
        """To be called when the result has been written; returns the number of rows, or raises."""
        n, m = (o.get["n"] for o in self.seen)
        return n if n == m else require_same_rows(before, written, self.what)


def require_same_rows(before: DataFrame, after: DataFrame, what: str) -> int:
    """Raise unless a join kept the number of rows; returns that number."""
    n, m = before.count(), after.count()
    if n != m:
        raise RowGuardError(f"{what}: {n} rows before, {m} after")
    return n
