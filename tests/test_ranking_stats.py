from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import by_key

from prodlens.common import pin
from prodlens.operators import ranking, stats


def _rows(n=3000, seed=3):
    """A third of the rows in one group, a third of the values equal, some missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else (None if i % 17 == 0 else f"g{i % 11}")
        u = rng.random()
        v = 0.0 if u < 0.33 else None if u < 0.4 else float("nan") if u < 0.41 else float("inf") if u < 0.42 else rng.lognormvariate(3, 2)
        out.append((g, v, rng.choice([1.0, 2.0, 3.0, None]), float(i)))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    rows = _rows()
    pdf = pd.DataFrame(rows, columns=["g", "v", "w", "i"])
    pdf.loc[~np.isfinite(pdf.v.astype(float)), "v"] = np.nan
    return spark.createDataFrame(rows, "g string, v double, w double, i double").cache(), pdf


@pytest.mark.parametrize("buckets", [2, 8, 40])
def test_exact_quantiles_match_numpy(sample, buckets):
    df, pdf = sample
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = by_key(ranking.exact_quantiles(df, ["g"], ["v", "w"], probs, buckets=buckets), "g")
    for g, part in pdf.groupby("g", dropna=False):
        key = None if isinstance(g, float) else g
        for c in ("v", "w"):
            want = np.quantile(part[c].dropna(), probs)
            have = [got[key][f"{c}_p{round(q * 100)}"] for q in probs]
            assert have == pytest.approx(list(want), rel=1e-12), (key, c)
    assert len(got) == pdf.g.nunique(dropna=False)


def test_quantiles_of_missing_and_single_values(spark):
    df = spark.createDataFrame([("a", 5.0, None), ("b", None, None)], "g string, x double, y double")
    got = by_key(ranking.exact_quantiles(df, ["g"], ["x", "y"], [0.1, 0.5]), "g")
    assert got["a"].x_p10 == got["a"].x_p50 == 5.0 and got["a"].y_p50 is None
    assert "b" not in got  # no value in any column


def test_average_ranks(sample):
    df, pdf = sample
    got = by_key(ranking.average_ranks(df, ["g"], "w"), "g", "w")
    ranked = pdf.assign(r=pdf.groupby("g", dropna=False).w.rank())
    for (g, w), part in ranked.dropna(subset=["w"]).groupby(["g", "w"], dropna=False):
        key = None if isinstance(g, float) else g
        assert got[(key, w)].avg_rank == part.r.iloc[0]
        assert got[(key, w)].n == len(part)


def test_ordered_index_is_dense_and_sorted(spark):
    rows = [("a", f"v{i:03d}") for i in range(200)] * 2 + [("b", "x"), ("b", None), ("b", "A")]
    out = ranking.ordered_index(spark.createDataFrame(rows, "dim string, value string"), ["dim"], "value", partitions=7)
    got = {(r.dim, r.value): r.code for r in out.collect()}
    assert [got[("a", f"v{i:03d}")] for i in range(200)] == list(range(200))
    assert got[("b", "A")] == 0 and got[("b", "x")] == 1 and len(got) == 202


def test_describe(sample):
    df, pdf = sample
    row = stats.describe(df, "v").first()
    v = pdf.v.dropna()
    assert row.n == len(v) and row.missing == len(pdf) - len(v)
    assert row["mean"] == pytest.approx(v.mean()) and row.sd == pytest.approx(v.std()) and row["sum"] == pytest.approx(v.sum())
    assert row["min"] <= row.p10 <= row.p25 <= row.p50 <= row.p75 <= row.p90 <= row["max"]


def test_describe_edges(spark):
    df = spark.createDataFrame([("one", 4.0), ("none", None), ("none", None)], "g string, v double")
    got = by_key(stats.describe(df, "v", ["g"]), "g")
    assert got["one"].sd == 0.0 and got["one"].p90 == 4.0
    assert got["none"].n == 0 and got["none"].missing == 2 and got["none"]["sum"] == 0.0 and got["none"]["mean"] is None


def test_describe_by_group_puts_the_whole_first(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 3.0)], "g string, v double")
    rows = stats.describe_by_group(df, "v", "g", "All", "(sin dato)").orderBy("place", "n", ascending=[True, False]).collect()
    assert [(r.g, r.n) for r in rows] == [("All", 3), ("(sin dato)", 2), ("a", 1)]


def brute_histogram(values, log=False, max_bins=60):
    s = sorted(v for v in values if v is not None and math.isfinite(v))
    if log:
        s = [math.log10(v) for v in s if v > 0]
    if len(s) < 2:
        return []
    iqr = np.quantile(s, 0.75) - np.quantile(s, 0.25)
    lo, hi = s[0], s[-1]
    width = 2 * iqr * len(s) ** (-1 / 3) if iqr > 0 else (hi - lo) / 20
    width = width if width > 0 else 1.0
    count = math.ceil((hi - lo) / width)
    if count > max_bins:
        count, width = max_bins, (hi - lo) / max_bins
    count = max(count, 1)
    bins = [0] * count
    for v in s:
        bins[min(max(math.floor((v - lo) / width), 0), count - 1)] += 1
    return bins


@pytest.mark.parametrize("log", [False, True])
def test_histogram_matches_brute_force(sample, log):
    df, pdf = sample
    got = stats.histogram(df, "v", log=log).orderBy("bin").collect()
    want = brute_histogram([None if pd.isna(v) else v for v in pdf.v], log)
    assert [r.n for r in got] == want
    assert all(a.x1 == pytest.approx(b.x0) for a, b in zip(got, got[1:]))


@pytest.mark.parametrize(
    "values", [[1.0] * 50 + [9.0], [3.0, 3.0, 3.0], [5.0], [], [1.0, 2.0]]
)
def test_histogram_fallbacks(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.n for r in stats.histogram(df, "v").orderBy("bin").collect()] == brute_histogram(values)


def brute_lorenz(values, points=100):
    s = sorted(v for v in values if v is not None and math.isfinite(v) and v > 0)
    if len(s) < 2:
        return [], None
    total, cum, area, curve = sum(s), 0.0, 0.0, [(0.0, 0.0)]
    step = max(1, len(s) // points)
    for i, v in enumerate(s):
        before = cum / total
        cum += v
        area += (before + cum / total) / 2 / len(s)
        if i % step == 0 or i == len(s) - 1:
            curve.append(((i + 1) / len(s) * 100, cum / total * 100))
    return curve, 1 - 2 * area


@pytest.mark.parametrize("which", ["sample", "ties", "two", "one"])
def test_lorenz_and_gini(spark, sample, which):
    values = {
        "sample": [None if pd.isna(v) else v for v in sample[1].v],
        "ties": [2.0] * 700 + [1.0] * 50 + [5.0] * 3,
        "two": [1.0, 3.0],
        "one": [4.0, -1.0],
    }[which]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    curve, gini = brute_lorenz(values)
    got = sorted((r.pct_entities, r.pct_total) for r in stats.lorenz_curve(df, "v").collect())
    assert len(got) == len(curve)
    for a, b in zip(got, curve):
        assert a == pytest.approx(b)
    row = stats.gini(df, "v").first()
    assert row.gini is None if gini is None else row.gini == pytest.approx(gini) and -1e-9 <= row.gini <= 1


@pytest.mark.parametrize("n, frac", [(3, 0.05), (30, 0.05), (101, 0.05), (10, 0.25)])
def test_top_share(spark, n, frac):
    values = [float(1 + i % 7) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(-5.0,), (None,)], "v double")
    s = sorted(values, reverse=True)
    k = max(1, math.floor(n * frac + 0.5))
    row = stats.top_share(df, "v", frac).first()
    assert (row.wells, row.of) == (k, n) and row.share == pytest.approx(sum(s[:k]) / sum(s) * 100)
    low = stats.top_share(df, "v", frac, floor_rule=True).first()
    assert low.wells == math.floor(n * frac) and low.share == pytest.approx(sum(s[: low.wells]) / sum(s) * 100)


def test_top_share_of_nothing(spark):
    assert stats.top_share(spark.createDataFrame([(-1.0,)], "v double"), "v").count() == 0


def test_correlations_match_pandas(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(1000):
        a = rng.choice([0.0, rng.gauss(0, 1)])
        b = a * 2 + rng.gauss(0, 1)
        rows.append((a, b if rng.random() > 0.1 else None, float(rng.randrange(4)), 1.0))
    cols = ["a", "b", "c", "flat"]
    pdf = pd.DataFrame(rows, columns=cols)
    got = by_key(stats.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double, flat double"), cols), "var_x", "var_y")
    assert len(got) == 6
    for x, y in [("a", "b"), ("a", "c"), ("b", "c")]:
        pair = pdf[[x, y]].dropna()
        assert got[(x, y)].pearson == pytest.approx(pair[x].corr(pair[y]))
        assert got[(x, y)].spearman == pytest.approx(pair[x].rank().corr(pair[y].rank()))
        assert got[(x, y)].n == len(pair)
    assert got[("a", "flat")].pearson is None and got[("a", "flat")].spearman is None


def test_correlation_needs_three_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None)], "a double, b double")
    row = stats.correlation_matrix(df, ["a", "b"]).first()
    assert row.pearson is None and row.spearman is None


def test_both_passes_over_the_counts_share_their_shuffle(sample):
    df, _ = sample
    out = ranking.exact_quantiles(pin(df), ["g"], ["v", "w"], [0.5])
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_no_window_or_sort_collects_a_group(sample):
    """Ranks are finished inside (group, bucket): every window carries the bucket or sums totals."""
    df, _ = sample
    plan = ranking.exact_quantiles(df, ["g"], ["v"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "percentile" not in plan
