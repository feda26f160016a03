import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions import pvalues
from panelspark.operators import compare, significance
from panelspark.operators.layout import _counted, exact_median, exact_medians, order_key, with_rows_below


def t_tail(t, df, steps=200_001):
    """P(|T| >= t) by Simpson's rule on the angle."""
    a = np.linspace(math.atan(t / math.sqrt(df)), math.pi / 2, steps)
    f = np.cos(a) ** (df - 1)
    area = (a[1] - a[0]) / 3 * (f[0] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum() + f[-1])
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    return 2 * c * area


def test_t_p_values(spark):
    cases = [(t, d) for t in (0.0, 0.3, 1.0, 2.5, 6.0) for d in (1, 2, 3, 4, 29, 30, 999, 1000, 1001, 5000)]
    df = spark.createDataFrame(cases, "t double, df int")
    for r in df.select("t", "df", pvalues.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(t_tail(r.t, r.df), abs=1e-9), (r.t, r.df)


def test_normal_p_values(spark):
    df = spark.createDataFrame([(z,) for z in (0.0, -0.5, 1.96, 2.99, 3.01, -5.0, 12.0)], "z double")
    for r in df.select("z", pvalues.normal_two_sided(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-9, abs=1e-15)


def average_ranks(a):
    return np.array([(a < x).sum() + ((a == x).sum() + 1) / 2 for x in a])


def brute_force(d):
    d = np.array(d)
    zeros = (d == 0).sum()
    d = d[d != 0]
    if len(d) == 0:
        return None
    r = average_ranks(np.abs(d))
    plus = r[d > 0].sum()
    n = len(d)
    if zeros == 0 and n <= 50:
        sums = [sum(c) for c in itertools.product(*[(0, i) for i in range(1, n + 1)])]
        k = math.floor(plus)
        low, high = np.mean([s <= k for s in sums]), np.mean([s >= k for s in sums])
        return min(1.0, 2 * min(low, high))
    _, ties = np.unique(np.abs(d), return_counts=True)
    var = n * (n + 1) * (2 * n + 1) / 24 - (ties**3 - ties).sum() / 48
    return math.erfc(abs((plus - n * (n + 1) / 4) / math.sqrt(var)) / math.sqrt(2))


def test_wilcoxon_equals_enumeration(spark):
    rng = np.random.default_rng(0)
    groups = {f"g{i}": list(rng.integers(-4, 6, size=rng.integers(1, 12)).astype(float)) for i in range(25)}
    groups["all zero"] = [0.0, 0.0, 0.0]
    groups["no ties"] = [0.5, -1.5, 2.25, 3.0]
    groups["n51"] = list(np.arange(1, 52) * np.where(np.arange(51) % 3 == 0, -1.0, 1.0))
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("g0", None)]
    got = significance.wilcoxon(spark.createDataFrame(rows, "g string, d double"), ["g"]).collect()
    assert len(got) == len(groups)
    for r in got:
        want = brute_force(groups[r.g])
        assert r.w_p == (pytest.approx(want, abs=1e-9) if want is not None else None), r.g


def test_rank_sums_of_a_large_group(spark):
    """Many distinct values in one group, ranked in digits of nine bits."""
    rng = np.random.default_rng(1)
    d = np.round(rng.normal(0.2, 5, 20_000), 2)
    df = spark.createDataFrame([(float(x),) for x in d], "d double").withColumn("g", F.lit("one"))
    r = significance.signed_rank_sums(df, ["g"], bits=9).first()
    d = d[d != 0]
    order = np.abs(d)
    values, inverse, counts = np.unique(order, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - counts + (counts + 1) / 2)[inverse]
    assert r.n_ranks == len(d)
    assert r.w_plus == pytest.approx(ranks[d > 0].sum()) and r.w_minus == pytest.approx(ranks[d < 0].sum())


def test_exact_median_of_large_and_small_groups(spark):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(0, 1, 30_001), "even": rng.integers(0, 5, 4000).astype(float), "one": np.array([3.0]),
              "two": np.array([1.0, 4.0]), None: np.array([1.0, 2.0, 9.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None)]
    got = exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()
    assert {r.g: r.m for r in got} == {g: float(np.median(v)) for g, v in groups.items()}


def test_dm_edges(spark):
    rows = [("same", 1, 2.0)] * 3 + [("single", 1, 1.0)] + [("h", 3, float(i)) for i in range(3)] + [("h1", 3, 1.0), ("h1", 3, 2.0)]
    out = significance.dm_statistics(spark.createDataFrame(rows, "g string, horizon int, d double"), ["g", "horizon"])
    by = {r.g: r for r in out.collect()}
    assert len(by) == 4
    assert by["same"].dm_hln is None and by["same"].mean_d == 2.0
    assert by["single"].dm_hln is None and by["single"].mean_d is None
    assert by["h"].dm_hln == 0.0 and by["h1"].dm_hln == 0.0


def test_dm_statistic(spark):
    rng = np.random.default_rng(3)
    d = rng.normal(0.3, 1, 30)
    df = spark.createDataFrame([(5, float(x)) for x in d], "horizon int, d double")
    r = significance.dm_statistics(df, ["horizon"]).first()
    t, h = 30, 5
    dm = d.mean() / math.sqrt(d.var(ddof=1) / t) * math.sqrt((t + 1 - 2 * h + h * (h - 1) / t) / t)
    assert r.dm_hln == pytest.approx(dm) and r.p == pytest.approx(t_tail(abs(dm), 29), abs=1e-9)


def test_ties_keep_the_first(spark):
    rows = [("c", 1, f"m{i}", "x", 1.0, 50.0, i) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, "currency string, horizon int, model string, config string, rmse double, da double, ord int")
    for metric in ("rmse", "da"):
        assert compare.best_per_group(df, compare.CELL, metric).first().model == "m1"
        assert [r.model for r in compare.leaderboard(df, metric, 2).collect()] == ["m1", "m2"]


def test_pairing_by_rank(spark):
    a = spark.createDataFrame([("k", i, float(i)) for i in (5, 1, 3)] + [("few", 1, 1.0)], "key string, w int, v double")
    b = spark.createDataFrame([("k", i, float(-i)) for i in (2, 4)] + [("few", 9, 1.0)], "key string, w int, v double")
    got = compare.paired_by_rank(a, b, ["key"], "w", "v").orderBy("rank").collect()
    assert [(r.key, r.rank, r.left_value, r.right_value) for r in got] == [("k", 1, 1.0, -2.0), ("k", 2, 3.0, -4.0)]


def test_grid_subsets(spark):
    sizes = {s: compare.param_grid(spark, ["a", "b"], [1, 5], ["x"], ["y"], s).count() for s in (None, "news", "prompt", "interaction")}
    assert sizes == {None: 20, "news": 12, "prompt": 12, "interaction": 20}


def test_forms_of_p_values_agree_at_the_border(spark):
    from panelspark.functions.pvalues import t_two_sided

    rows = spark.range(1, 60).selectExpr("id / 10.0D AS t").crossJoin(spark.createDataFrame([(999.0,), (1000.0,)], "df double"))
    both = rows.select(t_two_sided(F.col("t"), F.col("df"), 1000).alias("a"), t_two_sided(F.col("t"), F.col("df"), 10).alias("b")).collect()
    assert max(abs(r.a - r.b) for r in both) < 1e-10


def bits_of(x):
    n = int(np.array([abs(x)]).view(np.int64)[0])
    return 0 if x == 0 else -n if x < 0 else n


def test_keys_order_as_doubles_do(spark):
    rng = np.random.default_rng(5)
    powers = [2.0**k for k in range(-1074, 1024)]
    near = [np.nextafter(p, d) for p in powers[::7] for d in (0, np.inf)]
    some = np.array(rng.integers(-(2**63), 2**63 - 1, 20_000), np.int64).view(np.float64)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, *powers, *near, *map(float, some[~np.isnan(some)])]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", order_key(F.col("v")).alias("k")).collect()
    assert all(r.k == bits_of(r.v) for r in got)
    odd = spark.createDataFrame([(math.nan,), (None,)], "v double").select(order_key(F.col("v")).alias("k")).collect()
    assert odd[0].k > bits_of(math.inf) and odd[1].k is None


HOT = [("hot", float(v)) for v in np.round(np.random.default_rng(6).lognormal(0, 0.01, 9_000), 5)]
GROUPS = HOT + [("a", v) for v in (3.0, -1.0, -1.0, 0.0, -0.0, 1e300, -1e-300)] + [("b", 2.5)] + [(None, 1.0), (None, 4.0)] + [("none", None)]


@pytest.mark.parametrize("bits", [9, 22, 64])
def test_ranks_and_medians_a_digit_at_a_time(spark, bits):
    df = spark.createDataFrame(GROUPS, "g string, v double")
    values = {g: np.array([v for k, v in GROUPS if k == g and v is not None]) for g in ("hot", "a", "b", None)}
    got = {r.g: r.m for r in exact_median(df, ["g"], "v", "m", bits).collect()}
    assert got == {g: pytest.approx(float(np.median(v)), rel=1e-15) for g, v in values.items()}
    both = exact_medians(df.withColumn("w", -F.col("v")), ["g"], {"x": "v", "y": "w"}, bits).collect()
    assert all(r.x == got[r.g] and r.y == -r.x for r in both) and len(both) == 4
    kinds = df.filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    for r in with_rows_below(kinds, ["g"], "v", "n", "below", bits).collect():
        assert r.below == (values[r.g] < r.v).sum(), r


def test_no_task_orders_more_than_the_digits_under_one_prefix(spark):
    """One group holds nearly all rows; what a window orders is bounded by the digit, not by the group."""
    bits = 6
    kinds = spark.createDataFrame(HOT, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    assert kinds.count() > 40 * 2**bits
    tables = _counted(kinds.select("g", order_key(F.col("v")).alias("_key"), "n"), ["g"], "n", bits)
    for table in tables:
        largest = table.groupBy("g", F.shiftright("_key", bits)).count().agg(F.max("count")).first()[0]
        assert largest <= 2**bits


def test_keys_are_made_per_value_and_not_per_row(spark):
    """Rows are counted per value first: nothing below the counts computes a key, neither to filter nor to group."""
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") % 7 - 3.0).alias("d"))
    for made in (significance.signed_rank_sums(rows, ["g"]), exact_median(rows, ["g"], "d", "m")):
        plan = made._jdf.queryExecution().optimizedPlan().toString().splitlines()
        below = [x for x in plan if "Filter" in x or "Project [(id" in x]
        assert below and not any("log2" in x.lower() for x in below), below
    got = {(r.g, r.n_zero, r.n_ranks) for r in significance.signed_rank_sums(rows, ["g"]).collect()}
    assert sum(n for _, n, _ in got) == 143 and sum(n for _, _, n in got) == 857
