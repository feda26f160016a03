"""Simple per-series predictors as panel jobs.

Fits are aggregates over lagged pairs (map-side sums), so a series is never
gathered for its fit; predictions are short array recursions inside a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.features import is_train, lag_features
from panelspark.operators.layout import CHUNK_ROWS, framed, unframed
from panelspark.operators.windows import last_values, mean_of, sample_deviation
from panelspark.params import TRAIN_SHARE

ROWS_PER_PART = 25_000  # of tree training; small parts only add jobs' overhead

# --- predictions from the window itself -------------------------------------------


def naive(last: Column, horizon: Column) -> Column:
    """Last value, repeated."""
    return F.array_repeat(last, horizon)


def mean(recent: Column, horizon: Column) -> Column:
    return F.array_repeat(mean_of(recent), horizon)


def drift(recent: Column, horizon: Column) -> Column:
    """Last value plus the mean step of the window."""
    first, last = F.element_at(recent, 1), F.element_at(recent, -1)
    slope = (last - first) / F.greatest(F.lit(1), F.size(recent) - 1)
    return F.transform(F.sequence(F.lit(1), horizon), lambda k: last + slope * k)


def recurse_line(slope: Column, intercept: Column, last: Column, horizon: Column) -> Column:
    """x[k] = intercept + slope * x[k-1], started at the last value."""
    return F.slice(
        F.aggregate(
            F.sequence(F.lit(1), horizon),
            F.array(last),
            lambda path, _: F.concat(path, F.array(intercept + slope * F.element_at(path, -1))),
        ),
        2,
        horizon,
    )


def with_window_predictions(df: DataFrame, lookback: int | Column, digits: int | None = None) -> DataFrame:
    """Explode each window into one row per in-window predictor (naive, mean, drift, ar1).

    With ``digits`` predictions are kept to as many decimals, so one that repeats a price up
    to the last bits of a sum is no move in any direction; right for panels of large prices only.
    """
    recent = df.withColumn("_r", last_values(lookback))
    x, y = F.slice("_r", 1, F.size("_r") - 1), F.slice("_r", 2, F.size("_r") - 1)
    recent = recent.withColumns({"_mx": mean_of(x), "_my": mean_of(y)})
    sums = F.aggregate(
        F.zip_with(x, y, lambda a, b: F.struct((a - F.col("_mx")).alias("a"), (b - F.col("_my")).alias("b"))),
        F.struct(F.lit(0.0).alias("xx"), F.lit(0.0).alias("xy")),
        lambda s, d: F.struct((s["xx"] + d["a"] * d["a"]).alias("xx"), (s["xy"] + d["a"] * d["b"]).alias("xy")),
    )
    recent = recent.withColumn("_s", sums)
    moving = F.array_min(x) < F.array_max(x)
    recent = recent.withColumn("_b", F.when(moving, F.col("_s")["xy"] / F.col("_s")["xx"]).otherwise(F.lit(0.0)))
    recent = recent.withColumn("_a", F.when(moving, F.col("_my") - F.col("_b") * F.col("_mx")).otherwise(F.col("last_price")))
    h = F.col("horizon")
    made = F.array(
        F.struct(F.lit("naive").alias("model"), naive(F.col("last_price"), h).alias("pred")),
        F.struct(F.lit("mean").alias("model"), mean(F.col("_r"), h).alias("pred")),
        F.struct(F.lit("drift").alias("model"), drift(F.col("_r"), h).alias("pred")),
        F.struct(
            F.lit("ar1").alias("model"),
            recurse_line(F.col("_b"), F.col("_a"), F.col("last_price"), h).alias("pred"),
        ),
    )
    pred = F.col("_m.pred") if digits is None else F.transform("_m.pred", lambda v: F.round(v, digits))
    return recent.withColumn("_m", F.explode(made)).select(*df.columns, "_m.model", pred.alias("pred"))


# --- autoregressions fitted per series on the training part ----------------------


def _lagged(df: DataFrame, value: str, series: Sequence[str], p: int, d: int, chunk_rows: int) -> DataFrame:
    """Training rows with ``_y`` (d-times differenced value) and its lags ``_l1.._lp``."""
    rows, w = framed(df.filter(is_train()), series, back=p + d, chunk_rows=chunk_rows)
    weights = [1]
    for _ in range(d):
        weights = [a - b for a, b in zip([*weights, 0], [0, *weights])]

    def at(lag: int) -> Column:
        return reduce(
            lambda a, b: a + b,
            [F.lit(float(c)) * F.lag(value, lag + i).over(w) for i, c in enumerate(weights)],
        )

    cols = [at(0).alias("_y")] + [at(i).alias(f"_l{i}") for i in range(1, p + 1)]
    return unframed(rows.select("*", *cols), chunk_rows=chunk_rows).filter(F.col("pos") > p + d)


def fit_ar1(
    df: DataFrame, value: str = "close", series: Sequence[str] = ("series",), d: int = 1, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """First-order autoregression of the d-times differenced training part, by least squares."""
    return _lagged(df, value, series, 1, d, chunk_rows).groupBy(*series).agg(
        F.regr_slope("_y", "_l1").alias("slope"),
        F.regr_intercept("_y", "_l1").alias("intercept"),
        F.count(F.lit(1)).alias("pairs"),
    )


def predict_ar1(
    df: DataFrame, horizon: int, value: str = "close", series: Sequence[str] = ("series",), d: int = 1
) -> DataFrame:
    """Path of ``horizon`` steps from the end of the training part (d = 0 or 1)."""
    if d not in (0, 1):
        raise ValueError("d must be 0 or 1")
    split = F.floor(F.col("n") * F.lit(TRAIN_SHARE))
    ends = (
        df.filter((F.col("pos") > split - 2) & (F.col("pos") <= split))
        .groupBy(*series)
        .agg(F.max_by(value, "pos").alias("_last"), F.min_by(value, "pos").alias("_before"))
    )
    fitted = ends.join(fit_ar1(df, value, series, d), list(series))
    h = F.lit(horizon)
    if d == 0:
        path = recurse_line(F.col("slope"), F.col("intercept"), F.col("_last"), h)
    else:
        steps = recurse_line(F.col("slope"), F.col("intercept"), F.col("_last") - F.col("_before"), h)
        path = F.transform(
            F.sequence(F.lit(1), h),
            lambda k: F.col("_last") + F.aggregate(F.slice(steps, 1, k), F.lit(0.0), lambda a, x: a + x),
        )
    return fitted.select(*series, "slope", "intercept", "pairs", path.alias("pred"))


def _sweep(row: dict[tuple[int, int], str], k: int, size: int) -> list[tuple[tuple[int, int], str]]:
    """Column expressions that remove lag k from a covariance table held in named columns."""
    out = []
    for i in range(size):
        for j in range(i, size):
            if i > k:
                a, b = row[(min(i, k), max(i, k))], row[(min(j, k), max(j, k))]
                out.append(((i, j), f"{row[(i, j)]} - {a} * {b} / nullif({row[(k, k)]}, 0)"))
    return out


def _covariances(rows: DataFrame, series: Sequence[str], p: int, means: bool = False) -> tuple[DataFrame, dict]:
    """One aggregate with the covariances of lags 1..p and the value (last index)."""
    names = [f"_l{i}" for i in range(1, p + 1)] + ["_y"]
    cov = {(i, j): f"c_{i}_{j}" for i in range(p + 1) for j in range(i, p + 1)}
    sums = [F.covar_pop(names[i], names[j]).alias(c) for (i, j), c in cov.items()]
    if means:
        sums += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(names)]
    return rows.groupBy(*series).agg(F.count(F.lit(1)).alias("pairs"), *sums), cov


def fit_ar(
    df: DataFrame,
    p: int,
    d: int = 0,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Autoregression of order p on the d-times differenced training part, by least squares.

    Normal equations per series come from one aggregate; they are solved by elimination
    in column expressions on the one row per series.
    """
    fitted, cov = _covariances(_lagged(df, value, series, p, d, chunk_rows), series, p, means=True)
    fitted = _solved(fitted, cov, p, "b")
    slopes = "".join(f" - b{k} * _m{k}" for k in range(p))
    coefficients = F.array(*[F.col(f"b{k}") for k in range(p)]) if p else F.array().cast("array<double>")
    return fitted.select(
        *series, "pairs", F.expr(f"_m{p}{slopes}").alias("intercept"), coefficients.alias("coefficients")
    )


def _solved(df: DataFrame, cov: dict[tuple[int, int], str], p: int, name: str) -> DataFrame:
    """Add ``name``0.. of the regression of variable p on variables 0..p-1, from their covariances in named columns."""
    for k in range(p):
        nxt = _sweep(cov, k, p + 1)
        df = df.withColumns({f"{name}_s{k}_{i}_{j}": F.expr(e) for (i, j), e in nxt})
        # rows up to k keep their eliminated form for the way back
        cov = {**cov, **{ij: f"{name}_s{k}_{ij[0]}_{ij[1]}" for ij, _ in nxt}}
    for k in reversed(range(p)):
        rest = "".join(f" - {cov[(k, j)]} * {name}{j}" for j in range(k + 1, p))
        df = df.withColumn(f"{name}{k}", F.expr(f"({cov[(k, p)]}{rest}) / nullif({cov[(k, k)]}, 0)"))
    return df


def _ends(df: DataFrame, need: int, d: int, value: str, series: Sequence[str]) -> DataFrame:
    """The last ``need`` training values per series (``_h0``) and their differences up to order d (``_h1``..)."""
    split = F.floor(F.col("n") * F.lit(TRAIN_SHARE))
    ends = (
        df.filter((F.col("pos") > split - need) & (F.col("pos") <= split))
        .groupBy(*series)
        .agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_s"))
        .select(*series, F.col(f"_s.{value}").alias("_h0"))
    )
    for k in range(d):
        h = F.col(f"_h{k}")
        ends = ends.withColumn(
            f"_h{k + 1}",
            F.zip_with(F.slice(h, 2, F.size(h) - 1), F.slice(h, 1, F.size(h) - 1), lambda b, a: b - a),
        )
    return ends


def _undifferenced(df: DataFrame, d: int, horizon: int) -> DataFrame:
    """Sum ``_p``, a path of d-times differences, back to the level of ``_h0``."""
    for k in reversed(range(d)):
        start = F.element_at(f"_h{k}", -1)
        summed = F.aggregate(
            "_p", F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        df = df.withColumn("_p", F.slice(summed, 2, horizon))
    return df


def predict_ar(
    df: DataFrame,
    horizon: int,
    p: int,
    d: int = 0,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Path of ``horizon`` steps from the end of the training part, any p and d."""
    ends = _ends(df, p + d + 1, d, value, series)
    fitted = ends.join(fit_ar(df, p, d, value, series, chunk_rows), list(series))

    def grow(path: Column, _: Column) -> Column:
        newest_first = F.slice(F.reverse(path), 1, p) if p else F.array().cast("array<double>")
        products = F.zip_with(newest_first, F.col("coefficients"), lambda x, c: x * c)
        return F.concat(path, F.array(F.aggregate(products, F.col("intercept"), lambda a, x: a + x)))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(f"_h{d}"), grow)
    fitted = fitted.withColumn("_p", F.slice(steps, -horizon, horizon))
    fitted = _undifferenced(fitted, d, horizon)
    return fitted.select(*series, "pairs", "intercept", "coefficients", F.col("_p").alias("pred"))


def fit_arma(
    df: DataFrame,
    p: int,
    q: int,
    d: int = 0,
    long: int = 10,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Autoregression of order p with q moving-average terms on the d-times differenced training part.

    Two least-squares stages: a long autoregression estimates the shocks as its residuals, then the
    value is regressed on its p last values and the q last shocks. Both stages use the rows that have
    all ``long`` + q lags, so shocks are a linear map of lags and their covariances one of lag covariances:
    one aggregate over the rows gives both fits, and no residual is ever written next to a row.
    """
    reach = long + q
    fitted, cov = _covariances(_lagged(df, value, series, reach, d, chunk_rows), series, reach, means=True)

    def at(i: int, j: int) -> str:
        """Covariance of lags i and j (lag 0 is the value, the last variable of the table)."""
        a, b = sorted((x - 1 if x else reach for x in (i, j)))
        return cov[(a, b)]

    def mean_at(i: int) -> str:
        return f"_m{i - 1 if i else reach}"

    first = {(i, j): at(i + 1, j + 1) for i in range(long) for j in range(i, long)} | {(i, long): at(i + 1, 0) for i in range(long)}
    fitted = _solved(fitted, {**first, (long, long): at(0, 0)}, long, "a")
    fitted = fitted.withColumn("_c", F.expr(mean_at(0) + "".join(f" - a{i} * {mean_at(i + 1)}" for i in range(long))))
    # shock of lag j against lag k, then shock against shock, and the shocks' means
    shock = {(j, k): f"_u{j}_{k}" for j in range(1, q + 1) for k in range(reach + 1)}
    fitted = fitted.withColumns({c: F.expr(at(j, k) + "".join(f" - a{i} * {at(j + i + 1, k)}" for i in range(long))) for (j, k), c in shock.items()})
    both = {(j, k): f"_w{j}_{k}" for j in range(1, q + 1) for k in range(j, q + 1)}
    fitted = fitted.withColumns({c: F.expr(shock[(j, k)] + "".join(f" - a{i} * {shock[(j, k + i + 1)]}" for i in range(long))) for (j, k), c in both.items()})
    means = {j: f"_e{j}" for j in range(1, q + 1)}
    fitted = fitted.withColumns({c: F.expr(f"{mean_at(j)} - _c" + "".join(f" - a{i} * {mean_at(j + i + 1)}" for i in range(long))) for j, c in means.items()})
    # variables of the second stage: values 1..p, shocks 1..q, and the value itself
    kinds = [("y", i) for i in range(1, p + 1)] + [("e", j) for j in range(1, q + 1)] + [("y", 0)]

    def covariance(x: tuple[str, int], y: tuple[str, int]) -> str:
        if x[0] == y[0] == "y":
            return at(x[1], y[1])
        if x[0] == y[0]:
            return both[(x[1], y[1])]
        return shock[(x[1], y[1])] if x[0] == "e" else shock[(y[1], x[1])]

    size = len(kinds)
    fitted = _solved(fitted, {(i, j): covariance(kinds[i], kinds[j]) for i in range(size) for j in range(i, size)}, p + q, "b")
    sums = "".join(f" - b{k} * {mean_at(n) if kind == 'y' else means[n]}" for k, (kind, n) in enumerate(kinds[:-1]))

    def listed(names: list[str]) -> Column:
        return F.array(*[F.col(x) for x in names]) if names else F.array().cast("array<double>")

    return fitted.select(
        *series, "pairs", F.expr(mean_at(0) + sums).alias("intercept"),
        listed([f"b{k}" for k in range(p)]).alias("ar"), listed([f"b{p + k}" for k in range(q)]).alias("ma"),
        listed([f"a{k}" for k in range(long)]).alias("_long"), F.col("_c").alias("_long_intercept"),
    )


def predict_arma(
    df: DataFrame,
    horizon: int,
    p: int,
    q: int,
    d: int = 0,
    long: int = 10,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Path of ``horizon`` steps from the end of the training part; shocks to come are zero."""
    ends = _ends(df, max(p, long + q) + d, d, value, series)
    fitted = ends.join(fit_arma(df, p, q, d, long, value, series, chunk_rows), list(series))
    newest = F.reverse(F.col(f"_h{d}"))

    def weighted(values: Column, weights: Column) -> Column:
        return F.aggregate(F.zip_with(values, weights, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)

    # shocks of the last q values, newest first
    shocks = [F.get(newest, F.lit(j)) - F.col("_long_intercept") - weighted(F.slice(newest, j + 2, long), F.col("_long")) for j in range(q)]
    fitted = fitted.withColumn("_e", F.array(*shocks) if shocks else F.array().cast("array<double>"))

    def grow(path: Column, k: Column) -> Column:
        past = F.slice(F.reverse(path), 1, p) if p else F.array().cast("array<double>")
        # step k still sees the shocks k..q back from it
        left = F.slice("_e", 1, F.greatest(F.lit(0), F.lit(q) + 1 - k))
        moved = weighted(left, F.slice("ma", k, F.size(left))) if q else F.lit(0.0)
        return F.concat(path, F.array(F.col("intercept") + weighted(past, F.col("ar")) + moved))

    steps = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col(f"_h{d}"), grow)
    fitted = _undifferenced(fitted.withColumn("_p", F.slice(steps, -horizon, horizon)), d, horizon)
    return fitted.select(*series, "pairs", "intercept", "ar", "ma", F.col("_p").alias("pred"))


def order_scores(
    df: DataFrame,
    value: str = "close",
    series: Sequence[str] = ("series",),
    max_p: int = 5,
    max_d: int = 2,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """AIC = n ln(SSE / n) + 2 (p + 1) for every series and order (p, d).

    One table of lag covariances of the level serves every d: a difference is a linear map of
    levels, and so are its covariances. A smaller d has a few rows more at the start of the series; they
    travel along and are added to the moments one by one. For one d all orders share the same rows:
    removing lag after lag from the covariances leaves the residual variance of every nested
    order, so the panel is read once and nothing is refitted.
    """
    size = max_p + 1  # lags 1..max_p, then the value itself
    moments = _level_moments(df, value, series, max_p, max_d, chunk_rows)
    for d in range(max_d + 1):
        weights = [1]
        for _ in range(d):
            weights = [a - b for a, b in zip([*weights, 0], [0, *weights])]

        def mapped(i: int, j: int) -> str:
            terms = [f"{a * b} * {_moment(d, *sorted((i + x, j + y)))}" for x, a in enumerate(weights) for y, b in enumerate(weights)]
            return f"({' + '.join(terms)}) / nullif(n{d}, 0)"

        cov = {(i, j): f"c{d}_{i}_{j}" for i in range(size) for j in range(i, size)}
        lag = [*range(1, max_p + 1), 0]
        moments = moments.withColumns({c: F.expr(mapped(lag[i], lag[j])) for (i, j), c in cov.items()})
        for k in range(max_p + 1):
            mse = F.col(cov[(max_p, max_p)])
            aic = F.when(mse > 0, F.col(f"n{d}") * F.log(mse) + 2 * (k + 1))
            moments = moments.withColumn(f"aic{d}_{k}", aic)
            if k < max_p:
                nxt = _sweep(cov, k, size)
                moments = moments.withColumns({f"s{d}_{k}_{i}_{j}": F.expr(e) for (i, j), e in nxt})
                cov = {**cov, **{ij: f"s{d}_{k}_{ij[0]}_{ij[1]}" for ij, _ in nxt}}
    scored = F.array(*[
        F.struct(F.lit(k).alias("p"), F.lit(d).alias("d"), F.col(f"n{d}").alias("pairs"), F.col(f"aic{d}_{k}").alias("aic"))
        for d in range(max_d + 1) for k in range(max_p + 1)
    ])
    return moments.select(*series, F.inline(scored)).filter(F.col("pairs") > 0)


def _moment(d: int, i: int, j: int) -> str:
    """Column with the sum of products of lags i and j around their means, over the rows of difference order d."""
    return f"q{d}_{i}_{j}"


def _level_moments(df: DataFrame, value: str, series: Sequence[str], max_p: int, max_d: int, chunk_rows: int) -> DataFrame:
    """Per series and order d of difference: rows ``n``d, and the products of level lags 0..max_p + d over them.

    The rows of order d are those after the first max_p + d. Those of max_d are aggregated; the fewer than max_d rows
    before them are kept as arrays and added to counts, means and products.
    """
    reach = max_p + max_d
    rows, w = framed(df.filter(is_train()), series, back=reach, chunk_rows=chunk_rows)
    lags = [F.lag(value, i).over(w).cast("double").alias(f"_x{i}") for i in range(reach + 1)]
    rows = unframed(rows.select("*", *lags), chunk_rows=chunk_rows).filter(F.col("pos") > max_p)
    full = F.col("pos") > reach
    x = [F.when(full, F.col(f"_x{i}")) for i in range(reach + 1)]
    pairs = [(i, j) for i in range(reach + 1) for j in range(i, reach + 1)]
    early = F.when(~full, F.struct("pos", F.array(*[F.col(f"_x{i}") for i in range(reach + 1)]).alias("x")))
    table = rows.groupBy(*series).agg(
        F.count_if(full).alias(f"n{max_d}"), F.collect_list(early).alias("_early"),
        *[F.coalesce(F.avg(v), F.lit(0.0)).alias(f"m{max_d}_{i}") for i, v in enumerate(x)],
        *[F.coalesce(F.covar_pop(x[i], x[j]) * F.count_if(full), F.lit(0.0)).alias(_moment(max_d, i, j)) for i, j in pairs],
    )
    for d in reversed(range(max_d)):
        table = table.withColumn("_row", F.get(F.filter("_early", lambda e: e["pos"] == max_p + d + 1), F.lit(0))["x"])
        here = F.col("_row").isNotNull()
        n = F.col(f"n{d + 1}")
        table = table.withColumn(f"n{d}", n + here.cast("int"))
        used = range(max_p + d + 1)
        table = table.withColumns({f"_g{i}": F.when(here, F.col("_row")[i] - F.col(f"m{d + 1}_{i}")).otherwise(0.0) for i in used})
        table = table.withColumns(
            {f"m{d}_{i}": F.col(f"m{d + 1}_{i}") + F.col(f"_g{i}") / F.greatest(F.col(f"n{d}"), F.lit(1)) for i in used}
            | {
                _moment(d, i, j): F.col(_moment(d + 1, i, j)) + F.col(f"_g{i}") * F.col(f"_g{j}") * n / F.greatest(F.col(f"n{d}"), F.lit(1))
                for i in used for j in used if i <= j
            }
        )
    return table.drop("_early", "_row", *[f"_g{i}" for i in range(reach + 1)])


def select_order(scores: DataFrame, series: Sequence[str] = ("series",)) -> DataFrame:
    """Order with the smallest AIC; orders that could not be scored are skipped, ties go to smaller (p, d)."""
    best = Window.partitionBy(*series).orderBy("aic", "p", "d")
    return scores.filter(F.col("aic").isNotNull()).withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def direct_multi_step(
    df: DataFrame,
    horizon: int,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One regression per step ahead on the training part, all steps in one aggregate."""
    rows, w = framed(df.filter(is_train()), series, ahead=horizon, chunk_rows=chunk_rows)
    rows = unframed(
        rows.select("*", *[F.lead(value, k).over(w).alias(f"_y{k}") for k in range(1, horizon + 1)]),
        chunk_rows=chunk_rows,
    )
    fits = []
    for k in range(1, horizon + 1):
        fits += [F.regr_slope(f"_y{k}", value).alias(f"_b{k}"), F.regr_intercept(f"_y{k}", value).alias(f"_a{k}")]
    fitted = rows.groupBy(*series).agg(*fits, F.max_by(value, "pos").alias("last_price"))
    steps = F.array(
        *[
            F.struct(
                F.lit(k).alias("step"),
                F.col(f"_b{k}").alias("slope"),
                F.col(f"_a{k}").alias("intercept"),
                (F.col(f"_a{k}") + F.col(f"_b{k}") * F.col("last_price")).alias("pred"),
            )
            for k in range(1, horizon + 1)
        ]
    )
    return fitted.select(*series, "last_price", F.inline(steps))


def in_blocks(predict: Callable[[DataFrame], DataFrame], df: DataFrame, horizon: int, block: int) -> DataFrame:
    """Extend ``pred`` block by block to ``horizon`` steps and cut the surplus.

    ``predict`` maps rows with ``hist`` to rows with ``_block`` (block values).
    The number of rounds depends on the horizon only.
    """
    out = df.withColumn("pred", F.array().cast("array<double>"))
    for _ in range(-(-horizon // block)):
        out = predict(out).withColumn("hist", F.concat("hist", "_block")).withColumn("pred", F.concat("pred", "_block"))
        out = out.drop("_block")
    return out.withColumn("pred", F.slice("pred", 1, horizon))


# --- boosted trees -------------------------------------------------------------------


def fit_trees(
    features: DataFrame,
    columns: Sequence[str],
    value: str = "close",
    rounds: int = 100,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
):
    """One boosted-tree model for the whole panel on min-max scaled features."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [
        VectorAssembler(inputCols=list(columns), outputCol="_v"),
        MinMaxScaler(inputCol="_v", outputCol="_x"),
        GBTRegressor(
            featuresCol="_x", labelCol=value, predictionCol="prediction",
            maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, maxMemoryInMB=512, cacheNodeIds=True,
        ),
    ]
    return Pipeline(stages=stages).fit(features.select(*columns, value))


def _parsed_trees(text: str, weights: Sequence[float]) -> list[dict]:
    """The trees of an ensemble's debug text as node lists; a leaf is its own child."""
    trees: list[dict] = []
    lines = [x.strip() for x in text.splitlines()[1:]]
    at = 0

    def node(tree: dict) -> int:
        nonlocal at
        line, here = lines[at], len(tree["value"])
        at += 1
        for name, blank in (("feature", 0), ("threshold", 0.0), ("left", here), ("right", here), ("value", 0.0)):
            tree[name].append(blank)
        if line.startswith("Predict: "):
            tree["value"][here] = float(line.removeprefix("Predict: "))
            return here
        number, threshold = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        tree["feature"][here], tree["threshold"][here] = int(number), float(threshold)
        tree["left"][here] = node(tree)
        at += 1  # the line of the other branch
        tree["right"][here] = node(tree)
        return here

    while at < len(lines):
        if not lines[at].startswith("Tree "):
            at += 1
            continue
        at += 1
        trees.append({"weight": float(weights[len(trees)]), "feature": [], "threshold": [], "left": [], "right": [], "value": []})
        node(trees[-1])
    return trees


def _array(parts: Iterable[str]) -> str:
    return f"array({', '.join(parts)})"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tree_values(model, features: Column) -> Column:
    """Prediction of a fitted scaler and boosted trees as an expression on an array of plain features.

    The ensemble is one constant of node arrays; a tree is walked from its root as many steps as trees are deep.
    """
    scaler, ensemble = model.stages[-2], model.stages[-1]
    low, high = scaler.originalMin.toArray().tolist(), scaler.originalMax.toArray().tolist()
    # literals, which are folded into constants when the query is planned
    ranges = F.expr(_array(f"named_struct('low', {a!r}D, 'scale', {f'{1.0 / (b - a)!r}D' if b > a else 'CAST(NULL AS DOUBLE)'})" for a, b in zip(low, high)))
    trees = _parsed_trees(ensemble.toDebugString, list(ensemble.treeWeights))
    kinds = {"feature": "{}", "threshold": "{!r}D", "left": "{}", "right": "{}", "value": "{!r}D"}
    nodes = F.expr(_array(
        f"named_struct('weight', {t['weight']!r}D, " + ", ".join(f"'{k}', {_array(f.format(x) for x in t[k])}" for k, f in kinds.items()) + ")"
        for t in trees
    ))
    depth = F.sequence(F.lit(1), F.lit(max(1, max(t.depth for t in ensemble.trees))))
    scaled = F.zip_with(features, ranges, lambda v, r: F.coalesce((v - r["low"]) * r["scale"], F.lit(0.5)))

    def walk(x: Column) -> Column:
        def one(total: Column, t: Column) -> Column:
            leaf = F.aggregate(
                depth, F.lit(0),
                lambda i, _: F.when(F.get(x, F.get(t["feature"], i)) <= F.get(t["threshold"], i), F.get(t["left"], i)).otherwise(F.get(t["right"], i)),
            )
            return total + t["weight"] * F.get(t["value"], leaf)

        return F.aggregate(nodes, F.lit(0.0), one)

    return _let(scaled, walk)


def _newest_features(newest: Column, n_lags: int, rolling: Sequence[int]) -> Column:
    """Lags and rolling statistics, in the order of the fit, of values listed newest first."""

    def statistics(k: int) -> Column:
        last = F.slice(newest, 1, k)
        return _let(mean_of(last), lambda m: F.array(m, sample_deviation(last, m)))

    parts = [F.slice(newest, 1, n_lags), *map(statistics, rolling)]
    return F.concat(*parts)


def predict_trees(
    panel: DataFrame,
    horizon: int,
    value: str = "close",
    series: Sequence[str] = ("series",),
    n_lags: int = 30,
    rolling: Sequence[int] = (7, 14, 30),
    **fit: float,
) -> DataFrame:
    """Fit on the training part, then predict step by step from its end.

    The fitted trees become an expression on the last values, so all steps are one array recursion
    per series and no job runs after the fit.
    """
    train = panel.filter(is_train())
    columns = [f"lag_{i}" for i in range(1, n_lags + 1)]
    columns += [f"rolling_{s}_{k}" for k in rolling for s in ("mean", "std")]
    # kept while scaling, binning and boosting read them; a lost part is made again from its lineage
    rows = lag_features(train, value, series, n_lags, rolling).select(*columns, value).persist(StorageLevel.DISK_ONLY)
    parts = max(1, -(-rows.count() // ROWS_PER_PART))
    model = fit_trees(rows.coalesce(parts), columns, value, **fit)
    rows.unpersist()

    return trees_path(model, panel, horizon, value, series, n_lags, rolling)


def trees_path(
    model,
    panel: DataFrame,
    horizon: int,
    value: str = "close",
    series: Sequence[str] = ("series",),
    n_lags: int = 30,
    rolling: Sequence[int] = (7, 14, 30),
) -> DataFrame:
    """Steps (series, step, pred) of a fitted model from the end of the training part; series too short for its features have none."""
    need = max(n_lags, *rolling)
    split = F.floor(F.col("n") * F.lit(TRAIN_SHARE))
    state = (
        panel.filter((F.col("pos") <= split) & (F.col("pos") > split - need))
        .groupBy(*series)
        .agg(F.array_sort(F.collect_list(F.struct("pos", value))).alias("_s"))
        .select(*series, F.col(f"_s.{value}").alias("hist"))
        .filter(F.size("hist") == need)
    )

    def grow(path: Column, _: Column) -> Column:
        newest = F.reverse(F.slice(path, -need, need))
        value_next = _let(newest, lambda x: tree_values(model, _newest_features(x, n_lags, rolling)))
        return F.concat(path, F.array(value_next))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("hist"), grow)
    steps = state.select(*series, F.posexplode(F.slice(path, -horizon, horizon)).alias("step", "pred"))
    return steps.withColumn("step", F.col("step") + 1)
