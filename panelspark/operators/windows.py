"""Evaluation windows cut from dense panels.

All windows of a series come from a stretch whose length depends on parameters
only, so that stretch is picked by position, gathered once per series into one
bounded array, and windows are slices of it: no join and no loop over windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.params import CONTEXT, HORIZONS, LOOKBACK, N_WINDOWS, STEP, TRAIN_SHARE


def _stretch(df: DataFrame, keys: Sequence[str], wanted: Column, value: str, day: str) -> DataFrame:
    rows = df.filter(wanted).groupBy(*keys, "n").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(day).alias("d"), F.col(value).alias("v")))).alias("_s")
    )
    return rows.select(
        *keys,
        "n",
        F.col("_s")[0]["pos"].alias("_first"),
        F.col("_s.v").alias("_values"),
        F.col("_s.d").alias("_days"),
    )


def _slices(df: DataFrame, keys: Sequence[str], context: int) -> DataFrame:
    """Cut context and truth at ``window_end`` (rows seen, counted from the series start)."""
    start = F.greatest(F.lit(1), F.col("window_end") - context + 1)
    length = F.col("window_end") - start + 1
    offset = (start - F.col("_first") + 1).cast("int")
    cut = df.select(
        *keys,
        "n",
        "horizon",
        "window",
        "window_end",
        F.slice("_values", offset, length.cast("int")).alias("hist"),
        F.slice("_days", offset, length.cast("int")).alias("hist_days"),
        F.slice("_values", (F.col("window_end") - F.col("_first") + 2).cast("int"), F.col("horizon")).alias("truth"),
    )
    return cut.filter(F.size("truth") == F.col("horizon")).select(
        "*",
        F.element_at("hist", -1).alias("last_price"),
        F.element_at("hist_days", -1).alias("window_day"),
    )


def origin_windows(
    df: DataFrame,
    keys: Sequence[str] = ("series",),
    value: str = "close",
    day: str = "day",
    horizons: Sequence[int] = HORIZONS,
    n_windows: int = N_WINDOWS,
    step: int = STEP,
    lookback: int = LOOKBACK,
    context: int = CONTEXT,
) -> DataFrame:
    """Rolling-origin windows: up to ``context`` rows before each origin, truth after it.

    Window w of W ends at n - (W - w) * step - h.  Series shorter than
    lookback + (h + step) * W use a single window; windows ending before
    ``lookback`` are left out.
    """
    reach = n_windows * step + max(horizons) + context
    wanted = (F.col("pos") > F.col("n") - reach) & (F.col("pos") <= F.col("n") - step)
    series = _stretch(df, keys, wanted, value, day)
    by_horizon = series.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    short = F.col("n") < lookback + (F.col("horizon") + step) * n_windows
    counted = by_horizon.withColumn("_w", F.when(short, F.lit(1)).otherwise(F.lit(n_windows)))
    windows = counted.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_w") - 1))).withColumn(
        "window_end", F.col("n") - (F.col("_w") - F.col("window")) * step - F.col("horizon")
    )
    return _slices(windows.filter(F.col("window_end") >= lookback), keys, context)


def sliding_windows(
    df: DataFrame,
    keys: Sequence[str] = ("series",),
    value: str = "close",
    day: str = "day",
    horizons: Sequence[int] = HORIZONS,
    max_windows: int = 20,
    test_rows: int = 50,
    lookback: int = LOOKBACK,
    share: float = TRAIN_SHARE,
) -> DataFrame:
    """Step-1 windows from the split on: window i sees ``lookback`` rows ending at split + i + lookback."""
    split = F.floor(F.col("n") * F.lit(share))
    wanted = (F.col("pos") > split) & (F.col("pos") <= split + max_windows + lookback + max(horizons))
    series = _stretch(df, keys, wanted, value, day).withColumn("_split", split)
    count = F.least(F.lit(max_windows), F.lit(test_rows), F.col("n") - F.col("_split"))
    windows = (
        series.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
        .withColumn("_w", count.cast("int"))
        .filter(F.col("_w") > 0)
        .withColumn("window", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
        .withColumn("window_end", (F.col("_split") + F.col("window") + lookback).cast("int"))
        .filter(F.col("window_end") + F.col("horizon") <= F.col("n"))
    )
    return _slices(windows, keys, lookback)


def last_values(lookback: int | Column, hist: str = "hist") -> Column:
    """The last ``lookback`` values of a context (all when it is shorter)."""
    k = F.lit(lookback) if isinstance(lookback, int) else lookback
    return F.slice(hist, F.greatest(F.lit(1), F.size(hist) - k + 1), k)


def mean_of(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def sample_deviation(values: Column, mean: Column) -> Column:
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(square / (F.size(values) - 1)))


def window_stats(df: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """Current, mean, sample deviation, trend and daily volatility of each window."""
    recent = df.withColumn("_r", last_values(lookback)).withColumn("_mean", mean_of(F.col("_r")))
    steps = F.zip_with(F.slice("_r", 2, F.size("_r") - 1), F.slice("_r", 1, F.size("_r") - 1), lambda b, a: b - a)
    recent = recent.withColumn("_steps", steps).withColumn("_step_mean", mean_of(F.col("_steps")))
    step_square = F.aggregate(
        "_steps", F.lit(0.0), lambda a, x: a + (x - F.col("_step_mean")) * (x - F.col("_step_mean"))
    )
    rising = F.element_at("_r", -1) > F.element_at("_r", 1)
    return recent.select(
        *df.columns,
        F.element_at("_r", -1).alias("current"),
        F.col("_mean").alias("mean"),
        sample_deviation(F.col("_r"), F.col("_mean")).alias("volatility"),
        F.when(rising, F.lit("upward")).otherwise(F.lit("downward")).alias("trend"),
        F.when(F.size("_steps") > 0, F.sqrt(step_square / F.size("_steps"))).alias("daily_vol"),
    )
