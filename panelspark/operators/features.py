"""Lag and rolling features, sequences, scaling and splits of dense panels.

Input panels carry ``pos`` (1..n inside a series) and ``n``, from
``fill_days(dense=True)`` or ``layout.with_position``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.layout import CHUNK_ROWS, framed, unframed
from panelspark.params import N_LAGS, ROLLING, TRAIN_SHARE


def _rolling(names: Sequence[str], k: int) -> tuple[Column, Column]:
    """Mean and sample deviation of the first k of ``names``, null if one of them is missing.

    Plain arithmetic on lag columns stays in generated code; sliding window frames
    would add up all k rows again for every row.
    """
    values = [F.col(x) for x in names[:k]]
    mean = F.col(f"rolling_mean_{k}")
    square = reduce(add, [(v - mean) * (v - mean) for v in values])
    return reduce(add, values) / k, F.sqrt(square / (k - 1))


def lag_features(
    df: DataFrame,
    value: str = "close",
    series: Sequence[str] = ("series",),
    n_lags: int = N_LAGS,
    rolling: Sequence[int] = ROLLING,
    complete: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Lags 1..n and mean / sample deviation of the k rows before; incomplete rows dropped."""
    reach = max([n_lags, *rolling])
    rows, w = framed(df, series, back=reach, chunk_rows=chunk_rows)
    # named once: renaming 30 null-checked columns doubles the optimiser's constraints 30 times
    names = [f"lag_{i}" if i <= n_lags else f"_b{i}" for i in range(1, reach + 1)]
    lags = [F.lag(value, i).over(w).alias(x) for i, x in enumerate(names, 1)]
    out = unframed(rows.select("*", *lags), chunk_rows=chunk_rows)
    if complete:  # the longest reach is there only if all shorter ones are
        out = out.na.drop(subset=[value, *names])
    made = {k: _rolling(names, k) for k in rolling}
    out = out.withColumns({f"rolling_mean_{k}": m for k, (m, _) in made.items()})
    out = out.withColumns({f"rolling_std_{k}": s for k, (_, s) in made.items()})
    return out.select(*df.columns, *names[:n_lags], *[f"rolling_{s}_{k}" for k in rolling for s in ("mean", "std")])


def differences(
    df: DataFrame, value: str = "close", series: Sequence[str] = ("series",), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """First difference of each row to the one before."""
    rows, w = framed(df, series, back=1, chunk_rows=chunk_rows)
    return unframed(rows.withColumn("diff", F.col(value) - F.lag(value).over(w)), chunk_rows=chunk_rows)


def daily_volatility(df: DataFrame, value: str = "close", series: Sequence[str] = ("series",)) -> DataFrame:
    """Population deviation of the first differences per series."""
    return differences(df, value, series).groupBy(*series).agg(F.stddev_pop("diff").alias("daily_vol"))


def sequences(
    df: DataFrame,
    length: int,
    ahead: int = 1,
    value: str = "close",
    series: Sequence[str] = ("series",),
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Pairs of ``length`` values and the ``ahead`` values that follow; n-length-ahead+1 per series."""
    rows, w = framed(df, series, back=length, ahead=ahead - 1, chunk_rows=chunk_rows)
    out = rows.withColumn("x", F.collect_list(value).over(w.rowsBetween(-length, -1))).withColumn(
        "y", F.collect_list(value).over(w.rowsBetween(0, ahead - 1))
    )
    whole = (F.size("x") == length) & (F.size("y") == ahead)
    return unframed(out, chunk_rows=chunk_rows).filter(whole)


def is_train(share: float = TRAIN_SHARE) -> Column:
    """Chronological split: the first int(share * n) rows of a series."""
    return F.col("pos") <= F.floor(F.col("n") * F.lit(share))


def split_chrono(df: DataFrame, share: float = TRAIN_SHARE) -> DataFrame:
    return df.withColumn("part", F.when(is_train(share), F.lit("train")).otherwise(F.lit("test")))


def tail(df: DataFrame, rows: int) -> DataFrame:
    """Last ``rows`` rows of every series: a filter, no ordering."""
    return df.filter(F.col("pos") > F.col("n") - rows)


def fit_minmax(df: DataFrame, value: str = "close", series: Sequence[str] = ("series",)) -> DataFrame:
    """Shift and width learnt on the training rows; width 1 for constant series."""
    fitted = df.filter(is_train()).groupBy(*series).agg(F.min(value).alias("shift"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("shift")
    return fitted.withColumn("width", F.when(width == 0, F.lit(1.0)).otherwise(width)).drop("_hi")


def fit_standard(df: DataFrame, value: str = "close", series: Sequence[str] = ("series",)) -> DataFrame:
    """Mean and population deviation of the training rows; width 1 for constant series."""
    fitted = df.filter(is_train()).groupBy(*series).agg(
        F.avg(value).alias("shift"), F.stddev_pop(value).alias("width")
    )
    return fitted.withColumn("width", F.when(F.col("width") == 0, F.lit(1.0)).otherwise(F.col("width")))


def rescale(
    df: DataFrame,
    fitted: DataFrame,
    value: str = "close",
    series: Sequence[str] = ("series",),
    inverse: bool = False,
    name: str = "scaled",
) -> DataFrame:
    """Apply (or undo) a fitted scaling.

    A plain join: adaptive execution broadcasts the one-row-per-series side when
    it measures small and splits hot series otherwise.
    """
    v = F.col(value) * F.col("width") + F.col("shift") if inverse else (F.col(value) - F.col("shift")) / F.col("width")
    return df.join(fitted, list(series)).withColumn(name, v).drop("shift", "width")
