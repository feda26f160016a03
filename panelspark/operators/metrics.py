"""Accuracy of predictions.

Windows hold truth and prediction as short arrays, so a window is scored without
leaving its row; tables of windows then aggregate sums, which combine map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _hits(truth: Column, pred: Column, true_from: Column, pred_from: Column, masked: bool) -> Column:
    """Per step: 1 if the predicted move has the sign of the true one, else 0; null for steps that do not count."""
    true_move = F.zip_with(truth, true_from, lambda y, a: F.signum(y - a))
    pred_move = F.zip_with(pred, pred_from, lambda p, b: F.signum(p - b))

    def hit(up: Column, said: Column) -> Column:
        same = F.when(up == said, 1.0).otherwise(0.0)
        return F.when(up != 0, same) if masked else same

    return F.array_compact(F.zip_with(true_move, pred_move, hit))


def _percent(hits: Column) -> Column:
    # a one-element transform names the array, so it is made once for its sum and its size
    share = F.transform(F.array(hits), lambda h: F.try_divide(_total(h), F.size(h)) * 100)
    return F.get(share, F.lit(0))


def direction_anchored(truth: str, pred: str, last: str) -> Column:
    """Percent of steps whose move from the last actual value has the predicted sign.

    Steps without an actual move do not count; null when none is left.
    """
    before = F.concat(F.array(F.col(last)), F.slice(truth, 1, F.size(truth) - 1))
    return _percent(_hits(F.col(truth), F.col(pred), before, before, True))


def direction_of_steps(truth: str, pred: str, masked: bool = True) -> Column:
    """The same on steps inside the window, without an anchor; null below two values.

    With ``masked=False`` flat steps count, as right when both are flat.
    """

    def before(c: str) -> Column:
        return F.slice(c, 1, F.size(c) - 1)

    def after(c: str) -> Column:
        return F.slice(c, 2, F.size(c) - 1)

    return F.when(F.size(truth) > 1, _percent(_hits(after(truth), after(pred), before(truth), before(pred), masked)))


def split_valid(df: DataFrame, truth: str = "truth", pred: str = "pred") -> tuple[DataFrame, DataFrame]:
    """Windows that can be scored, and the others with a reason."""
    reason = (
        F.when(F.col(truth).isNull() | (F.size(truth) == 0), F.lit("empty truth"))
        .when(F.col(pred).isNull() | (F.size(pred) == 0), F.lit("empty prediction"))
        .when(F.size(truth) != F.size(pred), F.lit("different lengths"))
    )
    marked = df.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def score_windows(
    df: DataFrame, truth: str = "truth", pred: str = "pred", last: str = "last_price", parity: bool = False
) -> DataFrame:
    """Add error sums, ``window_rmse`` and ``window_da`` to each window.

    ``parity`` stores an undefined direction score as 0.0 instead of null.
    """
    scored = df.select(
        "*",
        F.size(truth).alias("steps"),
        _total(F.zip_with(truth, pred, lambda y, p: (y - p) * (y - p))).alias("sse"),
        _total(F.zip_with(truth, pred, lambda y, p: F.abs(y - p))).alias("sae"),
        _total(F.zip_with(truth, pred, lambda y, p: F.coalesce(F.try_divide(F.abs(y - p), F.abs(y)), F.lit(0.0)))).alias("sape"),
        F.size(F.filter(truth, lambda y: y != 0)).alias("steps_nonzero"),
        direction_anchored(truth, pred, last).alias("window_da"),
    ).withColumn("window_rmse", F.sqrt(F.col("sse") / F.col("steps")))
    return scored.withColumn("window_da", F.coalesce("window_da", F.lit(0.0))) if parity else scored


def summarise(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """RMSE, MAE, MAPE over all steps of all windows; DA as mean of the defined window scores."""
    return scored.groupBy(*by).agg(
        F.sqrt(F.sum("sse") / F.sum("steps")).alias("rmse"),
        (F.sum("sae") / F.sum("steps")).alias("mae"),
        F.coalesce(
            F.when(F.sum("steps_nonzero") > 0, F.sum("sape") / F.sum("steps_nonzero") * 100),
            F.lit(float("inf")),
        ).alias("mape"),
        F.avg("window_da").alias("da"),
        F.count(F.lit(1)).alias("n_windows"),
    )


def score_rows(df: DataFrame, by: Sequence[str], y: str = "y", p: str = "p") -> DataFrame:
    """RMSE, MAE and MAPE of a table with one row per step."""
    err = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.coalesce(F.avg(F.when(F.col(y) != 0, F.abs(err / F.col(y)))) * 100, F.lit(float("inf"))).alias("mape"),
        F.count(F.lit(1)).alias("steps"),
    )


def flat_prediction(pred: str = "pred", truth: str = "truth") -> Column:
    """True when the prediction hardly moves: population deviation below 0.1 % of the truth's."""

    def deviation(c: str) -> Column:
        mean = _total(F.col(c)) / F.size(c)
        spread = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(c))
        return F.when(F.array_min(c) == F.array_max(c), F.lit(0.0)).otherwise(spread)

    return deviation(pred) < deviation(truth) * 0.001
