"""Panels and text tables derived from the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.calendar import fill_days
from panelspark.operators.predict import with_window_predictions
from panelspark.operators.metrics import score_windows, summarise
from panelspark.operators.windows import origin_windows
from panelspark.params import CONFIGS

# Stand-ins for the two factors: calendar or trading-day fill x lookback.
STUDY = {
    "baseline_llm": ("calendar", 30),
    "news_only": ("trading", 30),
    "prompt_only": ("calendar", 60),
    "full_model": ("trading", 60),
}
DIGITS = 6  # prices of the tables are around 1e5: finer differences are rounding errors
STUDY_MODELS = ("naive", "mean", "drift", "ar1")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(rows: DataFrame, series: str, ts: str, price: str, key: str) -> DataFrame:
    """Daily bars: first, highest, lowest, last price and row count per series and day.

    ``key`` orders the rows of a day.  Partial aggregation runs before the shuffle,
    so a series with a third of all rows still arrives as one row per day and task.
    """
    return rows.groupBy(F.col(series).alias("series"), F.to_date(ts).alias("day")).agg(
        F.min_by(price, key).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, key).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the line items, one series per supplier; equal orders fall back to the line number."""
    lines = table(spark, sf_dir, "lineitem").withColumn("_key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return bars(lines, "l_suppkey", "l_shipdate", "l_extendedprice", "_key")


def filled(source: DataFrame, policy: str = "calendar", values: tuple[str, ...] = ("close",)) -> DataFrame:
    return fill_days(source, list(values), weekdays_only=policy == "trading", dense=True)


def order_windows(spark: SparkSession, sf_dir: str, context: int = 60) -> DataFrame:
    """Windows of both fill policies over the order bars."""
    source = order_bars(spark, sf_dir)
    both = reduce(
        DataFrame.unionByName,
        [filled(source, p).withColumn("policy", F.lit(p)) for p in ("calendar", "trading")],
    )
    return origin_windows(both, keys=("series", "policy"), context=context)


def study_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored windows of every predictor under the four configs, in the shape of a window table.

    ``naive`` and ``mean`` play the baselines (config ``baseline``: calendar fill,
    lookback 30); drift and ar1 run under every config.  ``ord`` fixes the order of equals.
    """
    windows = order_windows(spark, sf_dir)
    setups = F.array(
        *[
            F.struct(
                F.lit(c).alias("config"), F.lit(p).alias("_p"), F.lit(k).alias("lookback"), F.lit(i).alias("_c")
            )
            for i, (c, (p, k)) in enumerate(STUDY.items())
        ]
    )
    tried = (
        windows.withColumn("_s", F.explode(F.filter(setups, lambda s: s["_p"] == F.col("policy"))))
        .select(*windows.columns, "_s.config", "_s.lookback", "_s._c")
    )
    tried_models = with_window_predictions(tried, F.col("lookback"), DIGITS)
    base = F.col("model").isin("naive", "mean")
    kept = tried_models.filter(~base | (F.col("config") == CONFIGS[0]))
    order = F.element_at(F.create_map(*[F.lit(x) for i, m in enumerate(STUDY_MODELS) for x in (m, i)]), F.col("model"))
    return score_windows(
        kept.select(
            F.when(base, "baseline").otherwise("llm").alias("type"),
            "model",
            F.when(base, "baseline").otherwise(F.col("config")).alias("config"),
            F.col("series").alias("currency"),
            "horizon",
            "window",
            (order * 10 + F.col("_c")).alias("ord"),
            "truth",
            "pred",
            "last_price",
        )
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary table: one row per (type, model, config, currency, horizon), metrics to 4 decimals."""
    by = ["type", "model", "config", "currency", "horizon", "ord"]
    summary = summarise(study_windows(spark, sf_dir), by)
    return summary.select(
        *by, *[F.round(m, 4).alias(m) for m in ("rmse", "mae", "mape", "da")], "n_windows"
    )


def window_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window table of the significance tests, errors to 4 decimals."""
    return study_windows(spark, sf_dir).select(
        "type", "model", "config", "currency", "horizon", "window", "ord",
        F.round("window_rmse", 4).alias("window_rmse"),
        F.round("window_da", 4).alias("window_da"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated articles of the order series; the first line is the title."""
    names = F.array(*[F.lit(s) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.pmod(F.col("doc_id") * 7, F.lit(2400)).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        F.element_at(names, (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("series"),
        day.alias("published_on"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.col("source").alias("publisher"),
        F.col("text").alias("summary"),
    )
