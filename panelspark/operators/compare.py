"""Tables that compare models and configs.

Input rows have the shape currency, horizon, model, config, type, rmse, mae, mape,
da and ``ord``, which decides between equals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.text import label
from panelspark.operators.layout import exact_medians
from panelspark.params import ABLATIONS, BASELINE_MODELS, CONFIGS, FACTORS, METRICS

CELL = ("currency", "horizon")
UNIT = ("currency", "horizon", "model")
SMALLER_IS_BETTER = {"rmse": True, "mae": True, "mape": True, "da": False}


def _towards(metric: str, smaller: bool | None) -> Column:
    smaller = SMALLER_IS_BETTER[metric] if smaller is None else smaller
    return F.col(metric).asc() if smaller else F.col(metric).desc()


def leaderboard(df: DataFrame, metric: str, k: int = 10, smaller: bool | None = None) -> DataFrame:
    """Best ``k`` rows overall; each task keeps its own ``k`` first."""
    return df.filter(F.col(metric).isNotNull()).orderBy(_towards(metric, smaller), "ord", *CELL).limit(k)


def best_per_group(
    df: DataFrame,
    by: Sequence[str],
    metric: str,
    smaller: bool | None = None,
    order: Sequence[str] = ("ord",),
) -> DataFrame:
    """Best row per group, first by ``order`` on ties.  Tasks drop all but their best before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(_towards(metric, smaller), *order))
    return df.filter(F.col(metric).isNotNull()).withColumn("_r", rank).filter("_r = 1").drop("_r")


def best_by_mean(
    df: DataFrame, by: Sequence[str], choice: Sequence[str], metric: str = "window_rmse"
) -> DataFrame:
    """Choice with the smallest mean metric per group; ties by the choice's own order."""
    means = df.groupBy(*by, *choice).agg(F.avg(metric).alias("mean_metric"))
    return best_per_group(means, by, "mean_metric", True, choice)


def best_summary(df: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Per group: label and metrics of the best row by RMSE, label and value of the best by DA."""
    low = best_per_group(df, by, "rmse").select(
        *by,
        label(F.col("model"), F.col("config")).alias("best_model_rmse"),
        *[F.round(m, 4).alias(m) for m in METRICS],
    )
    high = best_per_group(df, by, "da").select(
        *by, label(F.col("model"), F.col("config")).alias("best_model_da"), F.round("da", 4).alias("best_da")
    )
    return low.join(high, list(by), "left")


def delta_vs_base(df: DataFrame, base: str = "baseline_llm", keys: Sequence[str] = UNIT) -> DataFrame:
    """Difference of every row to the base config of its unit; rows without one keep nulls."""
    reference = df.filter(F.lower("config") == base).select(
        *keys, F.col("rmse").alias("rmse_base"), F.col("da").alias("da_base")
    )
    return df.join(reference, list(keys), "left").withColumns(
        {"rmse_delta": F.col("rmse") - F.col("rmse_base"), "da_delta": F.col("da") - F.col("da_base")}
    )


def delta_summary(deltas: DataFrame, by: Sequence[str] = ("model", "config")) -> DataFrame:
    """Mean, exact median and count of the deltas per group (null keys form a group)."""
    sums = deltas.groupBy(*by).agg(
        F.avg("rmse_delta").alias("mean_rmse_delta"),
        F.avg("da_delta").alias("mean_da_delta"),
        F.count("rmse_delta").alias("n"),
    )
    middles = exact_medians(deltas, by, {"median_rmse_delta": "rmse_delta", "median_da_delta": "da_delta"})
    side = middles.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "median_rmse_delta", "median_da_delta")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)]
    return sums.join(side, same, "left").drop(*[f"_k{i}" for i in range(len(by))])


def best_config(summary: DataFrame) -> DataFrame:
    """Config with the smallest mean RMSE delta per model."""
    return best_per_group(summary, ("model",), "mean_rmse_delta", True, ("config",))


def prefix_groups(summary: DataFrame, prefix: str = "tsfl_", base: str = "baseline_llm") -> DataFrame:
    """Mean delta of configs with a name prefix against the other configs (base left out)."""
    inside = F.col("config").startswith(prefix)
    outside = ~inside & (F.col("config") != base)
    return summary.agg(
        F.avg(F.when(inside, F.col("mean_rmse_delta"))).alias("prefix_mean"),
        F.avg(F.when(outside, F.col("mean_rmse_delta"))).alias("other_mean"),
        F.count(F.when(inside, 1)).alias("prefix_rows"),
        F.count(F.when(outside, 1)).alias("other_rows"),
    )


def union_results(*parts: DataFrame) -> DataFrame:
    """Stack result tables; columns one side lacks become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def common_units(df: DataFrame, configs: Sequence[str] = CONFIGS, metric: str = "da", keys: Sequence[str] = UNIT) -> DataFrame:
    """Units present under every config, one column per config: a pivot instead of k-1 intersections."""
    wide = df.filter(F.col("config").isin(*configs)).groupBy(*keys).agg(
        *[F.max(F.when(F.col("config") == c, F.col(metric))).alias(c) for c in configs],
        F.count_distinct("config").alias("_seen"),
    )
    return wide.filter(F.col("_seen") == len(configs)).drop("_seen")


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two keyed columns side by side, incomplete pairs dropped."""
    left = a.select(*keys, F.col(value).alias("left_value"))
    right = b.select(*keys, F.col(value).alias("right_value"))
    return left.join(right, list(keys)).na.drop()


def paired_by_rank(
    a: DataFrame, b: DataFrame, keys: Sequence[str], order: str, value: str, at_least: int = 2
) -> DataFrame:
    """Pair the i-th rows of two ordered sets per key, up to the shorter one; keys with too few pairs drop out.

    Meant for evaluation windows, of which a key has a few dozen by construction.
    """
    w = Window.partitionBy(*keys).orderBy(order)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.row_number().over(w).alias("rank"), F.col(value).alias(name))

    pairs = ranked(a, "left_value").join(ranked(b, "right_value"), [*keys, "rank"])
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return pairs.withColumn("_n", size).filter(F.col("_n") >= at_least).drop("_n")


def per_series_table(df: DataFrame, as_text: bool = False) -> DataFrame:
    """Rows clustered by currency and sorted inside (horizon, rmse); write with ``partitionBy("currency")``.

    ``as_text`` sorts horizons as strings, as published tables do.  Range partitioning
    splits a currency that holds most rows.
    """
    horizon = F.col("horizon").cast("string") if as_text else F.col("horizon")
    shown = df.select("currency", "model", "config", "horizon", *METRICS, "ord")
    return shown.repartitionByRange("currency", horizon, "rmse", "ord").sortWithinPartitions(
        "currency", horizon, "rmse", "ord"
    )


def with_factors(df: DataFrame, lower: bool = True) -> DataFrame:
    """Add news and prompt of a config; unknown configs drop out."""
    key = F.lower("config") if lower else F.col("config")
    news = F.create_map(*[F.lit(x) for c, (n, _) in FACTORS.items() for x in (c, n)])
    prompt = F.create_map(*[F.lit(x) for c, (_, p) in FACTORS.items() for x in (c, p)])
    return df.withColumns({"news": news[key], "prompt": prompt[key]}).filter(F.col("news").isNotNull())


def with_type(df: DataFrame, baselines: Sequence[str] = BASELINE_MODELS) -> DataFrame:
    known = F.lower("model").isin(*baselines)
    return df.withColumn("type", F.when(known, "Baseline").otherwise("LLM"))


def factor_means(df: DataFrame, metrics: Sequence[str] = METRICS, digits: int = 4) -> DataFrame:
    """2x2 table, one row per config."""
    means = [F.round(F.avg(m), digits).alias(f"mean_{m}") for m in metrics]
    return (
        with_factors(df)
        .groupBy(F.lower("config").alias("config"), "news", "prompt")
        .agg(*means)
        .withColumn("news", F.when(F.col("news"), "Yes").otherwise("No"))
    )


def factor_pivot(flat: DataFrame, metric: str) -> DataFrame:
    """2x2 table with news in rows and prompt in columns."""
    return flat.groupBy("news").pivot("prompt", ["few", "zero"]).agg(F.first(f"mean_{metric}"))


def mean_by_config(
    df: DataFrame, metric: str, configs: Sequence[str], by: Sequence[str] = ("model",), positive_only: bool = False
) -> DataFrame:
    """Mean metric per model, one column per config; ``positive_only`` blanks means of zero and below."""
    means = df.filter(F.col(metric).isNotNull()).groupBy(*by, "config").agg(F.avg(metric).alias("_m"))
    if positive_only:
        means = means.filter(F.col("_m") > 0)
    return means.groupBy(*by).pivot("config", list(configs)).agg(F.first("_m"))


def winners_matrix(df: DataFrame, metric: str, horizons: Sequence[int]) -> DataFrame:
    """Label of the best row, currencies by horizons."""
    best = best_per_group(df, CELL, metric).withColumn("label", label(F.col("model"), F.col("config"), "colons"))
    wide = best.groupBy("currency").pivot("horizon", list(horizons)).agg(F.first("label"))
    return wide.select("currency", *[F.col(str(h)).alias(f"h{h}") for h in horizons])


def type_best(df: DataFrame) -> DataFrame:
    """Smallest RMSE and largest DA per (type, currency)."""
    return df.groupBy("type", "currency").agg(F.min("rmse").alias("best_rmse"), F.max("da").alias("best_da"))


def model_ranking(df: DataFrame, metric: str = "rmse", baseline: str = "baseline") -> DataFrame:
    """Mean metric per model: baselines as they are, others with their best config per cell."""
    base = df.filter(F.col("type") == baseline)
    best = best_per_group(df.filter(F.col("type") != baseline), UNIT, "rmse")
    both = base.unionByName(best)
    return both.filter(F.col(metric).isNotNull()).groupBy("model", "type").agg(F.avg(metric).alias(f"mean_{metric}"))


def factor_effects(df: DataFrame, factor: str, metrics: Sequence[str] = ("rmse", "da")) -> DataFrame:
    """Mean metric per model and level of one factor."""
    return with_factors(df).groupBy("model", factor).agg(*[F.avg(m).alias(f"mean_{m}") for m in metrics])


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("type").count().withColumnRenamed("count", "rows")


def table_shapes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns of named tables, in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def explanation_rollup(df: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean explanation features and sample count per model."""
    return df.groupBy(*by).agg(
        F.avg("news_grounding_rate").alias("avg_news_grounding"),
        F.avg("explanation_len").alias("avg_explanation_len"),
        F.avg("coherence_score").alias("avg_coherence"),
        F.avg("n_factors_cited").alias("avg_n_factors"),
        F.avg("confidence_score").alias("avg_confidence"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def feature_correlations(
    df: DataFrame,
    features: Sequence[str],
    targets: Sequence[str],
    by: Sequence[str] = ("model",),
    required: str | None = None,
    at_least: int = 5,
) -> DataFrame:
    """Pearson correlations over complete pairs, in one aggregate; null below ``at_least`` pairs or without spread."""
    rows = df if required is None else df.filter(F.col(required).isNotNull())
    cols = []
    for f in features:
        for t in targets:
            x, y = F.col(f).cast("double"), F.col(t).cast("double")
            both = x.isNotNull() & y.isNotNull()
            x, y = F.when(both, x), F.when(both, y)
            enough = F.count(F.when(both, 1)) >= at_least
            value = F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))
            cols.append(F.when(enough, F.round(value, 4)).alias(f"corr_{f}_vs_{t}"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *cols).filter(F.col("n") >= at_least)


def _runs(baselines: Sequence[str], models: Sequence[str], horizons: Sequence[int], subset: str | None) -> Column:
    configs = CONFIGS if subset is None else ABLATIONS[subset]
    runs = [("baseline", m, "baseline") for m in baselines] + [("llm", m, c) for m in models for c in configs]
    return F.array(
        *[
            F.struct(F.lit(t).alias("type"), F.lit(m).alias("model"), F.lit(c).alias("config"), F.lit(h).alias("horizon"))
            for t, m, c in runs
            for h in horizons
        ]
    )


def attach_grid(
    series: DataFrame,
    horizons: Sequence[int],
    baselines: Sequence[str],
    models: Sequence[str],
    subset: str | None = None,
) -> DataFrame:
    """Every series under every run: horizon x model x config.

    Baselines run once, models under the configs of ``subset`` (news, prompt,
    interaction; all when None).  The run list is a literal of parameter size that each
    row expands, so there is no join.
    """
    return series.select("*", F.inline(_runs(baselines, models, horizons, subset)))


def param_grid(
    spark: SparkSession,
    currencies: Sequence[str],
    horizons: Sequence[int],
    baselines: Sequence[str],
    models: Sequence[str],
    subset: str | None = None,
) -> DataFrame:
    """The grid of a list of currencies."""
    names = spark.createDataFrame([(c,) for c in currencies], "currency string")
    return attach_grid(names, horizons, baselines, models, subset)
