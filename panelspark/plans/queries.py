"""Named queries over the given tables; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.extract import in_scale, with_explanation, with_numbers
from panelspark.functions.text import base_of, label, p_text, quote_of, word_count
from panelspark.functions.tokens import decode, encode, encode_future, has_tokens, random_walk
from panelspark.operators import calendar, compare, context, explain, features, metrics, predict, prompts, significance
from panelspark.operators import windows as win
from panelspark.operators.layout import day_chunk, with_position
from panelspark.params import CONFIGS, HORIZONS
from panelspark.plans import tables as t
from panelspark.session import cut
from panelspark.sources.news import flatten_articles
from panelspark.sources.results import experiment_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WINDOW = ("series", "horizon", "window")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _r(name: str, digits: int = 4) -> Column:
    return F.round(name, digits).alias(name)


def _order_panel(spark: SparkSession, sf: str, policy: str = "calendar") -> DataFrame:
    return t.filled(t.order_bars(spark, sf), policy)


def _supplier_panel(spark: SparkSession, sf: str) -> DataFrame:
    return t.filled(t.supplier_bars(spark, sf))


def _windows(spark: SparkSession, sf: str, size: int = 30) -> DataFrame:
    return win.origin_windows(_order_panel(spark, sf), context=size)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Summary table, written once: comparisons read it several times and must not redo the study."""
    return cut(t.results(spark, sf))


def _window_results(spark: SparkSession, sf: str) -> DataFrame:
    return cut(t.window_results(spark, sf))


def _llm(spark: SparkSession, sf: str) -> DataFrame:
    return _results(spark, sf).filter(F.col("type") == "llm")


# --- panels, quality, fill ------------------------------------------------------------


@query
def bars_daily(spark, sf):
    return t.order_bars(spark, sf).select("series", _day("day"), "open", "high", "low", "close", "volume")


@query
def quality_report(spark, sf):
    report = calendar.quality_report(t.supplier_bars(spark, sf))
    return report.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query
def quality_rows(spark, sf):
    """Raw order rows, so repeated days push completeness over 100 %."""
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day")
    )
    report = calendar.quality_report(rows)
    return report.withColumns({c: F.col(c).cast("string") for c in ("start_date", "end_date")})


@query
def missing_days(spark, sf):
    """Every gap of every series."""
    return calendar.missing_days(t.supplier_bars(spark, sf)).select("series", "rank", _day("missing_day"))


@query
def missing_days_first10(spark, sf):
    return calendar.missing_days(t.supplier_bars(spark, sf), first=10).select("series", "rank", _day("missing_day"))


@query
def fill_calendar(spark, sf):
    bars = t.order_bars(spark, sf)
    filled = calendar.fill_days(bars, ["open", "high", "low", "close", "volume"], dense=True)
    return filled.withColumn("day", F.col("day").cast("string"))


@query
def fill_trading(spark, sf):
    bars = t.order_bars(spark, sf)
    filled = calendar.fill_days(bars, ["close", "volume"], weekdays_only=True, dense=True)
    return filled.withColumn("day", F.col("day").cast("string"))


@query
def fill_repeated_days(spark, sf):
    """Raw order rows, several per day: all rows of a day stay, totals per series and day."""
    rows = t.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.to_date("o_orderdate").alias("day"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
    )
    filled = calendar.fill_days(rows, ["price"], order=["o_orderkey"], chunk_days=64)
    return filled.groupBy("series", _day("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_filled").alias("filled"), F.round(F.sum("price"), 2).alias("total")
    )


@query
def fill_supplier_totals(spark, sf):
    return (
        _supplier_panel(spark, sf)
        .groupBy("series")
        .agg(
            F.count(F.lit(1)).alias("days"),
            F.count_if("is_filled").alias("filled_days"),
            F.max("n").alias("n"),
            F.round(F.sum("close"), 2).alias("close_sum"),
        )
    )


@query
def coerce_values(spark, sf):
    """Text fields read as numbers and days; what does not parse is null and then dropped or counted."""
    k = F.get_json_object("props", "$.k")
    rows = t.table(spark, sf, "events").select(
        "event_type",
        k.try_cast("double").alias("k"),
        F.col("event_type").try_cast("double").alias("bad"),
        F.try_to_date(F.substring(F.col("ts").cast("string"), 1, 10)).alias("day"),
    )
    return rows.na.drop(subset=["day"]).groupBy("event_type").agg(
        F.count("k").alias("numbers"),
        F.count("bad").alias("bad_numbers"),
        F.sum("k").alias("k_sum"),
        F.count_distinct("day").alias("days"),
    )


# --- features -----------------------------------------------------------------------------


@query
def lag_features(spark, sf):
    rows = features.lag_features(_order_panel(spark, sf), rolling=())
    return rows.select("series", "pos", "close", *[f"lag_{i}" for i in range(1, 31)])


@query
def rolling_stats(spark, sf):
    rows = features.lag_features(_order_panel(spark, sf), n_lags=1)
    cols = [_r(f"rolling_{s}_{k}", d) for k in (7, 14, 30) for s, d in (("mean", 4), ("std", 3))]
    return rows.select("series", "pos", *cols)


@query
def rolling_supplier_range(spark, sf):
    rows = features.lag_features(_supplier_panel(spark, sf), n_lags=1)
    return rows.groupBy("series").agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.round(F.max(f"rolling_mean_{k}"), 4).alias(f"max_mean_{k}") for k in (7, 14, 30)],
        *[F.round(F.max(f"rolling_std_{k}"), 3).alias(f"max_std_{k}") for k in (7, 14, 30)],
    )


@query
def sequences(spark, sf):
    rows = features.sequences(_order_panel(spark, sf), 30, 5)

    def shown(c: str) -> Column:
        return F.array_join(F.transform(c, lambda v: F.format_string("%.2f", v)), " ").alias(c)

    return rows.select("series", "pos", shown("x"), shown("y"))


@query
def scale_minmax(spark, sf):
    panel = _order_panel(spark, sf)
    fitted = features.fit_minmax(panel)
    scaled = features.rescale(panel, fitted)
    back = features.rescale(scaled, fitted, "scaled", inverse=True, name="restored")
    return back.select("series", "pos", _r("scaled", 6), _r("restored", 2))


@query
def scale_standard(spark, sf):
    panel = _order_panel(spark, sf)
    fitted = features.fit_standard(panel)
    scaled = features.rescale(panel, fitted)
    back = features.rescale(scaled, fitted, "scaled", inverse=True, name="restored")
    return back.select("series", "pos", _r("scaled", 6), _r("restored", 2))


@query
def split_chrono(spark, sf):
    parts = features.split_chrono(_supplier_panel(spark, sf))
    return parts.groupBy("series", "part").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"),
    )


@query
def tail_rows(spark, sf):
    return features.tail(_supplier_panel(spark, sf), 5).select("series", _day("day"), "pos", "close")


@query
def row_positions(spark, sf):
    """Positions of unfilled bars, numbered chunk by chunk."""
    bars = with_position(t.supplier_bars(spark, sf), ["series"], ["day"], day_chunk("day", 256))
    return bars.select("series", _day("day"), "pos", "n")


@query
def daily_volatility(spark, sf):
    vol = features.daily_volatility(_supplier_panel(spark, sf))
    return vol.select("series", _r("daily_vol", 3))


# --- windows ------------------------------------------------------------------------------


def _window_summary(w: DataFrame) -> DataFrame:
    return w.select(
        *WINDOW,
        "window_end",
        _day("window_day"),
        F.size("hist").alias("n_hist"),
        F.round(F.aggregate("hist", F.lit(0.0), lambda a, x: a + x), 2).alias("hist_sum"),
        F.round(F.aggregate("truth", F.lit(0.0), lambda a, x: a + x), 2).alias("truth_sum"),
        "last_price",
    )


@query
def origin_windows(spark, sf):
    return _window_summary(win.origin_windows(_supplier_panel(spark, sf)))


@query
def sliding_windows(spark, sf):
    return _window_summary(win.sliding_windows(_supplier_panel(spark, sf)))


@query
def window_stats(spark, sf):
    stats = win.window_stats(_windows(spark, sf))
    return stats.select(*WINDOW, "current", _r("mean"), _r("volatility", 3), "trend", _r("daily_vol", 3))


# --- predictions ----------------------------------------------------------------------------


@query
def ar1_prediction(spark, sf):
    path = predict.predict_ar1(_supplier_panel(spark, sf), 10)
    return path.select(
        "series", "pairs", _r("slope", 6), _r("intercept", 4), F.posexplode("pred").alias("step", "pred")
    ).select("series", "pairs", "slope", "intercept", (F.col("step") + 1).alias("step"), _r("pred", 3))


@query
def arp_prediction(spark, sf):
    """Second-order autoregression of first differences."""
    path = predict.predict_ar(_order_panel(spark, sf), 10, p=2, d=1)
    return path.select(
        "series", "pairs", F.round(F.col("coefficients")[0], 6).alias("c1"), F.round(F.col("coefficients")[1], 6).alias("c2"),
        _r("intercept", 3), F.posexplode("pred").alias("step", "pred"),
    ).select("series", "pairs", "c1", "c2", "intercept", (F.col("step") + 1).alias("step"), _r("pred", 3))


@query
def arma_prediction(spark, sf):
    """First differences with one autoregressive and one moving-average term; shocks from four lags."""
    path = predict.predict_arma(_order_panel(spark, sf), 10, p=1, q=1, d=1, long=4)
    return path.select(
        "series", "pairs", F.round(F.col("ar")[0], 5).alias("ar1"), F.round(F.col("ma")[0], 5).alias("ma1"),
        _r("intercept", 3), F.posexplode("pred").alias("step", "pred"),
    ).select("series", "pairs", "ar1", "ma1", "intercept", (F.col("step") + 1).alias("step"), _r("pred", 2))


@query
def order_select(spark, sf):
    scores = predict.order_scores(_order_panel(spark, sf), max_p=3, max_d=2)
    best = predict.select_order(scores)
    return best.select("series", "p", "d", "pairs", _r("aic", 3))


@query
def direct_multi_step(spark, sf):
    steps = predict.direct_multi_step(_order_panel(spark, sf), 10)
    return steps.select("series", "step", "last_price", _r("slope", 6), _r("pred", 3))


@query
def naive_prediction(spark, sf):
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    return made.select(*WINDOW, "model", F.posexplode("pred").alias("step", "pred")).select(
        *WINDOW, "model", (F.col("step") + 1).alias("step"), _r("pred", 3)
    )


@query
def gbt_prediction(spark, sf):
    panel = _order_panel(spark, sf)
    path = predict.predict_trees(panel, 5)
    train = panel.filter(features.is_train())
    lags = features.lag_features(train).groupBy("series").agg(
        F.count(F.lit(1)).alias("train_rows"),
        F.round(F.sum("lag_30"), 2).alias("lag_30_sum"),
        F.round(F.sum("rolling_mean_14"), 2).alias("mean_14_sum"),
    )
    # sums of shrunken leaf means stay near the values they were fitted on
    ends = train.agg(F.min("close").alias("low"), F.max("close").alias("high"))
    low, high = ends.first()
    near = F.col("pred").between(low - 0.1 * (high - low), high + 0.1 * (high - low))
    return path.join(lags, "series").select("series", "step", "train_rows", "lag_30_sum", "mean_14_sum", near.alias("in_range"))


# --- accuracy -----------------------------------------------------------------------------


@query
def metrics_micro(spark, sf):
    windows = win.origin_windows(_supplier_panel(spark, sf), context=30)
    made = predict.with_window_predictions(windows, 30, t.DIGITS)
    summary = metrics.summarise(metrics.score_windows(made), ["series", "horizon", "model"])
    return summary.select("series", "horizon", "model", _r("rmse"), _r("mae"), _r("mape"), "n_windows")


@query
def metrics_rows(spark, sf):
    """The same errors from a table with one row per step."""
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    steps = made.select("series", "horizon", "model", F.inline(F.arrays_zip(F.col("truth").alias("y"), F.col("pred").alias("p"))))
    scored = metrics.score_rows(steps, ["series", "horizon", "model"])
    return scored.select("series", "horizon", "model", _r("rmse"), _r("mae"), _r("mape"), "steps")


@query
def metrics_da(spark, sf):
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    summary = metrics.summarise(metrics.score_windows(made), ["series", "horizon", "model"])
    return summary.select("series", "horizon", "model", _r("da"), "n_windows")


@query
def metrics_da_diff(spark, sf):
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    scored = made.withColumns(
        {
            "masked": metrics.direction_of_steps("truth", "pred"),
            "unmasked": metrics.direction_of_steps("truth", "pred", masked=False),
        }
    )
    return scored.groupBy("series", "horizon", "model").agg(
        F.round(F.avg("masked"), 4).alias("da_masked"),
        F.round(F.avg("unmasked"), 4).alias("da_unmasked"),
        F.count("masked").alias("defined"),
    )


@query
def window_metrics(spark, sf):
    return t.window_results(spark, sf).drop("ord")


# --- comparisons --------------------------------------------------------------------------


@query
def param_grid(spark, sf):
    series = t.supplier_bars(spark, sf).groupBy("series").agg(F.count(F.lit(1)).alias("bars"))
    grid = compare.attach_grid(series, HORIZONS, t.STUDY_MODELS[:2], t.STUDY_MODELS[2:])
    marked = compare.with_factors(grid).select(
        *grid.columns, F.col("news").cast("string").alias("news"), "prompt"
    )
    plain = grid.filter(F.col("type") == "baseline")
    return compare.union_results(marked, plain)


@query
def leaderboard(spark, sf):
    rows = _results(spark, sf)
    both = [
        compare.leaderboard(rows, m, 10).select(
            F.lit(m).alias("metric"), "model", "config", "currency", "horizon", F.col(m).alias("value")
        )
        for m in ("rmse", "da")
    ]
    return both[0].unionByName(both[1])


@query
def best_per_group(spark, sf):
    rows = _results(spark, sf)
    both = [
        compare.best_per_group(rows, compare.CELL, m).select(
            F.lit(m).alias("metric"), "currency", "horizon", "model", "config", F.col(m).alias("value")
        )
        for m in ("rmse", "da")
    ]
    return both[0].unionByName(both[1])


@query
def best_by_mean(spark, sf):
    llm = t.window_results(spark, sf).filter(F.col("type") == "llm")
    return compare.best_by_mean(llm, compare.UNIT, ("config",)).select(*compare.UNIT, "config", _r("mean_metric"))


@query
def best_summary(spark, sf):
    return compare.best_summary(_results(spark, sf))


@query
def delta_vs_base(spark, sf):
    deltas = compare.delta_vs_base(_llm(spark, sf))
    return deltas.select(*compare.UNIT, "config", _r("rmse_delta"), _r("da_delta"))


@query
def delta_summary(spark, sf):
    summary = compare.delta_summary(compare.delta_vs_base(_llm(spark, sf)))
    names = ("mean_rmse_delta", "mean_da_delta", "median_rmse_delta", "median_da_delta")
    return summary.select("model", "config", "n", *[_r(c) for c in names])


@query
def best_config(spark, sf):
    summary = compare.delta_summary(compare.delta_vs_base(_llm(spark, sf)))
    return compare.best_config(summary).select("model", "config", _r("mean_rmse_delta"), _r("mean_da_delta"), "n")


@query
def prefix_groups(spark, sf):
    summary = compare.delta_summary(compare.delta_vs_base(_llm(spark, sf)))
    groups = compare.prefix_groups(summary, "news_")
    return groups.select(_r("prefix_mean"), _r("other_mean"), "prefix_rows", "other_rows")


@query
def union_results(spark, sf):
    rows = _results(spark, sf).drop("ord")
    base = rows.filter(F.col("type") == "baseline").drop("n_windows")
    llm = compare.with_factors(rows.filter(F.col("type") == "llm")).withColumn("news", F.col("news").cast("string"))
    return compare.union_results(base, llm)


@query
def common_units(spark, sf):
    return compare.common_units(t.results(spark, sf))


@query
def aligned_pairs(spark, sf):
    """Windows of two configs side by side, by key and by rank."""
    rows = _window_results(spark, sf)
    a, b = (rows.filter(F.col("config") == c) for c in ("baseline_llm", "full_model"))
    keys = [*compare.UNIT, "window"]
    by_key = compare.aligned(a, b, keys, "window_rmse").groupBy(*compare.UNIT).agg(
        F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.col("left_value") - F.col("right_value")), 3).alias("gap")
    )
    by_rank = compare.paired_by_rank(a, b, list(compare.UNIT), "window", "window_rmse").groupBy(*compare.UNIT).agg(
        F.count(F.lit(1)).alias("rank_pairs"), F.max("rank").alias("last_rank")
    )
    return by_key.join(by_rank, list(compare.UNIT))


@query
def per_series_table(spark, sf):
    return compare.per_series_table(t.results(spark, sf)).drop("ord")


@query
def factor_2x2(spark, sf):
    return compare.factor_means(_llm(spark, sf), digits=3)


@query
def factor_pivot(spark, sf):
    flat = compare.factor_means(_llm(spark, sf), digits=3)
    both = [compare.factor_pivot(flat, m).withColumn("metric", F.lit(m)) for m in ("rmse", "da")]
    return both[0].unionByName(both[1])


@query
def config_means(spark, sf):
    rows = _results(spark, sf)
    configs = ("baseline", *CONFIGS)
    overall = [
        compare.mean_by_config(rows, m, configs, positive_only=m == "da").select(
            F.lit(m).alias("metric"), F.lit(0).alias("horizon"), "model", *[_r(c, 3) for c in configs]
        )
        for m in ("rmse", "da")
    ]
    split = compare.mean_by_config(rows, "rmse", configs, ("horizon", "model")).select(
        F.lit("rmse").alias("metric"), "horizon", "model", *[_r(c, 3) for c in configs]
    )
    return reduce(DataFrame.unionByName, [*overall, split])


@query
def winners_matrix(spark, sf):
    rows = _results(spark, sf)
    both = [
        compare.winners_matrix(rows, m, HORIZONS).withColumn("metric", F.lit(m)) for m in ("rmse", "da")
    ]
    return both[0].unionByName(both[1])


@query
def type_best(spark, sf):
    return compare.type_best(t.results(spark, sf))


@query
def model_ranking(spark, sf):
    rows = _results(spark, sf)
    return compare.model_ranking(rows, "rmse").select("model", "type", _r("mean_rmse", 3)).join(
        compare.model_ranking(rows, "da").select("model", "type", _r("mean_da", 3)), ["model", "type"]
    )


@query
def factor_effects(spark, sf):
    rows = _llm(spark, sf)
    parts = [
        compare.factor_effects(rows, f).select(
            F.lit(f).alias("factor"), "model", F.col(f).cast("string").alias("level"), _r("mean_rmse", 3), _r("mean_da", 3)
        )
        for f in ("news", "prompt")
    ]
    return parts[0].unionByName(parts[1])


@query
def type_counts(spark, sf):
    return compare.type_counts(t.window_results(spark, sf))


@query
def label_text(spark, sf):
    """Labels, name parts and type by model list."""
    rows = compare.with_type(t.results(spark, sf), ("naive", "mean"))
    return rows.select(
        "currency",
        "horizon",
        label(F.col("model"), F.col("config")).alias("bracket_label"),
        label(F.col("model"), F.col("config"), "colons").alias("colon_label"),
        base_of(F.col("currency")).alias("base"),
        quote_of(F.col("currency")).alias("quote"),
        "type",
    )


@query
def result_documents(spark, sf):
    """Nested documents: number of rows in both lists and the first entry of each."""
    docs = experiment_documents(t.results(spark, sf).select("currency", "model", "config", "horizon", "rmse", "type"))
    return docs.select(
        "currency",
        F.size("baseline_results").alias("baselines"),
        F.size("llm_results").alias("llms"),
        F.col("baseline_results")[0]["rmse"].alias("first_baseline"),
        F.col("llm_results")[0]["rmse"].alias("first_llm"),
    )


# --- significance -------------------------------------------------------------------------


@query
def paired_t(spark, sf):
    tests = significance.config_tests(_llm(spark, sf))
    return tests.select(
        "config", "n_pairs",
        *[_r(f"{s}_{m}_delta", 3) for m in ("rmse", "da") for s in ("mean", "median")],
        _r("t_p_rmse", 6), _r("t_p_da", 6),
    )


@query
def wilcoxon(spark, sf):
    units = significance.question_units(_results(spark, sf))
    tests = significance.wilcoxon(units.withColumn("d", F.round("d", 4)), ["rq", "metric"])
    return tests.select("rq", "metric", "n_zero", "n_ranks", "w_plus", "w_minus", _r("w_p", 6))


@query
def signed_ranks_lines(spark, sf):
    """Signed-rank test of discount against tax over every line item, per return flag."""
    lines = t.table(spark, sf, "lineitem")
    d = F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)
    rows = lines.select("l_returnflag", d.alias("d"))
    tests = significance.wilcoxon(rows, ["l_returnflag"])
    return tests.select("l_returnflag", "n_zero", "n_ranks", "w_plus", "w_minus", _r("w_p", 6))


@query
def rq_units(spark, sf):
    units = significance.question_units(_results(spark, sf))
    tests = significance.t_statistics(units, ["rq", "metric"])
    return tests.select("rq", "metric", "n", _r("mean_delta", 3), _r("t_p", 6))


@query
def dm_pairs(spark, sf):
    losses = significance.dm_losses(_window_results(spark, sf))
    tests = significance.dm_statistics(losses, ["rq", *compare.UNIT])
    return tests.select(
        "rq", *compare.UNIT, "n", _r("mean_d", 2), _r("dm_hln", 5), _r("p", 5), p_text(F.col("p")).alias("p_text")
    )


@query
def dm_rollup(spark, sf):
    tests = significance.dm_statistics(significance.dm_losses(_window_results(spark, sf)), ["rq", *compare.UNIT])
    rolled = significance.dm_rollup(tests.withColumn("mean_d", F.round("mean_d", 6)))
    return rolled.select("rq", "n_pairs", "n_sig", _r("mean_dm"), _r("mean_loss_diff", 2), "n_negative", "n_positive")


# --- tokens -------------------------------------------------------------------------------


@query
def token_encode(spark, sf):
    return _windows(spark, sf).select(
        *WINDOW, encode(F.col("hist")).alias("tokens"), F.array_min("hist").alias("low"), F.array_max("hist").alias("high")
    )


@query
def future_tokens(spark, sf):
    return _windows(spark, sf).select(*WINDOW, encode_future(F.col("truth"), F.col("hist")).alias("tokens"))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with a known meaning: the next values as tokens, some one short, some without any."""
    full = encode_future(F.col("truth"), F.col("hist"))
    text = (
        F.when(F.col("window") % 5 == 0, F.lit("no idea"))
        .when(F.col("window") % 5 == 1, F.regexp_replace(full, r"  ###[^#]+###$", ""))
        .otherwise(F.concat(F.lit("Answer: "), full, F.lit("  ###0.1234### and 0.5")))
    )
    return _windows(spark, sf).withColumn("response", text)


@query
def token_decode(spark, sf):
    read = _answers(spark, sf).withColumn("pred", decode(F.col("response"), F.col("hist"), F.col("horizon")))
    return read.select(
        *WINDOW, (~has_tokens(F.col("response"))).alias("is_fallback"), F.posexplode("pred").alias("step", "pred")
    ).select(*WINDOW, "is_fallback", (F.col("step") + 1).alias("step"), _r("pred", 3))


# --- news and prompts ---------------------------------------------------------------------


@query
def news_topk(spark, sf):
    top = context.latest_articles(t.articles(spark, sf).select("series", "article_id", "published_on"), 10)
    return top.select("series", "rank", "article_id", _day("published_on"))


def _news_for_windows(spark: SparkSession, sf: str, columns: tuple[str, ...]) -> DataFrame:
    news = t.articles(spark, sf).select("series", "article_id", "published_on", *columns)
    return context.articles_before(_windows(spark, sf), news)


@query
def news_asof(spark, sf):
    return _news_for_windows(spark, sf, ()).select(*WINDOW, "rank", "article_id", _day("published_on"))


@query
def events_asof(spark, sf):
    """The eight events of a user in the seven days before each of the user's purchases, to the microsecond."""
    events = t.table(spark, sf, "events")
    bought = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought_ts"))
    others = events.filter("event_type <> 'purchase'").select("user_id", "event_id", "ts", "event_type")
    found = context.articles_asof(
        bought, others, window_keys=("user_id", "purchase_id"), series="user_id", window_ts="bought_ts", ts="ts", tie="event_id"
    )
    return found.select("purchase_id", "rank", "event_id", "event_type")


@query
def news_leaky(spark, sf):
    """Every window with the newest articles of its series, future ones included."""
    news = t.articles(spark, sf).select("series", "article_id", "published_on")
    return context.articles_before(_windows(spark, sf), news, leaky=True).select(
        *WINDOW, "rank", "article_id", _day("published_on")
    )


@query
def news_lines(spark, sf):
    found = _news_for_windows(spark, sf, ("title", "publisher", "summary"))
    return context.news_text(found, _windows(spark, sf).select(*WINDOW), style="full")


@query
def price_lines(spark, sf):
    return _windows(spark, sf).select(*WINDOW, context.price_text(F.col("hist"), F.col("hist_days")).alias("prices"))


@query
def fewshot_examples(spark, sf):
    windows = _windows(spark, sf, 500)
    return windows.select(
        *WINDOW,
        context.token_examples(F.col("hist"), F.col("horizon")).alias("token_examples"),
        context.price_examples(F.col("hist"), F.col("hist_days"), F.col("horizon")).alias("price_examples"),
    )


# model -> (worked examples, articles) of its prompt
LIMITS = {"llama3-8b": (3, 10), "qwen2.5-7b": (1, 5), "mistral-7b": (3, 3)}


def _lined_windows(spark: SparkSession, sf: str) -> DataFrame:
    windows = _windows(spark, sf, 500)
    news = t.articles(spark, sf).select("series", "article_id", "published_on", "title")
    return context.news_lines(context.articles_before(windows, news, k=10), windows, style="brief")


@query
def prompt_table(spark, sf):
    return prompts.prompts(_lined_windows(spark, sf), LIMITS).select(*WINDOW, "model", "config", "prompt")


@query
def number_prompt_table(spark, sf):
    return prompts.prompts(_lined_windows(spark, sf), LIMITS, family="number").select(*WINDOW, "model", "config", "prompt")


@query
def explain_prompt_table(spark, sf):
    windows = win.sliding_windows(_order_panel(spark, sf))
    news = t.articles(spark, sf).select("series", "article_id", "published_on", "title", "summary")
    texts = context.news_text(context.articles_before(windows, news), windows, style="cited")
    return prompts.explain_prompts(texts).select(*WINDOW, "prompt")


# --- responses ----------------------------------------------------------------------------


@query
def scale_filter(spark, sf):
    """Predicted paths as extracted numbers, kept on the scale of the last price."""
    numbers = F.concat("truth", F.slice("hist", 1, 5))
    kept = _windows(spark, sf).withColumn("kept", in_scale(numbers, F.col("last_price")))
    return kept.select(
        *WINDOW, F.size(numbers).alias("n_all"), F.size("kept").alias("n_kept"),
        F.round(F.aggregate("kept", F.lit(0.0), lambda a, x: a + x), 2).alias("kept_sum"),
    )


def _scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.table(spark, sf, "documents").select("doc_id", "lang", "text")
    return explain.with_explanation_scores(docs, "text", refs=None, titles=None)


@query
def text_words(spark, sf):
    docs = _scored_documents(spark, sf).select("doc_id", "explanation_len")
    turns = explain.with_explanation_scores(t.table(spark, sf, "conversations"), "text", refs=None, titles=None)
    talks = turns.groupBy("conv_id").agg(F.sum("explanation_len").alias("explanation_len"))
    return docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "explanation_len").unionByName(
        talks.select(F.lit("conversation").alias("kind"), F.col("conv_id").cast("bigint").alias("id"), "explanation_len")
    )


@query
def factor_terms(spark, sf):
    return _scored_documents(spark, sf).select(
        "doc_id", "n_factors_cited", F.array_join("factor_types", ",").alias("factor_types")
    )


@query
def coherence(spark, sf):
    return _scored_documents(spark, sf).select("doc_id", "coherence_score")


def _json_text(text: Column) -> Column:
    """A text as the inside of a JSON string."""
    for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def _explained(spark: SparkSession, sf: str) -> DataFrame:
    """A response of every document to a window of its series, in six shapes, with the titles offered to that window.

    Shapes: whole object; explanation as plain text; broken object; confidence in words; no
    object; a prediction that is no number.
    """
    windows = _windows(spark, sf).filter("horizon = 5")
    news = t.articles(spark, sf)
    offered = context.articles_before(windows, news.select("series", "article_id", "published_on", "title"))
    offered = offered.groupBy("series", "window").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("o"))
    offered = offered.select("series", "window", F.col("o.title").alias("titles"))
    asked = windows.select("series", "window", "truth").join(offered, ["series", "window"], "left")
    asked = asked.withColumn("titles", F.coalesce("titles", F.array().cast("array<string>")))
    number = F.floor(F.col("article_id") / 5)
    docs = news.select(
        "article_id", "series", "publisher", "summary", (number % 30).cast("int").alias("window"), (number % 6).cast("int").alias("shape")
    ).join(asked, ["series", "window"])
    values = F.array_join(F.transform("truth", lambda y, i: F.format_string("%.2f", y + (i + 1) * 1.25)), ", ")
    body, factor = _json_text(F.col("summary")), _json_text(F.col("publisher"))
    listed = F.concat(F.lit('{"predictions": ['), values, F.lit("]"))
    start = F.concat(listed, F.lit(', "explanation": {"summary": "'), body, F.lit('", "key_factors": ["'), factor, F.lit('"]'))
    text = (
        F.when(F.col("shape") == 0, F.concat(start, F.lit(', "news_references": [1, 3, 99], "confidence": 0.8, "risk_factors": ["war"]}}')))
        .when(F.col("shape") == 1, F.concat(listed, F.lit(', "explanation": "'), body, F.lit('"}')))
        .when(F.col("shape") == 2, F.concat(F.lit(' {"predictions": [1.5, 2.5], "explanation": '), body, F.lit("} ")))
        .when(F.col("shape") == 3, F.concat(start, F.lit(', "confidence": "high"}}')))
        .when(F.col("shape") == 4, F.col("summary"))
        .otherwise(F.concat(F.lit('{"predictions": [1.1, "n/a"], "explanation": {"summary": "'), body, F.lit('"}}')))
    )
    return with_explanation(docs.withColumn("response", text))


@query
def explanation_fields(spark, sf):
    return _explained(spark, sf).select(
        "article_id", "shape", word_count(F.col("explanation_text")).alias("words"), F.size("predictions").alias("n_predictions"),
        F.round(F.aggregate("predictions", F.lit(0.0), lambda a, x: a + x), 2).alias("pred_sum"),
        "bad_predictions", "confidence_score", F.size("news_refs").alias("n_refs"),
    )


@query
def explanation_grounding(spark, sf):
    """By references or by the titles offered to the window, and no others."""
    scored = explain.with_explanation_scores(_explained(spark, sf))
    return scored.select("article_id", "shape", F.size("titles").alias("offered"), _r("news_grounding_rate", 6))


@query
def explanation_errors(spark, sf):
    scored = explain.with_prediction_error(_explained(spark, sf).filter("NOT bad_predictions"))
    return scored.select("article_id", "shape", _r("abs_pred_error"), _r("directional_accuracy"))


def _numeric_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of the conversations as answers in the four shapes numbers come in, and some without any."""
    turns = t.table(spark, sf, "conversations").select("conv_id", "role", F.col("turn").alias("attempt"), "text")
    n = F.pmod(F.col("conv_id") * 7 + F.col("attempt") * 3, F.lit(6))
    value = F.concat(F.col("conv_id").cast("string"), F.lit("."), (F.col("attempt") + 1).cast("string"))
    text = (
        F.when(n == 0, F.concat(F.lit("\u00a0"), value, F.lit(", 2.5]} "), F.col("text")))
        .when(n == 1, F.concat(F.lit('So: {"predictions": ['), value, F.lit(", 7.25]} "), F.col("text")))
        .when(n == 2, F.concat(F.lit("Values ["), value, F.lit(", 3] "), F.col("text")))
        .when(n == 3, F.concat(F.lit("About "), value, F.lit(" or 12.75. "), F.col("text")))
        .when(n == 4, F.concat(F.lit("###"), value, F.lit("### "), F.col("text")))
        .otherwise(F.col("text"))
    )
    return turns.select("conv_id", "role", "attempt", text.alias("text"))


@query
def response_quality(spark, sf):
    return explain.response_counts(_numeric_answers(spark, sf), ("role", "attempt"), "text")


@query
def response_numbers(spark, sf):
    read = with_numbers(_numeric_answers(spark, sf), "text")
    return read.select(
        "conv_id", "attempt", F.coalesce("parse_case", F.lit(0)).alias("parse_case"), F.greatest(F.size("numbers"), F.lit(0)).alias("found"),
        F.try_element_at("numbers", F.lit(1)).alias("first_number"),
    )


@query
def retry_outcomes(spark, sf):
    answers = _answers(spark, sf).select(
        "series", "horizon", F.floor(F.col("window") / 3).alias("request"), (F.col("window") % 3).alias("attempt"), "response"
    )
    return explain.retry_outcomes(answers, ("series", "horizon", "request"))


@query
def flat_predictions(spark, sf):
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    flagged = made.withColumn("flat", F.coalesce(metrics.flat_prediction(), F.lit(False)))
    return flagged.groupBy("horizon", "model").agg(F.count(F.lit(1)).alias("windows"), F.count_if("flat").alias("flat"))


@query
def extracted_numbers(spark, sf):
    """Numbers found in every document, page and turn: extraction case, how many, and the first."""
    docs = t.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = t.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    read = with_numbers(docs.unionByName(pages), "text", max_decimals=None)
    return read.select(
        "kind", "id", F.coalesce("parse_case", F.lit(0)).alias("parse_case"),
        F.greatest(F.size("numbers"), F.lit(0)).alias("found"),
        F.try_element_at("numbers", F.lit(1)).alias("first_number"),
    )


@query
def feature_corr(spark, sf):
    scored = _scored_documents(spark, sf).select(
        "doc_id", F.col("lang").alias("model"), "explanation_len", "n_factors_cited", "coherence_score"
    )
    joined = scored.join(t.table(spark, sf, "labels"), "doc_id")
    return compare.feature_correlations(
        joined, ["explanation_len", "n_factors_cited", "coherence_score"], ["quality", "toxic"]
    )


@query
def explanation_rollup(spark, sf):
    scored = explain.with_explanation_scores(_explained(spark, sf)).withColumn("model", F.col("shape").cast("string"))
    rolled = compare.explanation_rollup(scored)
    return rolled.select("model", *[_r(c) for c in rolled.columns if c.startswith("avg_")], "n_samples")


@query
def table_shapes(spark, sf):
    return compare.table_shapes({n: t.table(spark, sf, n) for n in ("orders", "lineitem", "documents", "labels")})


@query
def window_metrics_parity(spark, sf):
    """Windows as the study writes them: an undefined direction score is 0.0."""
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    scored = metrics.score_windows(made, parity=True)
    return scored.select(*WINDOW, "model", _r("window_rmse"), _r("window_da"))


@query
def unscorable_windows(spark, sf):
    """Windows with a missing, empty, cut or whole prediction: what can be scored, and why the rest cannot."""
    kind = F.col("window") % 4
    pred = (
        F.when(kind == 0, F.lit(None).cast("array<double>")).when(kind == 1, F.array().cast("array<double>"))
        .when(kind == 2, F.concat("truth", F.array(F.lit(1.0)))).otherwise(F.col("truth"))
    )
    good, bad = metrics.split_valid(_windows(spark, sf).withColumn("pred", pred))
    both = bad.select("horizon", "reason").unionByName(good.select("horizon", F.lit("valid").alias("reason")))
    return both.groupBy("horizon", "reason").agg(F.count(F.lit(1)).alias("windows"))


@query
def news_flattened(spark, sf):
    """Raw articles with fields inside content, at the top, or at the top beside an empty content."""
    news = t.articles(spark, sf)
    link = F.concat(F.lit("http://news.example.com/"), F.col("article_id").cast("string"))
    day = F.col("published_on").cast("string")
    inner = F.struct(
        "title", "summary", F.struct(F.col("publisher").alias("displayName")).alias("provider"), F.struct(link.alias("url")).alias("clickThroughUrl"),
        F.concat(day, F.lit("T10:30:00Z")).alias("pubDate"), F.lit("STORY").alias("contentType"),
        F.struct(F.array(F.struct(F.concat(link, F.lit("/s.png")).alias("url")), F.struct(link.alias("url"))).alias("resolutions")).alias("thumbnail"),
        F.struct(F.array("series", F.lit("X")).alias("stockTickers")).alias("finance"),
    )
    flat = [F.col("title"), F.col("summary"), F.col("publisher").alias("provider"), link.alias("url"), F.concat(F.lit("on "), day).alias("pubDate"), F.lit("p.png").alias("thumbnail")]
    shape = F.col("article_id") % 3
    raw = (
        F.when(shape == 0, F.to_json(F.struct(inner.alias("content")))).when(shape == 1, F.to_json(F.struct(*flat)))
        .otherwise(F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("content"), *flat)))
    )
    return flatten_articles(news.select("article_id", raw.alias("raw"))).select(
        "article_id", "title", "publisher", "link", "published_at", "type", "thumbnail", F.size("related_tickers").alias("tickers"),
        F.length("summary").alias("summary_chars"),
    )


@query
def walk_shape(spark, sf):
    """The seeded walk without tokens: as long as the horizon, and no step beyond ten deviations."""
    key = F.concat_ws("|", "series", "horizon", "window")
    walked = win.window_stats(_windows(spark, sf), 500).withColumn("walk", random_walk(F.col("hist"), F.col("horizon"), key))
    steps = F.zip_with(F.concat(F.array("last_price"), F.slice("walk", 1, F.col("horizon") - 1)), "walk", lambda a, b: F.abs(b - a))
    return walked.select(
        *WINDOW, F.size("walk").alias("steps"), F.forall(steps, lambda x: x <= F.col("daily_vol") * 10).alias("near"),
        F.exists(steps, lambda x: x > 0).alias("moves"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to daily bars, calendar fill, rolling-origin windows, predictions, metrics per series and horizon."""
    made = predict.with_window_predictions(_windows(spark, sf), 30, t.DIGITS)
    summary = metrics.summarise(metrics.score_windows(made), ["series", "horizon", "model"])
    return summary.select("series", "horizon", "model", _r("rmse"), _r("mae"), _r("mape"), _r("da"), "n_windows")
