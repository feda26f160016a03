"""Paired tests and prediction-comparison tests as grouped aggregates.

Differences are rows; a test is a group.  A test may own most of the rows, so ranks are
built a digit of the value at a time: rows are counted per prefix, and a task orders the
digits under one prefix, never a test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.pvalues import (
    EXACT_RANKS,
    normal_two_sided,
    rank_sum_table,
    signed_rank_exact,
    t_two_sided,
)
from panelspark.operators.compare import CELL, UNIT, best_by_mean, best_per_group, delta_vs_base
from panelspark.operators.layout import DIGIT_BITS, exact_median, with_rows_below

ALPHA = 0.05


def t_statistics(df: DataFrame, by: Sequence[str], d: str = "d") -> DataFrame:
    """n, mean difference and two-sided p of the paired t-test per group; null differences are ignored."""
    sums = df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_delta"), F.stddev_samp(d).alias("_sd")
    )
    t = F.when(F.col("_sd") > 0, F.col("mean_delta") / (F.col("_sd") / F.sqrt("n")))
    return sums.withColumn("t", t).withColumn("t_p", t_two_sided(F.col("t"), F.col("n") - 1)).drop("_sd")


def signed_rank_sums(df: DataFrame, by: Sequence[str], d: str = "d", bits: int = DIGIT_BITS) -> DataFrame:
    """Rank sums of positive and negative differences, zeros dropped, average ranks for ties."""
    rows = df.filter(F.col(d).isNotNull()).select(*by, F.col(d).alias("_d"), F.abs(d).alias("_a"))
    kinds = rows.groupBy(*by, "_a").agg(
        F.count(F.lit(1)).alias("_tie"), F.count_if(F.col("_d") > 0).alias("_pos")
    )
    zero = F.col("_a") == 0
    # differences of zero have no rank: they count as no rows
    sized = kinds.withColumn("_rows", F.when(zero, F.lit(0)).otherwise(F.col("_tie")))
    ranked = with_rows_below(sized, by, "_a", "_rows", "_below", bits)
    tie, pos, rank = F.col("_rows").cast("double"), F.when(zero, F.lit(0)).otherwise(F.col("_pos")), F.col("_below") + (F.col("_rows") + 1) / 2
    return ranked.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(zero, F.col("_tie"))), F.lit(0)).alias("n_zero"),
        F.nullif(F.sum("_rows"), F.lit(0)).alias("n_ranks"),
        F.sum(F.when(~zero, rank * pos)).alias("w_plus"),
        F.sum(F.when(~zero, rank * (tie - pos))).alias("w_minus"),
        F.sum(F.when(~zero, tie * tie * tie - tie)).alias("tie_term"),
    )


def wilcoxon(df: DataFrame, by: Sequence[str], d: str = "d", exact_ranks: int = EXACT_RANKS) -> DataFrame:
    """Two-sided signed-rank test per group.

    Exact for up to ``exact_ranks`` differences without zeros, as the study's test; otherwise the normal form with tie
    correction and no continuity correction.  Null when every difference is zero.
    """
    sums = signed_rank_sums(df, by, d)
    n = F.col("n_ranks").cast("double")
    spread = n * (n + 1) * (n * 2 + 1) / 24 - F.col("tie_term") / 48
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(spread)
    exact = (F.col("n_zero") == 0) & (F.col("n_ranks") <= exact_ranks)
    table = rank_sum_table(df.sparkSession, exact_ranks).withColumnRenamed("n_ranks", "_n")  # as many rows
    p_exact = signed_rank_exact(F.col("ways"), F.col("_n"), F.col("w_plus"))
    return (
        sums.withColumn("_key", F.when(exact, F.col("n_ranks").cast("int")))
        .join(F.broadcast(table), F.col("_key") == F.col("_n"), "left")
        .select(
            *by, "n_zero", "n_ranks", "w_plus", "w_minus",
            F.when(exact, p_exact).when(spread > 0, normal_two_sided(z)).alias("w_p"),
        )
    )


def paired_tests(df: DataFrame, by: Sequence[str], d: str = "d", alpha: float = ALPHA) -> DataFrame:
    """One row per group: n, mean difference, both p-values and flags."""
    both = t_statistics(df, by, d).join(wilcoxon(df, by, d).select(*by, "w_p"), list(by), "left")
    return both.withColumns({"sig_t": F.col("t_p") < alpha, "sig_w": F.col("w_p") < alpha})


def config_tests(df: DataFrame, base: str = "baseline_llm", at_least: int = 5) -> DataFrame:
    """Every config against the base on RMSE and DA, units present on both sides, best mean first."""
    shared = df.filter(F.lower("config") == base).select(*UNIT, F.lit(1).alias("_has"))
    deltas = delta_vs_base(df, base).join(shared, list(UNIT), "left_semi").filter(F.lower("config") != base)
    long = deltas.select(
        "config",
        F.inline(
            F.array(
                F.struct(F.lit("rmse").alias("metric"), F.col("rmse_delta").alias("d")),
                F.struct(F.lit("da").alias("metric"), F.col("da_delta").alias("d")),
            )
        ),
    )
    keys = ["config", "metric"]
    tested = paired_tests(long, keys).join(exact_median(long, keys, "d", "median_delta"), keys, "left")
    pairs = deltas.groupBy("config").agg(F.count(F.lit(1)).alias("n_pairs"))

    def pick(metric: str, column: str, name: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col(column))).alias(name)

    wide = tested.groupBy("config").agg(
        *[
            pick(m, c, n)
            for m in ("rmse", "da")
            for c, n in (
                ("mean_delta", f"mean_{m}_delta"),
                ("median_delta", f"median_{m}_delta"),
                ("t_p", f"t_p_{m}"),
                ("w_p", f"w_p_{m}"),
            )
        ]
    )
    return pairs.join(wide, "config").filter(F.col("n_pairs") >= at_least).orderBy("mean_rmse_delta", "t_p_rmse")


# --- units of the four questions ----------------------------------------------------


def _long(rows: DataFrame, keys: Sequence[str], parts: Sequence[tuple[str, str, Column]]) -> DataFrame:
    made = [F.struct(F.lit(q).alias("rq"), F.lit(m).alias("metric"), d.alias("d")) for q, m, d in parts]
    return rows.select(F.inline(F.array(*made)), *keys).select("rq", "metric", *keys, "d")


def best_pairs(df: DataFrame) -> DataFrame:
    """RQ1: best config per (model, currency, horizon) minus best baseline of its cell."""
    best = best_per_group(df.filter(F.col("type") == "llm"), UNIT, "rmse")
    base = best_per_group(df.filter(F.col("type") == "baseline"), CELL, "rmse").select(
        *CELL, F.col("rmse").alias("_rmse"), F.col("da").alias("_da")
    )
    joined = best.join(base, list(CELL))
    return _long(
        joined,
        UNIT,
        [("RQ1", "RMSE", F.col("rmse") - F.col("_rmse")), ("RQ1", "DA", F.col("da") - F.col("_da"))],
    )


def factor_pairs(df: DataFrame) -> DataFrame:
    """RQ2 news, RQ3 prompt, RQ4 their interaction: one pivot by unit gives all three."""
    llm = df.filter(F.col("type") == "llm")
    c = F.col("config")

    def mean(metric: str, *configs: str) -> Column:
        return F.avg(F.when(c.isin(*configs), F.col(metric)))

    levels = {
        "news": ("news_only", "full_model"),
        "no_news": ("baseline_llm", "prompt_only"),
        "few": ("prompt_only", "full_model"),
        "zero": ("baseline_llm", "news_only"),
    }
    cols = [mean(m, *cfg).alias(f"{m}_{name}") for m in ("rmse", "da") for name, cfg in levels.items()]
    cols += [mean("da", cfg).alias(f"da_{cfg}") for cfg in ("baseline_llm", "news_only", "prompt_only", "full_model")]
    wide = llm.groupBy(*UNIT).agg(*cols)

    def gap(metric: str, a: str, b: str) -> Column:
        whole = F.lit(True)
        for m in ("rmse", "da"):
            whole = whole & F.col(f"{m}_{a}").isNotNull() & F.col(f"{m}_{b}").isNotNull()
        return F.when(whole, F.col(f"{metric}_{a}") - F.col(f"{metric}_{b}"))

    interaction = (F.col("da_full_model") - F.col("da_prompt_only")) - (
        F.col("da_news_only") - F.col("da_baseline_llm")
    )
    return _long(
        wide,
        UNIT,
        [
            ("RQ2", "RMSE", gap("rmse", "news", "no_news")),
            ("RQ2", "DA", gap("da", "news", "no_news")),
            ("RQ3", "RMSE", gap("rmse", "few", "zero")),
            ("RQ3", "DA", gap("da", "few", "zero")),
            ("RQ4", "DA_interaction", interaction),
        ],
    ).filter(F.col("d").isNotNull())


def question_units(df: DataFrame) -> DataFrame:
    """Paired differences of all four questions as (rq, metric, unit, d)."""
    return best_pairs(df).unionByName(factor_pairs(df))


# --- comparison of loss series ---------------------------------------------------------


def dm_statistics(df: DataFrame, by: Sequence[str], horizon: str = "horizon", d: str = "d") -> DataFrame:
    """Diebold-Mariano statistic with small-sample factor per group of loss differences.

    The factor is sqrt((T-h)(T-h+1))/T.  Groups with fewer than two values or without
    spread keep their row with a null statistic.
    """
    sums = df.groupBy(*by).agg(
        F.count(d).alias("n"), F.avg(d).alias("mean_d"), F.var_samp(d).alias("_var")
    )
    total, h = F.col("n").cast("double"), F.col(horizon)
    factor = F.sqrt((total - h) * (total - h + 1)) / total
    usable = (F.col("n") >= 2) & (F.col("_var") > 0)
    dm = F.when(usable, F.col("mean_d") / F.sqrt(F.col("_var") / total) * factor)
    mean = F.when(F.col("n") >= 2, F.col("mean_d"))
    return (
        sums.withColumns({"dm_hln": dm, "mean_d": mean, "df": F.col("n") - 1})
        .withColumn("p", t_two_sided(F.col("dm_hln"), F.col("df")))
        .drop("_var")
    )


def dm_best_losses(df: DataFrame) -> DataFrame:
    """RQ1: squared window errors, best config of each model minus best baseline of the cell, same window."""
    llm, base = df.filter(F.col("type") == "llm"), df.filter(F.col("type") == "baseline")
    config = best_by_mean(llm, UNIT, ("config",)).select(*UNIT, "config")
    model = best_by_mean(base, CELL, ("model",)).select(*CELL, "model")
    ours = llm.join(config, [*UNIT, "config"]).select(*UNIT, "window", F.col("window_rmse").alias("_a"))
    theirs = base.join(model, [*CELL, "model"]).select(*CELL, "window", F.col("window_rmse").alias("_b"))
    joined = ours.join(theirs, [*CELL, "window"])
    return joined.select(
        F.lit("RQ1").alias("rq"), *UNIT, "window", F.lit("").alias("other"),
        (F.col("_a") * F.col("_a") - F.col("_b") * F.col("_b")).alias("d"),
    )


def dm_factor_losses(df: DataFrame, parity: bool = False) -> DataFrame:
    """RQ2-RQ4 differences, aligned on (window, level of the other factor), from one pivot per window.

    ``parity`` counts an undefined direction score as 0.0.
    """
    llm, c = df.filter(F.col("type") == "llm"), F.col("config")
    da = F.coalesce("window_da", F.lit(0.0)) if parity else F.col("window_da")
    cfgs = ("baseline_llm", "news_only", "prompt_only", "full_model")
    wide = llm.groupBy(*UNIT, "window").agg(
        *[F.max(F.when(c == x, F.pow("window_rmse", F.lit(2)))).alias(f"l_{x}") for x in cfgs],
        *[F.max(F.when(c == x, da)).alias(f"a_{x}") for x in cfgs],
    )

    def gap(a: str, b: str) -> Column:
        return F.col(f"l_{a}") - F.col(f"l_{b}")

    effect = (F.col("a_news_only") - F.col("a_baseline_llm")) - (F.col("a_full_model") - F.col("a_prompt_only"))
    parts = [
        ("RQ2", "zero", gap("news_only", "baseline_llm")),
        ("RQ2", "few", gap("full_model", "prompt_only")),
        ("RQ3", "no news", gap("prompt_only", "baseline_llm")),
        ("RQ3", "news", gap("full_model", "news_only")),
        ("RQ4", "", effect),
    ]
    made = [F.struct(F.lit(q).alias("rq"), F.lit(o).alias("other"), d.alias("d")) for q, o, d in parts]
    return (
        wide.select(*UNIT, "window", F.inline(F.array(*made)))
        .select("rq", *UNIT, "window", "other", "d")
        .filter(F.col("d").isNotNull())
    )


def dm_losses(df: DataFrame, parity: bool = False) -> DataFrame:
    return dm_best_losses(df).unionByName(dm_factor_losses(df, parity))


def dm_rollup(tests: DataFrame, alpha: float = ALPHA, by: Sequence[str] = ("rq",)) -> DataFrame:
    """Pairs tested, significant ones, mean statistic and loss difference, and directions."""
    return tests.filter(F.col("n") >= 2).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("p") < alpha).alias("n_sig"),
        F.avg("dm_hln").alias("mean_dm"),
        F.avg("mean_d").alias("mean_loss_diff"),
        F.count_if(F.col("mean_d") < 0).alias("n_negative"),
        F.count_if(F.col("mean_d") > 0).alias("n_positive"),
    )
