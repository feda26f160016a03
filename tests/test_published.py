"""Published result tables must come out of the published input table."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import compare, significance
from panelspark.params import BASELINE_MODELS, CONFIGS, LANGUAGE_MODELS
from panelspark.sources.results import read_results

MODELS = ("arima", "lstm", "xgboost", "itransformer", "llama3-8b", "qwen2.5-7b", "mistral-7b")


@pytest.fixture(scope="module")
def results(spark, data):
    assert MODELS == BASELINE_MODELS + LANGUAGE_MODELS
    rows = read_results(spark, f"{data}/results.csv")
    model = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model"))
    config = F.array_position(F.array(*[F.lit(c) for c in CONFIGS]), F.col("config"))
    kind = F.when(F.col("model").isin(*BASELINE_MODELS), "baseline").otherwise("llm")
    return rows.withColumns({"ord": model * 10 + config, "type": kind}).cache()


def test_paired_tests(results, data):
    got = significance.paired_tests(significance.question_units(results), ["rq", "metric"]).toPandas()
    want = pd.read_csv(f"{data}/expected_tests.csv")
    both = want.merge(got, on=["rq", "metric"], suffixes=("", "_got"))
    assert len(both) == len(want) == len(got) == 7
    for c in ("n", "mean_delta", "t_p", "w_p"):
        assert both[f"{c}_got"].astype(float).values == pytest.approx(both[c].values, abs=1e-12, rel=1e-9)
    for c in ("sig_t", "sig_w"):
        assert (both[f"{c}_got"] == both[c]).all()


def test_factor_tables(results, data):
    flat = compare.factor_means(results.filter("type = 'llm'"))
    got = flat.toPandas().sort_values("config").reset_index(drop=True)
    want = pd.read_csv(f"{data}/expected_factors.csv").sort_values("config").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want)
    for metric in ("rmse", "da"):
        pivot = compare.factor_pivot(flat, metric).toPandas().sort_values("news")
        published = pd.read_csv(f"{data}/expected_pivot_{metric}.csv")
        assert pivot[["few", "zero"]].values == pytest.approx(published[["few", "zero"]].values)


def test_best_summary(results, data):
    got = compare.best_summary(results).toPandas()
    want = pd.read_csv(f"{data}/expected_best.csv")
    both = want.merge(got, on=["currency", "horizon"], suffixes=("", "_got"))
    assert len(both) == 15
    for c in ("best_model_rmse", "best_model_da"):
        assert (both[c] == both[f"{c}_got"]).all()
    for c in ("rmse", "mae", "mape", "da", "best_da"):
        assert both[f"{c}_got"].values == pytest.approx(both[c].values, abs=1e-9)


def test_order_inside_tables(results, data):
    """Published tables sort horizons as text, then by RMSE."""
    rows = compare.per_series_table(results, as_text=True).toPandas()
    want = pd.read_csv(f"{data}/results.csv")
    for currency, part in want.groupby("currency"):
        got = rows[rows["currency"] == currency]
        assert list(zip(got["horizon"], got["rmse"])) == list(zip(part["horizon"], part["rmse"]))


def test_config_tests(results):
    out = significance.config_tests(results.filter("type = 'llm'")).toPandas()
    assert sorted(out["config"]) == ["full_model", "news_only", "prompt_only"]
    assert (out["n_pairs"] == 45).all()
    assert list(out["mean_rmse_delta"]) == sorted(out["mean_rmse_delta"])
    wide = results.filter("type = 'llm'").toPandas().pivot_table(
        index=["currency", "horizon", "model"], columns="config", values="rmse"
    )
    for _, row in out.iterrows():
        d = wide[row["config"]] - wide["baseline_llm"]
        assert row["mean_rmse_delta"] == pytest.approx(d.mean())
        assert row["median_rmse_delta"] == pytest.approx(d.median())
