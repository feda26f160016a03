import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspark.operators import prompts
from panelspark.plans import queries as q
from panelspark.plans import tables as t


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 5 * 3 * 4 and all(r.rmse >= r.mae for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    plain = {n for n in q.QUERIES if n not in entry.oracle_sql()}
    assert plain == set()


@pytest.mark.parametrize("name", ["bars_daily", "fill_trading", "window_metrics", "best_summary", "news_lines", "explanation_grounding", "response_numbers"])
def test_queries_run_on_the_smallest_tables(spark, sf, name):
    assert entry.queries()[name](spark, sf).count() > 0


def test_prompts_have_their_parts(spark, sf):
    rows = q.prompt_table(spark, sf).filter("horizon = 5 AND window = 3").collect()
    by = {(r.series, r.model, r.config): r.prompt for r in rows}
    few, zero = by[("5-LOW", "llama3-8b", "prompt_only")], by[("5-LOW", "llama3-8b", "baseline_llm")]
    assert few.count("Case ") == 3 and zero.count("Case ") == 0
    assert by[("5-LOW", "qwen2.5-7b", "full_model")].count("Case ") == 1
    assert "News:" in by[("5-LOW", "mistral-7b", "news_only")] and "News:" not in zero
    history = zero.split("### Input:\n")[1].split("\n")[0]
    assert len(re.findall(r"###[-0-9.]+###", history)) == 30 and "{" not in zero


def test_number_prompts(spark, sf):
    windows = q._windows(spark, sf, 500).filter("horizon = 5 AND window = 3")
    lines = windows.withColumn("news_lines", F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.format_string("%d. x", i)))
    rows = {r.model: r for r in prompts.prompts(lines, q.LIMITS, family="number").filter("config = 'full_model' AND series = '5-LOW'").collect()}
    assert {m: r.prompt.count(". x") for m, r in rows.items()} == {"llama3-8b": 10, "qwen2.5-7b": 5, "mistral-7b": 3}
    row = rows["llama3-8b"]
    assert row.prompt.rstrip().endswith('{"predictions": [') and row.prompt.count("Case ") == 3


def test_hot_series_is_spread(spark, sf):
    """A panel in which one series holds most rows is still cut into many ranges."""
    from panelspark.operators.layout import framed

    panel = t.filled(t.order_bars(spark, sf))
    rows, _ = framed(panel, ["series"], back=30, chunk_rows=256)
    per_range = rows.groupBy("series", "_range").count().agg({"count": "max"}).first()[0]
    assert per_range <= 256 + 30
