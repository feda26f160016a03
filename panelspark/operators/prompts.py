"""Prompt text as a column of the window table.

Wording is a parameter: templates name their parts in braces and are filled by
string expressions, one prompt per window and config, nothing is looped over.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import base_of, quote_of
from panelspark.functions.tokens import encode
from panelspark.operators.context import NO_NEWS, joined_lines, price_examples, price_text, token_examples
from panelspark.operators.windows import last_values, window_stats
from panelspark.params import FACTORS, LOOKBACK

TOKEN_TEMPLATE = """Predict the {base}/{quote} rate. Values are written as ###value### tokens: scaled to
[-0.5, 0.5] with the minimum {low} and maximum {high} of the window, snapped to 10,000 bins on [-1, 1].
Current value: {current}
{examples}{news}
Answer with exactly {horizon} different token(s), separated by spaces.

### Input:
{tokens}

### Response:
"""

NUMBER_TEMPLATE = """Predict the {base}/{quote} rate for the next {horizon} days.
{examples}{news}
History, last {lookback} days:
{prices}

Current: {current}  Average: {mean}  Deviation: {deviation}  Trend: {trend}
Keep the scale of the history (around {current}). Answer with one JSON object holding
exactly {horizon} numbers and nothing else:
{"predictions": ["""

EXPLAIN_TEMPLATE = """Predict the {base}/{quote} rate for the next {horizon} days and explain the prediction.
News, numbered:
{news}

History, last {lookback} days:
{prices}

Current: {current}
Answer with one JSON object of this form and nothing else; news_references holds numbers of the list above:
{"predictions": [{example_path}], "explanation": {"summary": "...", "key_factors": ["..."],
"news_references": [1, 3], "confidence": 0.7, "direction": "bullish/bearish/neutral", "risk_factors": ["..."]}}
"""


def fill_template(template: str, parts: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` by columns; other braces are text."""
    pieces = re.split(r"\{(" + "|".join(map(re.escape, parts)) + r")\}", template)
    cols = [F.lit(p) if i % 2 == 0 else parts[p].cast("string") for i, p in enumerate(pieces)]
    return F.concat(*[c for c, p in zip(cols, pieces) if p != ""])


def _money(c: Column) -> Column:
    return F.format_string("%.4f", c)


def _common(series: str) -> dict[str, Column]:
    pair = F.col(series)
    return {
        "base": base_of(pair),
        "quote": quote_of(pair),
        "horizon": F.col("horizon"),
        "lookback": F.lit(LOOKBACK),
        "current": _money(F.col("last_price")),
    }


def prompts(
    windows: DataFrame,
    limits: Mapping[str, tuple[int, int]],
    series: str = "series",
    family: str = "token",
    lines: str = "news_lines",
    style: str = "brief",
    template: str | None = None,
) -> DataFrame:
    """One row per window, model and config with ``prompt``; ``limits`` maps a model to its examples and articles.

    ``windows`` needs ``hist``, ``hist_days``, ``horizon``, ``last_price`` and the array of
    news lines, of which each model reads as many as its limit allows.
    """
    runs = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"), F.lit(c).alias("config"), F.lit(n).alias("use_news"),
                F.lit(p).alias("style"), F.lit(ex).alias("n_examples"), F.lit(k).alias("max_news"),
            )
            for m, (ex, k) in limits.items()
            for c, (n, p) in FACTORS.items()
        ]
    )
    rows = window_stats(windows).withColumns(
        {"_recent": last_values(LOOKBACK), "_recent_days": last_values(LOOKBACK, "hist_days")}
    )
    counts = sorted({ex for ex, _ in limits.values()})
    # shared by all runs of a window, so made before the runs are expanded
    rows = rows.withColumns(
        {
            "_tokens": encode(F.col("_recent")),
            "_prices": price_text(F.col("_recent"), F.col("_recent_days")),
            **{
                f"_shots_{k}": token_examples(F.col("hist"), F.col("horizon"), k)
                if family == "token"
                else price_examples(F.col("hist"), F.col("hist_days"), F.col("horizon"), k)
                for k in counts
            },
        }
    )
    rows = rows.withColumn("_run", F.explode(runs)).select("*", "_run.*").drop("_run")
    shots = F.coalesce(*[F.when(F.col("n_examples") == k, F.col(f"_shots_{k}")) for k in counts])
    news = joined_lines(F.col(lines), style, F.col("max_news"))
    parts = {
        **_common(series),
        "low": _money(F.array_min("_recent")),
        "high": _money(F.array_max("_recent")),
        "tokens": F.col("_tokens"),
        "prices": F.col("_prices"),
        "mean": _money(F.col("mean")),
        "deviation": _money(F.col("volatility")),
        "trend": F.col("trend"),
        "examples": F.when(F.col("style") == "few", F.concat(F.lit("\nPast cases:\n"), shots, F.lit("\n"))).otherwise(""),
        "news": F.when(F.col("use_news"), F.concat(F.lit("\nNews:\n"), news, F.lit("\n"))).otherwise(""),
    }
    text = template or (TOKEN_TEMPLATE if family == "token" else NUMBER_TEMPLATE)
    return rows.withColumn("prompt", fill_template(text, parts)).select(
        *windows.columns, "model", "config", "prompt"
    )


def explain_prompts(
    windows: DataFrame, series: str = "series", news: str = "news_text", template: str = EXPLAIN_TEMPLATE
) -> DataFrame:
    """Prompt asking for a prediction with a structured explanation, one per window."""
    recent, days = last_values(LOOKBACK), last_values(LOOKBACK, "hist_days")
    path = F.transform(
        F.sequence(F.lit(1), F.col("horizon")),
        lambda i: F.format_string("%.4f", F.col("last_price") * (i * 0.001 + 1)),
    )
    parts = {
        **_common(series),
        "news": F.coalesce(F.col(news), F.lit(NO_NEWS)),
        "prices": price_text(recent, days),
        "example_path": F.array_join(path, ", "),
    }
    return windows.withColumn("prompt", fill_template(template, parts))
