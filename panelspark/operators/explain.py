"""Explanation quality of responses as a bulk job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions.extract import with_numbers
from panelspark.functions.text import coherence, factor_types, found_terms, grounding, title_heads
from panelspark.functions.tokens import has_tokens
from panelspark.operators.metrics import direction_of_steps
from panelspark.params import CONNECTORS, FACTOR_TERMS


def with_explanation_scores(
    df: DataFrame,
    text: str = "explanation_text",
    refs: str | None = "news_refs",
    titles: str | None = "titles",
    heads: str | None = None,
    terms: Mapping[str, Sequence[str]] = FACTOR_TERMS,
    connectors: Sequence[str] = CONNECTORS,
) -> DataFrame:
    """Word count, factor categories, coherence and, with titles, grounding per response.

    ``heads`` names a column of title heads made beforehand, instead of ``titles``.
    """
    wanted = [*(t for ts in terms.values() for t in ts), *connectors]
    low = df.withColumn("_low", F.lower(text)).withColumn("_found", found_terms(F.col("_low"), wanted))
    found, n_words = F.col("_found.terms"), F.col("_found.words")
    scored = low.withColumns(
        {
            "explanation_len": n_words,
            "factor_types": factor_types(found, terms),
            "coherence_score": coherence(F.col(text), n_words, found, terms, connectors),
        }
    ).withColumn("n_factors_cited", F.size("factor_types"))
    if titles or heads:
        cited = F.col(refs) if refs else F.array().cast("array<int>")
        scored = scored.withColumn("news_grounding_rate", grounding(F.col("_low"), cited, F.col(heads) if heads else title_heads(F.col(titles))))
    return scored.drop("_low", "_found")


def with_prediction_error(df: DataFrame, truth: str = "truth", pred: str = "predictions") -> DataFrame:
    """Mean absolute error and step direction score where the response predicts far enough, else null."""
    enough = F.size(pred) >= F.size(truth)
    used = df.withColumn("_p", F.slice(pred, 1, F.size(truth)))
    error = F.aggregate(
        F.zip_with(truth, "_p", lambda y, p: F.abs(y - p)), F.lit(0.0), lambda a, x: a + x
    ) / F.size(truth)
    return used.withColumns(
        {
            "abs_pred_error": F.when(enough, error),
            "directional_accuracy": F.when(enough, direction_of_steps(truth, "_p", masked=False)),
        }
    ).drop("_p")


def response_counts(
    df: DataFrame, by: Sequence[str] = ("model", "config", "attempt"), text: str = "response"
) -> DataFrame:
    """Responses, token-bearing ones and extraction cases per group; what is left over needs a retry."""
    read = with_numbers(df, text)
    return read.groupBy(*by).agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(has_tokens(F.col(text))).alias("with_tokens"),
        *[F.count_if(F.col("parse_case") == i).alias(f"case_{i}") for i in range(1, 5)],
        F.count_if(F.col("parse_case").isNull()).alias("unparsed"),
    )


def retry_outcomes(df: DataFrame, request: Sequence[str], attempt: str = "attempt", text: str = "response") -> DataFrame:
    """Per request: attempts made and the first valid response, or the last one when none is valid."""
    valid = has_tokens(F.col(text))
    rows = df.withColumn("_valid", valid)
    return rows.groupBy(*request).agg(
        F.count(F.lit(1)).alias("attempts"),
        F.bool_or("_valid").alias("valid"),
        F.coalesce(
            F.min_by(F.col(text), F.when(F.col("_valid"), F.col(attempt))), F.max_by(F.col(text), F.col(attempt))
        ).alias("response"),
    )
