"""Numbers and explanation fields out of free response text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.functions.text import stripped

# fixed values: what counts as a number list in a response
LEADING_RUN = r"^[\d\s.,]+"
NUMBER = r"(\d+\.?\d*)"
OBJECT_WITH_PREDICTIONS = r"(?s)(\{[^{}]*predictions[^{}]*\})"
NUMERIC_LIST = r"\[([\d.,\s]+)\]"
DECIMAL = r"\b(\d+\.\d+)\b"
FIRST_OBJECT = r"(?s)(\{.*\})"
MAX_DECIMALS = 20


def _numbers(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.trim(x).try_cast("double"))


def number_list(text: Column) -> Column:
    """Numbers of the first ``[...]`` made of digits only; null if one does not parse."""
    body = F.regexp_extract(text, NUMERIC_LIST, 1)
    parts = F.filter(F.split(F.regexp_replace(body, r"[\r\n\t]", " "), ","), lambda x: F.trim(x) != "")
    values = _numbers(parts)
    return F.when((F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull()), values)


def with_numbers(df: DataFrame, text: str = "response", max_decimals: int | None = MAX_DECIMALS) -> DataFrame:
    """Add ``numbers`` and ``parse_case`` (1-4; null when nothing was found).

    1 text starts with numbers, 2 object with ``predictions``, 3 first numeric list,
    4 decimals anywhere. ``max_decimals`` keeps the first of them (20 as the study does; None: all).
    White space around the text does not count.  A list with an element that is no number is no list.
    """
    t = F.col("_t")
    lead = _numbers(F.regexp_extract_all(F.regexp_extract(t, LEADING_RUN, 0), F.lit(NUMBER), F.lit(1)))
    obj = F.from_json(F.regexp_extract(t, OBJECT_WITH_PREDICTIONS, 1), "predictions array<double>")["predictions"]
    found = F.regexp_extract_all(t, F.lit(DECIMAL), F.lit(1))
    anywhere = _numbers(found if max_decimals is None else F.slice(found, 1, max_decimals))
    tries = [
        (lead, lambda v: F.size(v) > 0), (obj, lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull())),
        (number_list(t), lambda v: v.isNotNull()), (anywhere, lambda v: F.size(v) > 0),
    ]
    # one after another: a reading is made once, and only where those before it found nothing
    best = F.lit(None).cast("struct<case:int,numbers:array<double>>")
    for case, (reading, holds) in reversed(list(enumerate(tries, 1))):
        best = _tried(reading, holds, case, best)
    read = df.withColumn("_t", stripped(F.col(text))).withColumn("_best", best)
    return read.withColumns({"parse_case": F.col("_best.case"), "numbers": F.col("_best.numbers")}).drop("_t", "_best")


def _tried(reading: Column, holds: Callable[[Column], Column], case: int, otherwise: Column) -> Column:
    """(case, numbers) if a reading holds, else what comes after; the reading is evaluated once."""

    def choose(v: Column) -> Column:
        return F.when(holds(v), F.struct(F.lit(case).alias("case"), v.alias("numbers"))).otherwise(otherwise)

    return F.element_at(F.transform(F.array(reading), choose), 1)


def split_parsed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with numbers, and rows for quarantine."""
    return df.filter(F.col("parse_case").isNotNull()), df.filter(F.col("parse_case").isNull())


def in_scale(numbers: Column, scale: Column) -> Column:
    """Drop values outside [scale/2, 2*scale] if at least half of them (and one) remain."""
    kept = F.filter(numbers, lambda v: (v >= scale * 0.5) & (v <= scale * 2.0))
    enough = F.size(kept) >= F.greatest(F.lit(1), F.floor(F.size(numbers) / 2))
    return F.when((scale > 0) & enough, kept).otherwise(numbers)


def with_explanation(df: DataFrame, text: str = "response") -> DataFrame:
    """Add predictions, bad_predictions, explanation_text, news_refs and confidence_score.

    Fields come from the widest ``{...}`` of the text without white space around it; a text
    without braces has none. Missing fields have defaults. Nothing is lost to a field of the
    wrong kind: if the object is no valid JSON, the explanation is no object, a text or an
    element of a list is no string, a list no list, or the confidence no number (a string
    that reads as one is), then the whole text is the explanation, without references and
    with confidence 0.5, and its first numeric list gives the predictions. A prediction that
    is no number makes ``bad_predictions`` true and the list empty: such rows are for quarantine.
    """
    read = df.withColumn("_text", stripped(F.col(text))).withColumn("_body", F.regexp_extract("_text", FIRST_OBJECT, 1))
    read = read.withColumn("_json", F.try_parse_json("_body"))

    def field(path: str, kind: str) -> Column:
        return F.try_variant_get("_json", path, kind)

    def kind_of(path: str) -> Column:
        """Type of a field as a text; null when it is missing."""
        return F.schema_of_variant(field(path, "variant"))

    def is_text(path: str) -> Column:
        return F.coalesce(kind_of(path) == "STRING", F.lit(True))

    def is_texts(path: str) -> Column:
        given = field(path, "array<variant>")
        strings = F.coalesce(~F.exists(given, lambda v: F.schema_of_variant(v) != "STRING"), F.lit(False))
        return kind_of(path).isNull() | strings

    def strings(path: str) -> Column:
        return F.coalesce(field(path, "array<string>"), F.array().cast("array<string>"))

    at = "$.explanation"
    confidence = F.coalesce(
        field(f"{at}.confidence", "double"), F.trim(field(f"{at}.confidence", "string")).try_cast("double"),
        field(f"{at}.confidence", "boolean").cast("double"),
    )
    fine = (
        F.col("_json").isNotNull()
        & F.coalesce(kind_of(at).startswith("OBJECT"), F.lit(True))
        & is_text(f"{at}.summary") & is_texts(f"{at}.key_factors") & is_texts(f"{at}.risk_factors")
        & (kind_of(f"{at}.confidence").isNull() | confidence.isNotNull())
    )
    read = read.withColumn("_fine", F.coalesce(fine, F.lit(False)))
    has_body, ok = F.col("_body") != "", F.col("_fine")
    parts = F.concat(
        F.array(F.coalesce(field(f"{at}.summary", "string"), F.lit(""))),
        strings(f"{at}.key_factors"), strings(f"{at}.risk_factors"),
    )
    none = F.array().cast("array<double>")
    given = field("$.predictions", "array<double>")
    bad = (kind_of("$.predictions").isNotNull() & given.isNull()) | F.coalesce(F.exists(given, lambda v: v.isNull()), F.lit(False))
    listed = F.coalesce(number_list(F.col("_text")), F.when(bad, none), given, none)
    refs = F.filter(F.coalesce(field(f"{at}.news_references", "array<int>"), F.array().cast("array<int>")), lambda r: r.isNotNull())
    return read.select(
        *df.columns,
        F.when(~has_body, none).when(ok & bad, none).when(ok, F.coalesce(given, none)).otherwise(listed).alias("predictions"),
        (has_body & F.coalesce(bad, F.lit(False)) & (ok | number_list(F.col("_text")).isNull())).alias("bad_predictions"),
        F.when(~has_body, F.lit("")).when(ok, F.array_join(parts, " ")).otherwise(F.col("_text")).alias("explanation_text"),
        F.when(has_body & ok, refs).otherwise(F.array().cast("array<int>")).alias("news_refs"),
        F.when(has_body & ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.5))))).otherwise(F.lit(0.5)).alias("confidence_score"),
    )
