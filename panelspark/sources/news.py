"""News files: one JSON array of articles per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.prices import file_key

ARTICLE_SCHEMA = (
    "title string, publisher string, link string, published_at string, type string, "
    "thumbnail string, related_tickers array<string>, summary string"
)
ARTICLE_FIELDS = (
    "title", "publisher", "link", "published_at", "type", "thumbnail", "related_tickers", "summary",
)


def read_news(spark: SparkSession, path: str, pairs: DataFrame | None = None) -> DataFrame:
    """Articles with ``pair`` from the file name; ``pairs`` without a file stay as one null row."""
    rows = (
        spark.read.schema(ARTICLE_SCHEMA).option("multiLine", True).json(f"{path}/*_news.json")
        .withColumn("pair", file_key("_news.json"))
        .withColumn("published_ts", F.try_to_timestamp("published_at").cast("timestamp_ntz"))
        .withColumn("article_id", F.xxhash64("pair", "published_at", "title", "link"))
    )
    return rows if pairs is None else pairs.join(rows, "pair", "left")


def _text(raw: Column, path: str) -> Column:
    return F.try_variant_get(raw, path, "string")


def flatten_articles(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Articles in the fixed columns from raw JSON text, keeping the other columns.

    Fields are taken from ``content``, or from the top level when that is missing or
    empty.  Providers and thumbnails may be objects or plain text; ISO times lose their
    offset and other time texts stay as they are.
    """
    doc = df.withColumn("_raw", F.try_parse_json(raw))
    inner = F.try_variant_get("_raw", "$.content", "map<string,variant>")
    nested = F.coalesce(F.size(inner) > 0, F.lit(False))
    doc = doc.withColumn(
        "_c", F.when(nested, F.try_variant_get("_raw", "$.content", "variant")).otherwise(F.col("_raw"))
    )
    c = F.col("_c")

    def pick(path: str) -> Column:
        return F.coalesce(_text(c, path), F.lit(""))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(c, path, "variant")), F.lit(""))

    def is_object(path: str) -> Column:
        return kind(path).startswith("OBJECT")

    provider = F.when(is_object("$.provider"), pick("$.provider.displayName")).otherwise(pick("$.provider"))
    link = F.when(is_object("$.clickThroughUrl"), pick("$.clickThroughUrl.url")).otherwise(pick("$.url"))
    stamp = pick("$.pubDate")
    parsed = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(stamp, r"(Z|[+-]\d\d:?\d\d)$", ""), "T", " "))
    thumb = F.when(is_object("$.thumbnail"), pick("$.thumbnail.resolutions[0].url")).otherwise(pick("$.thumbnail"))
    tickers = F.coalesce(
        F.try_variant_get(c, "$.finance.stockTickers", "array<string>"), F.array().cast("array<string>")
    )
    return doc.select(
        *[x for x in df.columns if x != raw],
        pick("$.title").alias("title"),
        provider.alias("publisher"),
        link.alias("link"),
        F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm:ss"), stamp).alias("published_at"),
        pick("$.contentType").alias("type"),
        thumb.alias("thumbnail"),
        tickers.alias("related_tickers"),
        pick("$.summary").alias("summary"),
    )


def nested_to_text(df: DataFrame) -> DataFrame:
    """List, object and map columns as JSON text, so the table fits into CSV."""
    nested = ("array", "struct", "map")
    return df.select(
        *[F.to_json(c).alias(c) if t.startswith(nested) else F.col(c) for c, t in df.dtypes]
    )


def write_news_csv(df: DataFrame, path: str) -> None:
    nested_to_text(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_news_json(df: DataFrame, path: str, by: str = "pair") -> None:
    """Articles as JSON lines in one folder per pair; a pair is never gathered into one task."""
    df.write.mode("overwrite").partitionBy(by).json(path)
