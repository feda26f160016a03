"""Price files: one CSV per pair, named after it."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: columns of a price bar, and spellings that mean the day
BAR_COLUMNS = ("date", "open", "high", "low", "close", "adj_close", "volume")
DAY_NAMES = ("date", "datetime")

BAR_SCHEMA = T.StructType(
    [T.StructField("date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "adj_close")]
    + [T.StructField("volume", T.LongType())]
)


def file_key(suffix: str = ".csv") -> Column:
    """Key of a row from its file name, without the suffix."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return F.regexp_replace(name, suffix.replace(".", r"\.") + "$", "")


def normalise_bars(df: DataFrame, keep: Sequence[str] = ("pair",)) -> DataFrame:
    """Lower-case snake names, first level of tuple-like names, day as DATE, known columns only.

    Rows without a readable day are dropped.  If no column is called date or datetime
    the first one is taken.
    """
    names = {}
    for c in df.columns:
        first = c.strip("()").split(",")[0].strip("'\" ") if c.startswith("(") else c
        names[c] = first.strip().lower().replace(" ", "_")
    if "date" not in names.values():
        source = next((c for c in df.columns if names[c] in DAY_NAMES), None)
        source = source or next(c for c in df.columns if names[c] not in keep)
        names[source] = "date"
    renamed = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = [c for c in (*keep, *BAR_COLUMNS) if c in renamed.columns]
    day = F.coalesce(F.try_to_date(F.col("date").cast("string")), F.try_to_timestamp(F.col("date").cast("string")).cast("date"))
    return renamed.select(*kept).withColumn("date", day).filter(F.col("date").isNotNull())


def read_prices(spark: SparkSession, path: str, pair: str | None = None) -> DataFrame:
    """All price files of a folder (or one pair) as bars with ``pair``; files are read in parallel.

    Numbers that do not parse become null.
    """
    glob = f"{path}/{pair.upper() if pair else '*'}.csv"
    rows = spark.read.option("header", True).option("enforceSchema", False).schema(BAR_SCHEMA).csv(glob)
    return normalise_bars(rows.withColumn("pair", file_key()))


def read_prices_checked(spark: SparkSession, path: str, broken: bool = False) -> tuple[DataFrame, ...]:
    """Bars of files in any column order, and a quarantine table (pair, reason).

    A line with one of the bar names as a field and no field that begins like a number is the header of its file; every other line is read by the CSV
    parser under that header, so quoted fields, commas inside them and further columns land
    right. Files are read by header shape, one reading per shape: shapes are counted first, and there are as
    many as ways of writing a header, not as files. A day or a number that does not parse is dropped or null.
    Lines the parser cannot match to the header (a quote left open, too few or too many fields) are
    broken; with ``broken`` a third table (pair, line) holds them, in any case they are no bars.
    One unusable file does not stop the others. Spark does not list files of zero bytes.
    """
    lines = spark.read.text(f"{path}/*.csv").select(file_key().alias("pair"), F.trim("value").alias("line"))
    lines = lines.filter(F.col("line") != "")
    names = "|".join((*DAY_NAMES, *(c.replace("_", "[ _]") for c in BAR_COLUMNS[1:])))
    is_header = F.lower("line").rlike(rf"(^|,)\s*\"?({names})\"?\s*(,|$)") & ~F.col("line").rlike(r"(^|,)\s*\"?[-+.0-9]")
    headers = lines.filter(is_header).groupBy("pair").agg(F.min("line").alias("_header"))
    seen = spark.read.format("binaryFile").load(f"{path}/*.csv").select(
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", "").alias("pair"), "length"
    )
    rows = lines.filter(~is_header).join(headers, "pair")
    shapes = sorted(r[0] for r in headers.select("_header").distinct().collect())
    read = [_under_header(rows.filter(F.col("_header") == h), h) for h in shapes]
    empty = spark.createDataFrame([], T.StructType([T.StructField("pair", T.StringType()), T.StructField("line", T.StringType()),
                                                    T.StructField("_broken", T.BooleanType()), T.StructField("_known", T.BooleanType()), *BAR_SCHEMA]))
    parsed = reduce(DataFrame.unionByName, read, empty.withColumn("date", F.col("date").cast("date")).withColumn("volume", F.col("volume").cast("double")))
    bars = parsed.filter(~F.col("_broken") & F.col("date").isNotNull()).select("pair", *BAR_COLUMNS)
    counts = parsed.groupBy("pair").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("_known").alias("known"), F.bool_and("_broken").alias("all_broken"))
    reason = (
        F.when(F.coalesce("rows", F.lit(0)) == 0, F.lit("empty")).when(~F.col("known"), F.lit("no date column"))
        .when(F.col("all_broken"), F.lit("no readable line"))
    )
    bad = seen.join(counts, "pair", "left").select("pair", reason.alias("reason")).filter(F.col("reason").isNotNull())
    if not broken:
        return bars, bad
    return bars, bad, parsed.filter("_broken").select("pair", "line")


def _under_header(rows: DataFrame, header: str) -> DataFrame:
    """Lines of files with one header as (pair, line, _broken, _known, bar columns)."""
    plain = [x.strip().lower().replace(" ", "_") for x in next(csv.reader([header]))]
    names = ["date" if n == "datetime" and "date" not in plain else n for n in plain]
    # positions as names: a header may repeat one or leave one out
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    read = rows.withColumn("_f", F.from_csv("line", fields.simpleString()[7:-1].replace(":", " "), options))

    def column(name: str) -> Column:
        return F.col(f"_f.c{names.index(name)}") if name in names else F.lit(None).cast("string")

    open_quote = (F.regexp_count("line", F.lit('"')) % 2) == 1
    return read.select(
        "pair", "line", (F.col("_f._corrupt").isNotNull() | open_quote).alias("_broken"), F.lit("date" in names).alias("_known"),
        F.try_to_date(F.substring(F.trim(column("date")), 1, 10)).alias("date"),
        *[column(c).try_cast("double").alias(c) for c in BAR_COLUMNS[1:]],
    )


def write_prices(df: DataFrame, path: str, by: Sequence[str] = ("pair",)) -> None:
    """CSV per pair folder, header, ISO days.  Rows of a pair may span several files."""
    df.write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)
