"""Completeness checks and gap filling of daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.layout import CHUNK_DAYS, CHUNK_ROWS, day_chunk, with_range


def weekdays_through(day: Column) -> Column:
    """Mon-Fri days from Monday 1970-01-05 up to ``day`` (closed form, no calendar table)."""
    passed = F.datediff(day, F.lit("1970-01-05").cast("date"))
    weeks = F.floor(passed / F.lit(7))
    return weeks * 5 + F.least(passed - weeks * 7 + 1, F.lit(5))


def weekdays_between(first: Column, last: Column) -> Column:
    """Mon-Fri days in the closed interval."""
    return weekdays_through(last) - weekdays_through(F.date_sub(first, 1))


def quality_report(df: DataFrame, series: str = "series", day: str = "day") -> DataFrame:
    """Range, rows and completeness per series.

    ``actual_rows`` counts every row, weekend and repeated days too, so
    ``missing_trading_days`` can be negative.  One pass with map-side aggregation.
    """
    stats = df.filter(F.col(day).isNotNull()).groupBy(series).agg(
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        F.count(F.lit(1)).alias("actual_rows"),
    )
    expected = weekdays_between(F.col("start_date"), F.col("end_date")).cast("bigint")
    share = F.col("actual_rows") / F.nullif(F.col("expected_trading_days"), F.lit(0)) * 100
    return (
        stats.withColumn("expected_trading_days", expected)
        .withColumn("missing_trading_days", F.col("expected_trading_days") - F.col("actual_rows"))
        .withColumn("completeness_pct", F.round(share, 2))
    )


def missing_days(df: DataFrame, series: str = "series", day: str = "day", first: int | None = None) -> DataFrame:
    """Trading days without a row, numbered per series; all of them when ``first`` is None.

    After the distinct a series has at most one row per calendar day, which bounds
    the window.  Only the gaps are expanded, never the whole calendar.
    """
    seen = df.filter(F.col(day).isNotNull()).select(series, F.col(day).alias("_d")).distinct()
    after = F.lead("_d").over(Window.partitionBy(series).orderBy("_d"))
    gaps = seen.withColumn("_next", after).filter(F.datediff("_next", "_d") > 1)
    days = F.sequence(F.date_add("_d", 1), F.date_sub("_next", 1))
    missing = gaps.select(series, F.explode(days).alias("missing_day")).filter(F.weekday("missing_day") < 5)
    rank = F.row_number().over(Window.partitionBy(series).orderBy("missing_day"))
    ranked = missing.withColumn("rank", rank)
    return ranked if first is None else ranked.filter(F.col("rank") <= first)


def fill_days(
    df: DataFrame,
    values: Sequence[str],
    series: Sequence[str] = ("series",),
    day: str = "day",
    order: Sequence[str] = (),
    weekdays_only: bool = False,
    dense: bool = False,
    chunk_days: int = CHUNK_DAYS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per day (or weekday) between first and last day, last values carried forward.

    * each column is carried on its own; nulls before its first value stay
    * several rows on one day are all kept (give ``order`` to fix their sequence)
    * ``weekdays_only``: values of weekend rows are not used
    * ``dense``: input has one row per series and day; adds ``pos`` (1..n) and ``n``

    Every row covers the days up to the next row, so the calendar is never joined.
    Rows are ordered inside (series, time bucket); the next day and the last known
    values cross bucket borders through a table with one row per bucket. With ``order``
    a bucket is cut again into ranges of about ``chunk_rows`` rows by day and first order column (a
    number or a time), so a single day may hold most rows; values cross ranges inside
    a bucket first and buckets after that.
    """
    keys = list(series)
    weekday = F.weekday(F.col(day)) < 5
    rows = df.filter(F.col(day).isNotNull()).select(
        *keys,
        F.col(day).cast("date").alias(day),
        *[c for c in order],
        *[F.when(weekday, F.col(v)).alias(v) if weekdays_only else F.col(v) for v in values],
    ).withColumn("_chunk", day_chunk(day, chunk_days)).filter(F.col("_chunk").isNotNull())
    cells = ["_chunk"]
    if order:
        rows = with_range(rows, [*keys, "_chunk"], [day, order[0]], "_part", chunk_rows)
        cells += ["_day", "_part"]

    stamp = F.struct(day, *order) if order else F.col(day)
    summary = rows.groupBy(*keys, *cells).agg(
        F.min(day).alias("_from"),
        F.max(day).alias("_to"),
        *[F.max_by(F.col(v), F.when(F.col(v).isNotNull(), stamp)).alias(f"_last_{v}") for v in values],
    )
    whole = Window.partitionBy(*keys)

    def crossed(table: DataFrame, within: list[str], by: list[str]) -> DataFrame:
        """What crosses into each row of ``table`` from the rows before and after it, ordered by ``by``."""
        line = Window.partitionBy(*within).orderBy(*by)
        earlier = line.rowsBetween(Window.unboundedPreceding, -1)
        return table.select(
            *table.columns,
            F.lead("_from").over(line).alias("_next_from"),
            *[F.last(f"_last_{v}", ignorenulls=True).over(earlier).alias(f"_carry_{v}") for v in values],
        )

    lasts = [f"_last_{v}" for v in values]
    if order:
        # ranges inside their bucket, then buckets: no task orders all ranges of a series
        ranges = crossed(summary, [*keys, "_chunk"], ["_day", "_part"])
        at = F.struct("_day", "_part")
        summary = summary.groupBy(*keys, "_chunk").agg(
            F.min("_from").alias("_from"), F.max("_to").alias("_to"),
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in lasts],
        )
    borders = crossed(summary, keys, ["_chunk"]).withColumns({"_start": F.min("_from").over(whole), "_end": F.max("_to").over(whole)}).drop("_from", "_to", *lasts)
    if order:
        outer = {"_next_from": "_next_bucket", **{f"_carry_{v}": f"_before_{v}" for v in values}}
        borders = ranges.drop("_from", "_to", *lasts).join(borders.withColumnsRenamed(outer), [*keys, "_chunk"])
        borders = borders.withColumns({c: F.coalesce(c, o) for c, o in outer.items()}).drop(*outer.values())

    inside = Window.partitionBy(*keys, *cells).orderBy(day, *order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows are shuffled by (series, bucket) for the window anyway; the small side is hashed per partition
    carried = rows.join(borders.hint("shuffle_hash"), [*keys, *cells]).select(
        *keys,
        day,
        "_start",
        "_end",
        F.coalesce(F.lead(day).over(inside), F.col("_next_from")).alias("_next"),
        *[F.coalesce(F.last(v, ignorenulls=True).over(upto), F.col(f"_carry_{v}")).alias(v) for v in values],
    )
    until = F.greatest(F.col(day), F.coalesce(F.date_sub("_next", 1), F.col(day)))
    out = carried.withColumn("_own", F.col(day)).withColumn(day, F.explode(F.sequence(F.col(day), until)))
    if weekdays_only:
        out = out.filter(F.weekday(day) < 5)

    columns = [*keys, day, *values, (F.col(day) != F.col("_own")).alias("is_filled")]
    if dense:
        if weekdays_only:
            pos, n = weekdays_between(F.col("_start"), F.col(day)), weekdays_between(F.col("_start"), F.col("_end"))
        else:
            pos, n = F.datediff(day, "_start") + 1, F.datediff("_end", "_start") + 1
        columns += [pos.cast("int").alias("pos"), n.cast("int").alias("n")]
    return out.select(*columns)
