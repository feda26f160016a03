"""How ordered work is spread over tasks.

A series, a config or a test may hold a large part of all rows, so nothing here
sorts a whole group in one task.  Ordered work is cut into chunks (time buckets,
position ranges or value ranges); what crosses a chunk border is carried by a
small table with one row per chunk, or by a halo of neighbouring rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.session import cut

CHUNK_DAYS = 1024
CHUNK_ROWS = 8192


def day_chunk(day: Column | str, days: int = CHUNK_DAYS) -> Column:
    """Number of the ``days``-long bucket a date falls in."""
    col = F.col(day) if isinstance(day, str) else day
    return F.floor(F.unix_date(col.cast("date")) / F.lit(days))


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    pos: str = "pos",
    total: str = "n",
) -> DataFrame:
    """Number the rows of each group 1..n by ``order`` and add the group size.

    ``chunk`` must not decrease along ``order``.  Rows are counted per chunk with
    map-side aggregation, the counts are summed up over the few chunks of a group,
    and rows are only sorted inside their chunk.
    """
    rows = df.withColumn("_chunk", chunk).filter(F.col("_chunk").isNotNull())
    sizes = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    chunks = Window.partitionBy(*keys)
    before = chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select(
        *keys,
        "_chunk",
        (F.sum("_size").over(before) - F.col("_size")).alias("_offset"),
        F.sum("_size").over(chunks).alias(total),
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        rows.join(offsets.hint("shuffle_hash"), [*keys, "_chunk"])
        .withColumn(pos, F.col("_offset") + F.row_number().over(inside))
        .drop("_chunk", "_offset")
    )


def framed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str = "pos",
    back: int = 0,
    ahead: int = 0,
    chunk_rows: int = CHUNK_ROWS,
) -> tuple[DataFrame, WindowSpec]:
    """Rows in position ranges with a halo, and the window to compute over.

    Each range also receives the ``back`` rows before it and the ``ahead`` rows
    after it, so every frame of that reach is complete inside one partition of
    bounded size.  Follow with :func:`unframed` to drop the halo.
    """
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - 1 - ahead) / chunk_rows))
    last = F.floor((F.col(pos) - 1 + back) / chunk_rows)
    rows = df.withColumn("_range", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return rows, Window.partitionBy(*keys, "_range").orderBy(pos)


def unframed(df: DataFrame, pos: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.filter(F.col("_range") == F.floor((F.col(pos) - 1) / chunk_rows)).drop("_range")


def small_side(side: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """Hint a broadcast for a written table only after measuring that it is small.

    Above either bound it is returned without a hint: the join shuffles and adaptive
    execution splits hot keys.
    """
    rows, size = (
        side.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*")))))
        .first()
    )
    return F.broadcast(side) if rows <= max_rows and (size or 0) <= max_bytes else side


def checked_broadcast(df: DataFrame, max_rows: int = 100_000, max_bytes: int = 64 << 20) -> DataFrame:
    """:func:`small_side` of a computed table, which is written once for it."""
    return small_side(cut(df), max_rows, max_bytes)


# ---- order statistics -------------------------------------------------------------------


DIGIT_BITS = 22


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def order_key(value: Column) -> Column:
    """A whole number that orders as the doubles do: their IEEE bits, negated below zero.

    Both zeros are 0 and NaN is above infinity. Scaling by a power of two is exact, so the 52 bits
    of the fraction come out exactly; a logarithm that is off at a power of two is put right.
    """
    top = 2047 << 52

    def put_right(size: Column, guess: Column) -> Column:
        part = size / F.pow(F.lit(2.0), guess)
        return _once(part, lambda p: F.when((p >= 2) & (guess < 1023), guess + 1).when((p < 1) & (guess > -1022), guess - 1).otherwise(guess))

    def joined(size: Column, exponent: Column) -> Column:
        # below 2^-1022 numbers have no leading one: their part is under 1 and their exponent field 0
        field = (exponent.cast("long") + 1022) * (1 << 52)
        part = size / F.pow(F.lit(2.0), exponent)
        return _once(part, lambda p: F.when(p >= 1, field).otherwise(F.lit(0).cast("long")) + (p * float(1 << 52)).cast("long"))

    def bits(size: Column) -> Column:
        guess = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size))))
        exponent = _once(guess, lambda g: put_right(size, g))
        return F.when(size == float("inf"), F.lit(top)).otherwise(_once(exponent, lambda e: joined(size, e)))

    signed = _once(_once(F.abs(value), bits), lambda b: F.when(value < 0, -b).otherwise(b))
    return (
        F.when(value.isNull(), F.lit(None).cast("long")).when(F.isnan(value), F.lit(top + 1)).when(value == 0, F.lit(0).cast("long"))
        .otherwise(signed)
    )


def _keyed(df: DataFrame, value: Column) -> DataFrame:
    """Rows with a value, and their ``_key``.

    The key cannot be null: a join on its prefixes then asks no row below the counts for its key.
    """
    return df.filter(value.isNotNull()).withColumn("_key", F.coalesce(order_key(value), F.lit(0).cast("long")))


def _levels(bits: int) -> list[int]:
    """Shifts from the last level (whole keys: 0) up to the first one."""
    return list(range(0, 64, bits))


def _matched(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str) -> DataFrame:
    """Inner join on null-safe groups and one prefix; the columns of ``right`` are named apart before."""
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(by)] + [F.col(left_on) == F.col(right_on)]
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in right.columns if c not in by])
    return left.join(named, same).drop(*[f"_k{i}" for i in range(len(by))], right_on)


def _counted(kinds: DataFrame, by: Sequence[str], size: str, bits: int) -> list[DataFrame]:
    """Rows per group and key prefix, from whole keys (level 0) up to the first ``bits`` or fewer."""
    tables = [kinds]
    for shift in _levels(bits)[1:]:
        last = tables[-1].select(*by, F.shiftright("_key", bits).alias("_key"), F.col(size))
        tables.append(last.groupBy(*by, "_key").agg(F.sum(size).alias(size)))
    return tables


def with_rows_below(kinds: DataFrame, by: Sequence[str], value: str, size: str, name: str, bits: int = DIGIT_BITS) -> DataFrame:
    """Add to one row per group and value the number of rows of the group with a smaller value.

    Values are read as 64-bit keys, a digit of ``bits`` bits at a time: rows are counted per prefix, and
    a prefix sum over the digits under one prefix adds to what lies below that prefix. A task orders at
    most 2^bits rows at once, whatever the size of a group; no value looks for its range, and there is
    nothing to sample or to write down.
    """
    keyed = _keyed(kinds, F.col(value).cast("double"))
    tables = _counted(keyed.select(*by, "_key", size), by, size, bits)
    below = None
    for level in range(len(tables) - 1, -1, -1):
        rows = tables[level] if level else keyed
        if below is None:
            digits = Window.partitionBy(*by).orderBy("_key")
            start = F.lit(0).cast("long")
        else:
            rows = _matched(rows.withColumn("_up", F.shiftright("_key", bits)), below, by, "_up", "_at")
            digits = Window.partitionBy(*by, "_up").orderBy("_key")
            start = F.col("_start")
        before = F.coalesce(F.sum(size).over(digits.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = rows.withColumn("_below", start + before)
        below = placed.select(*by, F.col("_key").alias("_at"), F.col("_below").alias("_start"))
    return placed.select(*kinds.columns, F.col("_below").alias(name))


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str, bits: int = DIGIT_BITS) -> DataFrame:
    """Exact median per group (mean of the middle two), for groups of any size."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    return _medians(rows, by, bits).withColumnRenamed("_median", name)


def exact_medians(df: DataFrame, by: Sequence[str], values: Mapping[str, str], bits: int = DIGIT_BITS) -> DataFrame:
    """Exact medians of several columns per group (name -> column), selected together."""
    long = F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(c).cast("double").alias("_v")) for n, c in values.items()]))
    rows = df.select(*by, long).filter(F.col("_v").isNotNull())
    found = _medians(rows, [*by, "_name"], bits)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == n, F.col("_median"))).alias(n) for n in values])


def _medians(rows: DataFrame, by: Sequence[str], bits: int) -> DataFrame:
    """Selection by counted histograms: a digit at a time, only the prefixes that hold a middle row stay.

    The rows are counted per value once, with map-side sums; every level sums the one below it. A task
    orders at most 2^bits counts of one group.
    """
    kinds = _keyed(rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), F.col("_v"))
    tables = _counted(kinds.select(*by, "_key", "_n"), by, "_n", bits)
    chosen = None
    for level in range(len(tables) - 1, -1, -1):
        counts = tables[level] if level else kinds
        if chosen is None:
            group = Window.partitionBy(*by)
            counts = counts.withColumns({"_total": F.sum("_n").over(group), "_start": F.lit(0).cast("long")})
        else:
            counts = _matched(counts.withColumn("_up", F.shiftright("_key", bits)), chosen, by, "_up", "_at")
            group = Window.partitionBy(*by, "_up")
        last = F.sum("_n").over(group.orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("_last", F.col("_start") + last).withColumn("_first", F.col("_last") - F.col("_n"))
        # the middle rows, counted from 0, are (total - 1) / 2 and total / 2, rounded down
        low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
        has_low, has_high = ((F.col("_first") <= r) & (r < F.col("_last")) for r in (low, high))
        held = counts.filter(has_low | has_high)
        chosen = held.select(*by, F.col("_key").alias("_at"), "_total", F.col("_first").alias("_start"))
    ends = held.withColumns({"_low": F.when(has_low, F.col("_v")), "_high": F.when(has_high, F.col("_v"))})
    return ends.groupBy(*by).agg(((F.max("_low") + F.max("_high")) / 2).alias("_median"))


def as_number(df: DataFrame, name: str) -> Column:
    """A number that does not decrease where the column grows; null for columns that are no number, date or time."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, (T.NumericType, T.TimestampType)):
        return F.col(name).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def with_range(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str, rows: int = CHUNK_ROWS, bits: int = DIGIT_BITS) -> DataFrame:
    """Add ``_day`` and ``name``: ranges of about ``rows`` rows per group along a day and a second column.

    A range is a part of one day. Rows of equal order share one; nulls come first. A second
    column that is no number or time leaves days whole.
    """
    day, second = order
    placed = df.withColumns({"_day": F.unix_date(F.col(day).cast("date")), "_along": F.coalesce(as_number(df, second), F.lit(float("-inf")))})
    kinds = placed.groupBy(*by, "_day", "_along").agg(F.count(F.lit(1)).alias("_size"))
    ranked = with_rows_below(kinds, [*by, "_day"], "_along", "_size", "_before", bits)
    parts = ranked.select(*by, "_day", "_along", F.floor(F.col("_before") / rows).cast("int").alias(name))
    return placed.join(parts, [*by, "_day", "_along"]).drop("_along")
