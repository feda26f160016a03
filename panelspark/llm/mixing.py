"""Operator 6: mix sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its share of all words, at most ``MOST`` times what it has. Every document of
a source expects ``target / source_size`` copies. Documents lie in one order per source, their
expected copies are summed up along it, one random offset per source is added, and a document is
emitted once for each integer that its stretch crosses. The order is by size, so that the words
taken miss the target by no more than about one large document.

Positions come from counts: (source, size, bucket) is counted first, buckets split a size that a
hot group of copies fills, and only rows of one such bucket are ranked together.

Null and empty texts have size 0; they get copies like others and take no words. A null source is
one source, last in order. Repeated rows are documents of their own; a null id is an id. A source
without words has target 0 and takes nothing. Equal hashes are ordered by id, then arbitrarily
among identical rows, which does not change the result's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import n_words

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
ROWS_PER_BUCKET = 50_000


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets for (source, source_size) rows: one row per source, so one window over them all.

    Capped sources are those with the smallest ``most * size / weight``. With the first k of them
    capped, the rest share what is left by weight, at a level of words per weight. The level grows
    with k as long as the next source is above its cap and never after that: its maximum is right.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight)
    everything = Window.partitionBy()
    by_cap = Window.orderBy(F.col("source_size") * most / F.col("w"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "all_words": F.sum("source_size").over(everything),
        "cap": F.col("source_size") * F.lit(most),
        "left_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        "spent": F.coalesce(F.sum(F.col("source_size") * F.lit(most)).over(before), F.lit(0.0)),
    })
    rows = rows.withColumn("level", (F.col("all_words") - F.col("spent")) / F.col("left_w"))
    level = F.max("level").over(everything)
    return rows.withColumn("target", F.least(F.col("cap"), level * F.col("w"))).select(
        "source", "source_size", "target"
    )


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 7,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    return _drawn(rows, weights, most, seed)


def _drawn(rows: DataFrame, weights: tuple[float, ...], most: float, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """What ``mix_sources`` returns, for (doc_id, source, size) and further columns, which stay; equal ids are ordered by ``ties``."""
    own = [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    ident = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumns({"src": name, "h": _hex(ident, 8)}).withColumn("h", F.coalesce("h", F.lit(0)))
    # a bucket is a range of the hash; their number follows the rows of the (source, size)
    fine = 1 << 12
    counts = rows.groupBy("src", "size", (F.col("h") * fine / 2**32).cast("int").alias("slot")).agg(F.count("*").alias("n"))
    by_slot = Window.partitionBy("src", "size").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy("src", "size").agg(F.sum("n").alias("n"))
    by_size = Window.partitionBy("src").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("size_start", F.coalesce(F.sum("n").over(by_size), F.lit(0))).drop("n")
    slots = counts.withColumn("slot_start", F.coalesce(F.sum("n").over(by_slot), F.lit(0))).drop("n")
    places = slots.join(starts, ["src", "size"])
    totals = sizes.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    totals = totals.withColumn("source", F.when(F.col("src") != "null", F.substring("src", 2, 2**31 - 1)))
    targets = source_targets(totals.select("source", "source_size"), weights, most)
    targets = targets.withColumns({
        "src": name,
        "rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
        "offset": _hex(F.concat_ws("|", F.lit(str(seed)), F.lit("offset"), name), 8) / 2**32,
    }).drop("source")
    ranked = rows.withColumn("slot", (F.col("h") * fine / 2**32).cast("int")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("src", "size", "slot").orderBy("h", F.col("doc_id").asc_nulls_first(), *ties))
    )
    placed = ranked.join(places, ["src", "size", "slot"]).join(targets, "src")
    place = F.col("size_start") + F.col("slot_start") + F.col("rank")
    crossed = F.floor(place * F.col("rate") + F.col("offset")) - F.floor((place - 1) * F.col("rate") + F.col("offset"))
    copies = F.least(crossed, F.lit(int(math.floor(most)))).cast("long")
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *own
    )


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mixed rows of ``docs``: each row as often as it was drawn itself, with its own columns."""
    row = F.struct(*[docs[c] for c in docs.columns])
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row.alias("_row"), F.xxhash64("text").alias("_twin"))
    drawn = _drawn(rows, WEIGHTS, MOST, 7, ("_twin",)).filter("copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
