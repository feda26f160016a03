"""Operator 10: line dedup by overlapping three-line windows, in DataFrame operations.

A text is split at line feeds. Every run of three consecutive lines is a window, hashed to 128
bits. A window that occurs more than once in all documents keeps its first occurrence, by id and
then by position; every later occurrence is covered, and a document loses the lines that at least
one covered window holds. Lines that only occur in shorter repeats stay.

Null and empty texts have no window; a text of fewer than three lines neither. Windows of nothing
but white space are not counted. Windows of one text repeat as well. Rows that share an id are told
apart by their text's hash; identical rows are one occurrence at the same place, the later ones
are not removed. A null id comes first. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = 3


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _windows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, place, key) per window; `place` is the index of its first line."""
    rows = docs.withColumn("lines", _lines()).filter(F.size("lines") >= k)
    window = F.transform(
        F.sequence(F.lit(0), F.size("lines") - k),
        lambda i: F.array_join(F.slice(F.col("lines"), i + 1, k), "\n"),
    )
    places = rows.select("doc_id", "twin", F.posexplode(window).alias("place", "w")).filter(F.trim(F.translate("w", "\n\r\t", "   ")) != "")
    return places.select("doc_id", "twin", "place", F.xxhash64("w").alias("k1"), F.xxhash64(F.lit("second"), "w").alias("k2"))


def covered_lines(docs: DataFrame, k: int = LINES) -> DataFrame:
    """(doc_id, twin, covered): for every document that loses lines, their indexes."""
    spots = _windows(docs, k)
    first = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "twin", "place")).alias("first")
    repeated = spots.groupBy("k1", "k2").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    later = spots.join(repeated, ["k1", "k2"]).filter(
        ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("twin") == F.col("first.twin")) & (F.col("place") == F.col("first.place")))
    )
    starts = later.groupBy("doc_id", "twin").agg(F.collect_set("place").alias("starts"))
    merged = F.array_distinct(F.flatten(F.transform("starts", lambda p: F.sequence(p, p + k - 1))))
    return starts.select("doc_id", "twin", merged.alias("covered"))


def dedup_lines(docs: DataFrame, k: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) for every row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("twin", F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = covered_lines(rows, k).withColumnsRenamed({"doc_id": "_id", "twin": "_twin"})
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("twin") == F.col("_twin")), "left")
    lines = joined.withColumn("lines", _lines())
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    kept = F.when(F.col("covered").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at("lines", i + 1)), "\n")
    )
    return lines.select(
        "doc_id",
        F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("covered").isNull(), 0).otherwise(F.size("covered")).cast("long").alias("n_removed"),
        kept.alias("kept_text"),
    )
