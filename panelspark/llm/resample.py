"""Operator 12: importance resampling towards a target, on hashed word features.

The tokenizers library cuts A-Z-lowered texts with an untrained ``Split`` pre-tokenizer into words
and their offsets. Every run of up to ``max_run`` consecutive offset pairs is a feature: its words
joined by single spaces, counted in the bucket its CRC-32 falls in. Texts are cut once: each
document leaves its counts per bucket, as two short arrays, in the shared folder. Histograms of all
documents and of all target texts come from these (``BUCKETS`` numbers each, whatever the input);
a bucket's gain says how much more frequent it is in the target, and a document's weight is the
floored mean of the gains of its features. A draw without replacement takes the highest
weights with a Gumbel number added, which hangs on the document's id and the seed alone.

Ranks come without a global sort: scores are whole numbers in a range that gains and noise bound
(under 100,000 different ones), so their histogram gives the lowest score drawn and the place of
every score's first document; only drawn documents are shuffled, by score. The noise spreads them:
one score holds less than 1/2,700 of different ids. Rows equal in every column are counted before
that and expanded after it.

Null and empty texts have no features, weight 0 and a score like others, but are not drawn (fewer
than ``least`` words). A null id is written "null" in the hash and comes after all others in ties.
Repeated rows are documents of their own with ranks of their own. Extra columns are ignored. Without
target texts all gains follow from T = 0; an empty table gives an empty one. Texts are cut in
sections of ``SECTION`` characters that end between words, and runs reach across sections, so memory
grows with the number of words of one text only by its words.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.shared import lower_ascii, saved

BUCKETS = 10_000
SECTION = 1 << 16
# fixed value: words of the contract, in texts whose A-Z are lowered
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CACHED = 1 << 20


def splitter():
    """The pre-tokenizer: matches of ``WORD`` and their offsets, nothing else."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def _inside(char: str) -> bool:
    return char >= "\x80" or "a" <= char <= "z" or "0" <= char <= "9"


def sections(text: str) -> Iterator[tuple[int, str]]:
    """(start, part): a text in parts of about ``SECTION`` characters that never cut a word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SECTION)
        while end < len(text) and _inside(text[end - 1]) and _inside(text[end]):
            end += 1
        yield at, text[at:end]
        at = end


def offsets(text: str, split=None) -> list[tuple[int, int]]:
    """Start and end of every word of a lowered text."""
    cut = (split or splitter()).pre_tokenize_str
    return [(at + a, at + b) for at, part in sections(text) for _, (a, b) in cut(part)]


def feature_counts(text: str, split, max_run: int = 1) -> tuple[Counter, int]:
    """How often each feature occurs, and the number of words.

    A single word is what the split returns for its offsets; longer runs are windows over the offset pairs.
    """
    found: Counter = Counter()
    if max_run == 1:
        for _, part in sections(text):
            found.update([word for word, _ in split.pre_tokenize_str(part)])
        return found, found.total()
    pairs = offsets(text, split)
    for n in range(1, max_run + 1):
        found.update(" ".join([text[a:b] for a, b in pairs[i : i + n]]) for i in range(len(pairs) - n + 1))
    return found, len(pairs)


def bucket_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, bucket list, times list) per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, known = splitter(), {}
        for batch in batches:
            rows = []
            for value in batch["_text"]:
                found, n_words = feature_counts(value, split, max_run)
                held: dict[int, int] = {}
                for feature, times in found.items():
                    bucket = known.get(feature)
                    if bucket is None:
                        if len(known) >= CACHED:
                            known.clear()
                        bucket = known[feature] = crc32(feature.encode("utf-8", "surrogatepass")) % buckets
                    held[bucket] = held.get(bucket, 0) + times
                which = sorted(held)
                rows.append((n_words, sum(held.values()), which, [held[b] for b in which]))
            out = pd.DataFrame(rows, columns=["n_words", "n_features", "bucket", "times"])
            out.insert(0, "_key", batch["_key"].to_numpy())
            yield out

    lowered = lower_ascii(F.coalesce(docs[text], F.lit("")))
    rows = docs.select(docs[key].cast("string").alias("_key"), lowered.alias("_text"))
    made = rows.mapInPandas(run, "_key string, n_words long, n_features long, bucket array<int>, times array<int>")
    return made.select(F.col("_key").cast(docs.schema[key].dataType).alias("key"), "n_words", "n_features", "bucket", "times")


def histogram(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; ``buckets`` numbers reach the driver."""
    pairs = counts.select(F.explode(F.arrays_zip("bucket", "times")).alias("x")).select("x.bucket", "x.times")
    out = np.zeros(buckets, np.int64)
    for row in pairs.groupBy("bucket").agg(F.sum("times").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln) of how much more of the target falls into each bucket, both smoothed by one."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return [
        math.floor(1000 * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k))))
        for s, t in zip(source.tolist(), target.tolist())
    ]


def noise(key: str, seed: int) -> int:
    """A whole Gumbel number, in thousandths, that follows from the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(counts: DataFrame, gain: list[int], seed: int) -> DataFrame:
    """(key, n_words, n_features, weight, score) per row."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weight = [int((table[b] * t).sum()) // int(n) if n else 0 for b, t, n in zip(batch["bucket"], batch["times"], batch["n_features"])]
            score = [w + noise("null" if k is None else k, seed) for w, k in zip(weight, batch["_key"])]
            yield pd.DataFrame({"_key": batch["_key"], "n_words": batch["n_words"], "n_features": batch["n_features"], "weight": weight, "score": score})

    rows = counts.select(F.col("key").cast("string").alias("_key"), "n_words", "n_features", "bucket", "times")
    made = rows.mapInPandas(run, "_key string, n_words long, n_features long, weight long, score long")
    return made.withColumn("_key", F.col("_key").cast(counts.schema["key"].dataType)).withColumnRenamed("_key", "key")


def drawn(rows: DataFrame, percent: int, least: int) -> DataFrame:
    """Add ``rank`` to (key, n_words, n_features, weight, score): 1, 2, ... for those drawn, else null."""
    spark = rows.sparkSession
    eligible = F.col("n_words") >= least
    per_score = sorted(((r.score, r.n) for r in rows.filter(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, before, firsts = percent * sum(n for _, n in per_score) // 100, 0, []
    for score, n in per_score:
        if before >= wanted:
            break
        firsts.append((score, before))
        before += n
    if not firsts:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    lowest = firsts[-1][0]
    chance = eligible & (F.col("score") >= lowest)
    # equal rows are one row with a count until they have their places
    kinds = rows.filter(chance).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("same"))
    starts = F.broadcast(spark.createDataFrame(firsts, "score long, before long"))
    within = Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), *[c for c in rows.columns if c not in ("key", "score")])
    last = F.sum("same").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = kinds.join(starts, "score").withColumn("last", F.col("before") + last)
    ranks = F.explode(F.sequence(F.col("last") - F.col("same") + 1, F.col("last")))
    top = placed.select(*rows.columns, ranks.alias("rank"))
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return top.unionByName(rows.filter(~F.coalesce(chance, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least: int = 20, seed: int = 2024, max_run: int = 1,
    key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS,
) -> DataFrame:
    """(key, n_features, weight, score, rank) for every row of ``docs``; ``rank`` is null for those not drawn."""
    counts = saved(bucket_counts(docs, key, text, max_run, buckets), "resample")
    aim = target.select(F.lit(0).alias("key"), F.col(target_text).alias("text"))
    gain = gains(histogram(counts, buckets), histogram(bucket_counts(aim, "key", "text", max_run, buckets), buckets))
    rows = saved(scored(counts, gain, seed), "resample")
    return drawn(rows, percent, least).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")

