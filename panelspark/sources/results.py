"""Result tables and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.params import ALIASES, METRICS


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """Fail before anything runs if columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}, found {df.columns}")
    return df


def normalise_results(df: DataFrame, horizon_as_text: bool = False) -> DataFrame:
    """Clean names, known aliases, default config, model from other columns, numbers as DOUBLE.

    ``horizon`` stays a number unless asked for as text.
    """
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    df = df.withColumnsRenamed({a: n for a, n in ALIASES.items() if a in df.columns and n not in df.columns})
    if "config" not in df.columns:
        df = df.withColumn("config", F.lit("default"))
    if "model" not in df.columns:
        source = next((c for c in ("baseline_model", "llm") if c in df.columns), None)
        if source:
            df = df.withColumn("model", F.col(source))
    casts = {m: F.col(m).try_cast("double") for m in METRICS if m in df.columns}
    if "horizon" in df.columns:
        casts["horizon"] = F.col("horizon").cast("string") if horizon_as_text else F.col("horizon").try_cast("int")
    return df.withColumns(casts)


def read_results(spark: SparkSession, path: str, horizon_as_text: bool = False) -> DataFrame:
    return normalise_results(spark.read.option("header", True).csv(path), horizon_as_text)


def write_results(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """CSV without index, optionally one folder per key."""
    df.write.mode("overwrite").option("header", True).partitionBy(*by).csv(path)


def write_windows(df: DataFrame, path: str) -> None:
    """Window table as parquet by type and horizon, the input of the loss comparisons."""
    df.write.mode("overwrite").partitionBy("type", "horizon").parquet(path)


def experiment_documents(results: DataFrame, by: Sequence[str] = ("currency",)) -> DataFrame:
    """Nested documents with the two result lists, one per key.

    A list holds the rows of one key, that is models x configs x horizons, which
    parameters fix; nest by a key for which that is true.
    """
    fields = [c for c in results.columns if c not in (*by, "type")]

    def rows(kind: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct(*fields))))

    return results.groupBy(*by).agg(rows("baseline").alias("baseline_results"), rows("llm").alias("llm_results"))


def write_documents(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_bucketed(
    df: DataFrame, name: str, path: str, by: Sequence[str] = ("currency", "horizon"), order: Sequence[str] = ("model", "window"), buckets: int = 200
) -> None:
    """Window table as a bucketed, sorted table of the catalogue, with its files under ``path``.

    Comparisons group and join by the bucket columns and more, so they read the table without shuffling
    it; joins by more columns than these need ``BUCKETED``. Each task writes whole buckets, one file each.
    """
    dealt = df.repartition(buckets, *by).sortWithinPartitions(*by, *order)
    dealt.write.mode("overwrite").option("path", path).bucketBy(buckets, *by).sortBy(*by, *order).saveAsTable(name)


# joins by (currency, horizon, ...) may use a distribution by (currency, horizon)
BUCKETED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
