"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings a cluster run wants; anything the caller passes wins.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # call sites of column expressions are not recorded: building long plans is several times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files of cut tables go when no plan refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "panelspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a fresh local folder, removed at its end; on a
    cluster executors could not share one, so there the setting is required.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current is None:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if current is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if current is None:
            current = tempfile.mkdtemp(prefix="panelspark-")
            atexit.register(shutil.rmtree, current, ignore_errors=True)
        context.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there.

    Used for small tables whose values must be the same for every task that
    reads them, also after an executor is lost (approximate quantiles), and to
    end the growing plan of an iterative prediction.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
