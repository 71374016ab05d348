"""Spark session and checkpoint folder used by the library, tests and bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: str = "8", app: str = "seqtide", memory: str = "8g") -> SparkSession:
    """Session for tests and single-machine runs. A cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", os.environ.get("SEQTIDE_SHUFFLE", "8"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for ``checkpoint()``.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and
    the master is local (tests) is a scratch folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    scratch = tempfile.mkdtemp(prefix="seqtide-checkpoint-")
    context.setCheckpointDir(scratch)
    return scratch


def cut_lineage(df):
    """Reliable checkpoint: survives executor loss and is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
