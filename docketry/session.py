"""Session helpers: defaults for local runs and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "docketry") -> SparkSession:
    """A session for tests and benches. A cluster brings its own; nothing in the library depends on these settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and written to the checkpoint folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and the master is this one machine
    (tests, benches), a fresh folder is made; on a cluster without the setting this raises instead of writing to a
    disk that other machines don't see.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = context.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="docketry-checkpoint-")
        context.setCheckpointDir(shared)
    return df.checkpoint()
