"""Session set-up and lineage cutting."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = 8, name: str = "gristmill", **conf) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the checkpoint folder the cluster names; make one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        named = tempfile.mkdtemp(prefix="gristmill-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and go on from there.

    The copy survives the loss of executors, and its rows stay in the partitions they
    were written in, which a recomputed range exchange does not promise.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_files(spark: SparkSession) -> None:
    """Have Spark remove the files of exchanges and checkpoints that no table in use needs any more.

    Its cleaner learns of them only from the driver's garbage collection, which may not come before the
    disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
