"""Session helpers: a local session for tests and bench, and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tallywake") -> SparkSession:
    """Session used by the tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    Only a local session may go without that setting: it gets a temporary folder.
    On a cluster other machines could not see one, so there it is an error.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    target = spark.conf.get(CHECKPOINT_KEY, None)
    if not target:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that all machines share")
        target = tempfile.mkdtemp(prefix="tallywake-checkpoint-")
    context.setCheckpointDir(target)
    return context.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Let the shuffle files of finished steps go.

    Executors delete them once the driver's JVM has collected what refers to them. A driver
    with little to do hardly collects, and the files of all steps would lie there at once.
    """
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint(eager=True)
    release(df.sparkSession)
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for results that are read several times, by some of their columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a shuffled join, whatever the size that is planned for it.

    Spark plans with the bytes of the Parquet files, and adaptive execution never takes
    a planned broadcast back. A key table of a few compressed megabytes that gets a path
    or an array per row would pass through the driver as hundreds of megabytes.
    """
    return df.hint("merge")
