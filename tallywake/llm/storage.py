"""Reading the given tables, and tables kept in the cluster's shared folder between jobs."""

from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallywake.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from.

    Machines that do not have this folder get the package as they get any other
    code, by ``--py-files`` or an image.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def release_dictionaries() -> None:
    """Let go of the word dictionaries that earlier tasks left in this worker: tasks without tokens have other uses for the memory."""
    for module in ("tallywake.llm.pieces", "tallywake.llm.bpe"):
        if module in sys.modules:
            sys.modules[module]._kept.clear()


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, removed when the driver ends."""
    reach_workers(spark)
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there: a lost executor loses nothing, and nothing above is
    computed twice. Only the columns that a later step wants are read again.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
