"""Lines of text files with their number, however Spark splits and packs the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """file, line (from 0 within its file), number (from 0 over all files in the order of their paths) and value.

    Rows of one block of a file follow each other within a partition, so their
    running identifiers differ by their places. A summary with one row per block
    tells where each block starts; the lines themselves are not sorted. Files must
    not change while they are read.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("_id", F.monotonically_increasing_id())
    blocks = rows.groupBy("file", "block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    files = blocks.groupBy("file").agg(F.sum("_n").alias("_in_file"))
    # One row per file, and one per block of a file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before_file = files.select("file", F.coalesce(F.sum("_in_file").over(earlier), F.lit(0)).alias("_before"))
    starts = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above")).join(before_file, "file")
    line = F.col("_above") + F.col("_id") - F.col("_first")
    return rows.join(starts, ["file", "block"]).select("file", line.alias("line"), (F.col("_before") + line).alias("number"), "value")
