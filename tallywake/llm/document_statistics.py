"""Statistics of whole documents as columns, and scores from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.storage import reach_workers, release_dictionaries
from tallywake.llm.words import Statistics, portions, statistics

NAMES = [f.name for f in fields(Statistics)]

#: Statistics of a batch, by name -> one array per result column.
Judge = Callable[[dict[str, np.ndarray]], list[np.ndarray]]


def of_column(column: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of a column of texts; null counts as empty."""
    found = [statistics(p) for p in portions(column)]
    return {n: np.concatenate([np.zeros(0, np.int64), *[getattr(s, n) for s in found]]).astype(np.int64) for n in NAMES}


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and every statistic of its whole text, one row per input row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, T.LongType()) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_dictionaries()
        for batch in batches:
            found = of_column(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[n]) for n in NAMES]], names=schema.names)

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_columns(stats: DataFrame, judge: Judge, columns: list[T.StructField]) -> DataFrame:
    """A table of statistics with the columns that ``judge`` makes of them."""
    schema = T.StructType([*stats.schema, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = judge({n: batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES})
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(m) for m in made]], names=schema.names)

    reach_workers(stats.sparkSession)
    return stats.mapInArrow(run, schema)


def where_true(docs: DataFrame, judge: Judge) -> DataFrame:
    """Rows of ``docs`` whose text ``judge`` accepts, all columns as they are, whatever they are called."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(of_column(batch.column(at)))[0]))

    reach_workers(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled documents with ``quality``; a document labelled twice takes the lower one, null labels none."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return stats.join(known, "doc_id")


def bounded_sample(rows: DataFrame, most: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """At most ``most`` labelled rows, by a hash of their id: statistics by name, and quality."""
    taken = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(*NAMES, "quality").toArrow()
    return {n: taken.column(n).to_numpy().astype(np.int64) for n in NAMES}, taken.column("quality").to_numpy().astype(np.int64)
