"""Token ids in directly addressable codes: any token is read without decoding a block.

Ids are cut into chunks of eight bits. The lowest chunk of every id lies in level
0; ids that need more continue in level 1, and so on. A bitmap per level tells
which entries continue, and a directory of counts, one per 512 bits, gives the
rank of any entry and so its place in the next level.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.pieces import tokenizer_file, word_pieces
from tallywake.llm.storage import new_folder, reach_workers

#: Bits that one directory entry covers.
BLOCK = 512
#: Ids after which a segment ends, at the end of a document.
SEGMENT_IDS = 1 << 17

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


@dataclass
class Level:
    chunks: np.ndarray
    more: np.ndarray
    ranks: np.ndarray

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Entries before place ``i`` that continue."""
        block = i // BLOCK
        out = self.ranks[block].astype(np.int64)
        at = block * (BLOCK // 8)
        for k in range(BLOCK // 8):  # whole bytes of the block before i
            inside = at + k < i // 8
            if not inside.any():
                break
            out[inside] += _ONES[self.more[(at + k)[inside]]]
        rest = (i % 8).astype(np.uint8)
        partial = np.flatnonzero(rest)
        out[partial] += _ONES[self.more[i[partial] // 8] & ((1 << rest[partial]) - 1)]
        return out


class Codes:
    """One segment of ids as levels of chunks."""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint32)
        while len(rest) or not levels:
            goes_on = rest > 255
            bits = np.packbits(goes_on, bitorder="little")
            ones = _ONES[bits].astype(np.int64)
            starts = np.arange(0, max(len(bits), 1), BLOCK // 8)
            per_block = np.add.reduceat(ones, starts) if len(bits) else np.zeros(1, np.int64)
            ranks = np.concatenate((np.zeros(1, np.int64), np.cumsum(per_block))).astype(np.uint32)
            levels.append(Level((rest & 255).astype(np.uint8), bits, ranks))
            rest = rest[goes_on] >> 8
        return cls(levels)

    def take(self, places: np.ndarray) -> np.ndarray:
        """Ids at any places, each by one look-up per level."""
        places = np.asarray(places, np.int64)
        out, own, shift = np.zeros(len(places), np.uint32), np.arange(len(places)), 0
        for level in self.levels:
            if not len(places):
                break
            out[own] |= level.chunks[places].astype(np.uint32) << np.uint32(shift)
            on = (level.more[places // 8] >> (places % 8).astype(np.uint8)) & 1 == 1
            places, own, shift = level.rank(places[on]), own[on], shift + 8
        return out

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids in places start..stop-1: per level one slice, found by two ranks."""
        return self._span(0, start, stop)

    def split(self, sizes: list[int]) -> list[memoryview]:
        """All ids, cut into runs of these sizes, each as little-endian bytes: every level is read once, whatever the number of runs."""
        ends = np.cumsum(sizes, dtype=np.int64)
        raw = memoryview(self.span(0, int(ends[-1]) if len(ends) else 0).astype("<u4").tobytes())
        return [raw[4 * (end - size) : 4 * end] for size, end in zip(sizes, ends.tolist())]

    def _span(self, depth: int, start: int, stop: int) -> np.ndarray:
        level = self.levels[depth]
        out = level.chunks[start:stop].astype(np.uint32)
        if depth + 1 == len(self.levels) or start == stop:
            return out
        bits = np.unpackbits(level.more[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
        first = int(level.rank(np.array([start]))[0])
        out[bits] |= self._span(depth + 1, first, first + int(bits.sum())) << np.uint32(8)
        return out


_LEVEL = T.StructType([T.StructField(n, T.BinaryType()) for n in ("chunks", "more", "ranks")])


def _file_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("part", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("doc_sizes", T.ArrayType(T.LongType())),
            T.StructField("levels", T.ArrayType(_LEVEL)),
        ]
    )


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Write the ids of every whole text, each ending with ``end_id``, in ascending doc_id order.

    The file is a Parquet folder without compression or dictionaries; a row is a
    segment of about ``SEGMENT_IDS`` ids that holds whole documents: part (parts
    follow each other in doc_id order), start (ids of the part before it), n_ids,
    doc_ids, doc_sizes and levels. A null doc_id comes first, repeated ids follow
    each other by text; a null or empty text is its end id alone. An empty table
    gives a folder without rows. Tasks commit as Spark's writer does, so a lost
    executor leaves nothing half written.
    """
    tokenizer = tokenizer or tokenizer_file("word_bpe_49k.json")
    schema = _file_schema(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, start = word_pieces(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        end = np.array([end_id], np.uint32)

        def segment() -> pa.RecordBatch:
            nonlocal start, held, doc_ids
            sizes = [len(x) for x in held]
            ids = np.concatenate(held)
            levels = [{"chunks": v.chunks.tobytes(), "more": v.more.tobytes(), "ranks": v.ranks.astype("<u4").tobytes()} for v in Codes.of(ids).levels]
            row = {"part": part, "start": start, "n_ids": len(ids), "doc_ids": doc_ids, "doc_sizes": sizes, "levels": levels}
            start, held, doc_ids = start + len(ids), [], []
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        count = 0
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), pieces.ids(batch.column(1))):
                held.append(np.concatenate((ids, end)))
                doc_ids.append(doc_id)
                count += len(held[-1])
                if count >= SEGMENT_IDS:
                    yield segment()
                    count = 0
        if held:
            yield segment()

    reach_workers(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").option("parquet.enable.dictionary", "false").parquet(path)


def _codes(levels: list[dict]) -> Codes:
    return Codes([Level(np.frombuffer(v["chunks"], np.uint8), np.frombuffer(v["more"], np.uint8), np.frombuffer(v["ranks"], "<u4")) for v in levels])


def read_tokens(spark: SparkSession, path: str, id_type: T.DataType | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of a token file: doc_id, start (ids before it), n_tokens, ids_crc32 and, if wanted, ids (binary)."""
    id_type = id_type or T.LongType()
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("part", T.LongType()),
            T.StructField("in_part", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            *([T.StructField("ids", T.BinaryType())] if with_ids else []),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, _, doc_ids, sizes, levels = (c[i].as_py() for c in batch.columns)
                places = np.cumsum(sizes, dtype=np.int64) - sizes
                spans = _codes(levels).split(sizes)
                columns = [doc_ids, [part] * len(sizes), (places + start).tolist(), sizes, [zlib.crc32(s) for s in spans], *([[bytes(s) for s in spans]] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    reach_workers(spark)
    stored = spark.read.schema(_file_schema(id_type)).parquet(path)
    found = stored.mapInArrow(run, schema)
    # One row per file: what the files before it hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return found.join(offsets, "part").select("doc_id", (F.col("_before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_at(spark: SparkSession, path: str, wanted: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """The token at each place of ``wanted`` (a long column ``place``, counted over the whole file): place, token.

    Places join the segment that holds them by part and block of ids; each is then
    read by ``Codes.take``. Places beyond the file give no row; repeated ones repeat.
    """
    stored = spark.read.schema(_file_schema(id_type or T.LongType())).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored.groupBy("part").agg(F.sum("n_ids").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    segments = stored.join(offsets, "part").withColumn("first", F.col("_before") + F.col("start"))
    block = SEGMENT_IDS
    blocks = segments.select("part", "start", "first", "n_ids", F.explode(F.sequence((F.col("first") / block).cast("long"), ((F.col("first") + F.col("n_ids") - 1) / block).cast("long"))).alias("_b"))
    hits = (
        wanted.select("place", (F.col("place") / block).cast("long").alias("_b"))
        .join(blocks, "_b")
        .where("place >= first and place < first + n_ids")
        .groupBy("part", "start", "first")
        .agg(F.collect_list(F.col("place") - F.col("first")).alias("places"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first, places, levels = (c[i].as_py() for c in batch.columns)
                tokens = _codes(levels).take(np.array(places, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(places, np.int64) + first), pa.array(tokens.astype(np.int64))], names=["place", "token"])

    return hits.join(stored.select("part", "start", "levels"), ["part", "start"]).select("first", "places", "levels").mapInArrow(run, "place long, token long")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a token file in the shared folder and read its documents back, without their ids."""
    spark = docs.sparkSession
    path = new_folder(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark, path, docs.schema["doc_id"].dataType, with_ids=False)
