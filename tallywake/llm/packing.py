"""Packing token pieces into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.differencing import windows_within
from tallywake.llm.pieces import tokenizer_file, word_pieces
from tallywake.llm.storage import reach_workers, stored

#: Pieces that are differenced together.
GROUP_PIECES = 1024
_WINDOWS_BITS = 20


def cuts(total: int, capacity: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: full windows first, then at most ``longest`` each."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [longest] * (rest // longest) + ([rest % longest] if rest % longest else [])


def pieces(docs: DataFrame, capacity: int, longest: int, end_id: int, tokenizer: str, keep_ids: bool) -> DataFrame:
    """Pieces of every document, with their place in the task that cut them (unique together)."""
    fields = [
        T.StructField("doc_id", docs.schema["doc_id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "part", "row")],
        *([T.StructField("ids", T.BinaryType())] if keep_ids else []),
    ]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, encoder, part, row = to_arrow_schema(schema), word_pieces(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                raw, at = ids.astype("<u4").tobytes() + end, 0
                for length in cuts(len(ids) + 1, capacity, longest):
                    own = raw[at * 4 : (at + length) * 4]
                    out.append((doc_id, at, length, zlib.crc32(own), len(ids) + 1, part, row, *([own] if keep_ids else [])))
                    at, row = at + length, row + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [()] * len(fields), arrow)], schema=arrow)

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = 2048, longest: int = 512, end_id: int = 1, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Place every id of every document in windows of at most ``capacity`` ids.

    A document's ids and its end id are cut into full windows, and what is left
    into pieces of at most ``longest``. Short pieces are dealt by a hash of their
    own place into groups of about ``GROUP_PIECES``, whatever document or source
    they come from; each group is divided by multiway differencing, and its
    window count rises until no window is too full.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id (unique, not consecutive), offset (gapless from 0) and, if
    wanted, ids (binary). A null or empty text is its end id alone; a null
    doc_id stays null and repeated rows are packed as often as they stand. An
    empty table gives no row. Other columns are not looked at.
    """
    tokenizer = tokenizer or tokenizer_file("word_bpe_49k.json")
    cut = stored(pieces(docs, capacity, longest, end_id, tokenizer, keep_ids), "pieces")
    short = cut.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // GROUP_PIECES))
    held = [c for c in cut.columns if c != "ids"]
    schema = T.StructType([*[cut.schema[c] for c in held if c not in ("part", "row")], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *([T.StructField("part", T.LongType()), T.StructField("row", T.LongType())] if keep_ids else [])])

    def divide(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("row", "ascending")])
        sizes = group.column("length").to_numpy().astype(np.int64)
        window, _ = windows_within(sizes, capacity)
        order = np.argsort(window, kind="stable")
        run = np.cumsum(sizes[order]) - sizes[order]
        first = np.ones(len(order), bool)
        first[1:] = np.diff(window[order]) != 0
        offset = np.empty(len(order), np.int64)
        offset[order] = run - np.maximum.accumulate(np.where(first, run, 0))
        number = group.column("group")[0].as_py()
        sequence = ((np.int64(number) << _WINDOWS_BITS) + window) * 2
        group = group.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        return group.select([f.name for f in schema])

    grouped = short.select(*held, F.pmod(F.xxhash64("part", "row"), F.lit(groups)).alias("group"))
    placed = grouped.groupBy("group").applyInArrow(divide, schema)
    alone = cut.where(F.col("length") == capacity).select(
        *[c for c in held if c not in ("part", "row")],
        (F.shiftleft(F.col("part"), 33) + F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["part", "row"] if keep_ids else []),
    )
    packed = placed.unionByName(alone)
    if not keep_ids:
        return packed
    return packed.join(cut.select("part", "row", "ids"), ["part", "row"]).drop("part", "row")


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Windows as ids: sequence_id, n_tokens, ids (binary, padded with ``pad_id`` to ``capacity``).

    Takes the result of ``pack`` with ids; a window never holds more than ``capacity`` ids.
    """
    whole = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    padding = F.unhex(F.repeat(F.hex(F.lit(int(pad_id).to_bytes(4, "little"))), (F.lit(capacity) - F.col("n_tokens")).cast("int")))
    return whole.select("sequence_id", "n_tokens", F.concat(F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p.ids)), padding).alias("ids"))
