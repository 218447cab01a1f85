"""Token counts without ids: pieces per distinct word, joined to each text's word frequencies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallywake.llm.pieces import tokenizer_file, word_pieces
from tallywake.llm.storage import reach_workers


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text, and whether they are more than ``limit``.

    Pieces are counted once per distinct pre-token of a task's dictionary, joined
    there to per-document pre-token frequencies and summed; documents are never
    shuffled and ids never leave the counting of a word. One row per input row,
    repeated rows included: doc_id, n_bytes (UTF-8), n_tokens, over_limit. A null
    or empty text has no bytes and no tokens; a null doc_id stays null. Other
    columns, whatever their names, are not looked at.
    """
    path = path or tokenizer_file("word_bpe_49k.json")
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(path)
        for batch in batches:
            n_tokens = pieces.counts(batch.column(1))
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(np.asarray(n_tokens > limit))], names=schema.names)

    reach_workers(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
