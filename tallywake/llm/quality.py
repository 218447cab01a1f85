"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.document_statistics import bounded_sample, document_statistics, labelled, where_true, with_columns
from tallywake.llm.storage import stored
from tallywake.llm.trees import BoostedTrees

#: Labelled rows that the trees are fitted on, at most; about 10 MB on the driver.
FIT_ROWS = 50_000
#: Scores from here up predict label 1.
THRESHOLD = 0.3


def _features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines, size = (np.maximum(s[n], 1) for n in ("n_words", "word_chars", "n_lines", "n_bytes"))
    return np.stack(
        [
            np.log1p(s["n_words"]),
            np.log1p(s["n_bytes"]),
            s["word_chars"] / words,
            s["n_distinct_words"] / words,
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            s["n_marks"] / chars,
            s["n_symbols"] / words,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_beyond_ascii"] / size,
            np.log1p(s["longest_word"]),
            s["n_long_words"] / words,
            s["n_shout"] / words,
            s["n_words"] / lines,
        ],
        1,
    )


def is_held_out() -> Column:
    """One document in five, by the checksum of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame) -> BoostedTrees:
    """Trees from at most FIT_ROWS labelled rows that are not held out; without any, every score is 0.5."""
    sample, quality = bounded_sample(labelled(stats, labels).where(~is_held_out()), FIT_ROWS)
    return BoostedTrees.fit(_features(sample), (quality == 1).astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every whole text: likelihood of label 1, from its statistics alone.

    Returns doc_id, held_out, score and predicted, one row per input row,
    repeated rows included. A null or empty text is scored as a text without
    words; a null doc_id stays null. Empty tables give no row; without labels
    every score is 0.5. Extra columns are not looked at.
    """
    stats = stored(document_statistics(docs), "statistics")
    model = fit(stats, labels)
    scored = with_columns(stats, lambda s: [model.score(_features(s))], [T.StructField("score", T.DoubleType())])
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` predicted 1, with all their columns, whatever these are called.

    A null or empty text is judged as a text without words, a long one whole.
    Repeated rows stay or go together, ties do not matter, a null doc_id has no
    label and is judged like the others. Without labels every score is 0.5 and
    all rows stay; an empty table gives no row.
    """
    model = fit(stored(document_statistics(docs), "statistics"), labels)
    return where_true(docs, lambda s: [model.score(_features(s)) >= THRESHOLD])
