"""Quality rules: fixed limits, then an isolation forest on the rules' statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.document_statistics import bounded_sample, document_statistics, labelled, where_true, with_columns
from tallywake.llm.storage import stored
from tallywake.llm.trees import IsolationForest

#: Trees, and rows of each tree; together the bound of the sample that the forest is grown on.
TREES, TREE_ROWS = 100, 512
#: Labelled bad rows in the sample, to a good one. A forest finds what is rare: kept at their own
#: share, the bad rows form groups as dense as any other.
BAD_SHARE = 0.01
#: Share of the labelled good documents that the forest may reject.
GOOD_LOSS = 0.005
_STEPS = 10_000


def _features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars, lines = (np.maximum(s[n], 1) for n in ("n_words", "word_chars", "n_lines"))
    return np.stack(
        [
            np.log1p(s["n_words"]),
            s["word_chars"] / words,
            s["n_symbols"] / words,
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_shout"] / words,
            s["n_marks"] / chars,
            s["n_distinct_words"] / words,
            s["n_digits"] / chars,
        ],
        1,
    )


def _base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def _verdict(forest: IsolationForest | None, threshold: float, s: dict[str, np.ndarray]) -> list[np.ndarray]:
    """kept, base_failed and anomaly."""
    failed = _base_failed(s)
    anomaly = forest.score(_features(s)) if forest else np.zeros(len(failed))
    return [~failed & (anomaly < threshold), failed, anomaly]


def fit(stats: DataFrame, labels: DataFrame, good_loss: float = GOOD_LOSS):
    """Forest and threshold, as a function of statistics to (kept, base_failed, anomaly).

    The forest grows on at most TREES * TREE_ROWS labelled good rows and BAD_SHARE
    times as many bad ones. The threshold
    comes from all labelled rows that the fixed limits keep: the lowest that
    rejects at most ``good_loss`` of the good ones. Without labelled rows the
    fixed limits decide alone.
    """
    known = labelled(stats, labels).where(f"not ({_BASE_SQL})")
    good, _ = bounded_sample(known.where("quality = 1"), TREES * TREE_ROWS)
    bad, _ = bounded_sample(known.where("quality <> 1"), max(1, int(BAD_SHARE * len(good["n_words"]))))
    x = np.concatenate((_features(good), _features(bad)))
    if not len(x):
        return lambda s: _verdict(None, 2.0, s)
    forest = IsolationForest.fit(x, TREES, TREE_ROWS)
    scored = with_columns(known, lambda s: [forest.score(_features(s))], [T.StructField("anomaly", T.DoubleType())])
    steps = scored.where("quality = 1").groupBy(F.floor(F.col("anomaly") * _STEPS).alias("step")).count().collect()  # at most _STEPS rows
    total, above, threshold = sum(r["count"] for r in steps), 0, 2.0
    for r in sorted(steps, key=lambda r: -r["step"]):
        above += r["count"]
        if above > good_loss * total:
            threshold = (r["step"] + 1) / _STEPS
            break
    return lambda s: _verdict(forest, threshold, s)


_BASE_SQL = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rule statistics and verdict of every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and anomaly, one row per input row, repeated rows included.
    A null or empty text has zeros and fails; a null doc_id stays null and has no
    label. Empty tables give no row; labels that are null or missing teach
    nothing. Extra columns are not looked at.
    """
    stats = stored(document_statistics(docs), "statistics")
    judge = fit(stats, labels)
    columns = [T.StructField("kept", T.BooleanType()), T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType())]
    return with_columns(stats, judge, columns).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the rules keep, with all their columns, whatever these are called.

    Null, empty and short texts fail the fixed limits and go; texts count whole,
    however long. Repeated rows stay or go together, ties do not matter, a null
    doc_id has no label and is judged like the others. An empty table gives no row.
    """
    return where_true(docs, fit(stored(document_statistics(docs), "statistics"), labels))
