"""The usage, session and ledger jobs on streams.

Watermarks and late rows are an addition of ours: the batch jobs define the
results, and a stream whose input has fully arrived gives the same ones. Late
rows are counted by ``LateRows`` rather than lost silently.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tallywake.sources.logs import normalize_events
from tallywake.streaming.state import FailStreaks, FollowThrough, LedgerTail, use_state_store

FOLLOW_UP_MINUTES = 60


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """ts in milliseconds becomes the event time the watermark follows."""
    return events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", delay)


def usage_rollup(events: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events per hour, command and outcome; distinct repositories are approximate on a stream."""
    outcome = F.when(F.col("outcome").isin("fail", "error"), F.col("outcome")).otherwise("ok")
    return (
        _timed(events, delay)
        .groupBy(F.window("at", window).alias("w"), "cmd", outcome.alias("outcome"))
        .agg(F.count("*").alias("events"), F.sum("durationMs").alias("duration_ms"), F.approx_count_distinct("repo").alias("repos"))
        .select(F.col("w.start").alias("start"), "cmd", "outcome", "events", "duration_ms", "repos")
    )


def dedupe_usage(usage: DataFrame, delay: str = "1 hour") -> DataFrame:
    """T4: the first record of a message id within the watermark."""
    return _timed(usage, delay).dropDuplicatesWithinWatermark(["message_id"]).drop("at")


def session_activity(events: DataFrame, gap: str = "60 minutes", delay: str = "1 hour") -> DataFrame:
    """T5: bursts of a session closed by inactivity."""
    return (
        _timed(events, delay)
        .groupBy(F.session_window("at", gap).alias("w"), "session_id")
        .agg(F.count_if(F.col("kind") == "prompt").alias("prompts"), F.count_if(F.col("kind") == "edit").alias("edits"), F.count("*").alias("events"))
        .select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "prompts", "edits", "events")
    )


def follow_through(runs: DataFrame, window_minutes: int = FOLLOW_UP_MINUTES, delay: str = "1 hour") -> DataFrame:
    """Each alarm with the next run of its group, or without one once the window is over.

    runs(repo, ts, seq, verdict). Rows of a group are held until the watermark
    has passed them, so a row that arrives out of order is still put in its
    place. The state of a group is those rows and one open alarm.
    """
    use_state_store(runs.sparkSession)
    keyed = _timed(runs, delay).select("repo", "ts", "seq", "verdict", "at").groupBy("repo")
    schema = f"repo {dict(runs.dtypes)['repo']}, ts bigint, seq bigint, verdict string, next_seq bigint, next_verdict string"
    return keyed.transformWithState(FollowThrough(window_minutes * 60_000), schema, "Append", "EventTime")


def fail_streaks(results: DataFrame, cap: int = 3, delay: str = "1 hour", idle_minutes: int | None = None) -> DataFrame:
    """The running number of fails per (repo, head); any other verdict clears it.

    Results are counted in time order once the watermark has passed them, whatever
    order they arrive in. With ``idle_minutes`` a streak is also forgotten when
    that long nothing came.
    """
    use_state_store(results.sparkSession)
    types = dict(results.dtypes)
    keyed = _timed(results, delay).select("repo", "head", "ts", "seq", "verdict", "at").groupBy("repo", "head")
    schema = f"repo {types['repo']}, head {types['head']}, ts bigint, seq bigint, consecutive_fails bigint, escalate boolean"
    return keyed.transformWithState(FailStreaks(cap, None if idle_minutes is None else idle_minutes * 60_000), schema, "Append", "EventTime")


def verify_tail(records: DataFrame, timeout_minutes: int = 60, delay: str = "1 hour") -> DataFrame:
    """Check each record as it arrives against the last hash of its ledger.

    records(ledger, seq, prev_hash, record_hash, body, ts), where body is the
    canonical text the hash covers. Records ahead of their turn wait in the
    state until the gap before them is filled, or is reported as ``lost`` when
    the watermark is ``timeout_minutes`` past the first record behind it.
    """
    use_state_store(records.sparkSession)
    keyed = _timed(records, delay).select("ledger", "seq", "prev_hash", "record_hash", "body", "ts", "at").groupBy("ledger")
    schema = f"ledger {dict(records.dtypes)['ledger']}, seq bigint, record_hash string, valid boolean, lost bigint"
    return keyed.transformWithState(LedgerTail(timeout_minutes * 60_000), schema, "Append", "EventTime")


def write_events(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append normalised events as JSON lines, one folder per day, exactly once per checkpoint."""
    day = F.to_date(F.timestamp_millis("ts"))
    return (
        normalize_events(events).withColumn("day", day).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .partitionBy("day").trigger(**(trigger or {"availableNow": True})).start()
    )


def merge_batches(events: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None], trigger: dict | None = None) -> StreamingQuery:
    """Hand every micro-batch to a merge function, such as the catalogue upsert."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class LateRows(StreamingQueryListener):
    """Rows that stateful streams dropped for coming after the watermark, added up over each query's life.

    Add it with ``spark.streams.addListener`` before the queries start. Spark counts
    a windowed aggregate's rows after their partial aggregation.
    """

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def total(self, query: StreamingQuery, wait_seconds: float = 30) -> int:
        """Late rows of a query; of one that has stopped, with all its progress."""
        if not query.isActive:
            self.ended.setdefault(str(query.runId), threading.Event()).wait(wait_seconds)
        return self.dropped.get(str(query.id), 0)


def count_late_rows(spark: SparkSession) -> LateRows:
    """A listener that counts for the queries that start from now on."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener
