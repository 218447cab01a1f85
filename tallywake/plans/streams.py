"""Streams over the events and orders tables: replayed as files until all of them have arrived."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.plans.evaluation import LEDGER_CTE, ledger_fields
from tallywake.operators import ledger as l
from tallywake.plans.tables import table
from tallywake.plans.usage import RUNS_CTE, USAGE_CTE, gate_runs, usage_events
from tallywake.session import ensure_checkpoint_dir
from tallywake.streaming import jobs

#: The tables are replayed in one go, so a watermark as long as they are drops nothing.
DELAY = "60 days"
DAY_MS = 86_400_000


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def replayed(spark: SparkSession, rows: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, marks: int = 2) -> DataFrame:
    """What ``job`` puts out for a stream of ``rows`` (with ts in milliseconds) that has fully arrived.

    The rows are files that the stream finds; then marks, rows with nothing but a
    far later ts, move the watermark past all of them. Sources, state and results
    lie in the shared folder.
    """
    folder = new_folder(spark, name)
    rows.write.parquet(f"{folder}/in")
    last = rows.agg(F.max("ts")).first()[0] or 0

    def run() -> DataFrame:
        out = job(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        sink = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
        sink.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        return out

    out = run()
    for n in range(marks):
        later = spark.range(1).select(*[F.lit(last + (n + 1) * 100 * DAY_MS if f.name == "ts" else None).cast(f.dataType).alias(f.name) for f in rows.schema])
        later.write.mode("append").parquet(f"{folder}/in")
        run()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def t1_usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_events(spark, sf_dir).select("ts", "cmd", "outcome", "durationMs", "repo")
    done = replayed(spark, rows, lambda s: jobs.usage_rollup(s, delay=DELAY), "t1").where("cmd is not null")
    return done.select(F.unix_millis("start").alias("start_ms"), "cmd", "outcome", "events", F.round("duration_ms", 3).alias("duration_ms"))


T1_SQL = f"""with {USAGE_CTE}
select ts - ts % 3600000 as start_ms, cmd, outcome, count(*) as events, round(sum(durationMs), 3) as duration_ms from usage group by 1, 2, 3"""


def t2_follow_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate_runs(spark, sf_dir).select("repo", "ts", "seq", "verdict")
    return replayed(spark, rows, lambda s: jobs.follow_through(s, 60, DELAY), "t2").where("repo is not null")


T2_SQL = f"""with {RUNS_CTE}
select repo, ts, seq, verdict, case when follows then nseq end as next_seq, case when follows then nverdict end as next_verdict from paired where verdict in ('WARN', 'FAIL')"""


def t3_fail_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate_runs(spark, sf_dir).select("repo", F.floor(F.col("k") / 50).alias("head"), "ts", "seq", "verdict")
    return replayed(spark, rows, lambda s: jobs.fail_streaks(s, 2, DELAY), "t3").where("repo is not null")


T3_SQL = f"""with {USAGE_CTE},
r as (select repo, k // 50 as head, ts, seq, verdict from usage where verdict is not null),
n as (select *, row_number() over w as n, max(case when verdict <> 'FAIL' then ts * 1000000 + seq end) over w as cleared from r window w as (partition by repo, head order by ts, seq)),
c as (select *, row_number() over (partition by repo, head, cleared order by ts, seq) - case when cleared is null then 0 else 1 end as fails from n)
select repo, head, ts, seq, fails as consecutive_fails, fails >= 2 as escalate from c where verdict = 'FAIL'"""


def t4_dedupe_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered up to three times."""
    rows = usage_events(spark, sf_dir).select(F.col("seq").cast("string").alias("message_id"), "ts", "tokens", F.explode(F.sequence(F.lit(0), F.col("k") % 3)).alias("copy"))
    done = replayed(spark, rows, lambda s: jobs.dedupe_usage(s, DELAY), "t4").where("message_id is not null")
    return done.select("message_id", "ts", "tokens")


T4_SQL = f"with {USAGE_CTE} select cast(seq as varchar) as message_id, ts, tokens from usage"


def t5_session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("cmd") == "click", "prompt").when(F.col("cmd") == "purchase", "edit").otherwise(F.col("cmd"))
    rows = usage_events(spark, sf_dir).select(F.col("repo").alias("session_id"), "ts", kind.alias("kind"))
    done = replayed(spark, rows, lambda s: jobs.session_activity(s, "600 minutes", DELAY), "t5").where("session_id is not null")
    return done.select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "prompts", "edits", "events")


T5_SQL = f"""with {USAGE_CTE},
g as (select *, case when ts - lag(ts) over (partition by repo order by ts, seq) <= 36000000 then 0 else 1 end as opens from usage),
s as (select *, sum(opens) over (partition by repo order by ts, seq rows unbounded preceding) as burst from g)
select repo as session_id, min(ts) as start_ms, max(ts) + 36000000 as end_ms, count(*) filter (cmd = 'click') as prompts,
  count(*) filter (cmd = 'purchase') as edits, count(*) as events from s group by repo, burst"""


def t6_verify_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger per customer; some records were edited, and some never arrive."""
    done = l.append_records(ledger_fields(spark, sf_dir))
    tampered = F.when(F.col("seq") * 7 + F.col("ledger") % 97 == 90, F.concat("body", F.lit(" "))).otherwise(F.col("body"))
    rows = done.select("ledger", "seq", F.col("prev").alias("prev_hash"), F.col("hash").alias("record_hash"), tampered.alias("body"), (F.col("seq") * 1000).alias("ts"))
    arrived = rows.where((F.col("ledger") + 3 * F.col("seq")) % 11 > 0)
    return replayed(spark, arrived, lambda s: jobs.verify_tail(s, 60, DELAY), "t6").where("ledger is not null")


T6_SQL = f"""with recursive {LEDGER_CTE},
a as (select o_custkey as ledger, n, hash, coalesce(lag(n) over w, 0) as before from chain where (o_custkey + 3 * n) % 11 > 0 window w as (partition by o_custkey order by n))
select ledger, n as seq, hash as record_hash, n = before + 1 and n * 7 + ledger % 97 <> 90 as valid, 0 as lost from a
union all select ledger, before + 1, null, false, n - before - 1 from a where n > before + 1"""


def t7_event_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines, one folder a day, read back."""
    folder = new_folder(spark, "t7")
    rows = usage_events(spark, sf_dir).select("seq", "ts", "cmd", "durationMs", F.col("repo").cast("string").alias("repo_root"), F.when(F.col("outcome") != "ok", F.col("outcome")).alias("outcome"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    jobs.write_events(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    back = spark.read.schema("seq bigint, ts bigint, cmd string, durationMs bigint, outcome string, v int, repo string, day string").json(f"{folder}/out")
    return back.select("seq", "ts", "cmd", "durationMs", "outcome", "repo", "day")


T7_SQL = f"""with {USAGE_CTE}
select seq, ts, cmd, cast(floor(durationMs + 0.5) as bigint) as durationMs, outcome, substr(sha256(cast(repo as varchar)), 1, 12) as repo,
  strftime(to_timestamp(ts // 1000) at time zone 'UTC', '%Y-%m-%d') as day from usage"""


def t7_merged_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches merged into a table: each repository's newest event, batch by batch."""
    folder = new_folder(spark, "t7m")
    rows = usage_events(spark, sf_dir).select("repo", "ts", "seq", "cmd")
    rows.repartition(4, "seq").write.parquet(f"{folder}/in")
    newest = F.max(F.struct("ts", "seq", "cmd")).alias("last")

    def merge(batch: DataFrame, number: int) -> None:
        # A batch that is run again writes the same version once more.
        session, before = batch.sparkSession, [batch]
        if number:
            before.append(session.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}"))
        whole = before[0] if number == 0 else before[0].union(before[1].select(batch.columns))
        whole.groupBy("repo").agg(newest).select("repo", "last.ts", "last.seq", "last.cmd").write.mode("overwrite").parquet(f"{folder}/v{number}")

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    query = jobs.merge_batches(stream, f"{folder}/state", merge)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/v{query.lastProgress['batchId']}")


T7M_SQL = f"""with {USAGE_CTE}
select repo, max(ts) as ts, arg_max(seq, (ts, seq)) as seq, arg_max(cmd, (ts, seq)) as cmd from usage group by 1"""


QUERIES = {
    "t1_usage_rollup": (t1_usage_rollup, T1_SQL),
    "t2_follow_through": (t2_follow_through, T2_SQL),
    "t3_fail_streaks": (t3_fail_streaks, T3_SQL),
    "t4_dedupe_usage": (t4_dedupe_usage, T4_SQL),
    "t5_session_activity": (t5_session_activity, T5_SQL),
    "t6_verify_tail": (t6_verify_tail, T6_SQL),
    "t7_event_sink": (t7_event_sink, T7_SQL),
    "t7_merged_batches": (t7_merged_batches, T7M_SQL),
}
