"""Usage-log jobs over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.operators import usage as u
from tallywake.plans.tables import epoch_ms, spread, sql_proportion, table
from tallywake.sources import logs

FLOOR = 30

USAGE_SQL = """
  case when k % 3 = 0 then 'mcp' else 'cli' end as surface, event_type as cmd,
  case event_type when 'error' then 'error' when 'signup' then 'fail' else 'ok' end as outcome,
  case when k <> 7 then value end as durationMs, user_id as repo,
  case event_type when 'error' then 'FAIL' when 'signup' then 'WARN' when 'click' then null else 'PASS' end as verdict,
  case when event_type = 'purchase' then cast(k as double) end as saved_pct, k * 10 as saved_tokens,
  case when k % 2 = 0 then k * 100 end as tokens,
  case when event_type in ('view', 'click') then floor(value) end as convergence,
  case when k % 10 > 0 then k // 20 end as change_id
"""
USAGE_CTE = f"""
raw as (select *, cast(json_extract(props, '$.k') as bigint) as k from events),
usage as (select event_id as seq, epoch_us(ts) // 1000 as ts, k, {USAGE_SQL} from raw)
"""


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return spread(table(spark, sf_dir, "events")).select(
        F.col("event_id").alias("seq"),
        epoch_ms("ts").alias("ts"),
        k.alias("k"),
        F.when(k % 3 == 0, "mcp").otherwise("cli").alias("surface"),
        kind.alias("cmd"),
        F.when(kind == "error", "error").when(kind == "signup", "fail").otherwise("ok").alias("outcome"),
        F.when(k != 7, F.col("value")).alias("durationMs"),
        F.col("user_id").alias("repo"),
        F.when(kind == "error", "FAIL").when(kind == "signup", "WARN").when(kind != "click", "PASS").alias("verdict"),
        F.when(kind == "purchase", k.cast("double")).alias("saved_pct"),
        (k * 10).alias("saved_tokens"),
        F.when(k % 2 == 0, k * 100).alias("tokens"),
        F.when(kind.isin("view", "click"), F.floor("value")).alias("convergence"),
        F.when(k % 10 > 0, F.floor(k / 20)).alias("change_id"),
    )


def a14_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.usage_totals(usage_events(spark, sf_dir))


A14T_SQL = f"""
with {USAGE_CTE},
d as (select list_sort(list(durationMs)) as s, count(durationMs) as n from usage where durationMs is not null)
select count(*) as events, count(*) filter (surface = 'cli') as cli, count(*) filter (surface = 'mcp') as mcp,
  count(*) filter (outcome = 'ok') as ok, count(*) filter (outcome = 'fail') as fail, count(*) filter (outcome = 'error') as error,
  count(*) filter (verdict = 'PASS') as pass_verdicts, count(*) filter (verdict = 'WARN') as warn_verdicts,
  count(*) filter (verdict = 'FAIL') as fail_verdicts, min(ts) as ts_from, max(ts) as ts_to, count(distinct repo) as distinct_repos,
  (select cast(floor((s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2 + 0.5) as bigint) from d) as median_ms,
  (select cast(floor(s[least(n - 1, cast(floor(0.95::double * n) as bigint)) + 1] + 0.5) as bigint) from d) as p95_ms,
  cast(floor(100 * count(*) filter (verdict = 'PASS') / count(verdict) + 0.5) as bigint) as pass_rate,
  arg_max(saved_pct, (ts, seq)) filter (saved_pct is not null) as latest_saved_pct,
  arg_max(saved_tokens, (ts, seq)) filter (saved_pct is not null) as latest_saved_tokens,
  count(durationMs) = 0 as blind_latency, count(verdict) = 0 as blind_verdicts, count(saved_pct) = 0 as blind_eval
from usage
"""


def a14_usage_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.usage_commands(usage_events(spark, sf_dir))


A14C_SQL = f"""
with {USAGE_CTE},
s as (select cmd, count(*) as count, bool_or(surface = 'mcp') as m, bool_or(surface = 'cli') as c,
             list_sort(list(durationMs) filter (durationMs is not null)) as d, list_sort(list(tokens) filter (tokens is not null)) as t
      from usage group by 1)
select cmd, count, case when m and c then 'both' when m then 'mcp' else 'cli' end as surface,
  cast(floor((d[(len(d) - 1) // 2 + 1] + d[len(d) // 2 + 1]) / 2 + 0.5) as bigint) as median_ms,
  cast(floor((t[(len(t) - 1) // 2 + 1] + t[len(t) // 2 + 1]) / 2 + 0.5) as bigint) as median_tokens
from s
"""


def a15_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.exact_quantiles(usage_events(spark, sf_dir), ["repo"], "durationMs", (50, 95))


A15_SQL = f"""
with {USAGE_CTE},
s as (select repo, list_sort(list(durationMs)) as d, count(*) as n from usage where durationMs is not null group by 1)
select repo, n, cast(floor((d[(n - 1) // 2 + 1] + d[n // 2 + 1]) / 2 + 0.5) as bigint) as median,
  cast(floor(d[least(n - 1, cast(floor(0.5::double * n) as bigint)) + 1] + 0.5) as bigint) as p50,
  cast(floor(d[least(n - 1, cast(floor(0.95::double * n) as bigint)) + 1] + 0.5) as bigint) as p95,
  cast(floor(d[greatest(0, cast(ceil(n * 0.5::double) as bigint) - 1) + 1] + 0.5) as bigint) as c50,
  cast(floor(d[greatest(0, cast(ceil(n * 0.95::double) as bigint) - 1) + 1] + 0.5) as bigint) as c95
from s
"""


def w8_convergence_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.convergence_series(usage_events(spark, sf_dir))


W8_SQL = f"""
with {USAGE_CTE}
select repo, row_number() over (partition by repo order by ts, seq) as position, ts, cast(convergence as bigint) as value
from usage where convergence is not null
"""


def gate_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    status = lambda n: F.when(k % n == 0, "FAIL").when(k % n == 1, "WARN").otherwise("PASS")
    checks = F.map_concat(
        F.create_map(F.lit("Risk review"), status(3)),
        F.when(k % 5 > 0, F.create_map(F.lit("Secret scan"), status(4))).otherwise(F.create_map().cast("map<string,string>")),
    )
    return usage_events(spark, sf_dir).where("verdict is not null").withColumn("checks", checks)


def w1_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = u.with_follow_up(gate_runs(spark, sf_dir), ["repo"], ["seq", "verdict"], 60)
    return paired.select("repo", "seq", "ts", F.col("next.seq").alias("next_seq"), F.col("next.verdict").alias("next_verdict"))


RUNS_CTE = f"""{USAGE_CTE},
runs as (select *, lead(seq) over w as nseq, lead(ts) over w as nts, lead(verdict) over w as nverdict, lead(change_id) over w as nchange, lead(k) over w as nk
         from usage where verdict is not null window w as (partition by repo order by ts, seq)),
paired as (select *, coalesce(nts - ts <= 3600000, false) as follows from runs)
"""
W1_SQL = f"""with {RUNS_CTE}
select repo, seq, ts, case when follows then nseq end as next_seq, case when follows then nverdict end as next_verdict from paired"""


def a13_follow_through_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.follow_through_gate(gate_runs(spark, sf_dir), ["repo"], 60, FLOOR)


A13G_SQL = f"""with {RUNS_CTE},
c as (select count(*) as runs, count(*) filter (verdict <> 'PASS') as alarms, count(*) filter (verdict <> 'PASS' and follows) as followed,
  count(*) filter (verdict <> 'PASS' and follows and nverdict = 'PASS') as cleared,
  count(*) filter (verdict <> 'PASS' and follows and change_id is not null and nchange is not null) as comparable,
  count(*) filter (verdict <> 'PASS' and follows and change_id = nchange) as same from paired),
m as (select runs, 'followed' as measure, followed as hits, alarms as n from c union all select runs, 'cleared', cleared, followed from c
      union all select runs, 'same change', same, comparable from c)
select runs, measure, hits, n, {sql_proportion('hits', 'n', FLOOR)} from m"""


def a13_follow_through_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return u.follow_through_checks(gate_runs(spark, sf_dir), ["repo"], 60, FLOOR)


A13C_SQL = f"""with {RUNS_CTE},
each as (select 'Risk review' as name, k % 3 as s, case when follows then (case when nk % 3 < 2 then 'bad' else 'PASS' end) end as after, follows
           from paired where verdict <> 'PASS' and k % 3 < 2
         union all select 'Secret scan', k % 4, case when follows and nk % 5 > 0 then (case when nk % 4 < 2 then 'bad' else 'PASS' end) end, follows
           from paired where verdict <> 'PASS' and k % 5 > 0 and k % 4 < 2),
c as (select name, count(*) as alarms, count(*) filter (after = 'bad') as repeated, count(*) filter (follows and after is null) as not_run,
        count(*) filter (after = 'PASS') as cleared, count(after) as followed from each group by 1)
select *, {sql_proportion('cleared', 'followed', FLOOR)} from c"""


def a13_follow_through_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywake.operators.grading import convergence_band

    runs = usage_events(spark, sf_dir).where("convergence is not null").withColumn("band", convergence_band(F.col("convergence")))
    return u.follow_through_convergence(runs, ["repo"], 240, FLOOR)


A13V_SQL = f"""with {USAGE_CTE},
runs as (select convergence as c, ts, lead(ts) over w as nts, lead(convergence) over w as nc from usage where convergence is not null
         window w as (partition by repo order by ts, seq)),
p as (select *, c < 80 as low, coalesce(nts - ts <= 240 * 60000, false) as f from runs),
a as (select count(*) as runs, count(*) filter (low) as low, count(*) filter (low and f) as rescored,
        count(*) filter (low and f and nc > c) as improved, count(*) filter (low and f and nc >= 80) as aligned from p),
m as (select runs, 'rescored' as measure, rescored as hits, low as n from a union all select runs, 'improved', improved, rescored from a
      union all select runs, 'aligned', aligned, rescored from a)
select runs, measure, hits, n, {sql_proportion('hits', 'n', FLOOR)} from m"""


def w2_fail_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = usage_events(spark, sf_dir).where("verdict is not null").withColumn("head", F.floor(F.col("k") / 50))
    return u.fail_streaks(runs, ["repo", "head"], 2)


W2_SQL = f"""with {USAGE_CTE},
r as (select repo, k // 50 as head, ts, seq, verdict,
        sum(case when verdict <> 'FAIL' then 1 else 0 end) over (partition by repo, k // 50 order by ts, seq) as island
      from usage where verdict is not null),
s as (select *, row_number() over (partition by repo, head, island order by ts, seq)
          - (case when min(case when verdict <> 'FAIL' then 0 else 1 end) over (partition by repo, head, island) = 0 then 1 else 0 end) as streak from r)
select repo, head, ts, seq, streak as consecutive_fails, streak >= 2 as escalate from s where verdict = 'FAIL'"""


# Raw log lines rebuilt from the table: some torn, some from a newer version.
def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = usage_events(spark, sf_dir)
    signals = F.struct(F.col("verdict"), F.col("saved_pct").alias("savedPct"), F.col("convergence").cast("double").alias("convergence"))
    line = F.to_json(
        F.struct(F.when(F.col("k") % 20 == 3, 2).otherwise(1).alias("v"), "ts", "surface", "cmd", "outcome", "durationMs",
                 F.col("repo").cast("string").alias("repo"), signals.alias("signals"))
    )
    torn = F.when(F.col("k") % 20 == 4, F.substring_index(line, ",", 2)).when(F.col("k") % 20 == 5, "  ").otherwise(line)
    return events.select(torn.alias("value"))


def s1_read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = logs.classify_event_lines(raw_lines(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("n"))
    events = logs.parse_events(raw_lines(spark, sf_dir)).groupBy(F.concat_ws("/", "cmd", "signals.verdict").alias("status")).agg(F.count("*").alias("n"))
    return lines.unionByName(events)


S1_SQL = f"""with {USAGE_CTE}
select case when k % 20 = 3 then 'skippedNewerSchema' when k % 20 = 4 then 'skipped' else 'event' end as status, count(*) as n
from usage where k % 20 <> 5 group by 1
union all select concat_ws('/', cmd, verdict), count(*) from usage where k % 20 not in (3, 4, 5) group by 1"""


def s2_append_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage_events(spark, sf_dir).withColumn("repo_root", F.concat(F.lit("/work/"), F.col("repo").cast("string"))).drop("repo")
    return logs.normalize_events(rows.withColumn("outcome", F.when(F.col("outcome") != "ok", F.col("outcome")))).select(
        "seq", "v", "ts", "cmd", "outcome", "durationMs", "repo"
    )


S2_SQL = f"""with {USAGE_CTE}
select seq, 1 as v, ts, cmd, outcome, cast(floor(durationMs + 0.5) as bigint) as durationMs, substr(sha256('/work/' || repo), 1, 12) as repo from usage"""


def s3_shared_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = usage_events(spark, sf_dir).withColumns({
        "cmd": F.when(k % 9 == 0, F.concat(F.lit("9"), F.col("cmd"))).otherwise(F.upper("cmd")),
        "node": F.concat(F.lit("v"), k.cast("string"), F.lit(".1.0")),
        "engineVersion": F.when(k % 4 == 0, F.lit("1.2")).otherwise(F.concat(F.lit("1.2."), k.cast("string"), F.lit("-rc.1"))),
        "platform": F.when(k % 2 == 0, "linux").when(k % 3 == 0, "darwin").otherwise("plan9"),
        "durationMs": F.col("durationMs") * 100,
    })
    out = logs.shared_payload(rows)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


S3_SQL = f"""with {USAGE_CTE}
select surface, case when k % 9 = 0 then 'other' else cmd end as command, outcome,
  case when durationMs is null then 'unknown' when durationMs * 100 < 100 then 'under_100ms' when durationMs * 100 < 1000 then '100ms_to_1s'
       when durationMs * 100 < 5000 then '1s_to_5s' when durationMs * 100 < 30000 then '5s_to_30s' else 'over_30s' end as duration_bucket,
  case when k % 4 = 0 then '0.0.0' else '1.2.' || k || '-rc.1' end as version,
  case when k between 18 and 100 then k else 18 end as node_major,
  case when k % 2 = 0 then 'linux' when k % 3 = 0 then 'darwin' else 'other' end as platform, count(*) as n
from usage group by all"""


def result_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("k"), F.col("cmd")
    doc = F.to_json(F.struct(
        F.when(kind == "view", F.col("convergence")).alias("convergence"),
        F.when(kind == "click", F.struct(k.alias("savedTokens"), (k / 2).alias("savedPct"))).alias("totals"),
        F.when(kind == "purchase", F.struct(F.lit("confirmed").alias("verdict"))).alias("validation"),
        F.when((kind == "error") | (kind == "purchase"), F.col("verdict")).alias("verdict"),
        F.when((kind == "signup") & (k % 2 == 0), k).alias("ax"),
        F.when((kind == "signup") & (k % 2 == 1), F.struct(F.lit(1).alias("files"))).alias("summary"),
        F.when((kind == "signup") & (k % 4 == 1), F.array(F.lit("a"))).alias("files"),
        F.when(k % 3 > 0, F.array(F.struct(F.lit("Risk").alias("name"), F.col("outcome").alias("status")))).alias("checks"),
        F.struct(F.concat(F.lit("/work/"), F.col("repo").cast("string")).alias("root")).alias("repo"),
        F.when(k % 2 == 0, F.concat(F.lit(" task "), k.cast("string"))).alias("request"),
    ))
    return usage_events(spark, sf_dir).select("seq", "k", F.parse_json(doc).alias("doc"))


def s16_artifact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_docs(spark, sf_dir).groupBy(logs.artifact_kind(F.col("doc")).alias("kind"), "k").agg(F.count("*").alias("n"))


S16_SQL = f"""with {USAGE_CTE}
select case cmd when 'view' then 'converge' when 'click' then 'eval' when 'purchase' then 'impact' when 'error' then 'gate'
            else case when k % 2 = 0 then 'ax' when k % 4 = 1 then 'map' else 'report' end end as kind, k, count(*) as n
from usage group by 1, 2"""


def p12_extract_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_docs(spark, sf_dir).select("seq", logs.extract_signals(F.col("doc")).alias("s")).select(
        "seq", "s.verdict", "s.convergence", "s.ax", "s.savedTokens", "s.savedPct", "s.validationVerdict", "s.gateMode", "s.repoId", "s.requestId",
        F.element_at("s.checks", "Risk").alias("risk_status"),
    )


P12_SQL = f"""with {USAGE_CTE},
t as (select *, cmd in ('view', 'error', 'purchase') as scored from usage)
select seq, case when cmd in ('error', 'purchase') then verdict end as verdict, case when cmd = 'view' then convergence end as convergence,
  case when cmd = 'signup' and k % 2 = 0 then cast(k as double) end as ax, case when cmd = 'click' then cast(k as double) end as "savedTokens",
  case when cmd = 'click' then k / 2 end as "savedPct", case when cmd = 'purchase' then 'confirmed' end as "validationVerdict",
  case when cmd in ('error', 'purchase') then 'local' end as "gateMode",
  case when scored then substr(sha256('/work/' || repo), 1, 12) end as "repoId",
  case when scored and k % 2 = 0 then substr(sha256('task ' || k), 1, 12) end as "requestId",
  case when scored and k % 3 > 0 then outcome end as risk_status
from t"""


def s6_read_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    line = F.to_json(F.struct(
        F.when(k % 7 == 0, 2).otherwise(1).alias("v"), F.when(k % 5 == 0, "advisory").otherwise("trial").alias("mode"),
        F.when(k % 11 > 0, F.concat(F.lit("h"), k.cast("string"))).alias("head"), F.col("cmd").alias("tool"), F.col("verdict"),
    ))
    torn = F.when(k % 13 == 0, F.substring_index(line, ",", 3)).otherwise(line)
    return logs.parse_decisions(usage_events(spark, sf_dir).select(torn.alias("value"))).groupBy("head", "tool", "verdict").agg(F.count("*").alias("n"))


S6_SQL = f"""with {USAGE_CTE}
select 'h' || k as head, cmd as tool, verdict, count(*) as n from usage where k % 7 > 0 and k % 5 > 0 and k % 11 > 0 and k % 13 > 0 group by 1, 2, 3"""


QUERIES = {
    "a14_usage_totals": (a14_usage_totals, A14T_SQL),
    "a14_usage_commands": (a14_usage_commands, A14C_SQL),
    "a15_exact_quantiles": (a15_exact_quantiles, A15_SQL),
    "w8_convergence_series": (w8_convergence_series, W8_SQL),
    "w1_follow_up": (w1_follow_up, W1_SQL),
    "a13_follow_through_gate": (a13_follow_through_gate, A13G_SQL),
    "a13_follow_through_checks": (a13_follow_through_checks, A13C_SQL),
    "a13_follow_through_convergence": (a13_follow_through_convergence, A13V_SQL),
    "w2_fail_streaks": (w2_fail_streaks, W2_SQL),
    "s1_read_events": (s1_read_events, S1_SQL),
    "s2_append_event": (s2_append_event, S2_SQL),
    "s3_shared_payload": (s3_shared_payload, S3_SQL),
    "s6_read_decisions": (s6_read_decisions, S6_SQL),
    "s16_artifact_kinds": (s16_artifact_kinds, S16_SQL),
    "p12_extract_signals": (p12_extract_signals, P12_SQL),
}
