"""Session jobs over the conversations table: users prompt, the system interrupts, assistants edit and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.operators import sessions as s
from tallywake.operators.grading import assign_arm
from tallywake.plans.tables import as_text_files, sql_proportion, table
from tallywake.sources import transcripts as t
from tallywake.sources.lines import numbered_lines

FLOOR = 10

# Two rows in five are said again 65 seconds later; an edit's file and a check's request are the whole text.
EVENTS_CTE = """
talk as (select conv_id as session_id, role, text, turn * 60000 as ts, turn * 10 as seq from conversations
  union all select conv_id, role, text, (turn + 1) * 60000 + 5000, (turn + 1) * 10 + 5 from conversations where (conv_id + turn) % 5 < 2),
ev as (
  select session_id, seq, ts, case role when 'user' then 'prompt' when 'system' then 'interrupt' else 'edit' end as kind,
    case when role <> 'assistant' then text else null::varchar end as text, case when role = 'assistant' then text else null::varchar end as file, null::varchar as tool,
    case when role <> 'assistant' then substr(sha256(text), 1, 16) end as hash from talk
  union all select session_id, seq + 1, ts + 20000, 'check', null::varchar, null::varchar, 'review_gate', substr(sha256(text), 1, 16) from talk where role = 'assistant'),
turns as (select *, sum(case when kind in ('prompt', 'interrupt') then 1 else 0 end) over (partition by session_id order by ts, seq) as turn from ev)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn")
    said_again = F.when((F.col("conv_id") + turn) % 5 < 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    talk = table(spark, sf_dir, "conversations").withColumn("copy", F.explode(said_again)).withColumns({
        "ts": (turn + F.col("copy")) * 60000 + F.col("copy") * 5000, "seq": (turn + F.col("copy")) * 10 + F.col("copy") * 5, "said": F.col("role") != "assistant"
    })
    spoken = talk.select(
        F.col("conv_id").alias("session_id"), "seq", "ts",
        F.when(F.col("role") == "user", "prompt").when(F.col("role") == "system", "interrupt").otherwise("edit").alias("kind"),
        F.when(F.col("said"), F.col("text")).alias("text"), F.when(~F.col("said"), F.col("text")).alias("file"),
        F.lit(None).cast("string").alias("tool"), F.when(F.col("said"), t.prompt_hash(F.col("text"))).alias("hash"),
    )
    checks = talk.where("not said").select(
        F.col("conv_id").alias("session_id"), (F.col("seq") + 1).alias("seq"), (F.col("ts") + 20000).alias("ts"), F.lit("check").alias("kind"),
        F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("file"), F.lit("review_gate").alias("tool"),
        t.prompt_hash(F.col("text")).alias("hash"),
    )
    return spoken.unionByName(checks)


OUTCOME_CTE = EVENTS_CTE + """,
opening as (select session_id, turn, seq, ts, kind, text from turns where kind in ('prompt', 'interrupt')),
edits as (select distinct session_id, turn, file from turns where kind = 'edit'),
touched as (select e.session_id, e.turn, count(*) as edited, count(n.file) as again from edits e
   left join edits n on n.session_id = e.session_id and n.turn = e.turn + 1 and n.file = e.file group by 1, 2),
outcomes as (select o.session_id, o.turn, o.seq, o.ts, coalesce(n.ts - o.ts <= 90000, false) as follow_up,
    case when n.ts - o.ts <= 90000 then n.kind = 'interrupt' or regexp_matches(trim(n.text), '{pushback}') end as corrected,
    case when n.ts - o.ts <= 90000 and edited > 0 then again > 0 end as reworked
  from opening o left join opening n on n.session_id = o.session_id and n.turn = o.turn + 1
  left join touched t on t.session_id = o.session_id and t.turn = o.turn where o.kind = 'prompt')
""".replace("{pushback}", s.PUSHBACK.replace("'", "''")).replace("90000", "150000")


def w3_prompt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.prompt_outcomes(events(spark, sf_dir), 2.5)


W3_SQL = f"with {OUTCOME_CTE} select session_id, cast(turn as bigint) as turn, seq, ts, follow_up, corrected, reworked from outcomes"


def j17_checks_with_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.checks_with_prompt(events(spark, sf_dir))


J17_SQL = f"""with {EVENTS_CTE}
select session_id, seq, ts, tool, hash, prompt_seq from (
  select *, last_value(case when kind = 'prompt' then seq end ignore nulls) over (partition by session_id order by ts, seq rows between unbounded preceding and 1 preceding) as prompt_seq from ev)
where kind = 'check'"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("session_id"), (F.col("turn") * 60000 - 30000).alias("ts"), (F.length("text") * 5).alias("weighted")
    )


USAGE_CTE = "use as (select conv_id as session_id, turn * 60000 - 30000 as ts, length(text) * 5 as weighted from conversations where role = 'assistant')"


def j18_turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.turn_tokens(events(spark, sf_dir), usage(spark, sf_dir))


J18_SQL = f"""with {EVENTS_CTE}, {USAGE_CTE},
spans as (select session_id, turn, ts, lead(ts) over (partition by session_id order by ts, seq) as until from turns where kind in ('prompt', 'interrupt'))
select s.session_id, cast(s.turn as bigint) as turn, cast(sum(weighted) as bigint) as tokens from spans s join use u on u.session_id = s.session_id and u.ts >= s.ts and (until is null or u.ts < until)
group by 1, 2"""


def w5_drop_repeated_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.drop_repeated_prompts(events(spark, sf_dir)).groupBy("session_id").agg(F.count("*").alias("events"), F.sum("seq").alias("seqs"))


W5_SQL = f"""with recursive {EVENTS_CTE},
p as (select session_id, seq, ts, text as c, row_number() over (partition by session_id order by ts, seq) as n from ev where kind = 'prompt'),
f as (select session_id, n, seq, true as kept, c as kc, ts as kt from p where n = 1
  union all select p.session_id, p.n, p.seq, not (p.c = f.kc and p.ts - f.kt < 120000),
    case when p.c = f.kc and p.ts - f.kt < 120000 then f.kc else p.c end, case when p.c = f.kc and p.ts - f.kt < 120000 then f.kt else p.ts end
  from f join p on p.session_id = f.session_id and p.n = f.n + 1)
select session_id, count(*) as events, cast(sum(seq) as bigint) as seqs from ev where (session_id, seq) not in (select (session_id, seq) from f where not kept) group by 1"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing decisions: one per user turn, logged 7 minutes early or late; assistants' are never found."""
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("record_id"),
        F.when(F.col("turn") % 5 < 4, F.col("conv_id")).otherwise(F.col("conv_id") + 1).alias("session_id"),
        t.prompt_hash(F.col("text")).alias("hash"), (F.col("turn") * 60000 + F.when(F.col("turn") % 3 == 0, 420000).when(F.col("turn") % 3 == 1, 600000).otherwise(-60000)).alias("ts"),
        F.when(F.col("turn") % 2 == 0, "cheap").otherwise("premium").alias("tier"), "role",
    )


RECORDS_CTE = """rec as (select conv_id || '-' || turn as record_id, case when turn % 5 < 4 then conv_id else conv_id + 1 end as session_id, substr(sha256(text), 1, 16) as hash,
  turn * 60000 + case turn % 3 when 0 then 420000 when 1 then 600000 else -60000 end as ts, case when turn % 2 = 0 then 'cheap' else 'premium' end as tier, role from conversations)"""


def harnessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    return ev.withColumn("kind", F.when((F.col("kind") == "prompt") & (F.col("ts") == 120000), "harness").otherwise(F.col("kind")))


def j16_prompts_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.prompts_by_hash(records(spark, sf_dir), harnessed(spark, sf_dir)).select("record_id", "status", "prompt_seq")


J16_SQL = f"""with {EVENTS_CTE}, {RECORDS_CTE},
hv as (select session_id, seq, ts, hash, case when kind = 'prompt' and ts = 120000 then 'harness' else kind end as kind from ev),
first as (select record_id, arg_min(e.seq, (e.ts, e.seq)) as prompt_seq from rec r join hv e on e.session_id = r.session_id and e.hash = r.hash and e.kind = 'prompt' and abs(e.ts - r.ts) < 600000 group by 1)
select r.record_id, case when h.session_id is not null then 'excluded' when f.record_id is not null then 'joined' else 'unjoined' end as status,
   case when h.session_id is null then f.prompt_seq end as prompt_seq
from rec r left join first f using (record_id) left join (select distinct session_id, hash from hv where kind = 'harness') h on h.session_id = r.session_id and h.hash = r.hash"""


def j20_agent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = records(spark, sf_dir).select(
        (F.col("session_id")).alias("session_id"), "hash", F.when(F.col("tier") == "cheap", F.lit("delegate")).alias("arm"),
        F.when(F.col("role") == "user", "matched").when(F.col("role") == "assistant", "diverged").otherwise("rewrote").alias("action"),
    )
    logged = events(spark, sf_dir).where("kind = 'prompt' or kind = 'interrupt'").select("session_id", "hash")
    return s.agent_calls(calls, logged)


J20_SQL = f"""with {EVENTS_CTE}, {RECORDS_CTE},
known as (select distinct session_id, hash from ev where kind in ('prompt', 'interrupt')),
c as (select r.*, k.hash is not null as known from rec r left join known k on k.session_id = r.session_id and k.hash = r.hash)
select case when not known then '(unjoined)' when tier = 'cheap' then 'delegate' else 'advisory' end as arm, count(*) as calls, count(distinct (session_id, hash)) as requests,
  count(*) filter (role = 'user') as matched, count(*) filter (role = 'assistant') as diverged, count(*) filter (role = 'system') as rewrote
from c group by 1"""


def a35_outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.prompt_outcomes(events(spark, sf_dir), 2.5).withColumn("tier", F.when(F.col("seq") % 20 == 0, "cheap").otherwise("premium"))
    return s.outcome_rates(rows, "tier", FLOOR)


A35_SQL = f"""with {OUTCOME_CTE},
c as (select case when seq % 20 = 0 then 'cheap' else 'premium' end as tier, count(*) as prompts, count(*) filter (follow_up) as graded, count(*) filter (corrected) as corrected,
  count(reworked) as editing, count(*) filter (reworked) as reworked from outcomes group by 1),
m as (select tier, prompts, 'corrected' as measure, corrected as hits, graded as n from c union all select tier, prompts, 'reworked', reworked, editing from c)
select *, {sql_proportion('hits', 'n', FLOOR)} from m"""


def a35_billed_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.turn_tokens(events(spark, sf_dir), usage(spark, sf_dir)).withColumn("arm", assign_arm([F.col("session_id")], "bill"))
    return s.billed_summary(rows, "arm", FLOOR)


A35B_SQL = f"""with {EVENTS_CTE}, {USAGE_CTE},
spans as (select session_id, turn, ts, lead(ts) over (partition by session_id order by ts, seq) as until from turns where kind in ('prompt', 'interrupt')),
tok as (select s.session_id, s.turn, sum(weighted) as tokens from spans s join use u on u.session_id = s.session_id and u.ts >= s.ts and (until is null or u.ts < until) group by 1, 2),
a as (select case when ('0x' || substr(sha256('bill:' || session_id), 1, 8))::bigint / 4294967296.0 < 0.5 then 'shown' else 'withheld' end as arm, list_sort(list(tokens)) as d, count(*) as n, cast(sum(tokens) as bigint) as total from tok group by 1)
select arm, n, total, case when n >= {FLOOR} then cast(floor((d[(n - 1) // 2 + 1] + d[n // 2 + 1]) / 2 + 0.5) as bigint) end as median,
  case when n >= {FLOOR} then cast(floor(total / n + 0.5) as bigint) end as mean, n >= {FLOOR} as publishable from a"""


def check_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select(
        F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.col("turn").cast("string")).alias("decision_id"),
        F.lit("review_gate").alias("tool"), t.prompt_hash(F.col("text")).alias("hash"),
        (F.col("turn") * 60000 + 50000 + F.col("conv_id") % 90 * 1000).alias("ts"),
        assign_arm([F.col("conv_id"), F.col("turn")], "check").alias("arm"),
    )


def j15_nearest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = events(spark, sf_dir).where("kind = 'check'").select(
        "tool", "hash", "ts", F.concat_ws("/", F.lpad(F.col("session_id").cast("string"), 12, "0"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("call_id")
    )
    return s.nearest_calls(check_decisions(spark, sf_dir), calls)


# Decision by decision of a key: the nearest call that none before took; of calls equally near the earlier one, of
# simultaneous ones the last before and the first after.
J15_CTE = EVENTS_CTE + """,
calls as (select *, lpad(cast(session_id as varchar), {width}, '0') || '/' || lpad(cast(seq as varchar), 20, '0') as call_id from ev where kind = 'check'),
cs as (select *, row_number() over (partition by hash order by ts, call_id) as place from calls),
ds as (select *, row_number() over (partition by hash order by ts, decision_id) as n from (
  select lpad(cast(conv_id as varchar), 12, '0') || '-' || turn as decision_id, conv_id, turn, substr(sha256(text), 1, 16) as hash, turn * 60000 + 50000 + conv_id % 90 * 1000 as ts
  from conversations where role = 'assistant')),
taken(hash, n, decision_id, call_id, used) as (
  select hash, 0, null::varchar, null::varchar, []::varchar[] from (select distinct hash from ds)
  union all
  select hash, n, decision_id, call_id, case when call_id is null then used else list_append(used, call_id) end from (
    select t.hash, d.n, d.decision_id, t.used, arg_min(c.call_id, (abs(c.ts - d.ts), (c.ts >= d.ts)::int, case when c.ts < d.ts then -c.place else c.place end)) as call_id
    from taken t join ds d on d.hash = t.hash and d.n = t.n + 1
    left join cs c on c.hash = d.hash and abs(c.ts - d.ts) < 600000 and not list_contains(t.used, c.call_id)
    group by t.hash, d.n, d.decision_id, t.used)),
joined as (select decision_id, call_id from taken where call_id is not null)"""
J15_SQL = f"""with recursive {J15_CTE.replace('{width}', '12')} select * from joined"""


def a35_check_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.grade_checks(check_decisions(spark, sf_dir), events(spark, sf_dir), 2.5)
    return s.outcome_rates(rows, "arm", FLOOR)


A35K_SQL = f"""with recursive {OUTCOME_CTE.replace(EVENTS_CTE, J15_CTE.replace("lpad(cast(session_id as varchar), {width}, '0')", "cast(session_id as varchar)"))},
pr as (select session_id, seq, last_value(case when kind = 'prompt' then seq end ignore nulls) over (partition by session_id order by ts, seq rows between unbounded preceding and 1 preceding) as prompt_seq, kind from ev),
gr as (select c.session_id, p.prompt_seq, arg_min(case when ('0x' || substr(sha256('check:' || d.conv_id || ':' || d.turn), 1, 8))::bigint / 4294967296.0 < 0.5 then 'shown' else 'withheld' end, (d.ts, d.decision_id)) as arm
  from joined j join ds d using (decision_id) join calls c on c.call_id = j.call_id join pr p on p.session_id = c.session_id and p.seq = c.seq and p.kind = 'check' where p.prompt_seq is not null group by 1, 2),
oc as (select gr.arm, o.* from gr join outcomes o on o.session_id = gr.session_id and o.seq = gr.prompt_seq),
c as (select arm, count(*) as prompts, count(*) filter (follow_up) as graded, count(*) filter (corrected) as corrected, count(reworked) as editing, count(*) filter (reworked) as reworked from oc group by 1),
m as (select arm, prompts, 'corrected' as measure, corrected as hits, graded as n from c union all select arm, prompts, 'reworked', reworked, editing from c)
select *, {sql_proportion('hits', 'n', FLOOR)} from m"""


# Raw transcripts rebuilt from the table.
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.format_string("2024-01-01T%02d:%02d:30Z", F.floor(F.col("turn") / 60), F.col("turn") % 60)
    head = [stamp.alias("timestamp"), F.col("conv_id").cast("string").alias("sessionId"), (F.col("conv_id") % 10 == 9).alias("isSidechain")]
    user = F.to_json(F.struct(F.lit("user").alias("type"), *head, (F.col("turn") == 4).alias("isMeta"), F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    n = F.length("text")
    tool = F.struct(
        F.lit("tool_use").alias("type"),
        F.when(n % 3 == 0, "Edit").when(n % 3 == 1, "mcp__x__review_gate").otherwise("Read").alias("name"),
        F.struct(F.col("text").alias("file_path"), F.col("text").alias("query")).alias("input"),
    )
    bill = F.struct(n.alias("input_tokens"), (n * 2).alias("cache_read_input_tokens"), n.alias("cache_creation_input_tokens"),
                    F.struct((n * 2).alias("ephemeral_1h_input_tokens")).alias("cache_creation"), (n * 3).alias("output_tokens"))
    reply = F.to_json(F.struct(F.lit("assistant").alias("type"), *head, F.struct(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 4).cast("string")).alias("id"), F.array(tool).alias("content"), bill.alias("usage")).alias("message")))
    queue = F.to_json(F.struct(F.lit("queue-operation").alias("type"), *head, F.lit("enqueue").alias("operation"), F.concat(F.lit("<bash-input>"), F.col("text")).alias("content")))
    line = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).otherwise(queue)
    return table(spark, sf_dir, "conversations").select(line.alias("value"), "conv_id", "turn")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines as files, read back under their numbers."""
    return numbered_lines(spark, as_text_files(transcript_lines(spark, sf_dir), ["conv_id", "turn"])).select("value", F.col("number").alias("line"))


def s7_read_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.parse_sessions(transcripts(spark, sf_dir)).select("session_id", "seq", "ts", "kind", "file", "tool", "hash")


S7_SQL = """with a as (select *, row_number() over (order by conv_id, turn) - 1 as line from conversations),
c as (select *, length(text) as n, cast(conv_id as varchar) as session_id, line * 1048576 as seq, 1704067230000 + turn * 60000 as ts from a where conv_id % 10 <> 9)
select session_id, seq, ts, 'prompt' as kind, null as file, null as tool, substr(sha256(trim(text)), 1, 16) as hash from c where role = 'user' and turn <> 4
union all select session_id, seq, ts, case n % 3 when 0 then 'edit' else 'check' end, case n % 3 when 0 then text end, case n % 3 when 1 then 'review_gate' end,
  case n % 3 when 1 then substr(sha256(trim(text)), 1, 16) end from c where role = 'assistant' and n % 3 < 2
union all select session_id, seq, ts, 'harness', null, null, substr(sha256('<bash-input>' || text), 1, 16) from c where role = 'system'"""


def s8_read_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.parse_usage(transcripts(spark, sf_dir))


S8_SQL = """with c as (select *, length(text) as n from conversations where conv_id % 10 <> 9 and role = 'assistant'),
f as (select conv_id, turn // 4 as g, arg_min(n, turn) as n, min(turn) as turn from c group by 1, 2)
select cast(conv_id as varchar) as session_id, 'm' || conv_id || '-' || g as message_id, 1704067230000 + turn * 60000 as ts,
  cast(floor(n * 1.0::double + n * 2 * 0.1::double + n * 2.0::double + n * 3 * 5.0::double + 0.5) as bigint) as weighted from f"""


QUERIES = {
    "w3_prompt_outcomes": (w3_prompt_outcomes, W3_SQL),
    "w5_drop_repeated_prompts": (w5_drop_repeated_prompts, W5_SQL),
    "j15_nearest_calls": (j15_nearest_calls, J15_SQL),
    "j16_prompts_by_hash": (j16_prompts_by_hash, J16_SQL),
    "j17_checks_with_prompt": (j17_checks_with_prompt, J17_SQL),
    "j18_turn_tokens": (j18_turn_tokens, J18_SQL),
    "j20_agent_calls": (j20_agent_calls, J20_SQL),
    "a35_outcome_rates": (a35_outcome_rates, A35_SQL),
    "a35_billed_summary": (a35_billed_summary, A35B_SQL),
    "a35_check_outcomes": (a35_check_outcomes, A35K_SQL),
    "s7_read_sessions": (s7_read_sessions, S7_SQL),
    "s8_read_usage": (s8_read_usage, S8_SQL),
}
