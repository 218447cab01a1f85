"""Outcome grading over orders (changes) and line items (repairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.operators import grading as g
from tallywake.plans.tables import CHANGES_CTE, changes, epoch_s, sql_proportion, sql_round3, table

WINDOW = 365
FLOOR = 30
WEIGHTS = {"1-URGENT": 3, "2-HIGH": 3, "3-MEDIUM": 2, "4-NOT SPECIFIED": 0, "big order": 6, "never seen": 2}
WITHIN = f"coalesce(repaired_after <= {WINDOW * 86400}, false)"


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    flags = F.array_compact(
        F.array(
            F.when(F.col("priority") != "5-LOW", F.col("priority")),
            F.when(F.col("price") >= 400000, F.lit("big order")),
        )
    )
    return rows.withColumn("flags", flags)


FLAGGED_CTE = (
    CHANGES_CTE
    + """,
flagged as (
  select *, list_filter([case when priority <> '5-LOW' then priority end, case when price >= 400000 then 'big order' end],
                        lambda x: x is not null) as flags
  from changes)
"""
)
WEIGHT_ROWS = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())


def a3_flag_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.grade_flags(flagged(spark, sf_dir), WINDOW, FLOOR, WEIGHTS)


A3_SQL = f"""
with {FLAGGED_CTE},
base as (select count(*) as n, sum(case when {WITHIN} then 1 else 0 end) as hits from flagged),
weights(name, weight) as (values {WEIGHT_ROWS}),
exploded as (
  select unnest(case when len(flags) = 0 then ['(no flag)'] else flags end) as name, {WITHIN} as hit from flagged),
counted as (select name, count(*) as n, cast(sum(case when hit then 1 else 0 end) as bigint) as repaired from exploded group by 1),
names as (select name from counted union select name from weights union select '(no flag)'),
rows as (
  select names.name, w.weight, coalesce(c.n, 0) as n, coalesce(c.repaired, 0) as repaired,
         cast(base.hits as double) / base.n as base_rate
  from names left join weights w using (name) left join counted c using (name), base),
graded as (
  select name, weight, n, repaired, {sql_proportion('repaired', 'n', FLOOR)},
         case when n >= {FLOOR} and base_rate <> 0 then {sql_round3('cast(repaired as double) / n / base_rate')} end as lift
  from rows)
select *, row_number() over (order by coalesce(lift, -1) desc, n desc, name) as position from graded
"""


def a4_level_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flagged(spark, sf_dir)
    return g.grade_groups(
        rows, g.band_of_flags(F.col("flags"), WEIGHTS), ["low", "medium", "high"], WINDOW, FLOOR, rounded_base=False
    ).where(F.col("name") != g.BASE)


def _groups_sql(cte: str, source: str, group: str, order: list[str], rounded: bool, keep_base: bool = False) -> str:
    names = ", ".join(f"('{n}')" for n in order)
    base = sql_round3("cast(base.hits as double) / base.n") if rounded else "cast(base.hits as double) / base.n"
    share = sql_round3("cast(repaired as double) / n") if rounded else "cast(repaired as double) / n"
    r = [f"max(case when name = '{n}' then rate end) over ()" for n in order[:3]]
    return f"""
with {cte},
tagged as (select {group} as name, {WITHIN} as hit from {source}),
base as (select count(*) as n, sum(case when hit then 1 else 0 end) as hits from tagged),
names(name) as (values {names}),
counted as (select name, count(*) as n, cast(sum(case when hit then 1 else 0 end) as bigint) as repaired from tagged
            where name is not null group by 1),
rows as (select name, coalesce(c.n, 0) as n, coalesce(c.repaired, 0) as repaired, {base} as base_rate
         from (select name from names union select name from counted) left join counted c using (name), base),
graded as (
  select name, n, repaired, {sql_proportion('repaired', 'n', FLOOR)},
         case when n >= {FLOOR} and base_rate <> 0 then {sql_round3(f'{share} / base_rate')} end as lift
  from rows)
select *, case when {r[0]} is not null and {r[1]} is not null and {r[2]} is not null
          then {r[0]} < {r[1]} and {r[1]} < {r[2]} end as monotonic
from graded
"""


A4_SQL = _groups_sql(
    FLAGGED_CTE
    + """,
banded as (
  select *, list_sum(list_transform(flags, lambda f: case f when '1-URGENT' then 3 when '2-HIGH' then 3 when '3-MEDIUM' then 2
                                                       when 'big order' then 6 else 0 end)) as score from flagged)""",
    "banded",
    "case when score >= 9 then 'high' when score >= 4 then 'medium' else 'low' end",
    ["low", "medium", "high"],
    rounded=False,
)


def a5_window_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.window_sweep(changes(spark, sf_dir), (7, 14, 30, 60, 90, 365))


A5_SQL = f"""
with {CHANGES_CTE},
days(days) as (values (7), (14), (30), (60), (90), (365)),
n as (select count(*) as n from changes)
select days, max(n.n) as n, count(sha) as repaired, {sql_round3('cast(count(sha) as double) / max(n.n)')} as rate
from n, days left join changes on repaired_after <= days * 86400
group by days
"""


def a6_verdict_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.grade_verdicts(changes(spark, sf_dir), WINDOW, FLOOR)


A6V_SQL = f"""
with {CHANGES_CTE},
tagged as (select verdict as name, {WITHIN} as hit from changes
           union all select 'alarmed', {WITHIN} from changes where verdict <> 'PASS'
           union all select '(base)', {WITHIN} from changes),
rows as (select name, count(*) as n, cast(sum(case when hit then 1 else 0 end) as bigint) as repaired from tagged group by 1),
graded as (select name, n, repaired, {sql_proportion('repaired', 'n', FLOOR)} from rows),
base as (select rate as b from graded where name = '(base)'),
ends as (select max(case when name = 'PASS' then ci_high end) as p, max(case when name = 'alarmed' then ci_low end) as a from graded)
select name, n, repaired, rate, ci_low, ci_high, publishable,
       case when name <> '(base)' and b <> 0 then {sql_round3('rate / b')} end as lift,
       case when p is not null and a is not null then a > p end as separates
from graded, base, ends
"""


def a6_alarm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).withColumn("repo_id", F.col("repo_id") % 25)
    return g.alarm_summary(rows, WINDOW, FLOOR, by=["repo_id"])


A6A_SQL = f"""
with {CHANGES_CTE},
c as (select repo_id % 25 as repo_id, count(*) as gated, count(*) filter (verdict <> 'PASS') as alarmed,
             count(*) filter ({WITHIN}) as repaired, count(*) filter (verdict <> 'PASS' and {WITHIN}) as caught
      from changes group by 1),
m as (select repo_id, 'alarm rate' as measure, alarmed as hits, gated as n from c
      union all select repo_id, 'false alarms', alarmed - caught, alarmed from c
      union all select repo_id, 'caught', caught, repaired from c)
select repo_id, measure, hits, n, {sql_proportion('hits', 'n', FLOOR)} from m
"""


def a6_check_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Checks of a change: its line items; 'A' warned and 'R' failed, per line number.
    items = table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("check "), F.col("l_linenumber").cast("string"))
    raised = items.groupBy(F.col("l_orderkey").alias("sha")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "A", name)).alias("warned"),
        F.collect_set(F.when(F.col("l_returnflag") == "R", name)).alias("failed"),
    )
    return g.grade_checks(changes(spark, sf_dir).join(raised, "sha", "left"), WINDOW, FLOOR)


A6C_SQL = f"""
with {CHANGES_CTE},
raised as (select distinct l_orderkey as sha, 'check ' || l_linenumber as name from lineitem where l_returnflag in ('A', 'R')),
base as (select {sql_round3(f'avg(case when {WITHIN} then 1.0::double else 0.0::double end)')} as b from changes),
rows as (select name, count(*) as n, cast(sum(case when {WITHIN} then 1 else 0 end) as bigint) as repaired
         from raised join changes using (sha) group by 1),
graded as (select name, n, repaired, {sql_proportion('repaired', 'n', FLOOR)} from rows),
lifted as (select *, case when b <> 0 then {sql_round3('rate / b')} end as lift from graded, base)
select name, n, repaired, rate, ci_low, ci_high, publishable, lift,
       row_number() over (order by coalesce(lift, -1) desc, n desc, name) as position from lifted
"""


def a7_band_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    score = F.when(F.col("price") >= 20000, F.floor(F.col("price") / 5000))
    return g.grade_groups(rows, g.convergence_band(score), ["aligned", "partial", "drift", "inconclusive"], WINDOW, FLOOR)


A7_SQL = (
    _groups_sql(
        CHANGES_CTE,
        "(select * from changes union all by name select * replace (null as price) from changes where false)",
        "case when price < 20000 then 'inconclusive' when floor(price / 5000) >= 80 then 'aligned' "
        "when floor(price / 5000) >= 50 then 'partial' else 'drift' end",
        ["aligned", "partial", "drift", "inconclusive"],
        rounded=True,
    )
    + f"""
union all
select '(base)', n, hits, {sql_proportion('hits', 'n', FLOOR)}, null,
  (select case when count(rate) = 3 then max(case when name = 'aligned' then rate end) < max(case when name = 'partial' then rate end)
     and max(case when name = 'partial' then rate end) < max(case when name = 'drift' then rate end) end
   from graded where name in ('aligned', 'partial', 'drift'))
from (select n, cast(hits as bigint) as hits from base)
"""
)


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    price = F.col("price")
    deterministic = F.when(price < 150000, "cheap").when(price < 350000, "mid").otherwise("premium")
    offline = F.when(F.col("priority") == "5-LOW", "cheap").when(F.col("priority").isin("1-URGENT", "2-HIGH"), "premium")
    return rows.withColumn(
        "tiers", F.create_map(F.lit("deterministic"), deterministic, F.lit("offline"), offline.otherwise(F.lit("mid")),
                              F.lit("model"), F.when(F.col("verdict") == "WARN", deterministic))
    )


def a8_tier_regret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.grade_tiers(tiered(spark, sf_dir), WINDOW, FLOOR)


A8_SQL = f"""
with {CHANGES_CTE},
t as (select *, case when price < 150000 then 'cheap' when price < 350000 then 'mid' else 'premium' end as det,
      case when priority = '5-LOW' then 'cheap' when priority in ('1-URGENT', '2-HIGH') then 'premium' else 'mid' end as off from changes),
long as (select 'deterministic' as variant, det as tier, {WITHIN} as hit from t
         union all select 'offline', off, {WITHIN} from t
         union all select 'model', det, {WITHIN} from t where verdict = 'WARN'),
doubled as (select variant, tier, hit from long union all select variant, '(base)', hit from long),
rows as (select variant, tier, count(*) as n, cast(sum(case when hit then 1 else 0 end) as bigint) as repaired from doubled group by 1, 2),
graded as (select variant, tier, n, repaired, {sql_proportion('repaired', 'n', FLOOR)} from rows),
wide as (select *, max(case when tier = '(base)' then rate end) over (partition by variant) as b,
         max(case when tier = 'cheap' then rate end) over (partition by variant) as c,
         max(case when tier = 'mid' then rate end) over (partition by variant) as m,
         max(case when tier = 'premium' then rate end) over (partition by variant) as p,
         max(case when tier = 'cheap' then repaired end) over (partition by variant) as contradicted from graded)
select variant, tier, n, repaired, rate, ci_low, ci_high, publishable, contradicted,
       case when tier <> '(base)' and b <> 0 and n >= {FLOOR} then {sql_round3('cast(repaired as double) / n / b')} end as lift,
       case when c is not null and m is not null and p is not null then c < m and m < p end as monotonic
from wide
"""


def a9_answer_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).withColumn("answer", F.col("price") / 500000)
    return g.answer_spread(rows, ["priority"], "answer")


A9_SQL = f"""
with {CHANGES_CTE}
select priority, count(price) as n, {sql_round3('avg(price / 500000)')} as mean, {sql_round3('min(price / 500000)')} as min,
       {sql_round3('max(price / 500000)')} as max, {sql_round3('stddev_pop(price / 500000)')} as stdev
from changes group by 1
"""


SUBJECT_SQL = """case o_orderpriority when '1-URGENT' then 'fix(api): order ' || o_orderkey
  when '2-HIGH' then 'chore(release): publish v1.' || o_orderkey when '3-MEDIUM' then 'feat: order ' || o_orderkey || ' (#12)'
  when '4-NOT SPECIFIED' then 'hotfix order' else 'prefix order ' || o_orderkey end"""


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_orderkey") / 1000).alias("repo_id"),
        F.col("o_orderkey").alias("sha"),
        F.when(F.col("o_orderkey") % 50 != 0, F.array(F.col("o_orderkey") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"),
        epoch_s("o_orderdate").alias("time"),
        F.expr(SUBJECT_SQL).alias("subject"),
        F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("code_files"),
        "o_orderstatus",
    )


COMMITS_CTE = f"""
commits as (
  select o_orderkey // 1000 as repo_id, o_orderkey as sha, case when o_orderkey % 50 <> 0 then o_orderkey - 1 end as parent,
         cast(epoch(o_orderdate) as bigint) as time, {SUBJECT_SQL} as subject,
         case when o_orderstatus = 'O' then 0 else 1 end as code_files
  from orders),
subjects as (
  select *, regexp_matches(subject, '(?i)^(fix(es|ed|ing)?|hot-?fix|hot-fit|bug(s|fix)?|patch|revert)\\b') as is_fix,
     regexp_matches(subject, '(?i)\\[skip ci\\]|^v?\\d+\\.\\d+(\\.\\d+)?\\s*$')
     or (regexp_matches(subject, '(?i)^(chore|build|ci|release)\\b') and regexp_matches(subject, '(?i)\\b(release|version|prepare|publish)\\b')
         and regexp_matches(subject, '(?i)\\bv?\\d+\\.\\d+')) as is_release
  from commits)
"""


def a11_corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.corpus_counts(commits(spark, sf_dir), WINDOW, by=["repo_id"])


A11_SQL = f"""
with {COMMITS_CTE},
h as (select *, max(time) over (partition by repo_id) - time >= {WINDOW * 86400} as old,
      not is_fix and parent is not null and trim(subject) <> '' as request from subjects)
select repo_id, count(*) as commits,
  count(*) filter (request and not is_release and code_files > 0) as candidates,
  count(*) filter (request and not is_release and code_files > 0 and not old) as censored,
  count(*) filter (request and is_release) as releases,
  count(*) filter (request and not is_release and code_files = 0) as docs_only,
  count(*) filter (request and not is_release and code_files > 0 and old) as replayed,
  count(*) filter (is_fix and parent is not null) as fixes
from h group by 1
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.col("l_orderkey") - 1
    arm = g.assign_arm([F.floor(F.col("l_orderkey") / 1000), head], "trial")
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 1000).alias("repo_id"),
        head.alias("head"),
        F.struct("l_shipdate", "l_linenumber").alias("seq"),
        arm.alias("arm"),
        ((arm == "withheld") & (F.col("l_returnflag") != "R")).alias("withheld"),
        F.when((arm == "withheld") & (F.col("l_returnflag") == "R"), "blocking-fail").alias("shown_because"),
    )


def repaired_by_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).select(
        F.floor(F.col("sha") / 1000).alias("repo_id"), "sha", "repaired_after"
    )


def a12_trial_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.grade_trial(decisions(spark, sf_dir), commits(spark, sf_dir), repaired_by_sha(spark, sf_dir), WINDOW, FLOOR)


ARM_SQL = """case when ('0x' || substr(sha256('trial:' || (l_orderkey // 1000) || ':' || (l_orderkey - 1)), 1, 8))::bigint / 4294967296.0 < 0.5
   then 'shown' else 'withheld' end"""

A12_SQL = f"""
with {CHANGES_CTE}, {COMMITS_CTE},
d as (select l_orderkey // 1000 as repo_id, l_orderkey - 1 as head, {ARM_SQL} as arm, l_returnflag as flag from lineitem),
units as (select repo_id, head, any_value(arm) as arm, count(*) as checks,
                 count(*) filter (arm = 'withheld' and flag = 'R') as because from d group by 1, 2),
firsts as (select repo_id, parent as head, arg_min(sha, (time, sha)) as sha from commits where parent is not null group by 1, 2),
horizon as (select repo_id, max(time) as horizon from commits group by 1),
u as (select units.*, s.sha, s.is_fix, s.time, horizon.horizon, c.repaired_after,
        s.sha is not null and not s.is_fix and horizon.horizon - s.time >= {WINDOW * 86400} as gradable
      from units left join firsts using (repo_id, head) left join subjects s on s.sha = firsts.sha
      left join horizon on horizon.repo_id = units.repo_id left join changes c on c.sha = firsts.sha),
arms as (select arm, count(*) as changes, cast(sum(checks) as bigint) as checks, count(sha) as committed,
      count(*) filter (is_fix) as fix_commits, count(*) filter (sha is not null and not is_fix and not gradable) as censored,
      count(*) filter (because > 0) as shown_because_blocking,
      count(*) filter (gradable and {WITHIN}) as repaired, count(*) filter (gradable) as graded from u group by 1),
p as (select *, {sql_proportion('repaired', 'graded', FLOOR)} from arms)
select *, (select max(case when arm = 'shown' then ci_high end) < max(case when arm = 'withheld' then ci_low end) from p) as fewer_when_shown from p
"""


def j19_child_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = decisions(spark, sf_dir).select("repo_id", "head").distinct()
    return g.child_commits(heads, commits(spark, sf_dir))


J19_SQL = f"""
with {COMMITS_CTE},
firsts as (select repo_id, parent as head, arg_min(sha, (time, sha)) as sha from commits where parent is not null group by 1, 2),
heads as (select distinct l_orderkey // 1000 as repo_id, l_orderkey - 1 as head from lineitem)
select heads.repo_id, heads.head, c.sha, c.time, c.subject
from heads left join firsts using (repo_id, head) left join commits c on c.sha = firsts.sha
"""


# Line ranges: a returned item rewrites lines of its part; other items own lines of theirs.
def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 8
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.lit(0).alias("repo_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), epoch_s("l_shipdate").cast("string")).alias("fix_sha"),
        F.col("l_linestatus").alias("at_sha"), F.col("l_partkey").alias("path"),
        start.cast("bigint").alias("from_line"), (start + F.col("l_quantity")).cast("bigint").alias("to_line"),
        epoch_s("l_shipdate").alias("time"),
    )


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 8
    return table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(
        F.lit(0).alias("repo_id"), F.col("l_linestatus").alias("at_sha"), F.col("l_partkey").alias("path"),
        start.cast("bigint").alias("from_line"), (start + F.col("l_quantity")).cast("bigint").alias("to_line"),
        F.col("l_orderkey").alias("owner_sha"),
    )


def j1_repair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hunks(spark, sf_dir)
    fixes = h.select("repo_id", F.col("fix_sha").alias("sha"), "time").distinct()
    orders = table(spark, sf_dir, "orders").select(
        F.lit(0).alias("repo_id"), F.col("o_orderkey").alias("sha"), epoch_s("o_orderdate").alias("time")
    )
    return g.repair_join(h, owners(spark, sf_dir), fixes, orders).select("sha", "repaired_after")


J1_SQL = """
with h as (select l_orderkey || ':' || l_linenumber || ':' || cast(epoch(l_shipdate) as bigint) as fix_sha, l_linestatus as at_sha, l_partkey as path,
             l_linenumber * 8 as a, l_linenumber * 8 + cast(l_quantity as bigint) as b, cast(epoch(l_shipdate) as bigint) as time
           from lineitem where l_returnflag = 'R'),
o as (select l_orderkey as sha, l_linestatus as at_sha, l_partkey as path, l_linenumber * 8 as a,
             l_linenumber * 8 + cast(l_quantity as bigint) as b from lineitem where l_returnflag <> 'R')
select o.sha, min(h.time - cast(epoch(o_orderdate) as bigint)) as repaired_after
from h join o on h.path = o.path and h.at_sha = o.at_sha and o.a <= h.b and h.a <= o.b join orders on o_orderkey = o.sha
where h.time >= cast(epoch(o_orderdate) as bigint)
group by 1
"""


def j2_file_repair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", epoch_s("o_orderdate").alias("time"))
    changed = items.where("l_returnflag <> 'R'").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("repo_id"), F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), "time"
    )
    fixed = items.where("l_returnflag = 'R'").select(
        F.col("l_suppkey").alias("repo_id"), F.col("l_partkey").alias("path"), epoch_s("l_shipdate").alias("time")
    )
    return g.file_repair_join(changed, fixed).select("repo_id", F.col("sha").cast("bigint").alias("sha"), "repaired_after")


J2_SQL = """
select c.l_suppkey as repo_id, c.l_orderkey as sha,
       min(cast(epoch(f.l_shipdate) as bigint) - cast(epoch(o_orderdate) as bigint)) as repaired_after
from lineitem c join orders on o_orderkey = c.l_orderkey
join lineitem f on f.l_suppkey = c.l_suppkey and f.l_partkey = c.l_partkey and f.l_returnflag = 'R' and f.l_shipdate >= o_orderdate
where c.l_returnflag <> 'R' group by 1, 2
"""


def p14_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("v", F.floor("value"))
    return rows.groupBy(
        g.convergence_band(F.when(F.col("v") < 400, F.col("v"))).alias("convergence"),
        g.risk_level(F.col("v")).alias("risk"),
        g.experience_band(F.col("v")).alias("experience"),
    ).agg(F.count("*").alias("n"))


P14_SQL = """
select case when floor(value) >= 400 then 'inconclusive' when floor(value) >= 80 then 'aligned' when floor(value) >= 50 then 'partial' else 'drift' end as convergence,
  case when floor(value) >= 9 then 'high' when floor(value) >= 4 then 'medium' else 'low' end as risk,
  case when floor(value) >= 80 then 'excellent' when floor(value) >= 60 then 'good' when floor(value) >= 40 then 'fair' else 'poor' end as experience,
  count(*) as n
from events group by 1, 2, 3
"""


def p15_assign_arm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arm = g.assign_arm([F.floor(F.col("l_orderkey") / 1000), F.col("l_orderkey") - 1], "trial")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", arm.alias("arm")).groupBy("l_orderkey", "arm").agg(F.count("*").alias("n"))


P15_SQL = f"select l_orderkey, {ARM_SQL} as arm, count(*) as n from lineitem group by 1, 2"


def p8_subject_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = commits(spark, sf_dir)
    return rows.groupBy(
        "repo_id", g.is_fix_subject(F.col("subject")).alias("is_fix"), g.is_release_subject(F.col("subject")).alias("is_release")
    ).agg(F.count("*").alias("n"))


P8_SQL = f"with {COMMITS_CTE} select repo_id, is_fix, is_release, count(*) as n from subjects group by 1, 2, 3"


QUERIES = {
    "a3_flag_calibration": (a3_flag_calibration, A3_SQL),
    "a4_level_calibration": (a4_level_calibration, A4_SQL),
    "a5_window_sweep": (a5_window_sweep, A5_SQL),
    "a6_verdict_calibration": (a6_verdict_calibration, A6V_SQL),
    "a6_alarm_summary": (a6_alarm_summary, A6A_SQL),
    "a6_check_calibration": (a6_check_calibration, A6C_SQL),
    "a7_band_calibration": (a7_band_calibration, A7_SQL),
    "a8_tier_regret": (a8_tier_regret, A8_SQL),
    "a9_answer_spread": (a9_answer_spread, A9_SQL),
    "a11_corpus_counts": (a11_corpus_counts, A11_SQL),
    "a12_trial_arms": (a12_trial_arms, A12_SQL),
    "j1_repair_join": (j1_repair_join, J1_SQL),
    "j2_file_repair_join": (j2_file_repair_join, J2_SQL),
    "j19_child_commits": (j19_child_commits, J19_SQL),
    "p8_subject_predicates": (p8_subject_predicates, P8_SQL),
    "p14_bands": (p14_bands, P14_SQL),
    "p15_assign_arm": (p15_assign_arm, P15_SQL),
}
