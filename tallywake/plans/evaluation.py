"""Evaluation and ledgers over documents, labels, conversations and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.operators import evaluation as e
from tallywake.operators import ledger as l
from tallywake.plans.tables import as_text_files, sql_round3, table
from tallywake.sources.lines import numbered_lines

K = 5


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source, longest first; the first ten are the ranking."""
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").withColumn("rank", F.row_number().over(order)).where("rank <= 10")
    return docs.select(F.col("source").alias("case"), "rank", F.col("doc_id").alias("path"), F.when(F.col("rank") <= 6, "primary").otherwise("related").alias("section"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return table(spark, sf_dir, "labels").where("quality = 1").join(docs, "doc_id").select(F.col("source").alias("case"), F.col("doc_id").alias("path"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("case")).distinct().withColumn("known_gap", F.col("case") == "src5")


METRICS_CTE = f"""
r as (select * from (select source as c, doc_id as path, row_number() over (partition by source order by n_chars desc, doc_id) as rank from documents) where rank <= 10),
t as (select d.source as c, doc_id as path from labels join documents d using (doc_id) where quality = 1),
cs as (select distinct source as c from documents),
f as (select r.c, count(*) as returned, count(t.path) as hits, min(case when t.path is not null then rank end) as first from r left join t on t.c = r.c and t.path = r.path where rank <= {K} group by 1),
w as (select c, count(*) as relevant from t group by 1),
m as (select cs.c, case when relevant > 0 then coalesce(hits, 0) else 0 end as hits, coalesce(relevant, 0) as relevant, case when relevant > 0 then hits::double / returned end as precision,
  case when relevant > 0 then hits::double / relevant end as recall, case when relevant > 0 then coalesce(1.0::double / first, 0) end as mrr from cs left join f on f.c = cs.c left join w on w.c = cs.c)
"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.retrieval_metrics(cases(spark, sf_dir).select("case"), rankings(spark, sf_dir), truth(spark, sf_dir), K)


def a16_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir)


A16_SQL = f'with {METRICS_CTE} select c as "case", hits, relevant, precision, recall, mrr from m'


def a16_retrieval_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.retrieval_board(metrics(spark, sf_dir))


A16B_SQL = f"with {METRICS_CTE} select count(*) as cases, count(precision) as scored, {sql_round3('avg(precision)')} as precision, {sql_round3('avg(recall)')} as recall, {sql_round3('avg(mrr)')} as mrr from m"


def a17_case_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = truth(spark, sf_dir)
    return e.case_results(cases(spark, sf_dir), rankings(spark, sf_dir), every, every, K)


A17_SQL = f"""with {METRICS_CTE},
n as (select t.c, count(*) = count(r.path) as ok from t left join r on r.c = t.c and r.path = t.path and rank <= {K} group by 1),
a as (select t.c, count(r.path) > 0 as ok from t left join r on r.c = t.c and r.path = t.path group by 1)
select cs.c as "case", cs.c = 'src5' as known_gap, coalesce(n.ok, true) and coalesce(a.ok, true) as passed from cs left join n using (c) left join a using (c)"""


HISTORY_SUBJECT = """case o_orderkey % 9 when 0 then 'chore(release): v1.2' when 1 then concat('feat(api)!: Item ', cast(o_orderkey % 40 as varchar(9)), ' (#12)') when 2 then 'Bump deps' when 3 then 'fix: '
  when 4 then concat('item ', cast(o_orderkey % 40 as varchar(9))) when 5 then '1.2.3' else concat('docs: note ', cast(o_orderkey as varchar(19))) end"""


def history_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("files"))
    return table(spark, sf_dir, "orders").join(counts, "o_orderkey", "left").select(
        F.floor(n / 1000).alias("repo_id"), n.alias("sha"), F.when(n % 50 != 0, (n - 1).cast("string")).alias("parent"),
        F.when(n % 31 == 0, "renovate[bot] <x>").otherwise("dev <y>").alias("author"), F.expr(HISTORY_SUBJECT).alias("subject"), F.col("o_orderdate").alias("time"),
        F.coalesce("files", F.lit(0)).alias("expected_files"),
    )


def a18_history_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.history_cases(history_commits(spark, sf_dir), 6)


HISTORY_CTE = f"""
h0 as (select o_orderkey // 1000 as repo_id, o_orderkey as sha, o_orderkey % 50 = 0 as root, o_orderkey % 31 = 0 as bot, {HISTORY_SUBJECT} as subject, o_orderdate as time,
   (select count(*) from lineitem where l_orderkey = o_orderkey) as files from orders),
h1 as (select *, trim(regexp_replace(regexp_replace(subject, '(?i)^[a-z]+(\\([^)]*\\))?!?:\\s*', ''), '\\s*\\(#\\d+\\)\\s*$', '')) as query from h0),
h2 as (select *, case when root then 'root commit' when bot then 'bot author' when query = '' or regexp_matches(subject, '(?i)^(merge\\b|revert\\b|chore\\(release\\)|chore\\(deps(-dev)?\\)|bump\\b|release\\b|v?\\d+\\.\\d+\\.\\d+$)')
   or regexp_matches(query, '(?i)^(merge\\b|revert\\b|bump\\b|release\\b|v?\\d+\\.\\d+\\.\\d+$)') then 'release, merge or bump subject' end as early from h1),
h3 as (select *, row_number() over (partition by repo_id, lower(query), early is null order by time desc, sha desc) as n from h2),
hc as (select repo_id, sha, query, files, case when early is not null then early when n > 1 then 'repeated subject' when files = 0 then 'no existing file changed' when files > 6 then 'too many files changed' end as skipped from h3)
"""
A18C_SQL = f"with {HISTORY_CTE} select repo_id, sha, query, skipped from hc"


def a18_history_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored commits ranked by their own items: items returned are expected, quantity orders the ranking."""
    from pyspark.sql import Window

    scored = e.history_cases(history_commits(spark, sf_dir), 6).where("skipped is null").select(F.col("sha").alias("case"), "repo_id")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case"), "l_quantity", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus")
    path = F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string"))
    order = Window.partitionBy("case").orderBy(F.desc("l_quantity"), "l_partkey", "l_linenumber")
    ranked = items.withColumn("rank", F.row_number().over(order)).select("case", "rank", path.alias("path"))
    wanted = items.where("l_returnflag = 'R'").select("case", path.alias("path")).distinct()
    pack = items.groupBy("case").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("needed"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("found"), F.count_if(F.col("l_returnflag") == "N").alias("unindexed"))
    measured = e.retrieval_metrics(scored.select("case"), ranked, wanted, 3)
    return e.history_board(scored, measured, pack, ["repo_id"])


A18B_SQL = f"""with {HISTORY_CTE},
sc as (select sha as c, repo_id from hc where skipped is null),
it as (select l_orderkey as c, l_partkey || '/' || l_linenumber as path, l_returnflag as f, l_linestatus as s, row_number() over (partition by l_orderkey order by l_quantity desc, l_partkey, l_linenumber) as rank from lineitem),
wt as (select distinct c, path from it where f = 'R'),
fd as (select it.c, count(*) as returned, count(wt.path) as hits, min(case when wt.path is not null then rank end) as first from it left join wt on wt.c = it.c and wt.path = it.path where rank <= 3 group by 1),
wn as (select c, count(*) as relevant from wt group by 1),
pk as (select c, count(*) filter (f = 'R') as needed, count(*) filter (f = 'R' and s = 'O') as found, count(*) filter (f = 'N') as unindexed from it group by 1),
a as (select sc.*, relevant, hits, returned, first, needed, found, unindexed from sc left join wn using (c) left join fd using (c) left join pk using (c))
select repo_id, count(*) as cases, count(relevant) as scored, {sql_round3('coalesce(avg(case when relevant > 0 then (hits > 0)::int::double end), 0)')} as hit_at_k,
  {sql_round3('coalesce(avg(hits::double / relevant), 0)')} as r_at_k, {sql_round3('coalesce(avg(case when relevant > 0 then hits::double / returned end), 0)')} as p_at_k,
  {sql_round3('coalesce(avg(case when relevant > 0 then coalesce(1.0::double / first, 0) end), 0)')} as mrr,
  {sql_round3('coalesce(avg(case when relevant > 0 then found::double / needed end), 0)')} as pack_recall, {sql_round3('sum(unindexed)::double / sum(needed + unindexed)')} as unindexed_share from a group by 1"""


def a19_label_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    rows = table(spark, sf_dir, "labels").join(docs, "doc_id")
    actual = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic")))
    expected = F.when(F.col("n_chars") > 2000, F.array(F.lit("good"))).otherwise(F.array().cast("array<string>"))
    return e.label_accuracy(rows.select("source", actual.alias("actual"), expected.alias("expected"), F.array(F.lit("toxic")).alias("forbidden")), ["source"])


A19_SQL = f"""with r as (select source, (n_chars <= 2000 or quality = 1) and toxic = 0 as ok from labels join documents using (doc_id))
select source, count(*) as cases, count(*) filter (ok) as passed, {sql_round3('count(*) filter (ok)::double / count(*)')} as accuracy from r group by 1"""


def a20_threshold_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = a19_label_accuracy(spark, sf_dir)
    floors = table(spark, sf_dir, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("floor"))
    floors = floors.select(F.col("source").alias("metric"), F.when(F.col("source") != "src7", F.floor(F.col("floor") * 1000 + 0.5) / 1000).alias("floor"))
    return e.threshold_checks(acc.select(F.col("source").alias("metric"), F.col("accuracy").alias("value")), floors)


A20_SQL = f"""with r as (select source, (n_chars <= 2000 or quality = 1) and toxic = 0 as ok from labels join documents using (doc_id)),
a as (select source as metric, {sql_round3('count(*) filter (ok)::double / count(*)')} as value from r group by 1),
f as (select source as metric, case when source <> 'src7' then {sql_round3("avg((lang = 'en')::int::double)")} end as floor from documents group by 1)
select metric, value, floor, value >= floor as passed, min(value >= floor) over () as all_passed from a join f using (metric) where floor is not null"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    n, q = F.col("doc_id"), F.col("quality") == 1
    conf = F.least(F.lit(1.0), F.col("n_chars") / 8000.0)
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "lang", "source", "doc_id", F.when(n % 17 == 0, "timeout").alias("error"), q.alias("choice_correct"), (F.col("n_chars") > 1500).alias("accepted"), F.when(n % 5 != 0, conf).alias("confidence"),
        (q | (n % 3 == 0)).alias("applied_correct"), F.when(n % 4 == 0, "unknown").otherwise("fix").alias("heuristic"), (n % 4 == 1).alias("heuristic_correct"),
        F.when(n % 2 == 0, F.col("toxic") == 0).alias("capability_correct"), (F.col("n_chars") / 1000000).alias("cost_usd"), F.col("n_chars").alias("latency_ms"), (n % 3).alias("attempts"))


READS_CTE = """
rd as (select lang, source, doc_id, doc_id % 17 <> 0 as ok, quality = 1 as correct, n_chars > 1500 as accepted, case when doc_id % 5 <> 0 then least(1.0::double, n_chars / 8000.0::double) end as conf,
  quality = 1 or doc_id % 3 = 0 as applied, doc_id % 4 = 0 as unk, doc_id % 4 = 1 as heur, case when doc_id % 2 = 0 then toxic = 0 end as cap, n_chars / 1000000.0::double as cost, n_chars as lat, doc_id % 3 as att
  from labels join documents using (doc_id))
"""


def a21_grade_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.grade_reads(reads(spark, sf_dir), ["lang"])


def _share(hits: str, n: str) -> str:
    return f"case when {n} > 0 then {sql_round3(f'({hits})::double / ({n})')} end"


A21_SQL = f"""with {READS_CTE},
n as (select lang, count(*) as cases, count(*) filter (ok) as read, count(*) filter (ok and correct) as c, count(*) filter (ok and accepted) as a, count(*) filter (ok and accepted and correct) as ac,
  count(*) filter (ok and applied) as ap, count(*) filter (ok and heur) as hc, count(*) filter (ok and unk) as hu, count(cap) filter (ok) as g, count(*) filter (ok and cap) as gc,
  avg(case when ok then pow(conf - correct::int::double, 2) end) as b, sum(cost) filter (ok) as cost, sum(lat) filter (ok) as lat, count(*) filter (ok and att > 1) as retried from rd group by 1)
select lang, cases, read, cases - read as errors, {_share('c', 'read')} as accuracy, {_share('a', 'read')} as accepted_rate, {_share('ac', 'a')} as accepted_accuracy, {_share('ap', 'read')} as applied_accuracy,
  {_share('hc', 'read')} as heuristic_accuracy, hu as heuristic_unknown, {sql_round3('b')} as brier, g as graded, {_share('gc', 'g')} as capability_accuracy,
  floor(cost * 1000000.0 + 0.5) / 1000000.0 as total_usd, cast(floor(lat / read + 0.5) as bigint) as mean_latency_ms, retried from n"""


def a21_confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.confidence_bands(reads(spark, sf_dir), ["lang"])


A21B_SQL = f"""with {READS_CTE},
b(band, lo, hi) as (values ('< 0.5', 0.0::double, 0.5::double), ('0.5 to 0.7', 0.5, 0.7), ('0.7 to 0.9', 0.7, 0.9), ('>= 0.9', 0.9, 1.01)),
k as (select distinct lang from rd)
select k.lang, band, count(conf) as n, {sql_round3('avg(conf)')} as mean_confidence, case when count(conf) > 0 then {sql_round3('count(*) filter (correct)::double / count(conf)')} end as accuracy
from k join b on true left join rd on rd.lang = k.lang and ok and conf >= lo and conf < hi group by 1, 2"""


def a21_relevance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir).select("source", F.col("confidence").alias("relevance"), F.col("choice_correct").alias("expected"))
    return e.relevance_summary(rows, ["source"])


A21R_SQL = f"with {READS_CTE} select source, correct as expected, count(*) as scored, count(*) filter (conf < 0.2) as demoted, {sql_round3('avg(conf)')} as mean_relevance from rd where conf is not null group by 1, 2"


def a22_gate_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gate cases: items are checks, expectations come from the ship date's parity."""
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("case"), F.concat(F.lit("check "), F.col("l_linenumber").cast("string")).alias("name")).agg(
        F.max("l_returnflag").alias("flag"), F.max("l_suppkey").alias("s"))
    status = F.when(F.col("flag") == "R", "FAIL").when(F.col("flag") == "N", "WARN").otherwise("PASS")
    actual = items.select("case", "name", status.alias("status"), F.concat(F.lit("supplier "), F.col("s").cast("string")).alias("summary"))
    expected = items.where("s % 3 = 0").select("case", "name", F.when(F.col("s") % 2 == 0, status).otherwise("FAIL").alias("status"), F.array(F.lit("supplier"), F.lit("6")).alias("contains"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderstatus").alias("expected_verdict"), F.when(F.col("o_custkey") % 4 > 0, F.col("o_orderstatus")).otherwise("X").alias("actual_verdict"))
    return e.score_gate_cases(rows, expected, actual)


A22_SQL = """with i as (select l_orderkey as c, l_linenumber as name, max(l_returnflag) as flag, max(l_suppkey) as s from lineitem group by 1, 2),
x as (select *, case flag when 'R' then 'FAIL' when 'N' then 'WARN' else 'PASS' end as st, case when s % 2 = 0 then case flag when 'R' then 'FAIL' when 'N' then 'WARN' else 'PASS' end else 'FAIL' end as want from i),
w as (select c, count(*) filter (s % 3 = 0 and not (st = want and contains('supplier ' || s, '6'))) as wrong, count(*) filter (st = 'FAIL' and not (s % 3 = 0 and want = 'FAIL')) as unexpected from x group by 1)
select o_orderkey as "case", coalesce(wrong, 0) as wrong, coalesce(unexpected, 0) as unexpected, o_custkey % 4 > 0 and coalesce(wrong, 0) = 0 and coalesce(unexpected, 0) = 0 as passed from orders left join w on w.c = o_orderkey"""


def a34_token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.length(F.regexp_extract("text", r"^([^\n]*)", 1)).alias("used"), F.length("text").alias("naive"))
    return e.token_savings(rows, ["source"])


A34_SQL = """with s as (select source, sum(length(string_split(text, chr(10))[1])) as u, sum(length(text)) as n from documents group by 1)
select source, cast(ceil(u / 4) as bigint) as used_tokens, cast(ceil(n / 4) as bigint) as naive_tokens, cast(ceil(n / 4) - ceil(u / 4) as bigint) as saved_tokens, cast(floor((n - u) / n * 100 + 0.5) as bigint) as saved_pct from s"""


def r12_apply_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("request_id"), F.col("doc_id").alias("path"), F.col("n_chars").alias("rank"))
    scores = reads(spark, sf_dir).where("confidence is not null").select(F.col("source").alias("request_id"), F.col("doc_id").alias("path"), F.col("confidence").alias("relevance"))
    return e.apply_relevance(docs, scores)


R12_SQL = f"""with {READS_CTE},
k as (select * from (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars, doc_id) as n from documents)),
j as (select k.source as request_id, k.doc_id as path, n_chars as old_rank, conf as relevance, coalesce(conf < 0.2, false) as demoted from k left join rd on rd.doc_id = k.doc_id)
select *, case when not demoted then row_number() over (partition by request_id, demoted order by relevance desc nulls last, old_rank, path) end as position from j"""


# ---------------------------------------------------------------- ledgers
def ledger_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger per customer, one record per order in key order."""
    from tallywake.functions.slices import with_running

    orders = table(spark, sf_dir, "orders").withColumn("slice", F.floor(F.col("o_orderkey") / 10000))
    rows = with_running(orders, ["o_custkey"], "slice", ["o_orderkey"], sums={"line": F.lit(1)})
    v = lambda c: F.parse_json(c)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    fields = F.create_map(
        F.lit("verdict"), v(quoted(F.col("o_orderstatus"))), F.lit("mergeSha"), v(quoted(F.sha2(F.col("o_orderkey").cast("string"), 256))),
        F.lit("pr"), v(F.col("o_orderkey").cast("string")), F.lit("author"), v(F.lit("null")), F.lit("riskFlags"), v(F.concat(F.lit('["b", "'), F.col("o_orderpriority"), F.lit('"]'))),
    )
    return rows.select(F.col("o_custkey").alias("ledger"), "line", fields.alias("fields"))


LEDGER_BODY = """'{"author":null,"mergeSha":"' || sha256(o_orderkey || '') || '","pr":' || o_orderkey || ',"prevHash":"' || {prev} || '","riskFlags":["b","' || o_orderpriority || '"],"seq":' || n || ',"verdict":"' || o_orderstatus || '"}'"""
LEDGER_CTE = f"""
o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
chain as (select o_custkey, n, repeat('0', 64) as prev, sha256(repeat('0', 64) || {LEDGER_BODY.replace("{prev}", "repeat('0', 64)")}) as hash from o where n = 1
  union all select o.o_custkey, o.n, c.hash, sha256(c.hash || {LEDGER_BODY.replace('{prev}', 'c.hash').replace('|| n ||', '|| o.n ||')}) from chain c join o on o.o_custkey = c.o_custkey and o.n = c.n + 1)
"""


def s5_append_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.append_records(ledger_fields(spark, sf_dir)).select("ledger", "seq", F.col("prev").alias("prev_hash"), F.col("hash").alias("record_hash"))


S5_SQL = f"with recursive {LEDGER_CTE} select o_custkey as ledger, n as seq, prev as prev_hash, hash as record_hash from chain"


def ledger_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chained records as JSON lines; every 97th record was edited afterwards."""
    done = l.append_records(ledger_fields(spark, sf_dir))
    edited = F.when(F.col("seq") * 7 + F.col("ledger") % 97 == 90, F.replace(F.col("body"), F.lit('"riskFlags":["b"'), F.lit('"riskFlags":["c"'))).otherwise(F.col("body"))
    line = F.concat(F.expr("substring(_b, 1, length(_b) - 1)"), F.lit(',"recordHash":"'), F.col("hash"), F.lit('"}'))
    return done.withColumn("_b", edited).select("ledger", "line", line.alias("value"))


def w6_verify_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.ledger_summary(l.verify_ledger(l.parse_ledger(ledger_lines(spark, sf_dir))))


W6_SQL = f"""with recursive {LEDGER_CTE}
select o_custkey as ledger, count(*) as records, count(*) filter (n * 7 + o_custkey % 97 = 90) as broken, arg_max(hash, n) as tip, 0 as signed from chain group by 1"""


def s4_read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ledgers one after the other in some files; every line is found under its number."""
    folder = as_text_files(ledger_lines(spark, sf_dir), ["ledger", "line"])
    lines = numbered_lines(spark, folder).select("file", F.col("number").alias("ledger"), "line", "value")
    rows = l.parse_ledger(lines)
    return rows.groupBy(F.variant_get("record", "$.verdict", "string").alias("verdict"), F.variant_get("record", "$.riskFlags[1]", "string").alias("flag")).agg(
        F.count("*").alias("records"), F.sum(F.variant_get("record", "$.pr", "bigint")).alias("prs"), F.sum("ledger").alias("numbers"), F.sum(F.col("ledger") * F.variant_get("record", "$.seq", "bigint")).alias("weighted"))


S4_SQL = """with o as (select *, row_number() over (order by o_custkey, o_orderkey) - 1 as number, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
select o_orderstatus as verdict, o_orderpriority as flag, count(*) as records, cast(sum(o_orderkey) as bigint) as prs, cast(sum(number) as bigint) as numbers, cast(sum(number * n) as bigint) as weighted from o group by 1, 2"""


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract per order: its parts are declared, two amendments follow; some are tampered with."""
    n = F.col("o_orderkey")
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))).alias("owners"))
    empty = F.array().cast("array<string>")
    base = table(spark, sf_dir, "orders").join(parts, "o_orderkey").select(n.alias("contract_id"), F.struct(
        F.lit(1).alias("schema"), F.col("o_orderpriority").alias("request"), F.when(n % 3 > 0, n.cast("string")).alias("head"), F.lit(6).alias("impactEngineVersion"), F.reverse("owners").alias("owners"),
        empty.alias("supporting"), empty.alias("dirtyAtDeclaration"), F.when(n % 2 == 0, F.array(F.lit("w"))).alias("terms"), F.when(n % 2 == 0, empty).alias("modules")).alias("contract"))
    hashed = base.withColumn("contract_hash", l.contract_hash(F.col("contract")))
    one = hashed.withColumn("h1", l.amendment_hash(F.col("contract_hash"), F.lit(1), F.array(F.lit("z"), F.lit("a")), F.lit("needed")))
    two = one.withColumn("h2", l.amendment_hash(F.col("h1"), F.lit(2), F.array(F.lit("b")), F.when(F.col("contract_id") % 5 == 0, "late").otherwise("ok")))
    amend = lambda seq, files, reason, prev, h: F.struct(F.lit(seq).alias("seq"), files.alias("files"), reason.alias("reason"), prev.alias("prev_hash"), h.alias("hash"))
    both = F.array(amend(1, F.array(F.lit("a"), F.lit("z")), F.lit("needed"), F.col("contract_hash"), F.col("h1")), amend(2, F.array(F.lit("b")), F.lit("ok"), F.col("h1"), F.col("h2")))
    broken = F.when(F.col("contract_id") % 7 == 0, F.lit("x")).otherwise(F.col("contract_hash"))
    return two.select("contract_id", "contract", broken.alias("contract_hash"), both.alias("amendments"))


def w11_verify_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return l.verify_contracts(contracts(spark, sf_dir))


W11_SQL = """with p as (select l_orderkey as k, list_sort(list(distinct 'p' || l_partkey)) as owners from lineitem group by 1),
c as (select o_orderkey as k, '{"schema":1,"request":"' || o_orderpriority || '","head":' || case when o_orderkey % 3 > 0 then '"' || o_orderkey || '"' else 'null' end || ',"impactEngineVersion":6,"owners":["'
   || array_to_string(owners, '","') || '"],"supporting":[],"dirtyAtDeclaration":[]' || case when o_orderkey % 2 = 0 then ',"terms":["w"],"modules":[]' else '' end || '}' as j from orders join p on p.k = o_orderkey),
h as (select k, sha256(j) as h0 from c),
a as (select k, h0, sha256(h0 || '{"seq":1,"files":["a","z"],"reason":"needed"}') as h1 from h),
b as (select *, sha256(h1 || '{"seq":2,"files":["b"],"reason":"' || case when k % 5 = 0 then 'late' else 'ok' end || '"}') as h2 from a)
select k as contract_id, k % 7 <> 0 and k % 5 <> 0 as valid, k % 7 <> 0 as declared_valid, case when k % 7 = 0 then 1 when k % 5 = 0 then 2 end as broken_amendment, case when k % 7 <> 0 and k % 5 <> 0 then h2 end as tip from b"""


def a39_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("change_id"), "l_partkey")
    scalars = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), F.to_json(F.struct("o_orderpriority", "o_orderstatus")).alias("payload"))
    return l.receipts(rows, ["change_id"], F.col("l_partkey"), scalars)


A39_SQL = """with d as (select distinct l_orderkey as k, l_partkey || '' as i from lineitem),
b as (select k, substr(sha256(i), 1, 2) as b, sha256(string_agg(i, chr(10) order by i)) as h from d group by 1, 2),
w as (select k, string_agg(b || h, '' order by b) as s from b group by 1),
x as (select k, sha256('{"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}' || chr(10) || s) as h from w join orders on o_orderkey = k)
select k as change_id, 'rcpt_' || substr(h, 1, 12) as receipt, h as inputs_hash from x"""


QUERIES = {
    "a16_retrieval_metrics": (a16_retrieval_metrics, A16_SQL),
    "a16_retrieval_board": (a16_retrieval_board, A16B_SQL),
    "a17_case_results": (a17_case_results, A17_SQL),
    "a18_history_cases": (a18_history_cases, A18C_SQL),
    "a18_history_board": (a18_history_board, A18B_SQL),
    "a19_label_accuracy": (a19_label_accuracy, A19_SQL),
    "a20_threshold_checks": (a20_threshold_checks, A20_SQL),
    "a21_grade_reads": (a21_grade_reads, A21_SQL),
    "a21_confidence_bands": (a21_confidence_bands, A21B_SQL),
    "a21_relevance_summary": (a21_relevance_summary, A21R_SQL),
    "a22_gate_cases": (a22_gate_cases, A22_SQL),
    "a34_token_savings": (a34_token_savings, A34_SQL),
    "r12_apply_relevance": (r12_apply_relevance, R12_SQL),
    "s4_read_ledger": (s4_read_ledger, S4_SQL),
    "s5_append_attestation": (s5_append_attestation, S5_SQL),
    "w6_verify_ledger": (w6_verify_ledger, W6_SQL),
    "w11_verify_contracts": (w11_verify_contracts, W11_SQL),
    "a39_receipts": (a39_receipts, A39_SQL),
}
