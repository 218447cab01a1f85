"""History exports, dependency files, source facts, catalogues and routing over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.operators import corpus as c
from tallywake.operators import grading as g
from tallywake.operators import routing as r
from tallywake.operators import terms as t
from tallywake.plans.graph import PATH_SQL, PATHS_CTE
from tallywake.plans.impact import FILES_CTE as DOC_FILES_CTE
from tallywake.plans.impact import doc_files, doc_requests, sql_singular, sql_tokens
from tallywake.plans.tables import CHANGES_CTE, changes, epoch_s, spread, sql_proportion, sql_round3, table
from tallywake.sources import corpus as sc
from tallywake.sources import history as h


# ---------------------------------------------------------------- history text
def log_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as one commit record of a log export, its items as numstat rows."""
    count = F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 3 == 0), "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    row = F.concat(count, F.lit("\t"), count, F.lit("\tsrc/p"), F.col("l_partkey").cast("string"))
    stats = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("rows"))
    n = F.col("o_orderkey")
    head = F.concat_ws("\t", n.cast("string"), F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("p"), n.cast("string"))).otherwise(F.lit("a b")), epoch_s("o_orderdate").cast("string"), F.concat(F.lit("fix:\titem "), n.cast("string")))
    return table(spark, sf_dir, "orders").join(stats, "o_orderkey", "left").select(F.lit("r").alias("repo_id"), F.concat(head, F.lit("\n\n"), F.coalesce("rows", F.lit("")), F.lit("\n")).alias("value"))


def s9_read_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = h.parse_commits(log_chunks(spark, sf_dir))
    files = h.commit_files(commits).groupBy("sha").agg(F.count("*").alias("files"), F.sum("additions").alias("additions"), F.max("path").alias("last_path"))
    return commits.select("sha", F.size("parents").alias("parents"), "time", "subject").join(files, "sha", "left")


S9_SQL = """with f as (select l_orderkey as k, count(*) as files, cast(sum(l_quantity) as bigint) as additions, max('src/p' || l_partkey) as last_path from lineitem where not (l_returnflag = 'N' and l_linenumber % 3 = 0) group by 1)
select o_orderkey || '' as sha, case o_orderkey % 3 when 0 then 0 when 1 then 1 else 2 end as parents, cast(epoch(o_orderdate) as bigint) as time, 'fix:' || chr(9) || 'item ' || o_orderkey as subject, files, additions, last_path
from orders left join f on k = o_orderkey"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a zero-context diff; an item is a hunk, its quantity the range length."""
    def hunk(i: Column) -> Column:
        n, q = i["l_partkey"], i["l_quantity"].cast("int")
        path = F.concat(F.lit("src/p"), (n % 40).cast("string"))
        size = F.when(q % 5 == 1, "").otherwise(F.concat(F.lit(","), (q % 5).cast("string")))
        target = F.when(i["l_linenumber"] == 7, "/dev/null").otherwise(F.concat(F.lit("b/"), path))
        return F.concat(
            F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ "), target, F.lit("\n@@ -"), (n * 3).cast("string"), size,
            F.lit(" +"), (n * 2).cast("string"), size, F.lit(" @@ f()\n-old\n++++ b/not a file"),
        )

    # The items of an order meet as numbers; what they say is written out where they lie by then.
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("fix_sha")).agg(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("items"))
    hunks = F.transform("items", lambda i: F.struct(i["l_linenumber"].alias("l_linenumber"), i["l_partkey"].alias("l_partkey"), hunk(i).alias("h")))
    return rows.select("fix_sha", F.array_join(F.array_sort(hunks).getField("h"), "\n").alias("value"))


def s10_read_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = h.parse_hunks(diffs(spark, sf_dir))
    return out.groupBy("fix_sha", "path", "from_line", "to_line").agg(F.count("*").alias("n"))


# '++++ b/…' in a hunk is text, and '+++ /dev/null' leaves the file before it current.
S10_SQL = """with x as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as n, cast(l_quantity as int) % 5 as q from lineitem),
s as (select l_orderkey as fix_sha, last_value(case when l_linenumber <> 7 then 'src/p' || (l_partkey % 40) end ignore nulls) over (partition by l_orderkey order by n) as path, l_partkey * 3 as a, case when q = 1 then 1 else q end as c from x)
select fix_sha, path, a as from_line, a + c - 1 as to_line, count(*) as n from s where c > 0 and path is not null group by 1, 2, 3, 4"""


def s11_read_added_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return h.parse_added_lines(diffs(spark, sf_dir), "fix_sha")


S11_SQL = """select distinct l_orderkey as fix_sha, 'src/p' || (l_partkey % 40) as path, unnest(range(l_partkey * 2, l_partkey * 2 + cast(l_quantity as int) % 5)) as line from lineitem where l_linenumber <> 7"""


def s12_read_name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    line = F.when(n == 1, F.concat(F.lit("R087\told/"), p, F.lit("\tnew/"), p)).when(n == 2, F.concat(F.lit("C\ta"), p, F.lit("\tb"), p)).when(n == 3, F.lit("")).otherwise(F.concat(F.lit("M\tsrc/"), p))
    return h.parse_name_status(table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("value"))).groupBy("l_orderkey", "status", "score", "previous_path", "path").agg(F.count("*").alias("n"))


S12_SQL = """with x as (select l_orderkey, l_linenumber as n, l_partkey as p from lineitem where l_linenumber <> 3)
select l_orderkey, case n when 1 then 'R' when 2 then 'C' else 'M' end as status, case n when 1 then '087' end as score, case n when 1 then 'old/' || p when 2 then 'a' || p end as previous_path,
  case n when 1 then 'new/' || p when 2 then 'b' || p else 'src/' || p end as path, count(*) as n from x group by 1, 2, 3, 4, 5"""


def s12_read_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("l_partkey").cast("string"), F.col("l_linenumber")
    path = F.when(n == 1, F.concat(F.lit("src/{a => b/"), p, F.lit("}"))).when(n == 2, F.concat(F.lit("x/old.ts => y/"), p)).otherwise(F.concat(F.lit("src/"), p))
    line = F.concat(F.when(n == 4, "-").otherwise(F.col("l_quantity").cast("int").cast("string")), F.lit("\t"), n.cast("string"), F.lit("\t"), path)
    rows = h.parse_numstat(table(spark, sf_dir, "lineitem").select("l_orderkey", line.alias("value")))
    return rows.groupBy("l_orderkey", "path").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))


S12N_SQL = """select l_orderkey, case l_linenumber when 1 then 'src/b/' || l_partkey when 2 then 'x/y/' || l_partkey else 'src/' || l_partkey end as path,
  cast(sum(case when l_linenumber = 4 then 0 else l_quantity end) as bigint) as additions, cast(sum(l_linenumber) as bigint) as deletions from lineitem group by 1, 2"""

# ---------------------------------------------------------------- dependency files
DEP_NAME = """case p_partkey % 12 when 0 then 'package.json' when 1 then 'yarn.lock' when 2 then 'requirements-dev.txt' when 3 then 'go.sum' when 4 then 'Cargo.lock' when 5 then 'Gemfile.lock'
  when 6 then 'package-lock.json' when 7 then 'go.mod' when 8 then '.npmrc' when 9 then 'src/index.ts' when 10 then 'Pipfile.lock' else 'vendor/package.json' end"""
DEP_PATH = f"concat(case p_size % 3 when 0 then '' when 1 then 'apps/a/' else concat('apps/b', cast(p_size as varchar(9)), '/') end, {DEP_NAME})"


def dep_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dependency file per part naming one package after it."""
    name, k = F.lower(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), (F.col("p_partkey") % 50).cast("string"))), F.col("p_partkey") % 12
    text = (
        F.when(k == 0, F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "1"}, "devDependencies": {"@x/y": "2"}}')))
        .when(k == 1, F.concat(F.lit('# lock\n"@s/p@npm:^1", '), name, F.lit("@^2:\n  version 1\n")))
        .when(k == 2, F.concat(F.lit("# c\n"), name, F.lit("==1 # x\n\n")))
        .when(k == 3, F.concat(F.lit("x.io/"), name, F.lit(" v1 h1:x\n")))
        .when(k == 4, F.concat(F.lit('[[package]]\nname = "'), name, F.lit('"\n')))
        .when(k == 5, F.concat(F.lit("GEM\n    "), name, F.lit(" (1.0)\n      dep\n")))
        .when(k == 6, F.concat(F.lit('{"packages": {"": {}, "node_modules/@a/b": {}, "node_modules/'), name, F.lit('": {}}}')))
        .when(k == 7, F.concat(F.lit("module m\nrequire x.io/"), name, F.lit(" v1.2\n")))
        .when(k == 10, F.concat(F.lit('{"default": {"'), name, F.lit('": {}}, "develop": {}}')))
        .otherwise("x = 1")
    )
    return spread(table(spark, sf_dir, "part")).select(F.floor(F.col("p_partkey") / 100).alias("repo_id"), F.col("p_partkey").alias("k"), F.expr(DEP_PATH).alias("path"), text.alias("text"))


def dep_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per repository and path: packages of equal paths are merged."""
    rows = sc.dependency_files(dep_texts(spark, sf_dir))
    return rows.groupBy("repo_id", "path", "role", "ecosystem", "manager").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("packages")))).alias("packages"))


DEP_CTE = f"""
d0 as (select p_partkey // 100 as repo_id, p_partkey % 12 as k, {DEP_PATH} as path, lower(replace(p_name, ' ', '-')) || '-' || (p_partkey % 50) as n from part),
d1 as (select *, case when k in (0, 2, 7) then 'manifest' when k = 8 then 'config' else 'lockfile' end as role, case k when 0 then 'node' when 1 then 'node' when 2 then 'python' when 3 then 'go' when 4 then 'rust' when 5 then 'ruby' when 6 then 'node' when 7 then 'go' when 8 then 'node' else 'python' end as ecosystem,
   case k when 1 then 'yarn' when 6 then 'npm' when 8 then 'npm' when 10 then 'pipenv' end as manager,
   case k when 0 then [n, '@x/y'] when 1 then ['@s/p', n] when 3 then ['x.io/' || n] when 6 then ['@a/b', n] when 7 then ['x.io/' || n] when 8 then [] else [n] end as packages from d0 where k not in (9, 11)),
deps as (select repo_id, path, role, ecosystem, manager, list_sort(list_distinct(flatten(list(packages)))) as packages from d1 group by 1, 2, 3, 4, 5)
"""


def s14_dependency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dep_files(spark, sf_dir).withColumn("packages", F.array_join("packages", ","))


S14_SQL = f"with {DEP_CTE} select repo_id, path, role, ecosystem, manager, coalesce(array_to_string(packages, ','), '') as packages from deps"

DEP_REQUEST = """case p_partkey % 9 when 0 then concat('upgrade ', n, ' to 2.0, please') when 1 then 'update the stripe webhook' when 2 then 'npm audit fix for src/lib/a.ts' when 3 then 'patch CVE-2024-1234 in shell-quote'
  when 4 then 'bump lockfile and fix login' when 5 then concat('bump ', n, '@3.1.0') when 6 then 'yarn.lock is stale' when 7 then 'upgrade pricing tier to pro' else 'yarn up handlebars in the Mailer code' end"""


def dep_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), (F.col("p_partkey") % 50).cast("string")))
    return spread(table(spark, sf_dir, "part")).withColumn("n", name).select(F.col("p_partkey").alias("request_id"), F.floor(F.col("p_partkey") / 100).alias("repo_id"), F.expr(DEP_REQUEST).alias("text"))


def p10_dependency_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = c.dependency_requests(dep_requests(spark, sf_dir), dep_files(spark, sf_dir))
    return out.select("request_id", F.array_join("packages", ",").alias("packages"), "scoring_query", F.array_join("managers", ",").alias("managers"))


# One row per wording: which are dependency requests, and what is left of each.
P10_CTE = f"""{DEP_CTE},
known as (select distinct repo_id, unnest(packages) as p from deps),
q as (select p_partkey as request_id, p_partkey // 100 as repo_id, p_partkey % 9 as m, lower(replace(p_name, ' ', '-')) || '-' || (p_partkey % 50) as n from part),
req as (select request_id, repo_id, m, case m when 0 then [n] when 3 then ['shell-quote'] when 5 then [n] when 8 then case when (repo_id, 'handlebars') in (select (repo_id, p) from known) then ['handlebars'] else [] end else [] end as packages,
   case m when 0 then 'please' when 2 then 'for src/lib/a.ts' when 3 then '2024 1234 in' when 4 then 'login' when 6 then 'is stale' when 8 then 'handlebars in Mailer code' else '' end as scoring_query,
   case m when 2 then ['npm'] when 6 then ['yarn'] when 8 then ['yarn'] else [] end as managers
  from q where m in (2, 3, 4, 6, 8) or (m in (0, 5) and (repo_id, n) in (select (repo_id, p) from known)))
"""
P10_SQL = f"with {P10_CTE} select request_id, array_to_string(packages, ',') as packages, scoring_query, array_to_string(managers, ',') as managers from req"


def j26_owned_dependency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    deps = dep_files(spark, sf_dir)
    return c.owned_dependency_files(c.dependency_requests(dep_requests(spark, sf_dir), deps), deps)


J26_SQL = f"""with {P10_CTE},
sc as (select r.*, d.path, d.role as fr, d.packages as fp, case when contains(d.path, '/') then regexp_replace(d.path, '/[^/]*$', '') else '' end as folder from req r join deps d on d.repo_id = r.repo_id
   where (len(managers) = 0 or d.ecosystem = 'node') and (d.manager is null or len(managers) = 0 or list_contains(managers, d.manager))),
s2 as (select *, case when folder = '' then 0 else len(string_split(folder, '/')) end as depth, fr = 'manifest' and list_has_any(packages, fp) as decl from sc),
fx as (select request_id, bool_or(decl) as anyd, min(case when fr <> 'config' then depth end) as sh from s2 group by 1),
an as (select distinct s2.request_id, folder from s2 join fx using (request_id) where case when anyd then decl else depth = sh end),
o as (select request_id, repo_id, path, case when fr = 'manifest' then case when (request_id, folder) in (select (request_id, folder) from an) then case when len(packages) = 0 or decl then 'required' else 'supporting' end end
   when exists (select 1 from an where an.request_id = s2.request_id and (an.folder = s2.folder or s2.folder = '' or starts_with(an.folder, s2.folder || '/'))) then case when fr = 'lockfile' then 'required' else 'supporting' end end as role from s2)
select * from o where role is not null"""


# ---------------------------------------------------------------- catalogue and saved documents
def s17_upsert_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "customer")
    catalog = people.select(F.col("c_custkey").alias("root"), F.col("c_name").alias("name"), F.lit(0).cast("bigint").alias("files"))
    entries = table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").select(F.col("o_custkey").alias("root"), F.concat(F.lit("repo "), F.col("o_orderpriority")).alias("name"), F.col("o_orderkey").alias("files"), F.col("o_orderkey").alias("seq"))
    live = people.where("c_acctbal > 0").select(F.col("c_custkey").alias("root"))
    return sc.upsert_catalog(catalog, entries, live)


S17_SQL = """with e as (select o_custkey as root, arg_max('repo ' || o_orderpriority, o_orderkey) as name, max(o_orderkey) as files from orders where o_orderpriority <> '5-LOW' group by 1),
n as (select c_custkey as root, c_name as name, 0 as files from customer where c_custkey not in (select root from e) union all select * from e)
select n.* from n join customer on c_custkey = root where c_acctbal > 0"""


def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One saved run per customer; its commits are that customer's orders."""
    rows = changes(spark, sf_dir)
    n = F.col("sha")
    answer = F.struct(F.struct((n % 3).cast("double").alias("score")).alias("specificity"), F.struct((n % 5 / 2.5).alias("score")).alias("blast_radius"), F.struct((n % 10 / 10).alias("noul")).alias("novelty"))
    commit = F.struct(
        n.cast("string").alias("sha"), F.when(n % 11 == 0, "fix: x").when(n % 13 == 0, "chore(release): publish v1.2").otherwise("add y").alias("subject"), (n % 101).cast("double").alias("ax"),
        (n % 7).cast("int").alias("candidates"), (n % 90).cast("double").alias("containment"), F.when(n % 4 == 0, F.array(F.lit("auth/security"))).otherwise(F.array().cast("array<string>")).alias("riskPaths"),
        F.col("repaired_after").alias("repairedAfter"), F.struct(answer.alias("offline")).alias("inputs"),
    )
    runs = rows.groupBy(F.col("repo_id").alias("run_id")).agg(F.collect_list(commit).alias("commits"))
    return runs.select("run_id", F.to_json(F.struct(F.struct(F.lit(365).alias("windowDays"), F.lit(30).alias("minSample")).alias("method"), "commits")).alias("value"))


def s18_saved_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.saved_run(saved_runs(spark, sf_dir))
    return rows.groupBy("run_id", "window_days", "min_sample").agg(F.count("*").alias("commits"), F.sum("containment").alias("containment"), F.count("repairedAfter").alias("repaired"), F.sum(F.size("riskPaths")).alias("flags"))


S18_SQL = f"""with {CHANGES_CTE} select repo_id as run_id, 365 as window_days, 30 as min_sample, count(*) as commits, sum(sha % 90)::double as containment, count(repaired_after) as repaired, count(*) filter (sha % 4 = 0) as flags from changes group by 1"""


def a10_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.saved_run(saved_runs(spark, sf_dir)).withColumn("repaired_after", F.col("repairedAfter"))
    zero = F.lit(0.0)

    def tier(s, b, v):
        return r.route_tier(r.route_score(F.col("ax"), s, b, v, F.col("containment")), F.col("candidates"), F.col("riskPaths"))

    scorers = {
        "deterministic": lambda: tier(zero, zero, zero),
        "offline": lambda: tier(F.col("inputs.offline.specificity.score"), F.col("inputs.offline.blast_radius.score"), F.col("inputs.offline.novelty.noul")),
    }
    return g.rescore(rows, scorers, 365, 30)


ROUTE_CTE = f"""{CHANGES_CTE},
ro as (select *, (sha % 101)::double as ax, (sha % 90) as cont, sha % 7 as cand from changes),
rs as (select *, greatest(0.0, least(100.0, ax + case when cont >= 40 then ax * 0.1::double else 0 end)) as det,
   greatest(0.0, least(100.0, ax - ax * 0.25::double * ((sha % 3)::double / 2) - ax * 0.2::double * ((sha % 5) / 2.5::double / 2) - ax * 0.15::double * ((sha % 10) / 10::double) + case when cont >= 40 then ax * 0.1::double else 0 end)) as off from ro),
ti as (select *, least(3, case when cand = 0 then 3 when det >= 75 then 1 when det >= 45 then 2 else 3 end + (sha % 4 = 0)::int) as d, least(3, case when cand = 0 then 3 when off >= 75 then 1 when off >= 45 then 2 else 3 end + (sha % 4 = 0)::int) as f from rs)
"""
A10_SQL = f"""with {ROUTE_CTE},
kept as (select * from ti where sha % 11 <> 0 and sha % 13 <> 0),
long as (select 'deterministic' as variant, ['cheap', 'mid', 'premium'][d] as tier, coalesce(repaired_after <= 31536000, false) as hit from kept union all select 'offline', ['cheap', 'mid', 'premium'][f], coalesce(repaired_after <= 31536000, false) from kept),
dbl as (select * from long union all select variant, '(base)', hit from long),
rw as (select variant, tier, count(*) as n, cast(sum(hit::int) as bigint) as repaired from dbl group by 1, 2),
gr as (select variant, tier, n, repaired, {sql_proportion('repaired', 'n', 30)} from rw),
wd as (select *, max(case when tier = '(base)' then rate end) over w as b, max(case when tier = 'cheap' then rate end) over w as c, max(case when tier = 'mid' then rate end) over w as m, max(case when tier = 'premium' then rate end) over w as p,
   max(case when tier = 'cheap' then repaired end) over w as contradicted from gr window w as (partition by variant))
select variant, tier, n, repaired, rate, ci_low, ci_high, publishable, contradicted, case when tier <> '(base)' and b <> 0 and n >= 30 then {sql_round3('cast(repaired as double) / n / b')} end as lift,
  case when c is not null and m is not null and p is not null then c < m and m < p end as monotonic from wd"""


def p16_route_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sc.saved_run(saved_runs(spark, sf_dir))
    score = r.route_score(F.col("ax"), F.col("inputs.offline.specificity.score"), F.col("inputs.offline.blast_radius.score"), F.col("inputs.offline.novelty.noul"), F.col("containment"))
    return rows.select("sha", F.floor(score + 0.5).alias("route"), r.route_tier(score, F.col("candidates"), F.col("riskPaths")).alias("tier"))


P16_SQL = f"with {ROUTE_CTE} select sha || '' as sha, cast(floor(off + 0.5) as bigint) as route, ['cheap', 'mid', 'premium'][f] as tier from ti"

OFFLINE_TEXT = """concat(text, case turn % 6 when 0 then ' why is it broken' when 1 then ' rename the flag' when 2 then ' refactor across' when 3 then ' investigate and migrate' when 4 then ' design a label' else '' end)"""


def p17_offline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(OFFLINE_TEXT).alias("text"))
    a = r.offline_answers(F.col("text"), F.col("turn"), F.col("conv_id") % 4)
    out = rows.select("conv_id", "turn", a.alias("a"))
    milli = lambda x: F.floor(x * 1000 + 0.5).alias
    return out.select("conv_id", "turn", "a.specificity", "a.blast", "a.novelty", milli(F.col("a.blast_levels")[0])("low"), milli(F.col("a.blast_levels")[1])("middle"), milli(F.col("a.blast_levels")[2])("high"))


def _any(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(x, '{w}')" for w in words) + ")"


P17_SQL = f"""with a as (select conv_id, turn, lower({OFFLINE_TEXT}) as x from conversations),
b as (select *, greatest(0, least(2, 0.6::double + case when {_any(['figure out', 'find out', 'investigate', 'somewhere', 'something', 'not sure'])} then 0.8 else 0 end + case when {_any(['why', 'broken', 'wrong', 'failing'])} then 0.4 else 0 end
   - case when {_any(['typo', 'rename', 'bump', 'flag', 'copy', 'wording', 'string'])} then 0.45 else 0 end)) as sp,
  0.1::double + case when {_any(['design', 'introduce', 'add support', 'migrate', 'rework', 'rearchitect'])} then 0.4 else 0 end - case when {_any(['typo', 'bump', 'rename', 'copy', 'wording'])} then 0.06 else 0 end as nv,
  case when turn > 1 then (turn - 1) * 0.5::double else 0 end + greatest(0, conv_id % 4 - 1) * 0.4::double as s0 from a),
d as (select *, greatest(0, least(2, case when {_any(['typo', 'copy', 'wording', 'label', 'rename', 'comment'])} then least(s0, 0.2) else s0 end + case when {_any(['across', 'everywhere', 'refactor', 'rework', 'migrate'])} then 0.6 else 0 end)) as s from b),
e as (select *, greatest(0.03, 1 - s) as l, greatest(0.03, s / 2) as h, greatest(0.03, 1 - greatest(0.03, 1 - s) - greatest(0.03, s / 2)) as m from d)
select conv_id, turn, round(sp, 2) as specificity, round(s, 2) as blast, round(nv, 2) as novelty, cast(floor(round(l / (l + m + h), 3) * 1000 + 0.5) as bigint) as low, cast(floor(round(m / (l + m + h), 3) * 1000 + 0.5) as bigint) as middle,
  cast(floor(round(h / (l + m + h), 3) * 1000 + 0.5) as bigint) as high from e"""


def p18_experience_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("related"), (F.col("l_returnflag") == "R").cast("int").alias("flags"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), (F.col("o_totalprice") / 10).alias("tokens"), (F.col("o_orderkey") % 3).alias("concepts"), (F.col("o_orderkey") % 5).alias("guardrails"))
    return r.experience_score(ranked, requests)


P18_SQL = """with b as (select *, max(l_quantity) over (partition by l_orderkey) as best from lineitem),
f as (select l_orderkey as k, count(*) filter (l_quantity >= best * 0.5) as files, avg(l_linenumber) filter (l_quantity >= best * 0.5) as fan, count(*) filter (l_returnflag = 'R') as flagged from b group by 1),
p as (select o_orderkey as request_id, coalesce(files, 0) as files, o_totalprice / 10 as tok, greatest(0, least(100, 100.0::double - (coalesce(files, 0) * 5 + coalesce(fan, 0) * 8))) as co, (o_orderkey % 5) * 25 as gu,
   greatest(0, least(100, 100 - case when o_orderkey % 3 = 0 then 40 else 0 end - least(40, floor(case when coalesce(files, 0) > 0 then flagged::double / files else 0 end * 100 + 0.5)))) as cl from orders left join f on k = o_orderkey),
c as (select *, case when tok <= 1500 then 100 when tok >= 40000 then 0 else greatest(0, least(100, 100 - 100 * log10(tok / 1500) / log10(40000 / 1500::double))) end as ch from p),
t as (select *, cast(floor(0.35::double * ch + 0.3::double * co + 0.25::double * gu + 0.1::double * cl + 0.5) as bigint) as ax from c)
select request_id, files, cast(floor(ch + 0.5) as bigint) as changeability, cast(floor(co + 0.5) as bigint) as containment, cast(gu as bigint) as guardrails, cast(cl as bigint) as clarity, ax,
  case when ax >= 80 then 'excellent' when ax >= 60 then 'good' when ax >= 40 then 'fair' else 'poor' end as band from t"""


# ---------------------------------------------------------------- facts and summaries
CODE_TEXT = r"""concat('import { a } from "./m', cast(doc_id as varchar(19)), '"', chr(10), 'export class C', cast(doc_id % 7 as varchar(9)), ' {}', chr(10), translate(text, '"''`@', '    '), chr(10),
  'const q = "SELECT a FROM t', cast(doc_id % 9 as varchar(9)), ' WHERE b = 1"', chr(10), 'await prisma.user', cast(doc_id % 3 as varchar(9)), '.findMany()', chr(10), 'x("not sql"); y(`update u', cast(doc_id % 5 as varchar(9)), chr(10), ' set z = 1`)')"""


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as source code: an import, a class, its own text, then SQL and ORM calls."""
    ending = F.when(F.col("doc_id") % 6 == 0, ".md").when(F.col("doc_id") % 6 == 1, ".yml").otherwise(".ts")
    return spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("repo_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("path"), F.expr(CODE_TEXT).alias("text"), "doc_id")


CODE_CTE = f"""
code as (select source as repo_id, 'd' || doc_id || case doc_id % 6 when 0 then '.md' when 1 then '.yml' else '.ts' end as path, doc_id, {CODE_TEXT} as text from documents),
cl as (select repo_id, path, doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from code)
"""


def p19_source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.source_facts(code_files(spark, sf_dir))


def _rx(pattern: str, group: int = 1) -> str:
    return f"unnest(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', {group}))"


_DECL = " union all ".join(f"select repo_id, path, line, 'symbol' as fact, '{k}' as type, {_rx(p)} as name from cl where path like '%.ts'" for k, p in sc.DECLARATIONS.items())
P19_SQL = f"""with {CODE_CTE},
f as (select repo_id, path, line, 'import' as fact, 'module' as type, {_rx(chr(94) + r'''\s*(?:import|export)\s+(?:type\s+)?(?:.+?\s+from\s+)?['"]([^'"]+)['"]''')} as name from cl where path like '%.ts'
  union all select repo_id, path, line, 'import', 'module', {_rx(r'''\b(?:require|import)\(\s*['"]([^'"]+)['"]\s*\)''')} from cl where path like '%.ts'
  union all select repo_id, path, line, 'export', 'name', {_rx(r'export\s+(?:default\s+)?(?:class|function|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)')} from cl where path like '%.ts'
  union all select repo_id, path, line, 'export', 'name', trim(regexp_replace(trim(unnest(string_split({_rx(r'export\s*\{\s*([^}]+)\s*\}')[7:-1]}[1], ','))), '\\s+as\\s+.*$', '')) from cl where path like '%.ts' and regexp_matches(t, 'export\\s*\\{{\\s*([^}}]+)\\s*\\}}')
  union all {_DECL}
  union all select repo_id, path, line, 'symbol', 'config', {_rx(r'^\s*([A-Za-z_$][\w$.-]+)\s*:')} from cl where path like '%.yml'
  union all select repo_id, path, line, 'symbol', 'heading', regexp_replace(trim({_rx(r'^#{1,6}[ \t]+(\S[^\n]*)$')}), '\\s*#+\\s*$', '') from cl where path like '%.md'
  union all select repo_id, path, line, 'import', 'link', regexp_replace({_rx(r'\]\(\s*(\.{0,2}/[^)\s]+)\s*\)')}, '#.*$', '') from cl where path like '%.md')
select repo_id, path, fact, type, name, min(line) as line from f where name <> '' group by 1, 2, 3, 4, 5"""


# Artefacts: a list of exports over lines, front matter, SQL, templates and a schema, with the document's own text behind.
ARTEFACT_TEXT = r"""concat(case doc_id % 5
  when 0 then concat('const x = 1; export {', chr(10), '  alpha', cast(doc_id % 4 as varchar(9)), ',', chr(10), '  beta as gamma, // note', chr(10), '  delta', chr(10), '} from "./z"', chr(10), 'export { one, two as three }')
  when 1 then concat('---', chr(10), 'name: skill-', cast(doc_id % 50 as varchar(9)), chr(10), '# no heading', chr(10), 'description: >-', chr(10), '  folded', chr(10), '---', chr(10), '# Title ', cast(doc_id % 3 as varchar(9)), ' ##')
  when 2 then concat('UPDATE t', cast(doc_id % 7 as varchar(9)), ' SET col', cast(doc_id % 3 as varchar(9)), ' = 1;', chr(10), 'create table if not exists u', cast(doc_id % 4 as varchar(9)), ' (a int);')
  when 3 then concat('{{> partial', cast(doc_id % 6 as varchar(9)), '}}', chr(10), '{{#if ready}} {{ title }}')
  else concat('enum Kind', cast(doc_id % 5 as varchar(9)), ' {', chr(10), '  RED', chr(10), '}', chr(10), 'model User', cast(doc_id % 4 as varchar(9)), ' {', chr(10), '  id Int') end,
  chr(10), translate(text, '{}#:', '    '))"""
ARTEFACT_ENDING = "case doc_id % 5 when 0 then '.ts' when 1 then '.md' when 2 then '.sql' when 3 then '.hbs' else '.prisma' end"


def p19_facts_over_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("repo_id"), F.expr(f"concat('a', cast(doc_id as varchar(19)), {ARTEFACT_ENDING})").alias("path"), F.expr(ARTEFACT_TEXT).alias("text"))
    kept = sc.source_facts(rows)
    return kept.where((F.col("type").isin("name", "frontmatter", "column", "partial", "enum", "model", "heading")))


def _artefact_rx(pattern: str) -> str:
    return f"unnest(regexp_extract_all(t, '{pattern.replace(chr(39), chr(39) * 2)}', 1))"


P19X_SQL = f"""with a as (select source as repo_id, 'a' || doc_id || {ARTEFACT_ENDING} as path, doc_id, string_split({ARTEFACT_TEXT}, chr(10)) as ls from documents),
al as (select repo_id, path, doc_id, unnest(ls) as t, generate_subscripts(ls, 1) as line from a),
f as (select repo_id, path, line, 'export' as fact, 'name' as type, {_artefact_rx(r'export\s+(?:default\s+)?(?:class|function|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)')} as name from al where path like '%.ts'
  union all select repo_id, path, n.l, 'export', 'name', n.x from a, unnest([{{'l': 2, 'x': 'alpha' || (doc_id % 4)}}, {{'l': 3, 'x': 'beta'}}, {{'l': 4, 'x': 'delta'}}, {{'l': 6, 'x': 'one'}}, {{'l': 6, 'x': 'two'}}]) u(n) where path like '%.ts'
  union all select repo_id, path, n.l, 'symbol', 'frontmatter', n.x from a, unnest([{{'l': 2, 'x': 'name'}}, {{'l': 2, 'x': 'skill-' || (doc_id % 50)}}, {{'l': 4, 'x': 'description'}}]) u(n) where path like '%.md'
  union all select repo_id, path, 7, 'symbol', 'heading', 'Title ' || (doc_id % 3) from a where path like '%.md'
  union all select repo_id, path, line, 'symbol', 'column', {_artefact_rx(r'(?i)\b(?:ADD|DROP|ALTER|RENAME)\s+COLUMN\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?"?(\w+)"?')} from al where path like '%.sql'
  union all select repo_id, path, line, 'symbol', 'column', {_artefact_rx(r'(?i)\bSET\s+"?(\w+)"?\s*=')} from al where path like '%.sql'
  union all select repo_id, path, 1, 'import', 'partial', 'partial' || (doc_id % 6) from a where path like '%.hbs'
  union all select repo_id, path, 1, 'symbol', 'enum', 'Kind' || (doc_id % 5) from a where path like '%.prisma'
  union all select repo_id, path, 4, 'symbol', 'model', 'User' || (doc_id % 4) from a where path like '%.prisma')
select repo_id, path, fact, type, name, min(line) as line from f where name <> '' group by 1, 2, 3, 4, 5"""


def p20_data_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.data_access(code_files(spark, sf_dir))


P20_CTE = f"""{CODE_CTE},
n as (select repo_id, path, doc_id, len(string_split(text, chr(10))) as n from code),
da as (select repo_id, path, 'sql' as source, 'SELECT' as op, 't' || (doc_id % 9) as "table", n - 3 as line from n union all select repo_id, path, 'prisma', 'findMany', 'user' || (doc_id % 3), n - 2 from n
   union all select repo_id, path, 'sql', 'UPDATE', 'u' || (doc_id % 5), n - 1 from n)
"""
P20_SQL = f'with {P20_CTE} select * from da'


def a26_data_access_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.data_access_report(sc.data_access(code_files(spark, sf_dir)))


A26_SQL = f"""with {P20_CTE} select repo_id, 'op' as by, op as key, count(*) as count from da group by 1, 3 union all select repo_id, 'table', "table", count(*) from da group by 1, 3 union all select repo_id, 'source', source, count(*) from da group by 1, 3"""


def a26_data_access_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.data_access_by_file(sc.data_access(code_files(spark, sf_dir)))


A26F_SQL = f"""with {P20_CTE} select repo_id, path, count(*) as hits, string_agg(op, ',' order by op) as operations, string_agg("table", ',' order by "table") as tables,
  string_agg(line || ':' || op || ':' || "table", ' ' order by line) as samples from da group by 1, 2"""


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo_id"), F.expr(PATH_SQL).alias("path"), F.col("p_type").alias("domain"), F.col("p_size").alias("symbols"), (F.col("p_partkey") % 4).alias("data_access"))
    return rows.withColumn("kind", P.kind(F.col("path")))


PART_CTE = f"{PATHS_CTE}, pf0 as (select p_brand as repo_id, k.path, p_type as domain, p_size as symbols, p_partkey % 4 as data_access, k.kind from kinds k join part on p_partkey = k.id)"


def a25_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.kind_counts(part_files(spark, sf_dir))


A25K_SQL = f"with {PART_CTE} select repo_id, kind, count(*) as files from pf0 group by 1, 2"


def a25_domain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.domain_summary(part_files(spark, sf_dir))


A25D_SQL = f"with {PART_CTE}, k as (select repo_id, domain, kind, count(*) as n from pf0 group by 1, 2, 3) select repo_id, domain, cast(sum(n) as bigint) as files, string_agg(kind || ':' || n, ',' order by n desc, kind) as kinds from k group by 1, 2"


def a25_language_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.language_counts(part_files(spark, sf_dir))


A25L_SQL = f"with {PART_CTE} select repo_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as extension, count(*) as files from pf0 group by 1, 2"


def a25_repository_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.repository_counters(part_files(spark, sf_dir))


_KINDS = ["route", "apiRoute", "controller", "service", "module", "schema", "component", "test", "doc", "config"]
A25R_SQL = f"""with {PART_CTE} select repo_id, count(*) as files, cast(sum(symbols) as bigint) as symbols, cast(sum(data_access) as bigint) as data_access, {', '.join(f"count(*) filter (kind = '{k}') as " + chr(34) + k + chr(34) for k in _KINDS)} from pf0 group by 1"""


def j23_integrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_files(spark, sf_dir).select(F.substring("repo_id", 1, 7).alias("workspace"), "repo_id", "kind", "domain")
    order = rows.select("workspace", "repo_id", F.length("repo_id").alias("l")).distinct().select("workspace", "repo_id", F.struct("l", "repo_id").alias("position"))
    return c.integrations(rows, order)


J23_SQL = f"""with {PART_CTE}, w as (select substr(repo_id, 1, 7) as ws, * from pf0),
rp as (select ws, repo_id, count(*) filter (kind in ('apiClient', 'route')) as f, count(*) filter (kind in ('controller', 'service')) as b from w group by 1, 2),
pk as (select ws, arg_min(repo_id, (length(repo_id), repo_id)) filter (f > 0) as fr, arg_min(repo_id, (length(repo_id), repo_id)) filter (b > 0) as br from rp group by 1),
d as (select w.ws, domain, count(*) filter (repo_id = fr and kind = 'apiClient') as clients, count(*) filter (repo_id = br and kind = 'controller') as controllers, count(*) filter (repo_id = br and kind = 'service') as services from w join pk using (ws) where fr is not null and br is not null group by 1, 2)
select ws as workspace, domain, clients, controllers, services, least(clients, 1) * 10 + controllers * 2 + services as score from d where clients > 0 and (controllers > 0 or services > 0)"""


def p11_filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = part_files(spark, sf_dir).withColumns({"domains": F.array("domain"), "route": P.route(F.col("path")), "controller": F.lit(None).cast("string"), "imports": none, "exports": F.array(F.concat(F.lit("Make"), F.col("domain"))), "method_paths": none})
    one = c.filter_map(rows, domain="ECO").select("repo_id", "path", F.lit("domain").alias("filter"))
    two = c.filter_map(rows, kind="test", route=r"^tests/(auth|users)").select("repo_id", "path", F.lit("kind and route").alias("filter"))
    three = c.filter_map(rows, route="makes(").select("repo_id", "path", F.lit("plain").alias("filter"))
    four = c.filter_map(rows, route="makeprom").select("repo_id", "path", F.lit("export").alias("filter"))
    return one.unionByName(two).unionByName(three).unionByName(four)


P11_SQL = f"""with {PART_CTE} select repo_id, path, 'domain' as filter from pf0 where domain = 'ECONOMY' union all select repo_id, path, 'kind and route' from pf0 where kind = 'test' and regexp_matches(path, '^tests/(auth|users)')
union all select repo_id, path, 'export' from pf0 where domain like 'PROM%'"""


def r13_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents")).select(F.col("source").alias("repo_id"), F.col("doc_id").alias("path"), "text")
    return c.search_lines(rows, "THEN")


R13_SQL = """with l as (select source as repo_id, doc_id as path, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
select repo_id, path, line, trim(t) as text from l where contains(lower(t), 'then')"""


# ---------------------------------------------------------------- requests
INTENT_TEXT = """case item_id % 8 when 0 then concat('where is it handled ', text) when 1 then concat('Reviewing ', text) when 2 then concat('why does it crash ', text) when 3 then concat('How do I add ', text)
  when 4 then concat('the app is broken ', text) when 5 then concat('is a consistent with b?', '') when 6 then concat('migrated debugging ', text) else text end"""


def p13_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.expr(INTENT_TEXT).alias("text"))
    i = t.intent(F.col("text"), t.context_tokens(F.col("text")))
    return rows.select("item_id", i.alias("i")).select("item_id", "i.action", F.array_join("i.topics", " ").alias("topics"))


CONTEXT_TOKENS = f"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 and w not in {tuple(fixed.CONTEXT_STOP_WORDS)})"
ACTION = """case when x in {a} then x when regexp_replace(x, '(?:ing|ed|es|s)$', '') = x then null when regexp_replace(x, '(?:ing|ed|es|s)$', '') in {a} then regexp_replace(x, '(?:ing|ed|es|s)$', '')
  when regexp_replace(x, '(?:ing|ed|es|s)$', '') || 'e' in {a} then regexp_replace(x, '(?:ing|ed|es|s)$', '') || 'e'
  when regexp_matches(regexp_replace(x, '(?:ing|ed|es|s)$', ''), '(bb|dd|gg|ll|mm|nn|pp|rr|ss|tt)$') and regexp_replace(x, '(?:ing|ed|es|s)$', '')[:-2] in {a} then regexp_replace(x, '(?:ing|ed|es|s)$', '')[:-2] end""".replace("{a}", str(tuple(fixed.ACTION_WORDS)))
P13_SQL = f"""with q as (select item_id, {INTENT_TEXT} as text from benchmark), k as (select item_id, trim(text) as text, {CONTEXT_TOKENS} as tk from q),
s as (select *, len(list_filter(tk, lambda x: x in {tuple(fixed.SYMPTOM_WORDS)})) > 0 as sym, list_filter(list_transform(tk, lambda x: {ACTION}), lambda a: a is not null)[1] as named,
   (regexp_matches(text, '(?i)^(where|how|why|what|which|who|when)(''s)?\\b') and not regexp_matches(text, '(?i)^(where|how|why|what|which|who|when)(''s)?\\s+(do|does|should|can|could|would|might)\\s+(i|we|you)\\b'))
   or (regexp_matches(text, '(?i)^(is|are|was|were|does|do|did|can|should)\\s+[^?]*\\?\\s*$') and not regexp_matches(text, '(?i)^(is|are|was|were|does|do|did|can|should)\\s+(i|we|you)\\b')) as asked from k)
select item_id, case when asked then case when sym then 'debug' else 'explain' end when named is not null then named when sym then 'debug' else 'unknown' end as action,
  array_to_string(list_filter(tk, lambda x: {ACTION} is null)[1:8], ' ') as topics from s"""


def a38_scope_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.request_scope_terms(doc_requests(spark, sf_dir), doc_files(spark, sf_dir))


def sql_scope(x: str) -> str:
    kept = f"list_filter({sql_tokens(x)}, lambda s: length(s) >= 2 and not regexp_matches(s, '^[0-9]+$'))"
    return f"list_distinct(list_concat(list_transform({kept}, lambda w: case when length(w) > 4 then {sql_singular('w')} else w end), list_transform({kept}, lambda w: {sql_singular('w')})))"


A38_SQL = f"""with {DOC_FILES_CTE},
a as (select request_id, repo_id, unnest({sql_scope('text')}) as term from requests),
fz as (select repo_id, path, unnest({sql_scope("regexp_replace(path, '\\.[^./]*$', '')")}) as term from files),
ca as (select repo_id, term, count(*) as n from fz group by 1, 2),
ex as (select distinct repo_id, unnest({sql_scope("regexp_extract(path, '(\\.[^./]*)$', 1)")}) as term from files),
sz as (select repo_id, count(*) as f from files group by 1)
select a.request_id, a.repo_id, a.term from a left join ca using (repo_id, term) left join ex using (repo_id, term) join sz using (repo_id)
where a.term not in ('app', 'bin', 'build', 'dist', 'lib', 'main', 'out', 'packages', 'package', 'pkg', 'public', 'src', 'test', 'tests') and coalesce(n, 0) <= greatest(20, ceil(f * 0.03)) and not (coalesce(n, 0) = 0 and ex.term is not null)"""


def a38_request_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.request_modules(doc_requests(spark, sf_dir), doc_files(spark, sf_dir))


# No request of the given tables names a tracked path, so all its words count.
A38M_SQL = f"""with {DOC_FILES_CTE},
a as (select distinct request_id, repo_id, unnest({sql_scope('text')}) as term from requests),
di as (select repo_id, array_to_string(string_split(path, '/')[1:d], '/') as directory from files, unnest(range(1, len(string_split(path, '/')))) u(d)),
sz as (select repo_id, count(*) as f from files group by 1),
fo as (select repo_id, directory, lower(regexp_extract(directory, '([^/]+)$', 1)) as name from (select repo_id, directory, count(*) as held from di group by 1, 2) join sz using (repo_id)
  where held <= f * 0.2 and lower(regexp_extract(directory, '([^/]+)$', 1)) not in {tuple(fixed.TREE_NAMES)} and not starts_with(lower(regexp_extract(directory, '([^/]+)$', 1)), '.')),
hits as (select a.request_id, a.repo_id, x.directory from (select repo_id, directory, unnest({sql_scope('name')}) as term from fo) x join a using (repo_id, term)
  intersect select a.request_id, a.repo_id, x.directory from (select repo_id, directory, unnest({sql_scope("regexp_replace(name, '[^a-z0-9]+', '', 'g')")}) as term from fo) x join a using (repo_id, term)),
ou as (select * from hits h where not exists (select 1 from hits u where u.request_id = h.request_id and u.repo_id = h.repo_id and starts_with(h.directory, u.directory || '/')))
select *, count(*) over (partition by request_id, repo_id) as n from ou"""


def p9_docs_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths_ = table(spark, sf_dir, "part").select("p_partkey", F.expr(PATH_SQL).alias("path"))
    rows = table(spark, sf_dir, "lineitem").join(paths_, F.col("l_partkey") == F.col("p_partkey")).select(F.lit(0).alias("repo_id"), F.col("l_orderkey").alias("sha"), "path")
    return g.code_file_counts(rows)


P9_SQL = f"""with {PATHS_CTE} select 0 as repo_id, l_orderkey as sha, count(*) filter (not is_doc) as code_files, bool_and(regexp_matches(path, '(?i)(\\.(md|mdx|markdown|txt|rst|adoc)$|^docs?/)')) as docs_only
from lineitem join kinds on id = l_partkey group by 2"""


def s19_eval_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One corpus per document: its lines are cases and risk labels."""
    lines = F.split("text", "\n")

    def case(line, i):
        name = i.cast("string")
        return F.struct(name.alias("name"), line.alias("query"), F.array(name).alias("expectedPrimary"), F.array().cast("array<string>").alias("expectedAnyOf"), (i % 3 == 0).alias("knownGap"))

    def risk(line, i):
        return F.struct(i.cast("string").alias("name"), F.lit("query").alias("mode"), F.col("lang").alias("query"), F.lit(None).cast("string").alias("path"), F.array(F.col("lang")).alias("expectedConcepts"))

    value = F.to_json(F.struct(F.lit(4).alias("k"), F.transform(lines, case).alias("retrieval"), F.transform(lines, risk).alias("risk")))
    corpora = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id"), value.alias("value"))
    cases, labels, _ = sc.eval_corpus(corpora)
    left = cases.groupBy("corpus_id", "k").agg(F.count("*").alias("cases"), F.count_if("knownGap").alias("gaps"), F.sum(F.length("query")).alias("chars"))
    right = labels.groupBy("corpus_id").agg(F.count("*").alias("labels"), F.count_if(F.array_contains("expectedConcepts", "en")).alias("english"))
    return left.join(right, "corpus_id")


S19_SQL = """with d as (select doc_id, lang, string_split(text, chr(10)) as l from documents)
select doc_id as corpus_id, 4 as k, len(l) as cases, (len(l) + 2) // 3 as gaps, cast(list_sum(list_transform(l, lambda x: length(x))) as bigint) as chars, len(l) as labels, case when lang = 'en' then len(l) else 0 end as english from d"""


def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files that define makeThing functions; some are registries, some export what they define."""
    n = F.col("p_partkey")
    make = F.concat(F.lit("makeThing"), (n % 300).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.floor(n / 500).alias("repo_id"), F.concat(F.lit("src/m"), n.cast("string"), F.lit(".ts")).alias("path"), F.when(n % 10 == 3, "test").otherwise("source").alias("kind"), F.lit(False).alias("is_vendor"),
        F.array(F.struct(make.alias("name"), F.when(n % 7 == 0, "heading").otherwise("function").alias("type")), F.struct(F.lit("setup").alias("name"), F.lit("function").alias("type"))).alias("symbols"),
        F.when(n % 2 == 0, F.array(make)).otherwise(F.array().cast("array<string>")).alias("exports"), n.alias("n"), make.alias("make"),
    )


def j8_named_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallywake.operators.impact import named_symbols

    files = symbol_files(spark, sf_dir)
    requests = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request_id"), F.floor(F.col("p_partkey") / 500).alias("repo_id"), F.concat(F.lit("please call makeThing"), (F.col("p_partkey") % 290).cast("string"), F.lit(" in setup of m.ts")).alias("text"))
    degrees = files.select("repo_id", "path", (F.col("n") % 3).alias("importers"))
    return named_symbols(requests, files, degrees).select("request_id", "repo_id", "path", "literal", "rule")


J8S_SQL = """with f as (select p_partkey as n, p_partkey // 500 as repo_id, 'src/m' || p_partkey || '.ts' as path, 'makeThing' || (p_partkey % 300) as make from part where p_partkey % 10 <> 3 and p_partkey % 7 <> 0),
few as (select repo_id, make from f group by 1, 2 having count(*) <= 3)
select p_partkey as request_id, f.repo_id, f.path, f.make as literal, case when f.n % 2 = 0 and f.n % 3 > 0 then 'symbol' else 'definer' end as rule
from part join f on f.repo_id = p_partkey // 500 and f.make = 'makeThing' || (p_partkey % 290) join few on few.repo_id = f.repo_id and few.make = f.make"""


def j8_implementers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registries name run_thing_N and call makeThingN and setup of the modules they import."""
    from tallywake.operators.impact import implementers

    files = symbol_files(spark, sf_dir)
    number = (F.col("n") % 300).cast("string")
    name = F.concat(F.lit("run_thing_"), number)
    registry = files.where("n % 4 = 1").select("repo_id", "path", name.alias("name"), F.array("make", F.lit("setup")).alias("calls"))
    exports = files.select("repo_id", "path", "kind", F.when(F.col("n") % 2 == 0, F.array("make")).otherwise(F.array(F.lit("setup"))).alias("exports"), "n")
    base = F.col("repo_id") * 500
    imports = files.where("n % 4 = 1").select("repo_id", F.col("path").alias("src"), F.explode(F.array(F.col("n") + 300, F.col("n") - 300, F.col("n") + 1, F.col("n") + 2)).alias("m")).where((F.col("m") >= base) & (F.col("m") < base + 500))
    imports = imports.select("repo_id", "src", F.concat(F.lit("src/m"), F.col("m").cast("string"), F.lit(".ts")).alias("dst"))
    asked = registry.select(F.regexp_extract("path", "([0-9]+)", 1).cast("bigint").alias("request_id"), "repo_id", F.col("name").alias("literal"))
    return implementers(asked, registry, imports, exports).select("request_id", "repo_id", "path", "literal", "via")


# No word of a called name is one of a registered name here, so all overlaps are equal.
J8I_SQL = """with f as (select p_partkey as n, p_partkey // 500 as repo_id, 'src/m' || p_partkey || '.ts' as path from part),
r as (select n, repo_id, path, 'run_thing_' || (n % 300) as literal from f where n % 4 = 1),
im as (select r.n, m from r, unnest([n + 300, n - 300, n + 1, n + 2]) u(m) where m >= r.repo_id * 500 and m < r.repo_id * 500 + 500),
fo as (select distinct a.n as request_id, a.repo_id, a.literal, s.path as via, d.path from r a join r s on s.repo_id = a.repo_id and s.literal = a.literal join im on im.n = s.n
  join f d on d.n = im.m where d.n <> s.n and d.n % 10 <> 3 and (d.n % 2 = 1 or d.n % 300 = s.n % 300)),
o as (select *, row_number() over (partition by request_id, repo_id, literal order by via, path) as k from fo)
select request_id, repo_id, path, literal, via from o where k <= 3"""


QUERIES = {
    "s9_read_history": (s9_read_history, S9_SQL),
    "s10_read_hunks": (s10_read_hunks, S10_SQL),
    "s11_read_added_lines": (s11_read_added_lines, S11_SQL),
    "s12_read_name_status": (s12_read_name_status, S12_SQL),
    "s12_read_numstat": (s12_read_numstat, S12N_SQL),
    "s14_dependency_files": (s14_dependency_files, S14_SQL),
    "p10_dependency_requests": (p10_dependency_requests, P10_SQL),
    "j26_owned_dependency_files": (j26_owned_dependency_files, J26_SQL),
    "s17_upsert_catalog": (s17_upsert_catalog, S17_SQL),
    "s18_saved_run": (s18_saved_run, S18_SQL),
    "a10_rescore": (a10_rescore, A10_SQL),
    "p16_route_tier": (p16_route_tier, P16_SQL),
    "p17_offline_answers": (p17_offline_answers, P17_SQL),
    "p18_experience_score": (p18_experience_score, P18_SQL),
    "p19_source_facts": (p19_source_facts, P19_SQL),
    "p19_facts_over_lines": (p19_facts_over_lines, P19X_SQL),
    "p20_data_access": (p20_data_access, P20_SQL),
    "a26_data_access_report": (a26_data_access_report, A26_SQL),
    "a26_data_access_by_file": (a26_data_access_by_file, A26F_SQL),
    "a25_kind_counts": (a25_kind_counts, A25K_SQL),
    "a25_domain_summary": (a25_domain_summary, A25D_SQL),
    "a25_language_counts": (a25_language_counts, A25L_SQL),
    "a25_repository_counters": (a25_repository_counters, A25R_SQL),
    "j23_integrations": (j23_integrations, J23_SQL),
    "p11_filter_map": (p11_filter_map, P11_SQL),
    "r13_search_lines": (r13_search_lines, R13_SQL),
    "p13_intent": (p13_intent, P13_SQL),
    "a38_scope_terms": (a38_scope_terms, A38_SQL),
    "a38_request_modules": (a38_request_modules, A38M_SQL),
    "p9_docs_only": (p9_docs_only, P9_SQL),
    "s19_eval_corpus": (s19_eval_corpus, S19_SQL),
    "j8_named_symbols": (j8_named_symbols, J8S_SQL),
    "j8_implementers": (j8_implementers, J8I_SQL),
}
