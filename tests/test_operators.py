"""Literal rows with known results, and invariants under other partitionings."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywake.functions import paths as P
from tallywake.functions.slices import medians, order_statistics, with_next, with_running
from tallywake.operators import changes as c
from tallywake.operators import context as x
from tallywake.operators import grading as g
from tallywake.operators import graph
from tallywake.operators import ledger as l
from tallywake.operators import ownership as o
from tallywake.operators import sessions as s
from tallywake.operators import terms as t
from tallywake.operators import usage as u
from tallywake.sources import corpus as sc
from tallywake.sources import logs

MIN = 60_000


# ---------------------------------------------------------------- slices
def test_sliced_windows_equal_whole_windows(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.randrange(5000), i, rng.randrange(50)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, i int, v int").withColumn("slice", F.floor(F.col("t") / 300))
    got = with_running(df, ["k"], "slice", ["t", "i"], sums={"n": F.lit(1), "sv": F.col("v")}, maxima={"m": F.col("v")})
    got = with_next(got, ["k"], "slice", ["t", "i"], F.col("i"), "nxt").select("k", "i", "n", "sv", "m", "nxt").toPandas().set_index("i").sort_index()
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v"]).sort_values(["t", "i"])
    by = pdf.groupby("k")
    want = pd.DataFrame({"i": pdf["i"], "n": by.cumcount() + 1, "sv": by["v"].cumsum(), "m": by["v"].cummax(), "nxt": by["i"].shift(-1)}).set_index("i").sort_index()
    assert (got["n"] == want["n"]).all() and (got["sv"] == want["sv"]).all() and (got["m"] == want["m"]).all()
    assert got["nxt"].astype(float).fillna(-1).tolist() == want["nxt"].fillna(-1).tolist()


def test_order_statistics_are_exact(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.uniform(-50, 5000), 7.0]) for _ in range(501)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 1.0), ("b", 4.0)], "k string, v double")
    got = {r.k: (r.n, r.low, r.high) for r in medians(df, ["k"], "v").collect()}
    ordered = sorted(values)
    assert got == {"a": (501, ordered[250], ordered[250]), "b": (2, 1.0, 4.0)}
    top = order_statistics(df, ["k"], "v", {"p": F.floor(F.col("n") * 0.9)}).where("k = 'a'").first()
    assert top.p == ordered[450]


# ---------------------------------------------------------------- grading
def test_line_overlap_finds_the_change_that_wrote_the_line(spark, rows):
    hunks = spark.createDataFrame([("r", "fix1", "p1", "src/a.js", 2, 2)], "repo_id string, fix_sha string, at_sha string, path string, from_line int, to_line int")
    owners = spark.createDataFrame([("r", "p1", "src/a.js", 1, 1, "seed"), ("r", "p1", "src/a.js", 2, 2, "edit"), ("r", "p1", "src/b.js", 1, 9, "other")], "repo_id string, at_sha string, path string, from_line int, to_line int, owner_sha string")
    fixes = spark.createDataFrame([("r", "fix1", 900)], "repo_id string, sha string, time long")
    changes = spark.createDataFrame([("r", "seed", 100), ("r", "edit", 500), ("r", "other", 10)], "repo_id string, sha string, time long")
    assert rows(g.repair_join(hunks, owners, fixes, changes)) == [("r", "edit", 400)]
    many = spark.createDataFrame([("r", "fix2", "p1", "src/a.js", i, i) for i in range(1, 62)], hunks.schema)
    assert {r.owner_sha for r in g.repair_pairs(many, owners).collect()} == {"seed", "edit"}  # however many ranges
    assert g.joined_fixes(g.repair_pairs(hunks, owners)).first().joined_fixes == 1


def test_rates_below_the_floor_are_withheld(spark):
    df = spark.createDataFrame([(["money flow"], 10), (["dependency"], None), ([], None)], "flags array<string>, repaired_after long")
    got = {r.name: r for r in g.grade_flags(df, 30, 30).collect()}
    assert got["money flow"].n == 1 and got["money flow"].repaired == 1 and got["money flow"].rate is None and got["money flow"].lift is None
    assert got["money flow"].weight == 3 and got["dependency"].weight == 0 and got["(no flag)"].n == 1
    assert got["auth/security"].n == 0 and not got["auth/security"].publishable


@pytest.mark.parametrize("subject,fix", [("fix: a", True), ("Hot-fix b", True), ("hot-fit c", True), ("bugfix d", True), ("fixture e", False), ("prefix f", False), ("patched g", False), ("Revert h", True)])
def test_fix_subjects(spark, subject, fix):
    assert spark.range(1).select(g.is_fix_subject(F.lit(subject)).alias("f")).first().f is fix


def test_wilson_interval(spark):
    from tallywake.functions import stats

    r = spark.range(1).select(stats.wilson_low(F.lit(8), F.lit(10)).alias("a"), stats.wilson_high(F.lit(8), F.lit(10)).alias("b"), stats.wilson_low(F.lit(0), F.lit(0)).alias("z")).first()
    assert (r.a, r.b, r.z) == (0.49, 0.943, 0.0)


# ---------------------------------------------------------------- usage
def test_usage_rollup_rows(spark):
    rows = [(5, 1, "cli", "ax", "ok", 100.0, "r", None, 40.0), (10, 2, "mcp", "ax", "ok", 300.0, "r", None, None), (20, 3, "cli", "gate", "ok", 50.0, "q", "PASS", None), (40, 4, "cli", "gate", "fail", 60.0, None, "FAIL", 62.0)]
    df = spark.createDataFrame(rows, "ts long, seq long, surface string, cmd string, outcome string, durationMs double, repo string, verdict string, saved_pct double").withColumns({"saved_tokens": F.lit(None).cast("long"), "tokens": F.lit(None).cast("long")})
    r = u.usage_totals(df).first()
    assert (r.events, r.cli, r.mcp, r.ok, r.fail, r.pass_rate, r.latest_saved_pct, r.distinct_repos) == (4, 3, 1, 3, 1, 50, 62.0, 2)
    ax = {row.cmd: row for row in u.usage_commands(df).collect()}["ax"]
    assert (ax["count"], ax.surface, ax.median_ms, ax.median_tokens) == (2, "both", 200, None)


def test_follow_through_rows(spark):
    rows = [(0, 1, "WARN", "WARN", "c1"), (5, 2, "PASS", "PASS", "c2"), (100, 3, "WARN", "WARN", "c3"), (103, 4, "WARN", "WARN", "c3")]
    df = spark.createDataFrame([("r", m * MIN, i, v, c_, {"Risk review": s_}) for m, i, v, s_, c_ in rows], "repo string, ts long, seq long, verdict string, change_id string, checks map<string,string>")
    got = {r.measure: (r.hits, r.n) for r in u.follow_through_gate(df, ["repo"]).collect()}
    assert got == {"followed": (2, 3), "cleared": (1, 2), "same change": (1, 2)}
    risk = u.follow_through_checks(df, ["repo"], min_sample=1).first()
    assert (risk.name, risk.alarms, risk.repeated, risk.cleared, risk.rate) == ("Risk review", 3, 1, 1, 0.5)
    late = spark.createDataFrame([("r", 0, 1, "WARN"), ("r", 61 * MIN, 2, "PASS")], "repo string, ts long, seq long, verdict string").withColumn("change_id", F.lit(None).cast("string"))
    assert {r.measure: r.hits for r in u.follow_through_gate(late, ["repo"]).collect()}["followed"] == 0


def test_log_lines_are_counted_not_lost(spark):
    lines = spark.createDataFrame([('{"v":1,"cmd":"gate"}',), ("{torn",), ('{"v":2}',), ("  ",), ('{"cmd":7}',)], "value string")
    r = logs.event_line_counts(lines).first()
    assert (r.events, r.skipped, r.skipped_newer_schema) == (2, 1, 1)


# ---------------------------------------------------------------- sessions
def session_rows(spark):
    rows = [
        ("s1", 0, "prompt", "do it", None), ("s1", 1, "edit", None, "src/refund.js"), ("s1", 2, "check", None, None), ("s1", 5, "prompt", "thanks", None), ("s1", 6, "edit", None, "README.md"), ("s1", 9, "prompt", "next", None),
        ("s2", 0, "prompt", "charge", None), ("s2", 1, "edit", None, "src/charge.js"), ("s2", 2, "check", None, None), ("s2", 2.5, "check", None, None), ("s2", 4, "prompt", "no, it has to be async", None), ("s2", 5, "edit", None, "src/charge.js"), ("s2", 8, "prompt", "ok", None),
        ("s3", 0, "prompt", "look", None), ("s3", 1, "check", None, None),
    ]
    out = [(a, i, int(m * MIN), k, text, f, "gate" if k == "check" else None, a if k == "check" else None) for i, (a, m, k, text, f) in enumerate(rows)]
    return spark.createDataFrame(out, "session_id string, seq long, ts long, kind string, text string, file string, tool string, hash string")


def test_check_outcomes_of_three_sessions(spark):
    decisions = spark.createDataFrame(
        [("d1", "gate", "s1", int(2.1 * MIN), "shown"), ("d2", "gate", "s2", int(2.1 * MIN), "withheld"), ("d3", "gate", "s2", int(2.6 * MIN), "withheld"), ("d4", "gate", "s3", int(1.1 * MIN), "shown"), ("d5", "gate", "none", 50 * MIN, "shown")],
        "decision_id string, tool string, hash string, ts long, arm string")
    graded = s.grade_checks(decisions, session_rows(spark))
    got = {(r.session_id, r.arm): (r.checks, r.follow_up, r.corrected, r.reworked) for r in graded.collect()}
    assert got == {("s1", "shown"): (1, True, False, False), ("s2", "withheld"): (2, True, True, True), ("s3", "shown"): (1, False, None, None)}
    rates = {(r.arm, r.measure): (r.hits, r.n, r.rate) for r in s.outcome_rates(graded, "arm", 30).collect()}
    assert rates[("withheld", "corrected")] == (1, 1, None) and rates[("shown", "corrected")] == (0, 1, None)


def brute_force_matches(decisions, calls, window):
    used, out = set(), {}
    for ts, key, d in sorted((ts, key, d) for d, key, ts in decisions):
        near = [(abs(cts - ts), cts, cid) for cid, ckey, cts in calls if ckey == key and cid not in used and abs(cts - ts) < window]
        if near:
            out[d] = min(near)[2]
            used.add(out[d])
    return out


def test_nearest_calls_equal_first_come_matching(spark):
    rng = random.Random(11)
    decisions = [(f"d{i:03}", rng.choice("xy"), rng.randrange(0, 6_000)) for i in range(160)]
    calls = [(f"c{i:03}", rng.choice("xy"), rng.randrange(0, 6_000)) for i in range(130)]
    want = brute_force_matches(decisions, calls, 300)
    d = spark.createDataFrame([(a, b, ts) for a, b, ts in decisions], "decision_id string, hash string, ts long")
    k = spark.createDataFrame([(a, b, ts) for a, b, ts in calls], "call_id string, hash string, ts long")
    got = {r.decision_id: r.call_id for r in s.nearest_calls(d, k, ["hash"], 300).collect()}
    assert got == want and len(want) > 80


def test_repeated_prompts_compare_with_the_last_kept(spark):
    times = [0, 100_000, 200_000, 310_000, 330_000, 3_590_000, 3_650_000, 3_720_000]
    df = spark.createDataFrame([("s", i, ts, "prompt", "same") for i, ts in enumerate(times)] + [("s", 99, 5, "edit", None)], "session_id string, seq long, ts long, kind string, text string")
    kept, last = [], None
    for i, ts in enumerate(times):
        if last is None or ts - last >= 120_000:
            kept.append(i)
            last = ts
    got = sorted(r.seq for r in s.drop_repeated_prompts(df).where("kind = 'prompt'").collect())
    assert got == kept


# ---------------------------------------------------------------- graph
def code_files(spark, rows):
    return spark.createDataFrame([("r", p, P_kind, False, imports) for p, P_kind, imports in rows], "repo_id string, path string, kind string, is_vendor boolean, imports array<string>")


def test_edges_extracted_and_inferred(spark, rows):
    files = code_files(spark, [("src/utils/format.ts", "source", []), ("src/api/handler.ts", "source", ["../utils/format.js"]), ("src/alias.ts", "source", ["@/utils/format"]), ("src/page.ts", "route", ["utils/format", "react", "lodash/fp"])])
    packages = spark.createDataFrame([("r", "lodash")], "repo_id string, package string")
    got = rows(graph.build_edges(files, packages).select("src", "dst", "provenance"), "src")
    assert got == [("src/alias.ts", "src/utils/format.ts", "EXTRACTED"), ("src/api/handler.ts", "src/utils/format.ts", "EXTRACTED"), ("src/page.ts", "src/utils/format.ts", "INFERRED")]


def test_dependents_prefer_extracted_paths(spark, rows):
    edges = spark.createDataFrame(
        [("r", "service", "core", "EXTRACTED"), ("r", "core.test", "core", "EXTRACTED"), ("r", "guessed", "core", "INFERRED"), ("r", "controller", "service", "EXTRACTED"), ("r", "controller", "guessed", "EXTRACTED"), ("r", "route", "guessed", "EXTRACTED"), ("r", "core", "route", "EXTRACTED")],
        "repo_id string, src string, dst string, provenance string")
    starts = spark.createDataFrame([("r", 1, "core")], "repo_id string, start_set int, path string")
    out = graph.dependents(edges, starts, 3, 20)
    got = rows(out.select("path", "depth", "provenance", "via"), "position")
    assert got == [("core.test", 1, "EXTRACTED", "core"), ("service", 1, "EXTRACTED", "core"), ("guessed", 1, "INFERRED", "core"), ("controller", 2, "EXTRACTED", "service"), ("route", 2, "INFERRED", "guessed")]
    assert graph.dependents(edges, starts, 1, 2).first().truncated


# ---------------------------------------------------------------- paths
@pytest.mark.parametrize("path,flags", [
    ("src/roles.guard.ts", {"auth/security"}), ("src/tokens.js", set()), ("src/token.service.ts", {"auth/security"}), ("yarn.lock", {"dependency"}), (".nvmrc", {"configuration"}),
    ("src/lib/config.js", set()), ("tests/vite.config.ts", set()), ("src/processors/a.ts", set()), ("db/1.sql", {"data model"}),
])
def test_risk_flags_of_paths(spark, path, flags):
    assert set(spark.range(1).select(P.risk_flags(F.lit(path)).alias("f")).first().f) == flags


def test_gate_and_secret_paths(spark):
    df = spark.createDataFrame([("tests/checkout.spec.ts",), ("yarn.lock",), (".nvmrc",), ("config/dev.environments.ts",), ("docs/secrets-management.md",), (".env.local",), (".env.example",), ("secrets/aws.json",)], "p string")
    got = {r.p: (r.gate, r.secret) for r in df.select("p", P.is_gate_risk(F.col("p")).alias("gate"), P.is_secret(F.col("p")).alias("secret")).collect()}
    assert not got["tests/checkout.spec.ts"][0] and not got["yarn.lock"][0] and got[".nvmrc"][0]
    assert not got["config/dev.environments.ts"][1] and not got["docs/secrets-management.md"][1] and got[".env.local"][1] and not got[".env.example"][1] and got["secrets/aws.json"][1]


def test_concepts_need_whole_words(spark):
    df = spark.createDataFrame([("fix payload parsing",), ("add Apple sign-in",), ("sign in with google",), ("add an apple emoji",)], "q string")
    got = {r.q: r.c for r in df.select("q", t.concepts(F.col("q")).alias("c")).collect()}
    assert got == {"fix payload parsing": [], "add Apple sign-in": ["auth/security"], "sign in with google": ["auth/security"], "add an apple emoji": []}


# ---------------------------------------------------------------- changes
def test_declared_closure_reaches_a_fixed_point(spark, rows):
    key = "change_id int, path string"
    df = lambda *paths: spark.createDataFrame([(1, p) for p in paths], key)
    edges = spark.createDataFrame([(1, "src/user/a.ts", "src/far/b.ts"), (1, "src/far/b.ts", "src/far/c.ts"), (1, "src/x/d.ts", "src/hub.ts"), (1, "src/user/a.ts", "src/hub.ts"), (1, "src/pay/billing.ts", "src/far/c.ts")], "change_id int, src string, dst string")
    importers = spark.createDataFrame([(1, "src/far/b.ts", 1), (1, "src/far/c.ts", 2), (1, "src/hub.ts", 9)], "change_id int, path string, importers int")
    terms = spark.createDataFrame([(1, "hubspot")], "change_id int, term string")
    modules = spark.createDataFrame([(1, "src/named")], "change_id int, directory string")
    lines = spark.createDataFrame([(1, "deploy.yml", 1, "run: hubspot-sync")], "change_id int, path string, line int, text string")
    candidates = df("src/far/b.ts", "src/far/c.ts", "src/hub.ts", "src/x/d.ts", "docs/hubspot-sync.md", "src/named/q.ts", "deploy.yml", "src/user/sub/z.ts", "tests/b.test.ts", "docs/other.md", "src/pay/billing.ts", ".env")
    out = c.declared_closure(df("src/user/a.ts"), candidates, df("src/user/a.ts"), terms, modules, edges, importers, lines)
    got = {r.path: (r.rule, r.anchor) for r in out.collect()}
    assert got == {
        "docs/hubspot-sync.md": ("request-word", "hubspot"), "src/named/q.ts": ("request-module", "src/named"), "deploy.yml": ("request-config", "hubspot"), "src/user/sub/z.ts": ("owner-module", "src/user/a.ts"),
        "src/far/b.ts": ("scope-import", "src/user/a.ts"), "src/far/c.ts": ("scope-import", "src/far/b.ts"), "tests/b.test.ts": ("scope-test", "src/far/b.ts"), "docs/other.md": ("scope-doc", "deploy.yml"),
    }


def test_results_do_not_depend_on_partitioning(spark):
    base = spark.createDataFrame([(i % 4, f"src/m{i % 7}/f{i}.ts", "required" if i % 3 else "supporting") for i in range(60)], "change_id int, path string, role string")
    changed = base.where("change_id <> 3").select("change_id", "path").unionByName(spark.createDataFrame([(0, "src/m1/new.ts")], "change_id int, path string"))
    one = c.prediction_verdicts(c.compare_predicted(base.repartition(1), changed.repartition(1)))
    many = c.prediction_verdicts(c.compare_predicted(base.repartition(17), changed.repartition(17)))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_last_owner_rule_wins(spark):
    rules = o.parse_rules(spark.createDataFrame([("r", "CODEOWNERS", "* @a\n*.md @docs # prose\n/src/ @core @org/team\nbuild/ ops@x.io\napps/**/x.ts @x\nnobody\n")], "repo_id string, path string, text string"))
    files = spark.createDataFrame([("r", p) for p in ["a.ts", "src/b.md", "lib/src/c.ts", "lib/build/d.ts", "apps/q/r/x.ts", "README.md"]], "repo_id string, path string")
    got = {r.path: r.owners for r in o.match_owners(files, rules).collect()}
    assert got == {"a.ts": ["@a"], "src/b.md": ["@core", "@org/team"], "lib/src/c.ts": ["@a"], "lib/build/d.ts": ["ops@x.io"], "apps/q/r/x.ts": ["@x"], "README.md": ["@docs"]}


# ---------------------------------------------------------------- ledgers
def test_appended_records_verify_and_edits_do_not(spark, monkeypatch):
    monkeypatch.setattr(l, "LINES_PER_SLICE", 3)
    df = spark.createDataFrame([("a", i, f'{{"z": {i}, "b": {{"y": 1.0, "x": null}}}}') for i in range(1, 9)], "ledger string, line long, j string")
    records = l.append_records(df.select("ledger", "line", F.parse_json("j").cast("map<string,variant>").alias("fields")))
    lines = records.select("ledger", "line", F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.lit(',"recordHash":"'), F.col("hash"), F.lit('"}')).alias("value"))
    assert l.ledger_summary(l.verify_ledger(l.parse_ledger(lines))).first().broken == 0
    edited = lines.withColumn("value", F.when(F.col("line") == 5, F.regexp_replace("value", '"z":5', '"z":6')).otherwise(F.col("value")))
    bad = [r.line for r in l.verify_ledger(l.parse_ledger(edited)).where("not valid").collect()]
    assert bad == [5]
    after = l.append_records(df.where("line = 1").select("ledger", "line", F.parse_json("j").cast("map<string,variant>").alias("fields")), spark.createDataFrame([("a", 8, "f" * 64)], "ledger string, seq long, tip string")).first()
    assert after.seq == 9 and after.prev == "f" * 64


def test_receipts_ignore_order(spark):
    df = spark.createDataFrame([(1, f"p{i}") for i in range(300)], "change_id int, path string")
    a, b = (l.receipts(d, ["change_id"], F.col("path")).first().receipt for d in (df.repartition(1), df.orderBy(F.desc("path")).repartition(7)))
    assert a == b and a != l.receipts(df.where("path <> 'p5'"), ["change_id"], F.col("path")).first().receipt


# ---------------------------------------------------------------- context ranking
def context_files(spark, rows):
    none = F.array().cast("array<string>")
    df = spark.createDataFrame(rows, "repo_id string, path string, kind string, domain string, symbols array<struct<name:string,type:string,line:int,terms:array<string>>>, exports array<string>")
    return df.withColumns({"domains": F.array("domain"), "route": F.lit(None).cast("string"), "controller": F.lit(None).cast("string"), "repo_name": F.lit("shop"), "package_name": F.lit(None).cast("string"), "is_vendor": F.lit(False),
                           "http": none, "imports": none, "form": none, "navigation": none, "local": none, "data_access": F.lit(0)})


def test_context_scores_by_hand(spark):
    files = context_files(spark, [
        ("r", "src/refund/refund-service.ts", "service", "refund", [("createRefund", "method", 3, []), ("other", "method", 9, [])], ["createRefund"]),
        ("r", "tests/refund.test.ts", "test", "tests", [], []), ("r", "src/types.ts", "source", "src", [("Refund", "interface", 1, [])], []), ("r", "src/none.ts", "source", "src", [], []),
    ])
    requests = spark.createDataFrame([(1, "r", "create refund")], "request_id int, repo_id string, text string")
    got = {r.path: r.score for r in x.context_scores(requests, files, smallest=12).collect()}
    # service: path 8, domain exact 10, export 8 + 8, symbol two words 18 + 24, topic domain 30
    assert got["src/refund/refund-service.ts"] == 8 + 10 + 16 + 42 + 30
    # test: path 8 at 70%; types: one weak word 9 at 40%
    assert got["tests/refund.test.ts"] == 5 and got["src/types.ts"] == 3 and "src/none.ts" not in got


def test_hotspots_and_modules(spark):
    files = context_files(spark, [("r", "src/refund/a.ts", "service", "refund", [("createRefund", "method", 3, []), ("misc", "method", 9, [])], [])])
    requests = spark.createDataFrame([(1, "r", "create refund")], "request_id int, repo_id string, text string")
    tokens = x.request_tokens(requests)
    terms = x.term_table(files)
    matches = x.symbol_matches(tokens, terms, files, x._factors(x.file_words(terms), tokens, files, smallest=12))
    focus = files.select(F.lit(1).alias("request_id"), "repo_id", "path")
    assert [r.name for r in x.hotspots(matches, focus, focus).collect()] == ["createRefund"]
    tree = spark.createDataFrame([("r", f"src/user/f{i}.ts") for i in range(3)] + [("r", f"lib/x{i}.ts") for i in range(30)] + [("r", "src/user/user/deep.ts")], "repo_id string, path string")
    asked = spark.createDataFrame([(1, "r", "user: add a field")], "request_id int, repo_id string, text string")
    assert [r.directory for r in t.request_modules(asked, tree).collect()] == ["src/user"]


def test_modules_of_a_request_that_names_many_folders(spark):
    paths = [f"src/part{i}/user/f.ts" for i in range(8)] + [f"lib/x{i}.ts" for i in range(40)]
    tree = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    asked = spark.createDataFrame([(1, "r", "user: add a field")], "request_id int, repo_id string, text string")
    got = {(r.directory, r.n) for r in t.request_modules(asked, tree).collect()}
    assert got == {(f"src/part{i}/user", 8) for i in range(8)}


def test_loose_candidates_keep_every_file_and_rank_by_kind(spark):
    paths = [f"src/lib/a{i}.ts" for i in range(8)] + ["src/lib/zeta.ts", "src/lib/zeta/index.ts", "src/lib/zeta/x.ts", "main.ts"] + [f"web/{i}/auth.ts" for i in range(7)]
    files = spark.createDataFrame([("r", p) for p in paths], "repo_id string, path string")
    asked = [("src/lib/a0.ts", "./zeta"), ("src/lib/a0.ts", "./zeta.ts"), ("web/0/auth.ts", "@/lib/auth"), ("web/0/auth.ts", "../../main")]
    imports = spark.createDataFrame([("r", *a) for a in asked], "repo_id string, src string, specifier string")
    of = lambda rows, spec: [(r.path, r.kind) for r in sorted(rows, key=lambda r: r.position) if r.specifier == spec]
    got, best = graph.loose_candidates(imports, files).collect(), graph.loose_candidates(imports, files, 3).collect()
    others = [(p, 3) for p in paths[:8]] + [("src/lib/zeta/x.ts", 3)]
    assert of(got, "./zeta") == [("src/lib/zeta.ts", 1), ("src/lib/zeta/index.ts", 2)] + others
    assert of(got, "./zeta.ts")[0] == ("src/lib/zeta.ts", 0) and len(of(got, "./zeta.ts")) == 11
    assert of(got, "@/lib/auth") == [(f"web/{i}/auth.ts", 1) for i in range(7)]
    assert of(got, "../../main") == [("main.ts", 1)]
    for spec in ("./zeta", "./zeta.ts", "@/lib/auth", "../../main"):
        assert of(best, spec) == of(got, spec)[:3]


def test_hotspots_look_past_unspecific_symbols(spark):
    rows = [(1, "r", "a.ts", n, f"common{n}", 90 - n, 0.5) for n in range(9)] + [(1, "r", "a.ts", 9, "rare", 10, 2.0)]
    matches = spark.createDataFrame(rows, "request_id int, repo_id string, path string, symbol_no int, name string, score int, specificity double")
    focus = matches.select("request_id", "repo_id", "path").distinct()
    assert [r.name for r in x.hotspots(matches, focus, focus.where("false")).collect()] == ["rare"]
    assert x.hotspots(matches, focus, focus).count() == 10


def test_related_files_hold_all_files_alike(spark):
    files = spark.createDataFrame([("r", f"f{i}.ts", "service", "user") for i in range(7)], "repo_id string, path string, kind string, domain string")
    primary = spark.createDataFrame([(1, "r", "f0.ts")], "request_id int, repo_id string, path string")
    none = files.selectExpr("1 as request_id", "repo_id", "path", "kind", "0 as score").where("false")
    edges = files.selectExpr("repo_id", "path as src", "path as dst").where("false")
    got = x.related_files(primary, none, edges, files)
    assert sorted(r.path for r in got.collect()) == [f"f{i}.ts" for i in range(1, 7)]
    assert x.related_files(primary, none, edges, files, alike=3).count() == 3


# ---------------------------------------------------------------- sources
def test_source_tree_scan(spark, tmp_path):
    for name, text in {"src/a.ts": "export const a = 1", "node_modules/x/b.ts": "no", "yarn.lock": "x", "img.png": "no", ".husky/pre-commit": "run", "package.json": "{}", "db/dump.sql": "no", "db/migrations/1.sql": "x", "schema.sql": "x", "src/server.key": "no", "big.ts": "y" * 1_100_000}.items():
        target = tmp_path / "tree" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    got = {r.path for r in sc.read_source_files(spark, str(tmp_path / "tree"), "r", (".husky",)).collect()}
    assert got == {"src/a.ts", "yarn.lock", ".husky/pre-commit", "db/migrations/1.sql", "schema.sql", "big.ts"}


def test_artifacts_from_a_folder(spark, tmp_path):
    for name, text in {"a.json": '{"convergence": 5}', "b.json": '{"verdict": "PASS"}', "index.json": "{}", "c.json": "{torn", "d.json": '{"summary": {"a": 1}, "files": []}'}.items():
        (tmp_path / name).write_text(text)
    assert {r.file: r.kind for r in logs.read_artifacts(spark, str(tmp_path)).collect()} == {"a.json": "converge", "b.json": "gate", "d.json": "map"}


def test_saved_run_without_answers_fails(spark):
    good = '{"method":{"windowDays":30,"minSample":30},"commits":[{"sha":"a","containment":5,"inputs":{"offline":{"novelty":{"noul":0.1}}}}]}'
    assert sc.saved_run(spark.createDataFrame([(1, good)], "run_id int, value string")).count() == 1
    with pytest.raises(Exception, match="replay it"):
        sc.saved_run(spark.createDataFrame([(1, good.replace('"containment":5,', ""))], "run_id int, value string")).collect()


def test_eval_corpus_parts(spark):
    doc = '{"k":3,"thresholds":{"retrieval":{"mrr":0.9},"risk":{"accuracy":0.97}},"retrieval":[{"name":"n","query":"q","expectedPrimary":["a"]}],"risk":[{"name":"m","mode":"path","path":"p"}]}'
    cases, risk, floors = sc.eval_corpus(spark.createDataFrame([(1, doc)], "corpus_id int, value string"))
    assert (cases.first().k, risk.first().path) == (3, "p")
    assert {r.metric: r.floor for r in floors.collect()} == {"retrieval.mrr": 0.9, "risk.accuracy": 0.97}


def test_registry_names_lead_to_the_modules_they_call(spark):
    from tallywake.operators.impact import implementers

    named = spark.createDataFrame([(1, "r", "order_total")], "request_id int, repo_id string, literal string")
    registry = spark.createDataFrame([("r", "src/tools.ts", "order_total", ["sumOrder", "taxRows"]), ("r", "tests/fixtures/tools.ts", "order_total", ["sumOrder"])], "repo_id string, path string, name string, calls array<string>")
    imports = spark.createDataFrame([("r", "src/tools.ts", "src/order.ts"), ("r", "src/tools.ts", "src/lines.ts"), ("r", "tests/fixtures/tools.ts", "src/other.ts")], "repo_id string, src string, dst string")
    files = spark.createDataFrame([("r", "src/order.ts", "source", ["sumOrder"]), ("r", "src/lines.ts", "source", ["taxRows"]), ("r", "src/other.ts", "source", ["sumOrder"])], "repo_id string, path string, kind string, exports array<string>")
    got = [(r.path, r.via) for r in implementers(named, registry, imports, files).collect()]
    assert got == [("src/order.ts", "src/tools.ts")]
