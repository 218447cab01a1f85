"""Checks of a change and their roll-up.

Every check is one grouped aggregate over a change table and returns
checks(change_id, name, status, details bigint), where ``details`` counts what
the status rests on. ``all_checks`` unions what is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.functions.text import entropy, lit_array



def _check(df: DataFrame, name: str, status: Column, details: Column) -> DataFrame:
    return df.select("change_id", F.lit(name).alias("name"), status.alias("status"), details.cast("bigint").alias("details"))


def changed_files(changes: DataFrame, files: DataFrame) -> DataFrame:
    """WARN when a change holds no file. changes(change_id), files(change_id, path)."""
    held = files.groupBy("change_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _check(changes.join(held, "change_id", "left"), "Changed files", F.when(n == 0, "WARN").otherwise("PASS"), n)


def secret_paths(files: DataFrame) -> DataFrame:
    """FAIL when a changed path is a credential file."""
    counted = P.with_path_facts(files, {"_secret": P.is_secret(F.col("path"))}).groupBy("change_id").agg(F.count_if("_secret").alias("n"))
    return _check(counted, "Secret paths", F.when(F.col("n") > 0, "FAIL").otherwise("PASS"), F.col("n"))


def scanned_lines(files: DataFrame, added_lines: DataFrame) -> DataFrame:
    """The lines to look for credentials in: (change_id, path, line, text, whole).

    files(change_id, path, content); added_lines(change_id, path, line, text) of the
    files whose added lines are known. Only these are looked at there; of a file
    that has none the whole content is, and ``whole`` says so. Lines count from 0.
    """
    key = ["change_id", "path"]
    known = added_lines.select(*key).distinct()
    lines = files.join(known, key, "left_anti").select(*key, F.posexplode(F.split("content", "\n")).alias("line", "text"))
    return added_lines.select(*key, "line", "text", F.lit(False).alias("whole")).unionByName(lines.withColumn("whole", F.lit(True)))


def secret_coverage(files: DataFrame, added_lines: DataFrame) -> DataFrame:
    """Per change how many files were scanned, how many of them whole, and how many had no content to scan."""
    known = added_lines.select("change_id", "path").distinct().withColumn("_known", F.lit(True))
    there = F.col("content").isNotNull() | F.col("_known").isNotNull()
    return files.join(known, ["change_id", "path"], "left").groupBy("change_id").agg(
        F.count_if(there).alias("scanned"), F.count_if(F.col("content").isNotNull() & F.col("_known").isNull()).alias("whole_files"), F.count_if(~there).alias("unavailable")
    )


def secret_findings(lines: DataFrame) -> DataFrame:
    """(change_id, path, line, format, severity) for lines that hold a credential.

    Templates only fail on a known format. A word of high entropy that is assigned
    to a name like that of a credential warns; a word of few letters does not.
    """
    text = F.col("text")
    formats = [F.when(text.rlike(pattern), F.struct(F.lit(name).alias("format"), F.lit("FAIL").alias("severity"))) for name, pattern in fixed.SECRET_FORMATS.items()]
    words = F.regexp_extract_all(text, F.lit(fixed.SECRET_ASSIGNMENT))
    assigned = F.when(
        text.rlike(fixed.SECRET_ASSIGNMENT) & ~P.is_template(F.col("path")) & F.exists(words, lambda w: entropy(w) >= fixed.SECRET_ENTROPY),
        F.struct(F.lit("credential assignment").alias("format"), F.lit("WARN").alias("severity")),
    )
    return lines.select("change_id", "path", "line", F.explode(F.array_compact(F.array(*formats, assigned))).alias("f")).select(
        "change_id", "path", "line", "f.format", "f.severity"
    )


def secret_content(changes: DataFrame, findings: DataFrame) -> DataFrame:
    """FAIL on a known format, WARN on an assignment; all findings are counted."""
    counted = findings.groupBy("change_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") == "FAIL").alias("bad")
    )
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    return _check(changes.join(counted, "change_id", "left"), "Secret content", F.when(bad > 0, "FAIL").when(n > 0, "WARN").otherwise("PASS"), n)


def risk_review(files: DataFrame) -> DataFrame:
    """C4: WARN when a changed path is risk-sensitive."""
    counted = P.with_path_facts(files, {"_risk": P.is_gate_risk(F.col("path"))}).groupBy("change_id").agg(F.count_if("_risk").alias("n"))
    return _check(counted, "Risk review", F.when(F.col("n") > 0, "WARN").otherwise("PASS"), F.col("n"))


def migration_statements(migrations: DataFrame) -> DataFrame:
    """(change_id, path, statement_no, effect, every_row) from migrations(change_id, path, text)."""
    plain = F.regexp_replace(F.regexp_replace("text", r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    each = migrations.select("change_id", "path", F.posexplode(F.split(plain, ";")).alias("statement_no", "s"))
    no_where = ~F.col("s").rlike(r"(?i)\bWHERE\b")
    effects = [
        F.when(F.col("s").rlike(p), F.struct(F.lit(e).alias("effect"), (F.lit(e in ("rewrites existing rows", "deletes rows")) & no_where).alias("every_row")))
        for e, p in fixed.DATA_MUTATIONS.items()
    ]
    return each.select("change_id", "path", "statement_no", F.explode(F.array_compact(F.array(*effects))).alias("e")).select("change_id", "path", "statement_no", "e.*")


def migration_safety(migrations: DataFrame) -> DataFrame:
    """WARN when a changed migration rewrites or drops data; no row without a migration."""
    rows = migrations.where(F.col("path").rlike(r"(?i)\.sql$") & F.col("path").rlike(r"(?i)(^|/)migrations?/"))
    found = migration_statements(rows).groupBy("change_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _check(rows.select("change_id").distinct().join(found, "change_id", "left"), "Migration safety", F.when(n > 0, "WARN").otherwise("PASS"), n)


def release_discipline(versions: DataFrame, files: DataFrame, settings: DataFrame) -> DataFrame:
    """Versions agree, are well formed and come with a changelog.

    versions(change_id, path, version, base_version) of changed version files,
    settings(change_id, private_solo).
    """
    well = F.coalesce(F.col("version").rlike(fixed.VERSION_FORMAT), F.lit(False))
    moved = ~F.col("version").eqNullSafe(F.col("base_version"))
    facts = versions.groupBy("change_id").agg(
        F.count("version").alias("values"), F.count_if(moved).alias("moved"), F.count_if(F.col("version").isNotNull() & ~well).alias("bad"),
        (F.min("version") != F.max("version")).alias("differ"),
    )
    log = files.groupBy("change_id").agg(F.bool_or(F.lower(P.basename(F.col("path"))).rlike(r"^changelog(\.|$)")).alias("log"))
    rows = settings.join(facts, "change_id", "left").join(log, "change_id", "left")
    status = (
        F.when(F.col("moved").isNull() | (F.col("moved") == 0), "PASS")
        .when(F.col("values") == 0, "WARN")
        .when((F.col("bad") > 0) | F.col("differ"), "FAIL")
        .when(F.coalesce("log", F.lit(False)), "PASS")
        .otherwise(F.when(F.col("private_solo"), "WARN").otherwise("FAIL"))
    )
    return _check(rows, "Release discipline", status, F.coalesce("moved", F.lit(0)))


def pr_state(prs: DataFrame) -> DataFrame:
    """prs(change_id, state, is_draft, mergeable, merge_state)."""
    up = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    state, can, merge = up("state"), up("mergeable"), up("merge_state")
    status = (
        F.when(state == "MERGED", "PASS")
        .when((state == "CLOSED") | F.coalesce("is_draft", F.lit(False)) | (can == "CONFLICTING") | (merge == "DIRTY"), "FAIL")
        .when((can == "UNKNOWN") | merge.isin("UNKNOWN", "", "BLOCKED", "UNSTABLE"), "WARN")
        .otherwise("PASS")
    )
    return _check(prs, "PR state", status, F.lit(1))


def review_decision(prs: DataFrame) -> DataFrame:
    """prs(change_id, decision, governance)."""
    decision = F.upper(F.trim(F.coalesce("decision", F.lit(""))))
    status = (
        F.when(decision == "APPROVED", "PASS").when(decision == "CHANGES_REQUESTED", "FAIL")
        .when(decision == "REVIEW_REQUIRED", F.when(F.col("governance") == "solo", "WARN").otherwise("FAIL"))
        .when(decision == "", "SKIPPED").otherwise("WARN")
    )
    return _check(prs, "Review decision", status, F.lit(1))


def owner_approval(prs: DataFrame, approvals: DataFrame) -> DataFrame:
    """approvals(change_id, path, status) from the ownership join; prs(change_id, governance, has_rules)."""
    facts = approvals.groupBy("change_id").agg(F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "manual").alias("manual"))
    missing, manual = F.coalesce("missing", F.lit(0)), F.coalesce("manual", F.lit(0))
    status = (
        F.when(~F.col("has_rules"), "WARN").when(missing > 0, F.when(F.col("governance") == "solo", "WARN").otherwise("FAIL"))
        .when(manual > 0, "SKIPPED").otherwise("PASS")
    )
    return _check(prs.join(facts, "change_id", "left"), "CODEOWNERS", status, missing + manual)


def conversations(prs: DataFrame, threads: DataFrame) -> DataFrame:
    """FAIL while a review thread is open. threads(change_id, resolved)."""
    open_ = threads.groupBy("change_id").agg(F.count_if(~F.col("resolved")).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return _check(prs.join(open_, "change_id", "left"), "Review conversations", F.when(n > 0, "FAIL").otherwise("PASS"), n)


def status_checks(prs: DataFrame, runs: DataFrame) -> DataFrame:
    """C11: runs(change_id, conclusion, status): a bad conclusion fails, an unfinished one warns, none warns."""
    conclusion, state = F.upper(F.coalesce("conclusion", F.lit(""))), F.upper(F.coalesce("status", F.lit("")))
    good = conclusion.isin("SUCCESS", "NEUTRAL", "SKIPPED")
    facts = runs.groupBy("change_id").agg(
        F.count("*").alias("n"), F.count_if(~good & (conclusion != "")).alias("failing"), F.count_if((conclusion == "") & (state != "COMPLETED")).alias("pending")
    )
    n, failing, pending = (F.coalesce(c, F.lit(0)) for c in ("n", "failing", "pending"))
    status = F.when(n == 0, "WARN").when(failing > 0, "FAIL").when(pending > 0, "WARN").otherwise("PASS")
    return _check(prs.join(facts, "change_id", "left"), "Status checks", status, F.when(failing > 0, failing).otherwise(pending))


SAFEGUARDS = ["reviews", "approving review", "owner review", "status checks", "conversations", "no force push", "no deletion"]


def branch_protection(prs: DataFrame) -> DataFrame:
    """prs(change_id, base_branch, protected, reviews_required, approvals_required, owner_reviews,
    status_contexts, conversation_resolution, force_pushes, deletions)."""
    reviews = F.col("reviews_required")
    issues = F.array_compact(F.array(
        F.when(~reviews, F.lit("reviews")), F.when(reviews & (F.col("approvals_required") < 1), F.lit("approving review")),
        F.when(reviews & ~F.col("owner_reviews"), F.lit("owner review")), F.when(F.col("status_contexts") == 0, F.lit("status checks")),
        F.when(~F.col("conversation_resolution"), F.lit("conversations")), F.when(F.col("force_pushes"), F.lit("no force push")),
        F.when(F.col("deletions"), F.lit("no deletion")),
    ))
    status = (
        F.when(F.trim(F.coalesce("base_branch", F.lit(""))) == "", "SKIPPED").when(~F.col("protected"), "WARN")
        .when(F.size(issues) > 0, "WARN").otherwise("PASS")
    )
    return _check(prs, "Branch protection", status, F.size(issues))


def scope_contract(compared: DataFrame, implied: DataFrame, amended: DataFrame) -> DataFrame:
    """FAIL when a changed file was never declared, amended or implied.

    compared is J10 with amended files already counted as related; the counts
    are columns beside the check.
    """
    key = ["change_id", "path"]
    rows = (
        compared.where("place <> 'unconfirmed'")
        .join(implied.select(*key, F.lit(True).alias("implied")).distinct(), key, "left")
        .join(amended.select(*key, F.lit(True).alias("amended")).distinct(), key, "left")
    )
    expected = F.col("place").isin("direct", "related")
    facts = rows.groupBy("change_id").agg(
        F.count_if(expected & F.col("amended").isNull()).alias("declared"), F.count_if((F.col("place") == "related") & F.col("amended").isNotNull()).alias("amended"),
        F.count_if(~expected & F.col("implied").isNotNull()).alias("implied"), F.count_if(~expected & F.col("implied").isNull()).alias("undeclared"),
    )
    return facts.select(
        "change_id", F.lit("Scope contract").alias("name"), F.when(F.col("undeclared") > 0, "FAIL").otherwise("PASS").alias("status"),
        F.col("undeclared").alias("details"), "declared", "amended", "implied",
    )


def all_checks(*parts: DataFrame) -> DataFrame:
    """Every check in one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def verdicts(checks: DataFrame, keys: tuple[str, ...] = ("change_id",)) -> DataFrame:
    """FAIL beats WARN beats PASS; a skipped check says nothing. Also rolls repositories up."""
    severity = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARN", 1).otherwise(0)
    worst = F.max(severity)
    return checks.groupBy(*keys).agg(F.when(worst == 2, "FAIL").when(worst == 1, "WARN").otherwise("PASS").alias("verdict"))


def policy(checks: DataFrame, changes: DataFrame, files: DataFrame, high_risk: bool = False) -> DataFrame:
    """The company (or high-risk) profile of each change. changes(change_id, governance, remote).

    Issues: solo governance, no remote evidence, or any of five named checks
    missing or not PASS; high risk adds risk-sensitive paths.
    """
    named = checks.where(F.col("name").isin(*fixed.COMPANY_CHECKS)).groupBy("change_id").agg(
        F.collect_set(F.when(F.col("status") == "PASS", F.col("name"))).alias("passed")
    )
    risky = P.with_path_facts(files, {"_risk": P.is_gate_risk(F.col("path"))}).groupBy("change_id").agg(F.count_if("_risk").alias("risky"))
    rows = changes.join(named, "change_id", "left").join(risky, "change_id", "left")
    unmet = len(fixed.COMPANY_CHECKS) - F.size(F.coalesce(F.array_intersect("passed", lit_array(fixed.COMPANY_CHECKS)), F.array().cast("array<string>")))
    issues = (F.col("governance") == "solo").cast("int") + F.when(~F.col("remote"), 1).otherwise(unmet)
    risk = F.coalesce("risky", F.lit(0))
    if high_risk:
        issues = issues + (~F.col("remote") & (risk > 0)).cast("int")
    status = F.when(issues > 0, "FAIL").when(F.lit(high_risk) & (risk > 0), "WARN").otherwise("PASS")
    return _check(rows, "Policy profile", status, issues)
