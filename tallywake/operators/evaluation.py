"""Evaluate rankings, reads, risk labels and gate results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import stats

# Subjects and authors that are not requests, and what a read must reach to count.
SKIPPED_SUBJECT = r"(?i)^(merge\b|revert\b|chore\(release\)|chore\(deps(-dev)?\)|bump\b|release\b|v?\d+\.\d+\.\d+$)"
BOT_AUTHOR = r"(?i)\[bot\]|dependabot|renovate"
IGNORED_PATH = r"(?i)(^|/)CHANGELOG(\.[a-z]+)?$"
DEMOTE_BELOW = 0.2
CHARS_PER_TOKEN = 4


def query_from_subject(subject: Column) -> Column:
    """The request behind a commit subject: no type prefix, no trailing pull request number."""
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"(?i)^[a-z]+(\([^)]*\))?!?:\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*\(#\d+\)\s*$", ""))


def retrieval_metrics(cases: DataFrame, rankings: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """Per case precision (of what was returned), recall, reciprocal rank within k.

    cases(case), rankings(case, rank from 1, path), truth(case, path). A case
    without an expectation has null measures.
    """
    top = rankings.where(F.col("rank") <= k)
    relevant = truth.select("case", "path").distinct()
    marked = top.join(relevant.withColumn("hit", F.lit(1)), ["case", "path"], "left")
    found = marked.groupBy("case").agg(
        F.count("*").alias("returned"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first")
    )
    wanted = relevant.groupBy("case").agg(F.count("*").alias("relevant"))
    rows = cases.join(wanted, "case", "left").join(found, "case", "left").na.fill(0, ["relevant", "returned", "hits"])
    known = F.col("relevant") > 0
    return rows.select(
        "case",
        F.when(known, F.col("hits")).otherwise(0).alias("hits"),
        "relevant",
        F.when(known, F.when(F.col("returned") == 0, 0.0).otherwise(F.col("hits") / F.col("returned"))).alias("precision"),
        F.when(known, F.col("hits") / F.col("relevant")).alias("recall"),
        F.when(known, F.when(F.col("first").isNull(), 0.0).otherwise(1 / F.col("first"))).alias("mrr"),
    )


def retrieval_board(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over the cases that expected something."""
    mean = lambda c: stats.round_half_up(F.coalesce(F.avg(c), F.lit(0.0)))
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count("precision").alias("scored"),
        mean("precision").alias("precision"), mean("recall").alias("recall"), mean("mrr").alias("mrr"),
    )


def case_results(cases: DataFrame, rankings: DataFrame, expected: DataFrame, any_of: DataFrame, k: int = 5) -> DataFrame:
    """A case passes when every expected path is in the top k and, if given, one of any-of is in the pack.

    cases(case, known_gap), rankings(case, rank, path, section), expected(case, path), any_of(case, path).
    """
    primary = rankings.where((F.col("section") == "primary") & (F.col("rank") <= k)).select("case", "path").distinct().withColumn("got", F.lit(1))
    pack = rankings.select("case", "path").distinct().withColumn("got", F.lit(1))
    need = expected.distinct().join(primary, ["case", "path"], "left").groupBy("case").agg((F.count("*") == F.count("got")).alias("all_found"))
    some = any_of.distinct().join(pack, ["case", "path"], "left").groupBy("case").agg((F.count("got") > 0).alias("any_found"))
    joined = cases.join(need, "case", "left").join(some, "case", "left")
    passed = F.coalesce("all_found", F.lit(True)) & F.coalesce("any_found", F.lit(True))
    return joined.select("case", "known_gap", passed.alias("passed"))


def history_cases(commits: DataFrame, max_files: int = 12) -> DataFrame:
    """Every commit with its query and the reason it is skipped, null when scored.

    commits(repo_id, sha, parent, author, subject, time, expected_files). Of equal
    queries the newest copy is kept: its time comes from a combined maximum.
    """
    query = query_from_subject(F.col("subject"))
    early = (
        F.when(F.col("parent").isNull() | (F.col("parent") == ""), "root commit")
        .when(F.coalesce(F.col("author").rlike(BOT_AUTHOR), F.lit(False)), "bot author")
        .when((query == "") | F.col("subject").rlike(SKIPPED_SUBJECT) | query.rlike(SKIPPED_SUBJECT), "release, merge or bump subject")
    )
    rows = commits.withColumns({"query": query, "_early": early, "_key": F.lower(query)})
    newest = rows.where("_early is null").groupBy("repo_id", "_key").agg(F.max(F.struct("time", "sha")).alias("_newest"))
    joined = rows.join(newest, ["repo_id", "_key"], "left")
    is_newest = F.struct("time", "sha") == F.col("_newest")
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(~is_newest, "repeated subject")
        .when(F.col("expected_files") == 0, "no existing file changed")
        .when(F.col("expected_files") > max_files, "too many files changed")
    )
    return joined.select("repo_id", "sha", "query", reason.alias("skipped"))


def history_board(cases: DataFrame, metrics: DataFrame, pack: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hit, recall, precision and MRR at k, pack recall and the share of files no index holds.

    cases(case), metrics from A16, pack(case, needed, found, unindexed).
    """
    rows = cases.join(metrics, "case", "left").join(pack, "case", "left")
    scored = F.col("recall").isNotNull()
    mean = lambda c: stats.round_half_up(F.coalesce(F.avg(F.when(scored, c)), F.lit(0.0)))
    total = F.sum(F.col("needed") + F.col("unindexed"))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(scored).alias("scored"),
        mean((F.col("hits") > 0).cast("double")).alias("hit_at_k"), mean(F.col("recall")).alias("r_at_k"),
        mean(F.col("precision")).alias("p_at_k"), mean(F.col("mrr")).alias("mrr"),
        mean(F.coalesce(F.when(F.col("needed") > 0, F.col("found") / F.col("needed")), F.lit(0.0))).alias("pack_recall"),
        F.when(total > 0, stats.round_half_up(F.sum("unindexed") / total)).otherwise(0.0).alias("unindexed_share"),
    )


def label_accuracy(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Share of cases whose expected labels are all there and forbidden ones absent.

    rows(keys..., actual, expected, forbidden) are short label arrays.
    """
    passed = (F.size(F.array_except("expected", "actual")) == 0) & ~F.arrays_overlap("forbidden", "actual")
    counted = rows.groupBy(*keys).agg(F.count("*").alias("cases"), F.count_if(passed).alias("passed"))
    return counted.withColumn("accuracy", stats.round_half_up(F.col("passed") / F.col("cases")))


def threshold_checks(measures: DataFrame, thresholds: DataFrame) -> DataFrame:
    """measures(metric, value) against thresholds(metric, floor); a metric without a floor is not checked."""
    rows = measures.join(thresholds.where("floor is not null"), "metric")
    passed = F.col("value") >= F.col("floor")
    return rows.select("metric", "value", "floor", passed.alias("passed"), F.min(passed).over(Window.partitionBy()).alias("all_passed"))


def grade_reads(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, acceptance and Brier score of reads.

    reads(keys..., error, choice_correct, accepted, confidence, applied_correct,
    heuristic, heuristic_correct, capability_correct, cost_usd, latency_ms, attempts).
    """
    ok = F.col("error").isNull()
    yes = lambda c: ok & F.coalesce(F.col(c), F.lit(False))
    share = lambda hits, n: F.when(n > 0, stats.round_half_up(hits / n))
    brier = F.avg(F.when(ok, F.pow(F.col("confidence") - F.col("choice_correct").cast("double"), F.lit(2.0))))
    counted = reads.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(ok).alias("read"), F.count_if(yes("choice_correct")).alias("_correct"), F.count_if(yes("accepted")).alias("_accepted"),
        F.count_if(yes("accepted") & yes("choice_correct")).alias("_both"), F.count_if(yes("applied_correct")).alias("_applied"),
        F.count_if(yes("heuristic_correct")).alias("_heuristic"), F.count_if(ok & (F.col("heuristic") == "unknown")).alias("heuristic_unknown"),
        F.count(F.when(ok, F.col("capability_correct"))).alias("graded"), F.count_if(yes("capability_correct")).alias("_capable"),
        brier.alias("_brier"), F.sum(F.when(ok, F.col("cost_usd"))).alias("_cost"), F.sum(F.when(ok, F.col("latency_ms"))).alias("_latency"),
        F.count_if(ok & (F.coalesce("attempts", F.lit(1)) > 1)).alias("retried"),
    )
    read = F.col("read")
    return counted.select(
        *keys, "cases", "read", (F.col("cases") - read).alias("errors"), share(F.col("_correct"), read).alias("accuracy"),
        share(F.col("_accepted"), read).alias("accepted_rate"), share(F.col("_both"), F.col("_accepted")).alias("accepted_accuracy"),
        share(F.col("_applied"), read).alias("applied_accuracy"), share(F.col("_heuristic"), read).alias("heuristic_accuracy"), "heuristic_unknown",
        stats.round_half_up(F.col("_brier")).alias("brier"), "graded", share(F.col("_capable"), F.col("graded")).alias("capability_accuracy"),
        stats.round_half_up(F.col("_cost"), 6).alias("total_usd"), stats.round_int(F.col("_latency") / read).alias("mean_latency_ms"), "retried",
    )


def confidence_bands(reads: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """N, mean confidence and accuracy in four bands; empty bands are rows too."""
    bands = [("< 0.5", 0.0, 0.5), ("0.5 to 0.7", 0.5, 0.7), ("0.7 to 0.9", 0.7, 0.9), (">= 0.9", 0.9, 1.01)]
    c = F.col("confidence")
    inside = F.col("error").isNull() & c.isNotNull()
    counted = reads.groupBy(*keys).agg(*[
        F.struct(
            F.count_if(inside & (c >= low) & (c < high)).alias("n"),
            stats.round_half_up(F.avg(F.when(inside & (c >= low) & (c < high), c))).alias("mean_confidence"),
            F.count_if(inside & (c >= low) & (c < high) & F.coalesce("choice_correct", F.lit(False))).alias("correct"),
        ).alias(f"_b{i}")
        for i, (_, low, high) in enumerate(bands)
    ])
    entries = F.array(*[F.struct(F.lit(name).alias("band"), F.col(f"_b{i}").alias("b")) for i, (name, _, _) in enumerate(bands)])
    long = counted.select(*keys, F.explode(entries).alias("e"))
    return long.select(
        *keys, "e.band", "e.b.n", "e.b.mean_confidence", F.when(F.col("e.b.n") > 0, stats.round_half_up(F.col("e.b.correct") / F.col("e.b.n"))).alias("accuracy")
    )


def relevance_summary(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Demotions and mean relevance of expected and other files. scores(keys..., relevance, expected)."""
    known = scores.where("relevance is not null")
    return known.groupBy(*keys, "expected").agg(
        F.count("*").alias("scored"), F.count_if(F.col("relevance") < DEMOTE_BELOW).alias("demoted"), stats.round_half_up(F.avg("relevance")).alias("mean_relevance")
    )


def score_gate_cases(cases: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Verdict as expected, every expected check with its status and text, no other FAIL.

    cases(case, expected_verdict, actual_verdict), expected(case, name, status,
    contains array<string>), actual(case, name, status, summary).
    """
    got = actual.select("case", "name", F.col("status").alias("got"), F.coalesce("summary", F.lit("")).alias("summary"))
    each = expected.join(got, ["case", "name"], "left")
    fits = F.coalesce((F.col("got") == F.col("status")) & F.forall(F.coalesce("contains", F.array().cast("array<string>")), lambda s: F.col("summary").contains(s)), F.lit(False))
    checks = each.groupBy("case").agg(F.count_if(~fits).alias("wrong"))
    allowed = expected.where("status = 'FAIL'").select("case", "name").distinct()
    extra = got.where("got = 'FAIL'").join(allowed, ["case", "name"], "left_anti").groupBy("case").agg(F.count("*").alias("unexpected"))
    rows = cases.join(checks, "case", "left").join(extra, "case", "left").na.fill(0, ["wrong", "unexpected"])
    passed = F.col("expected_verdict").eqNullSafe(F.col("actual_verdict")) & (F.col("wrong") == 0) & (F.col("unexpected") == 0)
    return rows.select("case", "wrong", "unexpected", passed.alias("passed"))


def estimate_tokens(chars: Column) -> Column:
    """Four characters are a token, rounded up."""
    return F.ceil(chars / CHARS_PER_TOKEN).cast("bigint")


def token_savings(tasks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tokens of the answer against the naive read. tasks(keys..., used, naive) in characters."""
    total = tasks.groupBy(*keys).agg(F.sum("used").alias("used"), F.sum("naive").alias("naive"))
    used, naive = estimate_tokens(F.col("used")), estimate_tokens(F.col("naive"))
    return total.select(
        *keys, used.alias("used_tokens"), naive.alias("naive_tokens"), (naive - used).alias("saved_tokens"),
        F.when(F.col("naive") > 0, stats.round_int((F.col("naive") - F.col("used")) / F.col("naive") * 100)).otherwise(0).alias("saved_pct"),
    )


def apply_relevance(ranked: DataFrame, scores: DataFrame) -> DataFrame:
    """Files scored under 0.2 leave the list with their old rank; the rest by relevance, unscored last.

    ranked(request_id, path, rank), scores(request_id, path, relevance). Every
    distinct path of a request stays in the result, scored or not.
    """
    first = ranked.groupBy("request_id", "path").agg(F.min("rank").alias("rank"))
    rows = first.join(scores, ["request_id", "path"], "left")
    demoted = F.coalesce(F.col("relevance") < DEMOTE_BELOW, F.lit(False))
    again = Window.partitionBy("request_id", "demoted").orderBy(F.desc_nulls_last("relevance"), "rank", "path")
    return rows.withColumn("demoted", demoted).select(
        "request_id", "path", F.col("rank").alias("old_rank"), "relevance", "demoted",
        F.when(~F.col("demoted"), F.row_number().over(again)).alias("position"),
    )
