"""Grade changes against what later happened to them.

``by`` lists leading keys such as ``repo_id``; an empty list grades the whole
table as one corpus. Every grade is one aggregate with map-side combine; the
base rate rides along as an extra group so no second pass or cross join is
needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import stats
from tallywake.functions.stats import DAY_SECONDS, DEFAULT_MIN_SAMPLE

BASE = "(base)"
NO_FLAG = "(no flag)"
LINE_BUCKET = 64


# ---------------------------------------------------------------- subjects
def is_fix_subject(subject: Column) -> Column:
    return F.coalesce(subject.rlike(fixed.FIX_SUBJECT), F.lit(False))


def is_release_subject(subject: Column) -> Column:
    return F.coalesce(subject.rlike(fixed.RELEASE_SUBJECT), F.lit(False))


# ---------------------------------------------------------------- joins
def repair_join(hunks: DataFrame, owners: DataFrame, fixes: DataFrame, changes: DataFrame) -> DataFrame:
    """Seconds from each change to the earliest fix that rewrote its lines.

    hunks(repo_id, fix_sha, at_sha, path, from_line, to_line) are the pre-image
    ranges of each fix; owners(repo_id, at_sha, path, from_line, to_line,
    owner_sha) say who owned the lines then. Both sides are cut at fixed line
    buckets, so the overlap test runs inside small equi-join keys and a hot file
    spreads over many tasks, however many ranges it has.
    """
    pairs = repair_pairs(hunks, owners)
    timed = (
        pairs.join(fixes.select("repo_id", F.col("sha").alias("fix_sha"), F.col("time").alias("fix_time")), ["repo_id", "fix_sha"])
        .join(changes.select("repo_id", F.col("sha").alias("owner_sha"), F.col("time").alias("change_time")), ["repo_id", "owner_sha"])
        .withColumn("elapsed", F.col("fix_time") - F.col("change_time"))
        .where("elapsed >= 0")
    )
    return timed.groupBy("repo_id", F.col("owner_sha").alias("sha")).agg(F.min("elapsed").alias("repaired_after"))


def repair_pairs(hunks: DataFrame, owners: DataFrame) -> DataFrame:
    """Distinct (repo_id, fix_sha, owner_sha) whose line ranges overlap."""
    def bucketed(df: DataFrame, low: str, high: str) -> DataFrame:
        spans = F.sequence(F.floor(F.col("from_line") / LINE_BUCKET), F.floor(F.col("to_line") / LINE_BUCKET))
        return df.withColumn("bucket", F.explode(spans)).withColumnsRenamed({"from_line": low, "to_line": high})

    h = bucketed(hunks.select("repo_id", "at_sha", "path", "fix_sha", "from_line", "to_line"), "h_from", "h_to")
    o = bucketed(owners.select("repo_id", "at_sha", "path", "owner_sha", "from_line", "to_line"), "o_from", "o_to")
    return (
        h.join(o, ["repo_id", "at_sha", "path", "bucket"])
        .where((F.col("o_from") <= F.col("h_to")) & (F.col("h_from") <= F.col("o_to")))
        .select("repo_id", "fix_sha", "owner_sha")
        .distinct()
    )


def joined_fixes(pairs: DataFrame, by: Sequence[str] = ("repo_id",)) -> DataFrame:
    """How many fixes rewrote at least one owned line."""
    fixes = pairs.select(*by, "fix_sha").distinct()
    return fixes.groupBy(*by).agg(F.count("*").alias("joined_fixes"))


def file_repair_join(changed: DataFrame, fixed_files: DataFrame, slice_seconds: int = 30 * DAY_SECONDS) -> DataFrame:
    """The weaker baseline; the next fix that touched the same file at or after a change.

    changed(repo_id, sha, path, time), fixed_files(repo_id, path, time). Only the
    next fix per row is looked up, from slices of time, so no pairs are listed.
    """
    marks = fixed_files.select("repo_id", "path", F.lit(None).cast("string").alias("sha"), "time", F.lit(1).alias("is_fix"))
    rows = changed.select("repo_id", "path", F.col("sha").cast("string").alias("sha"), "time", F.lit(0).alias("is_fix"))
    # Reversed time turns "next fix" into a running minimum, kept as a maximum of -time.
    both = rows.unionByName(marks).select(
        "*", (-F.col("time")).alias("back"), (-F.floor(F.col("time") / slice_seconds)).alias("slice")
    )
    from tallywake.functions.slices import with_running

    # At the same second the fix must come first when walking backwards.
    known = with_running(
        both.withColumn("rank", 1 - F.col("is_fix")),
        ["repo_id", "path"],
        "slice",
        ["back", "rank"],
        maxima={"last_fix": F.when(F.col("is_fix") == 1, F.col("back"))},
    )
    return (
        known.where("is_fix = 0 and last_fix is not null")
        .groupBy("repo_id", "sha")
        .agg(F.min(-F.col("last_fix") - F.col("time")).alias("repaired_after"))
    )


def child_commits(heads: DataFrame, commits: DataFrame) -> DataFrame:
    """The earliest single-parent commit made on each head."""
    children = commits.where(F.size("parents") == 1).select(
        "repo_id", F.col("parents")[0].alias("head"), F.struct("time", "sha", "subject").alias("child")
    )
    first = children.groupBy("repo_id", "head").agg(F.min("child").alias("child"))
    return heads.join(first, ["repo_id", "head"], "left").select(
        *heads.columns, F.col("child.sha").alias("sha"), F.col("child.time").alias("time"), F.col("child.subject").alias("subject")
    )


# ---------------------------------------------------------------- grades
def _grade(
    rows: DataFrame,
    by: Sequence[str],
    names: Column,
    within: Column,
) -> DataFrame:
    """n and repaired for every name of every row; one shuffle, combined map-side."""
    return (
        rows.select(*by, F.explode(names).alias("name"), within.cast("int").alias("_hit"))
        .groupBy(*by, "name")
        .agg(F.count("*").alias("n"), F.sum("_hit").cast("bigint").alias("repaired"))
    )


def _with_base(graded: DataFrame, by: Sequence[str], min_sample: int, rounded_base: bool) -> DataFrame:
    """Rates, intervals and lift over the base row of the same group."""
    w = Window.partitionBy(*by)
    base_n = F.max(F.when(F.col("name") == BASE, F.col("n"))).over(w)
    base_hits = F.max(F.when(F.col("name") == BASE, F.col("repaired"))).over(w)
    base_share = stats.rate(base_hits, base_n, min_sample) if rounded_base else F.when(base_n > 0, base_hits / base_n)
    shown = (F.col("n") >= min_sample) & (F.col("n") > 0)
    share = F.when(shown, F.col("repaired") / F.col("n"))
    return graded.select(
        *by,
        "name",
        "n",
        "repaired",
        stats.round_half_up(share).alias("rate"),
        F.when(shown, stats.wilson_low(F.col("repaired"), F.col("n"))).alias("ci_low"),
        F.when(shown, stats.wilson_high(F.col("repaired"), F.col("n"))).alias("ci_high"),
        share.alias("_share"),
        base_share.alias("_base"),
        (F.col("n") >= min_sample).alias("publishable"),
    )


def _fill_names(counted: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Every listed name gets a row per group, with zero counts when unseen."""
    zeros = counted.where(F.col("name") == BASE).select(
        *by, F.explode(F.array(*[F.lit(n) for n in names])).alias("name"), F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("repaired")
    )
    return counted.unionByName(zeros).groupBy(*by, "name").agg(F.sum("n").alias("n"), F.sum("repaired").alias("repaired"))


def grade_flags(
    changes: DataFrame,
    window_days: int,
    min_sample: int = DEFAULT_MIN_SAMPLE,
    weights: dict[str, int] | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """A3: repair rate and lift per flag. changes(by..., flags, repaired_after)."""
    weights = fixed.RISK_WEIGHTS if weights is None else weights
    flags = F.coalesce(F.array_distinct("flags"), F.array().cast("array<string>"))
    names = F.concat(F.when(F.size(flags) == 0, F.array(F.lit(NO_FLAG))).otherwise(flags), F.array(F.lit(BASE)))
    counted = _fill_names(
        _grade(changes, by, names, stats.repaired_within(F.col("repaired_after"), window_days)), by, [*weights, NO_FLAG]
    )
    graded = _with_base(counted, by, min_sample, rounded_base=False).where(F.col("name") != BASE)
    weight_of = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    out = graded.select(
        *by,
        "name",
        (weight_of[F.col("name")] if weight_of is not None else F.lit(None)).cast("int").alias("weight"),
        "n",
        "repaired",
        "rate",
        "ci_low",
        "ci_high",
        F.when(F.col("_base") != 0, stats.round_half_up(F.col("_share") / F.col("_base"))).alias("lift"),
        "publishable",
    )
    order = Window.partitionBy(*by).orderBy(F.coalesce("lift", F.lit(-1.0)).desc(), F.desc("n"), "name")
    return out.withColumn("position", F.row_number().over(order))


def band_of_flags(flags: Column, weights: dict[str, int] | None = None) -> Column:
    weights = fixed.RISK_WEIGHTS if weights is None else weights
    score = sum((F.when(F.array_contains(flags, name), F.lit(w)).otherwise(0) for name, w in weights.items()), F.lit(0))
    return F.when(score >= fixed.RISK_HIGH, "high").when(score >= fixed.RISK_MEDIUM, "medium").otherwise("low")


def grade_groups(
    changes: DataFrame,
    group: Column,
    order: Sequence[str],
    window_days: int,
    min_sample: int = DEFAULT_MIN_SAMPLE,
    by: Sequence[str] = (),
    rounded_base: bool = True,
) -> DataFrame:
    """A4, A7, and the tier tables of A8: a row per listed group plus the ordering check.

    ``monotonic`` compares the first three of ``order`` and is null unless all
    three cleared the sample floor.
    """
    names = F.array(group, F.lit(BASE))
    within = stats.repaired_within(F.col("repaired_after"), window_days)
    counted = _fill_names(_grade(changes, by, names, within).where(F.col("name").isNotNull()), by, order)
    graded = _with_base(counted, by, min_sample, rounded_base)
    w = Window.partitionBy(*by)
    rates = [F.max(F.when(F.col("name") == name, F.col("rate"))).over(w) for name in order[:3]]
    lift_share = F.col("rate") if rounded_base else F.col("_share")
    return graded.select(
        *by,
        "name",
        "n",
        "repaired",
        "rate",
        "ci_low",
        "ci_high",
        F.when((F.col("_base") != 0) & (F.col("name") != BASE), stats.round_half_up(lift_share / F.col("_base"))).alias("lift"),
        "publishable",
        stats.ordered(*rates).alias("monotonic"),
    )


def window_sweep(changes: DataFrame, days: Sequence[int] = (7, 14, 30, 60, 90), by: Sequence[str] = ()) -> DataFrame:
    """A5: repair rate at each window length, from one pass."""
    counted = changes.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.count_if(stats.repaired_within(F.col("repaired_after"), d)).alias(f"_d{d}") for d in days],
    )
    entries = F.array(*[F.struct(F.lit(d).alias("days"), F.col(f"_d{d}").alias("repaired")) for d in days])
    return counted.select(*by, "n", F.explode(entries).alias("e")).select(
        *by, "e.days", "n", "e.repaired", stats.round_half_up(F.col("e.repaired") / F.greatest("n", F.lit(1))).alias("rate")
    )


def separates(better_high: Column, worse_low: Column) -> Column:
    """True when the worse group's interval lies wholly above the better one's."""
    return F.when(better_high.isNotNull() & worse_low.isNotNull(), worse_low > better_high)


def grade_verdicts(
    changes: DataFrame, window_days: int, min_sample: int = DEFAULT_MIN_SAMPLE, by: Sequence[str] = ()
) -> DataFrame:
    """Repair rate per verdict, and how the alarm separates. changes(by..., verdict, repaired_after)."""
    gated = changes.where(F.col("verdict").isNotNull())
    alarmed = F.col("verdict") != "PASS"
    names = F.array_compact(F.array(F.col("verdict"), F.when(alarmed, F.lit("alarmed")), F.lit(BASE)))
    within = stats.repaired_within(F.col("repaired_after"), window_days)
    order = ["PASS", "WARN", "FAIL", "alarmed"]
    counted = _fill_names(_grade(gated, by, names, within), by, order)
    graded = _with_base(counted, by, min_sample, rounded_base=True)
    w = Window.partitionBy(*by)
    passed_high = F.max(F.when(F.col("name") == "PASS", F.col("ci_high"))).over(w)
    alarmed_low = F.max(F.when(F.col("name") == "alarmed", F.col("ci_low"))).over(w)
    return graded.select(
        *by,
        "name",
        "n",
        "repaired",
        "rate",
        "ci_low",
        "ci_high",
        F.when((F.col("_base") != 0) & (F.col("name") != BASE), stats.round_half_up(F.col("rate") / F.col("_base"))).alias("lift"),
        "publishable",
        separates(passed_high, alarmed_low).alias("separates"),
    )


def alarm_summary(
    changes: DataFrame, window_days: int, min_sample: int = DEFAULT_MIN_SAMPLE, by: Sequence[str] = ()
) -> DataFrame:
    """Alarm rate, false alarms and caught repairs, as one row per group and measure."""
    within = stats.repaired_within(F.col("repaired_after"), window_days)
    alarm = F.col("verdict") != "PASS"
    counted = changes.where(F.col("verdict").isNotNull()).groupBy(*by).agg(
        F.count("*").alias("gated"),
        F.count_if(alarm).alias("alarmed"),
        F.count_if(within).alias("repaired"),
        F.count_if(alarm & within).alias("caught"),
    )
    measures = F.array(
        F.struct(F.lit("alarm rate").alias("measure"), F.col("alarmed").alias("hits"), F.col("gated").alias("n")),
        F.struct(F.lit("false alarms").alias("measure"), (F.col("alarmed") - F.col("caught")).alias("hits"), F.col("alarmed").alias("n")),
        F.struct(F.lit("caught").alias("measure"), F.col("caught").alias("hits"), F.col("repaired").alias("n")),
    )
    return (
        counted.select(*by, F.explode(measures).alias("m"))
        .select(*by, "m.*")
        .select(*by, "measure", "hits", "n", *stats.proportion("hits", "n", min_sample))
    )


def grade_checks(
    changes: DataFrame, window_days: int, min_sample: int = DEFAULT_MIN_SAMPLE, by: Sequence[str] = ()
) -> DataFrame:
    """Repair rate per check that warned or failed. changes(by..., warned, failed, repaired_after)."""
    empty = F.array().cast("array<string>")
    raised = F.array_union(F.coalesce("warned", empty), F.coalesce("failed", empty))
    gated = changes.where(F.col("verdict").isNotNull())
    counted = _grade(gated, by, F.concat(raised, F.array(F.lit(BASE))), stats.repaired_within(F.col("repaired_after"), window_days))
    graded = _with_base(counted, by, min_sample, rounded_base=True).where(F.col("name") != BASE)
    out = graded.select(
        *by, "name", "n", "repaired", "rate", "ci_low", "ci_high",
        F.when(F.col("_base") != 0, stats.round_half_up(F.col("rate") / F.col("_base"))).alias("lift"),
        "publishable",
    )
    order = Window.partitionBy(*by).orderBy(F.coalesce("lift", F.lit(-1.0)).desc(), F.desc("n"), "name")
    return out.withColumn("position", F.row_number().over(order))


def grade_tiers(
    rows: DataFrame, window_days: int, min_sample: int = DEFAULT_MIN_SAMPLE, by: Sequence[str] = ()
) -> DataFrame:
    """Tier regret per variant. rows(by..., tiers map<variant, tier>, repaired_after).

    Each variant is graded against its own rows. Lift divides the unrounded
    share by the variant's rounded base rate.
    """
    tiers = ["cheap", "mid", "premium"]
    keys = [*by, "variant"]
    long = rows.select(*by, F.explode("tiers").alias("variant", "tier"), "repaired_after").where(F.col("tier").isNotNull())
    within = stats.repaired_within(F.col("repaired_after"), window_days)
    counted = _fill_names(_grade(long, keys, F.array(F.col("tier"), F.lit(BASE)), within), keys, tiers)
    graded = _with_base(counted, keys, min_sample, rounded_base=True)
    w = Window.partitionBy(*keys)
    rates = [F.max(F.when(F.col("name") == t, F.col("_share"))).over(w) for t in tiers]
    rounded = [stats.round_half_up(r) for r in rates]
    return graded.select(
        *keys,
        F.col("name").alias("tier"),
        "n",
        "repaired",
        "rate",
        "ci_low",
        "ci_high",
        F.when((F.col("_base") != 0) & (F.col("name") != BASE), stats.round_half_up(F.col("_share") / F.col("_base"))).alias("lift"),
        "publishable",
        stats.ordered(*rounded).alias("monotonic"),
        F.max(F.when(F.col("name") == "cheap", F.col("repaired"))).over(w).alias("contradicted"),
    )


def answer_spread(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """N, mean, min, max and population deviation of numeric answers."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.count(v).alias("n"),
        stats.round_half_up(F.avg(v)).alias("mean"),
        stats.round_half_up(F.min(v)).alias("min"),
        stats.round_half_up(F.max(v)).alias("max"),
        stats.round_half_up(F.stddev_pop(v)).alias("stdev"),
    )


def rescore(
    saved: DataFrame,
    scorers: dict[str, Callable[[], Column]],
    window_days: int,
    min_sample: int = DEFAULT_MIN_SAMPLE,
    by: Sequence[str] = (),
) -> DataFrame:
    """A10: drop release and fix rows, recompute each variant's tier, grade again.

    ``scorers`` maps a variant to a function returning the tier Column.
    """
    subject = F.coalesce(F.col("subject"), F.lit(""))
    kept = saved.where(~is_release_subject(subject) & ~is_fix_subject(subject))
    tiers = F.create_map(*[x for name, score in scorers.items() for x in (F.lit(name), score())])
    return grade_tiers(kept.withColumn("tiers", tiers), window_days, min_sample, by)


def corpus_counts(commits: DataFrame, window_days: int, by: Sequence[str] = ()) -> DataFrame:
    """How many commits were gradable, censored, releases, docs only.

    commits(by..., subject, parents, time, code_files). The horizon is the newest
    commit of the group; a commit younger than the window is censored. It comes
    from a small aggregate joined back, so a big group is never one window.
    """
    subject = F.coalesce(F.col("subject"), F.lit(""))
    horizon = commits.groupBy(*by).agg(F.max("time").alias("horizon"))
    rows = commits.join(horizon, list(by)) if by else commits.withColumn("horizon", horizon.scalar())
    request = ~is_fix_subject(subject) & (F.size("parents") == 1) & (F.trim(subject) != "")
    change = request & ~is_release_subject(subject)
    candidate = change & (F.col("code_files") > 0)
    old = F.col("horizon") - F.col("time") >= window_days * DAY_SECONDS
    return rows.groupBy(*by).agg(
        F.count("*").alias("commits"),
        F.count_if(candidate).alias("candidates"),
        F.count_if(candidate & ~old).alias("censored"),
        F.count_if(request & is_release_subject(subject)).alias("releases"),
        F.count_if(change & (F.col("code_files") == 0)).alias("docs_only"),
        F.count_if(candidate & old).alias("replayed"),
        F.count_if(is_fix_subject(subject) & (F.size("parents") == 1)).alias("fixes"),
    )


def trial_units(decisions: DataFrame) -> DataFrame:
    """One unit per (repo_id, head); the arm of its first decision."""
    return decisions.groupBy("repo_id", "head").agg(
        F.min_by("arm", "seq").alias("arm"),
        F.count("*").alias("checks"),
        F.count_if("withheld").alias("withheld"),
        F.count_if(F.col("shown_because").isNotNull()).alias("shown_because"),
    )


def grade_trial(
    decisions: DataFrame,
    commits: DataFrame,
    repaired: DataFrame,
    window_days: int,
    min_sample: int = DEFAULT_MIN_SAMPLE,
) -> DataFrame:
    """The two arms by what happened to the commit made on each head.

    decisions(repo_id, head, seq, arm, withheld, shown_because), commits(repo_id,
    sha, parents, time, subject), repaired(repo_id, sha, repaired_after).
    """
    horizon = commits.groupBy("repo_id").agg(F.max("time").alias("horizon"))
    units = child_commits(trial_units(decisions), commits).join(horizon, "repo_id", "left").join(repaired, ["repo_id", "sha"], "left")
    is_fix = F.col("sha").isNotNull() & is_fix_subject(F.col("subject"))
    gradable = F.col("sha").isNotNull() & ~is_fix & (F.col("horizon") - F.col("time") >= window_days * DAY_SECONDS)
    hit = gradable & stats.repaired_within(F.col("repaired_after"), window_days)
    arms = units.groupBy("arm").agg(
        F.count("*").alias("changes"),
        F.sum("checks").alias("checks"),
        F.count_if(F.col("sha").isNotNull()).alias("committed"),
        F.count_if(is_fix).alias("fix_commits"),
        F.count_if(F.col("sha").isNotNull() & ~is_fix & ~F.coalesce(gradable, F.lit(False))).alias("censored"),
        F.count_if(F.col("shown_because") > 0).alias("shown_because_blocking"),
        F.count_if(hit).alias("repaired"),
        F.count_if(gradable).alias("graded"),
    )
    out = arms.select("*", *stats.proportion("repaired", "graded", min_sample))
    w = Window.partitionBy()
    shown_high = F.max(F.when(F.col("arm") == "shown", F.col("ci_high"))).over(w)
    withheld_low = F.max(F.when(F.col("arm") == "withheld", F.col("ci_low"))).over(w)
    return out.withColumn(
        "fewer_when_shown", F.when(shown_high.isNotNull() & withheld_low.isNotNull(), shown_high < withheld_low)
    )


# ---------------------------------------------------------------- small columns
def convergence_band(score: Column) -> Column:
    """Aligned from 80, partial from 50, drift below, inconclusive when unknown."""
    return F.when(score.isNull(), "inconclusive").when(score >= 80, "aligned").when(score >= 50, "partial").otherwise("drift")


def risk_level(score: Column) -> Column:
    """High from 9, medium from 4."""
    return F.when(score >= fixed.RISK_HIGH, "high").when(score >= fixed.RISK_MEDIUM, "medium").otherwise("low")


def experience_band(score: Column) -> Column:
    """Excellent, good, fair or poor from 80, 60 and 40."""
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "fair").otherwise("poor")


def assign_arm(unit: Sequence[Column], salt: str, share: float = 0.5, arms: tuple[str, str] = ("shown", "withheld")) -> Column:
    """A stable arm from the first 32 bits of a hash of the unit's parts."""
    text = F.concat_ws(":", F.lit(salt), *[c.cast("string") for c in unit])
    bucket = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    return F.when(bucket < share, arms[0]).otherwise(arms[1])


def code_file_counts(commit_files: DataFrame) -> DataFrame:
    """Per change how many files are no documents, and whether all are documents by the looser rule.

    commit_files(repo_id, sha, path). A change without code files cannot be
    graded; requests use the looser ``docs_only``.
    """
    from tallywake.functions import paths as P

    known = P.with_path_facts(commit_files, {"_doc": P.is_doc(F.col("path")), "_like": P.is_doc_like(F.col("path"))})
    return known.groupBy("repo_id", "sha").agg(F.count_if(~F.col("_doc")).alias("code_files"), F.min("_like").alias("docs_only"))
