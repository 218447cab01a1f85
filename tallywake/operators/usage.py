"""Usage-log analytics: totals, medians, follow-through, fail streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywake.functions import stats
from tallywake.functions.slices import order_statistics, with_next, with_running
from tallywake.functions.stats import DEFAULT_MIN_SAMPLE

HOUR_MS = 3_600_000
DAY_MS = 86_400_000
FAIL_CAP = 3


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[int] = (95,)) -> DataFrame:
    """Median (middle two averaged, rounded) and percentiles read by index, never interpolated.

    ``pNN`` takes the element at floor(NN% of n); ``cNN`` the one at ceil(NN% of n) - 1.
    """
    n = F.col("n")
    positions: dict[str, Column] = {"_low": F.floor((n - 1) / 2), "_high": F.floor(n / 2)}
    for p in percentiles:
        positions[f"p{p}"] = F.least(n - 1, F.floor(F.lit(p / 100.0) * n))
        positions[f"c{p}"] = F.greatest(F.lit(0), F.ceil(n * (p / 100.0)) - 1)
    found = order_statistics(df, keys, value, positions)
    return found.select(
        *keys,
        "n",
        stats.round_int((F.col("_low") + F.col("_high")) / 2).alias("median"),
        *[stats.round_int(F.col(f"p{p}")).alias(f"p{p}") for p in percentiles],
        *[stats.round_int(F.col(f"c{p}")).alias(f"c{p}") for p in percentiles],
    )


def outcome_class(outcome: Column) -> Column:
    return F.when(outcome.isin("fail", "error"), outcome).otherwise("ok")


def usage_totals(events: DataFrame) -> DataFrame:
    """One row over the whole log. events(ts, seq, surface, cmd, outcome, durationMs, repo, verdict, saved_pct, saved_tokens)."""
    outcome = outcome_class(F.col("outcome"))
    verdict = F.col("verdict")
    latest = F.max_by(
        F.struct("ts", "saved_pct", "saved_tokens"), F.when(F.col("saved_pct").isNotNull(), F.struct("ts", "seq"))
    )
    counted = events.agg(
        F.count("*").alias("events"),
        F.count_if(F.col("surface") == "cli").alias("cli"),
        F.count_if(F.col("surface") == "mcp").alias("mcp"),
        F.count_if(outcome == "ok").alias("ok"),
        F.count_if(outcome == "fail").alias("fail"),
        F.count_if(outcome == "error").alias("error"),
        F.count_if(verdict == "PASS").alias("pass_verdicts"),
        F.count_if(verdict == "WARN").alias("warn_verdicts"),
        F.count_if(verdict == "FAIL").alias("fail_verdicts"),
        F.min("ts").alias("ts_from"),
        F.max("ts").alias("ts_to"),
        latest.alias("latest"),
        F.count("durationMs").alias("timed"),
    )
    repos = events.where("repo is not null").select("repo").distinct().agg(F.count("*").alias("repos"))
    times = exact_quantiles(events, [], "durationMs", (95,))
    verdicts = F.col("pass_verdicts") + F.col("warn_verdicts") + F.col("fail_verdicts")
    return counted.select(
        *[c for c in counted.columns if c not in ("latest", "timed")],
        repos.scalar().alias("distinct_repos"),
        times.select("median").scalar().alias("median_ms"),
        times.select("p95").scalar().alias("p95_ms"),
        F.when(verdicts > 0, stats.round_int(100 * F.col("pass_verdicts") / verdicts)).alias("pass_rate"),
        F.col("latest.saved_pct").alias("latest_saved_pct"),
        F.col("latest.saved_tokens").alias("latest_saved_tokens"),
        (F.col("timed") == 0).alias("blind_latency"),
        (verdicts == 0).alias("blind_verdicts"),
        F.col("latest").isNull().alias("blind_eval"),
    )


def usage_commands(events: DataFrame) -> DataFrame:
    """Per command the count, the surface and the median duration and tokens."""
    cmd = F.coalesce("cmd", F.lit("unknown"))
    rows = events.withColumn("cmd", cmd)
    counted = rows.groupBy("cmd").agg(
        F.count("*").alias("count"),
        F.bool_or(F.coalesce(F.col("surface") == "mcp", F.lit(False))).alias("_mcp"),
        F.bool_or(F.coalesce(F.col("surface") == "cli", F.lit(False))).alias("_cli"),
    )
    durations = exact_quantiles(rows, ["cmd"], "durationMs", ()).select("cmd", F.col("median").alias("median_ms"))
    tokens = exact_quantiles(rows, ["cmd"], "tokens", ()).select("cmd", F.col("median").alias("median_tokens"))
    surface = F.when(F.col("_mcp") & F.col("_cli"), "both").when(F.col("_mcp"), "mcp").otherwise("cli")
    return (
        counted.join(durations, "cmd", "left")
        .join(tokens, "cmd", "left")
        .select("cmd", "count", surface.alias("surface"), "median_ms", "median_tokens")
    )


def convergence_series(events: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Each group's scores numbered in time order."""
    scored = events.where("convergence is not null").withColumn("slice", F.floor(F.col("ts") / DAY_MS))
    numbered = with_running(scored, list(keys), "slice", ["ts", "seq"], sums={"position": F.lit(1)})
    return numbered.select(*keys, "position", "ts", F.col("convergence").alias("value"))


def with_follow_up(runs: DataFrame, keys: Sequence[str], fields: Sequence[str], window_minutes: int = 60) -> DataFrame:
    """``next`` is the following run of the group when it lands inside the window, else null."""
    sliced = runs.withColumn("_slice", F.floor(F.col("ts") / HOUR_MS))
    paired = with_next(sliced, keys, "_slice", ["ts", "seq"], F.struct("ts", *fields), "_next")
    inside = F.col("_next.ts") - F.col("ts") <= window_minutes * 60_000
    return paired.withColumn("next", F.when(inside, F.col("_next"))).drop("_next", "_slice")


ALARM = ["WARN", "FAIL"]


def follow_through_gate(runs: DataFrame, keys: Sequence[str], window_minutes: int = 60, min_sample: int = DEFAULT_MIN_SAMPLE) -> DataFrame:
    """What happened after each alarm. runs(keys..., ts, seq, verdict, change_id)."""
    paired = with_follow_up(runs, keys, ["verdict", "change_id"], window_minutes)
    alarm = F.col("verdict").isin(*ALARM)
    followed = alarm & F.col("next").isNotNull()
    comparable = followed & F.col("change_id").isNotNull() & F.col("next.change_id").isNotNull()
    counted = paired.agg(
        F.count("*").alias("runs"),
        F.count_if(alarm).alias("alarms"),
        F.count_if(followed).alias("followed"),
        F.count_if(followed & (F.col("next.verdict") == "PASS")).alias("cleared"),
        F.count_if(comparable).alias("comparable"),
        F.count_if(comparable & (F.col("change_id") == F.col("next.change_id"))).alias("same"),
    )
    return _measures(
        counted, ["runs"], {"followed": ("followed", "alarms"), "cleared": ("cleared", "followed"), "same change": ("same", "comparable")}, min_sample
    )


def _measures(counted: DataFrame, keep: Sequence[str], measures: dict[str, tuple[str, str]], min_sample: int) -> DataFrame:
    entries = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(h).alias("hits"), F.col(n).alias("n")) for m, (h, n) in measures.items()]
    )
    long = counted.select(*keep, F.explode(entries).alias("m")).select(*keep, "m.*")
    return long.select(*keep, "measure", "hits", "n", *stats.proportion("hits", "n", min_sample))


def follow_through_checks(runs: DataFrame, keys: Sequence[str], window_minutes: int = 60, min_sample: int = DEFAULT_MIN_SAMPLE) -> DataFrame:
    """Per alarmed check, whether the follow-up cleared it. runs(..., checks map<name, status>)."""
    paired = with_follow_up(runs, keys, ["checks"], window_minutes).where(F.col("verdict").isin(*ALARM))
    each = paired.select("next", F.explode("checks").alias("name", "status")).where(F.col("status").isin(*ALARM))
    after = F.try_element_at(F.col("next.checks"), F.col("name"))
    followed = F.col("next").isNotNull()
    cleared, repeated = followed & (after == "PASS"), followed & after.isin(*ALARM)
    decided = F.coalesce(cleared | repeated, F.lit(False))
    counted = each.groupBy("name").agg(
        F.count("*").alias("alarms"),
        F.count_if(repeated).alias("repeated"),
        F.count_if(followed & ~decided).alias("not_run"),
        F.count_if(cleared).alias("cleared"),
        F.count_if(decided).alias("followed"),
    )
    return counted.select("*", *stats.proportion("cleared", "followed", min_sample))


def follow_through_convergence(runs: DataFrame, keys: Sequence[str], window_minutes: int = 60, min_sample: int = DEFAULT_MIN_SAMPLE) -> DataFrame:
    """How low scores move. runs(keys..., ts, seq, convergence, band)."""
    paired = with_follow_up(runs, keys, ["convergence", "band"], window_minutes)
    low = F.coalesce(F.col("band") != "aligned", F.lit(True))
    again = low & F.col("next").isNotNull()
    counted = paired.agg(
        F.count("*").alias("runs"),
        F.count_if(low).alias("low"),
        F.count_if(again).alias("rescored"),
        F.count_if(again & (F.col("next.convergence") > F.col("convergence"))).alias("improved"),
        F.count_if(again & (F.col("next.band") == "aligned")).alias("aligned"),
    )
    return _measures(
        counted, ["runs"], {"rescored": ("rescored", "low"), "improved": ("improved", "rescored"), "aligned": ("aligned", "rescored")}, min_sample
    )


def fail_streaks(results: DataFrame, keys: Sequence[str], cap: int = FAIL_CAP) -> DataFrame:
    """Consecutive fails at each failing result; escalate from the cap. results(keys..., ts, seq, verdict)."""
    sliced = results.withColumn("_slice", F.floor(F.col("ts") / DAY_MS))
    numbered = with_running(sliced, keys, "_slice", ["ts", "seq"], sums={"_rn": F.lit(1)})
    reset = with_running(
        numbered, keys, "_slice", ["ts", "seq"], maxima={"_reset": F.when(F.col("verdict") != "FAIL", F.col("_rn"))}
    )
    streak = F.col("_rn") - F.coalesce("_reset", F.lit(0))
    return reset.where("verdict = 'FAIL'").select(
        *keys, "ts", "seq", streak.alias("consecutive_fails"), (streak >= cap).alias("escalate")
    )
