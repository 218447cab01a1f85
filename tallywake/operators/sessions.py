"""Session outcomes: turns, corrections, rework, decision joins.

events(session_id, seq, ts, kind, text, file, tool, hash), ``ts`` in milliseconds,
kinds prompt, interrupt, edit, check, harness. A session may be any size: turns
are numbered over slices of time, and everything after that joins on
(session_id, turn).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywake.functions import stats
from tallywake.functions.slices import medians, with_running
from tallywake.functions.stats import DEFAULT_MIN_SAMPLE
from tallywake.session import cut_lineage

HOUR_MS = 3_600_000
JOIN_WINDOW_MS = 600_000
REPEAT_MS = 120_000

# The opening of a prompt that corrects the one before.
PUSHBACK = (
    r"(?i)^(no\b|nope|not\b|wrong|that'?s (not|wrong)|this is (not|wrong)|still\b|again\b|undo|revert|roll ?back|stop\b|wait\b|hold on"
    r"|why (did|are|is|does|would)|you (didn'?t|did not|missed|broke|forgot|changed|removed|ignored|should)|i (said|asked|meant|told)"
    r"|but\b|actually\b|instead\b|it'?s (not|still|broken)|doesn'?t|didn'?t|isn'?t|can'?t|won'?t|leave it|don'?t|dont\b|never)"
)


def is_pushback(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(PUSHBACK), F.lit(False))


def _sliced(events: DataFrame) -> DataFrame:
    return events.withColumn("_slice", F.floor(F.col("ts") / HOUR_MS))


def with_turns(events: DataFrame) -> DataFrame:
    """Number the turns; a prompt or an interruption opens one, 0 is before the first."""
    opens = F.col("kind").isin("prompt", "interrupt").cast("int")
    return with_running(_sliced(events), ["session_id"], "_slice", ["ts", "seq"], sums={"turn": opens}).drop("_slice")


def prompt_outcomes(events: DataFrame, window_minutes: int = 60) -> DataFrame:
    """For every prompt, whether the next turn corrected it and reworked its edits.

    Null ``corrected``/``reworked`` when no follow-up came inside the window;
    ``reworked`` is also null when the turn edited nothing.
    """
    turns = with_turns(events)
    opening = turns.where(F.col("kind").isin("prompt", "interrupt")).select("session_id", "turn", "seq", "ts", "kind", "text")
    following = opening.select(
        "session_id",
        (F.col("turn") - 1).alias("turn"),
        F.col("ts").alias("next_ts"),
        ((F.col("kind") == "interrupt") | is_pushback(F.col("text"))).alias("_corrected"),
    )
    edits = turns.where("kind = 'edit'").select("session_id", "turn", "file").distinct()
    again = edits.select("session_id", (F.col("turn") - 1).alias("turn"), "file", F.lit(1).alias("again"))
    touched = (
        edits.join(again, ["session_id", "turn", "file"], "left")
        .groupBy("session_id", "turn")
        .agg(F.count("*").alias("edited"), F.count("again").alias("edited_again"))
    )
    follow = F.coalesce(F.col("next_ts") - F.col("ts") <= window_minutes * 60_000, F.lit(False))
    return (
        opening.where("kind = 'prompt'")
        .join(following, ["session_id", "turn"], "left")
        .join(touched, ["session_id", "turn"], "left")
        .select(
            "session_id",
            "turn",
            "seq",
            "ts",
            follow.alias("follow_up"),
            F.when(follow, F.col("_corrected")).alias("corrected"),
            F.when(follow & (F.col("edited") > 0), F.col("edited_again") > 0).alias("reworked"),
        )
    )


def checks_with_prompt(events: DataFrame) -> DataFrame:
    """Each check call with the seq of the latest earlier prompt of its session."""
    prompt = F.when(F.col("kind") == "prompt", F.struct("ts", "seq"))
    known = with_running(_sliced(events), ["session_id"], "_slice", ["ts", "seq"], maxima={"_prompt": prompt}, include_current=False)
    return known.where("kind = 'check'").select("session_id", "seq", "ts", "tool", "hash", F.col("_prompt.seq").alias("prompt_seq"))


def turn_tokens(events: DataFrame, usage: DataFrame) -> DataFrame:
    """What each turn was billed; usage(session_id, ts, weighted). Turns without usage are absent.

    Usage rows are numbered together with the events, so the interval join is a
    running turn number and one group-by.
    """
    shape = ["session_id", "seq", "ts", "kind", "weighted"]
    both = events.select("session_id", "seq", "ts", "kind", F.lit(None).cast("bigint").alias("weighted")).unionByName(
        # At the same instant the prompt comes first: usage from its start counts.
        usage.select("session_id", F.lit(2**62).alias("seq"), "ts", F.lit("usage").alias("kind"), F.col("weighted").cast("bigint").alias("weighted"))
    ).select(*shape)
    return with_turns(both).where("kind = 'usage' and turn > 0").groupBy("session_id", "turn").agg(F.sum("weighted").alias("tokens"))


def drop_repeated_prompts(events: DataFrame) -> DataFrame:
    """Drop a prompt equal to the last kept prompt of its session within two minutes.

    The state along a session is just the last kept prompt, so each hour of a
    session is folded on its own. An hour that ends with a prompt kept in its last
    two minutes hands it to the next hour, which is folded again; from then on only
    hours whose last kept prompt changed are followed.
    """
    keys = ["session_id", "_slice"]
    prompts = _sliced(events.where("kind = 'prompt'")).select(*keys, "ts", "seq", F.sha2("text", 256).alias("text_hash"))
    hours = cut_lineage(prompts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "text_hash"))).alias("rows")))
    state = "struct<ts:bigint,text_hash:string>"

    def step(acc: Column, row: Column) -> Column:
        last = acc["last"]
        repeat = F.coalesce((last["text_hash"] == row["text_hash"]) & (row["ts"] - last["ts"] < REPEAT_MS), F.lit(False))
        kept = F.struct(row["ts"].alias("ts"), row["text_hash"].alias("text_hash"))
        return F.struct(
            F.when(repeat, last).otherwise(kept).cast(state).alias("last"),
            F.when(repeat, F.concat(acc["dropped"], F.array(row["seq"]))).otherwise(acc["dropped"]).alias("dropped"),
        )

    def fold(carried: DataFrame, number: int) -> DataFrame:
        empty = F.struct(F.col("last").alias("last"), F.array().cast("array<bigint>").alias("dropped"))
        return cut_lineage(carried.select(*keys, F.aggregate("rows", empty, step).alias("out"), F.lit(number).alias("round")))

    done = [fold(hours.withColumn("last", F.lit(None).cast(state)), 0)]
    near = F.col("out.last.ts") >= (F.col("_slice") + 1) * HOUR_MS - REPEAT_MS
    changed = done[0].where(near)
    while True:
        handed = changed.select("session_id", (F.col("_slice") + 1).alias("_slice"), F.when(near, F.col("out.last")).alias("last"))
        fresh = fold(hours.join(handed, keys), len(done))
        before = _latest(done, keys, "out").select(*keys, F.col("out.last").alias("before"))
        changed = fresh.join(before, keys).where(~F.col("out.last").eqNullSafe(F.col("before"))).drop("before")
        done.append(fresh)
        if changed.isEmpty():
            break
    dropped = _latest(done, keys, "out").select("session_id", F.explode("out.dropped").alias("seq"))
    return events.join(dropped, ["session_id", "seq"], "left_anti")


def _latest(done: list[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """The result of each slice's last round."""
    return reduce(DataFrame.union, done).groupBy(*keys).agg(F.max_by(value, "round").alias(value))


def nearest_calls(decisions: DataFrame, calls: DataFrame, keys: Sequence[str] = ("tool", "hash"), window_ms: int = JOIN_WINDOW_MS) -> DataFrame:
    """In time order, each decision takes the closest unused call of its key within the window.

    decisions(keys..., decision_id, ts), calls(keys..., call_id, ts). Returns
    (decision_id, call_id) for joined decisions. A key is cut into slices one
    window long; a slice sees the calls of its neighbours and the calls that
    decisions of the two slices before it took. Slices are matched in parallel;
    then only those behind a slice that changed are matched again, until none
    does, which is the first-come result.
    """
    keys = list(keys)
    at = F.floor(F.col("ts") / window_ms)
    d = decisions.select(*keys, at.alias("_slice"), F.lit(0).alias("_call"), F.col("decision_id").alias("_id"), "ts")
    c = calls.select(*keys, F.explode(F.array(at - 1, at, at + 1)).alias("_slice"), F.lit(1).alias("_call"), F.col("call_id").alias("_id"), "ts")
    busy = d.select(*keys, "_slice").distinct()
    rows = cut_lineage(d.unionByName(c.join(busy, [*keys, "_slice"], "left_semi")))
    group = [*keys, "_slice"]
    types = dict(decisions.dtypes)
    pair = f"decision_id: {types['decision_id']}, call_id: {dict(calls.dtypes)['call_id']}"
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + f", _slice bigint, pairs array<struct<{pair}>>"

    def match(part: pd.DataFrame) -> pd.DataFrame:
        taken = set(part.loc[part["_call"] == 2, "_id"])
        calls_here = part[(part["_call"] == 1) & ~part["_id"].isin(taken)].sort_values(["ts", "_id"])
        times, ids = calls_here["ts"].to_numpy(), calls_here["_id"].to_list()
        # Free neighbours: following a used call leads to the next free one on that side.
        left, right = list(range(len(ids))), list(range(len(ids) + 1))

        def free_left(i: int) -> int:
            while i >= 0 and left[i] != i:
                left[i] = left[left[i]] if left[i] >= 0 else -1
                i = left[i]
            return i

        def free_right(i: int) -> int:
            while right[i] != i:
                right[i] = right[right[i]]
                i = right[i]
            return i

        asked = part[part["_call"] == 0].sort_values(["ts", "_id"])
        out = []
        for ts, decision, at in zip(asked["ts"], asked["_id"], np.searchsorted(times, asked["ts"].to_numpy())):
            before, after = free_left(int(at) - 1), free_right(int(at))
            gaps = [(ts - times[before], before)] if before >= 0 else []
            if after < len(ids):
                gaps.append((times[after] - ts, after))
            if gaps and min(gaps)[0] < window_ms:
                pick = min(gaps)[1]
                left[pick], right[pick] = pick - 1, pick + 1
                out.append((decision, ids[pick]))
        pairs = [{"decision_id": a, "call_id": b} for a, b in out]
        return pd.DataFrame([(*(part.iloc[0][k] for k in group), pairs)], columns=[*group, "pairs"])

    def matched(part: DataFrame, number: int) -> DataFrame:
        return cut_lineage(part.groupBy(*group).applyInPandas(match, schema).withColumn("round", F.lit(number)))

    done = [matched(rows, 0)]
    changed = done[0].where(F.size("pairs") > 0)
    behind = F.explode(F.array(F.col("_slice") + 1, F.col("_slice") + 2)).alias("_slice")
    while True:
        todo = cut_lineage(changed.select(*keys, behind).distinct().join(busy, group, "left_semi"))
        latest = _latest(done, group, "pairs")
        taken = latest.select(*keys, behind, "pairs").join(todo, group, "left_semi").select(*group, F.lit(2).alias("_call"), F.explode("pairs.call_id").alias("_id"), F.lit(0).cast("bigint").alias("ts"))
        fresh = matched(rows.join(todo, group, "left_semi").unionByName(taken), len(done))
        changed = fresh.join(latest.withColumnRenamed("pairs", "before"), group).where(~F.col("pairs").eqNullSafe(F.col("before"))).drop("before")
        done.append(fresh)
        if changed.isEmpty():
            return _latest(done, group, "pairs").select(F.explode("pairs").alias("p")).select("p.decision_id", "p.call_id")


def prompts_by_hash(records: DataFrame, events: DataFrame, window_ms: int = JOIN_WINDOW_MS) -> DataFrame:
    """Each record with the first prompt of its session and hash within the window either side.

    records(record_id, session_id, hash, ts). ``status`` is excluded (a harness
    prompt had the hash), joined or unjoined. The first prompt after ts - window
    is found by a running minimum, so records are never paired with every prompt.
    """
    harness = events.where("kind = 'harness'").select("session_id", "hash").distinct().withColumn("_harness", F.lit(True))
    prompts = events.where("kind = 'prompt'").select("session_id", "hash", "ts", "seq")
    marks = prompts.select("session_id", "hash", F.col("ts").alias("at"), F.struct((-F.col("ts")).alias("t"), (-F.col("seq")).alias("s")).alias("prompt"), F.lit(None).cast(dict(records.dtypes)["record_id"]).alias("record_id"), F.lit(1).alias("_side"))
    asks = records.select("session_id", "hash", (F.col("ts") - window_ms).alias("at"), F.lit(None).cast("struct<t:bigint,s:bigint>").alias("prompt"), "record_id", F.lit(0).alias("_side"))
    # Walking backwards in time; strictly later prompts only, so a prompt at the
    # same instant comes after the record.
    both = marks.unionByName(asks).select("*", (-F.col("at")).alias("back"), (-F.floor(F.col("at") / HOUR_MS)).alias("_slice"))
    # The latest mark seen walking backwards is the earliest prompt after the point.
    known = with_running(
        both.withColumn("_p", F.when(F.col("_side") == 1, F.struct("back", "prompt"))),
        ["session_id", "hash"], "_slice", ["back", "_side", "record_id"], maxima={"_latest": F.col("_p")},
    )
    first = known.where("_side = 0").select("record_id", (-F.col("_latest.prompt.t")).alias("prompt_ts"), (-F.col("_latest.prompt.s")).alias("prompt_seq"))
    joined = records.join(first, "record_id", "left").join(harness, ["session_id", "hash"], "left")
    close = F.coalesce(F.col("prompt_ts") < F.col("ts") + window_ms, F.lit(False))
    status = F.when(F.col("_harness"), "excluded").when(close, "joined").otherwise("unjoined")
    return joined.select(*records.columns, status.alias("status"), F.when(status == "joined", F.col("prompt_seq")).alias("prompt_seq"))


def agent_calls(calls: DataFrame, records: DataFrame) -> DataFrame:
    """Agent calls whose request was logged, per arm; others counted under '(unjoined)'.

    calls(session_id, hash, arm, action), records(session_id, hash).
    """
    known = records.select("session_id", "hash").distinct().withColumn("_known", F.lit(True))
    rows = calls.join(known, ["session_id", "hash"], "left").withColumn(
        "arm", F.when(F.col("_known"), F.coalesce("arm", F.lit("advisory"))).otherwise("(unjoined)")
    )
    # Distinct requests by grouping on the request first: no task holds a set.
    per_request = rows.groupBy("arm", "session_id", "hash").agg(
        F.count("*").alias("calls"), *[F.count_if(F.col("action") == a).alias(a) for a in ("matched", "diverged", "rewrote")]
    )
    return per_request.groupBy("arm").agg(
        F.sum("calls").alias("calls"), F.count("*").alias("requests"), *[F.sum(a).alias(a) for a in ("matched", "diverged", "rewrote")]
    )


def outcome_rates(rows: DataFrame, group: str, min_sample: int = DEFAULT_MIN_SAMPLE) -> DataFrame:
    """Corrected and reworked shares per tier or arm. rows(group, follow_up, corrected, reworked)."""
    counted = rows.groupBy(group).agg(
        F.count("*").alias("prompts"),
        F.count_if("follow_up").alias("graded"),
        F.count_if("corrected").alias("corrected"),
        F.count_if(F.col("reworked").isNotNull()).alias("editing"),
        F.count_if("reworked").alias("reworked"),
    )
    entries = F.array(
        F.struct(F.lit("corrected").alias("measure"), F.col("corrected").alias("hits"), F.col("graded").alias("n")),
        F.struct(F.lit("reworked").alias("measure"), F.col("reworked").alias("hits"), F.col("editing").alias("n")),
    )
    long = counted.select(group, "prompts", F.explode(entries).alias("m")).select(group, "prompts", "m.*")
    return long.select("*", *stats.proportion("hits", "n", min_sample))


def billed_summary(rows: DataFrame, group: str, min_sample: int = DEFAULT_MIN_SAMPLE) -> DataFrame:
    """N, total, median and mean of billed tokens per group. rows(group, tokens)."""
    totals = rows.where("tokens is not null").groupBy(group).agg(F.sum("tokens").alias("total"))
    middle = medians(rows, [group], "tokens")
    shown = (F.col("n") >= min_sample) & (F.col("n") > 0)
    return totals.join(middle, group).select(
        group,
        "n",
        "total",
        F.when(shown, stats.round_int((F.col("low") + F.col("high")) / 2)).alias("median"),
        F.when(shown, stats.round_int(F.col("total") / F.col("n"))).alias("mean"),
        shown.alias("publishable"),
    )


def grade_checks(decisions: DataFrame, events: DataFrame, window_minutes: int = 60) -> DataFrame:
    """J15 + J17 + W3: one row per (session, prompt) that a joined check answered.

    A prompt is graded in the arm of its first check. decisions(decision_id, tool,
    hash, ts, arm).
    """
    checks = checks_with_prompt(events)
    calls = checks.select("tool", "hash", F.concat_ws("/", F.col("session_id").cast("string"), F.lpad(F.col("seq").cast("string"), 20, "0")).alias("call_id"), "ts", "session_id", "seq", "prompt_seq")
    taken = nearest_calls(decisions, calls)
    prompts = (
        decisions.join(taken, "decision_id")
        .join(calls.select("call_id", "session_id", "prompt_seq"), "call_id")
        .where("prompt_seq is not null")
        .groupBy("session_id", "prompt_seq")
        .agg(F.min_by("arm", F.struct("ts", "decision_id")).alias("arm"), F.count("*").alias("checks"))
    )
    outcomes = prompt_outcomes(events, window_minutes).withColumnRenamed("seq", "prompt_seq")
    return prompts.join(outcomes, ["session_id", "prompt_seq"])
