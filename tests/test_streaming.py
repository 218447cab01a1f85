"""A stream whose input has fully arrived must give the batch result."""

from pyspark.sql import functions as F

from tallywake.operators import usage as u
from tallywake.streaming import jobs

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


def replay(spark, df, tmp_path, name, schema=None):
    """Write a table as files in time order and read it back as a stream."""
    path = str(tmp_path / name)
    df.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return query


def runs(spark):
    from tallywake.plans.usage import gate_runs

    return gate_runs(spark, SF).select("repo", "ts", "seq", "verdict", (F.floor(F.col("k") / 50)).alias("head"), "k", "cmd", "outcome", "durationMs")


def test_rollup_matches_batch(spark, tmp_path):
    df = runs(spark)
    last = df.agg(F.max("ts")).first()[0]
    marker = df.limit(1).withColumn("ts", F.lit(last + 10 * HOUR)).withColumn("cmd", F.lit("marker"))
    stream = replay(spark, df.unionByName(marker), tmp_path, "rollup")
    run(jobs.usage_rollup(stream, delay="40 days"), "rollup", "update")
    got = spark.table("rollup").groupBy("start", "cmd", "outcome").agg(F.max("events").alias("events")).where("cmd <> 'marker'")
    want = df.groupBy(F.window(F.timestamp_millis("ts"), "1 hour")["start"].alias("start"), "cmd", F.when(F.col("outcome").isin("fail", "error"), F.col("outcome")).otherwise("ok").alias("outcome")).agg(F.count("*").alias("events"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_follow_through_matches_batch(spark, tmp_path):
    df = runs(spark).select("repo", "ts", "seq", "verdict")
    last = df.agg(F.max("ts")).first()[0]
    # Two later marks move the watermark past every real row.
    marks = spark.createDataFrame([(-1, last + 1200 * HOUR, -1, "PASS"), (-1, last + 2600 * HOUR, -2, "PASS")], df.schema)
    path = str(tmp_path / "follow")
    df.repartitionByRange(3, "ts").write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.follow_through(stream, 60, "40 days").writeStream.format("memory").queryName("follow").outputMode("append").start()
    query.processAllAvailable()
    for mark in marks.collect():
        spark.createDataFrame([mark], df.schema).write.mode("append").parquet(path)
        query.processAllAvailable()
    query.stop()
    got = spark.table("follow").where("repo >= 0")
    batch = u.with_follow_up(df, ["repo"], ["seq", "verdict"], 60).where(F.col("verdict").isin("WARN", "FAIL"))
    want = batch.select("repo", "ts", "seq", "verdict", F.col("next.seq").alias("next_seq"), F.col("next.verdict").alias("next_verdict"))
    assert want.count() == got.count() > 0
    assert got.exceptAll(want).isEmpty()


def in_files(spark, schema, path):
    """Writes rows as one more file of a stream's source, and opens the stream."""
    def write(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(path)

    write()
    return write, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_fail_streaks_match_batch_on_late_input(spark, tmp_path):
    df = runs(spark).select("repo", "head", "ts", "seq", "verdict")
    last = df.agg(F.max("ts")).first()[0]
    path = str(tmp_path / "streaks")
    # Files in the order of a hash: most results of a head arrive out of order.
    df.repartition(4, F.xxhash64("seq")).write.parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.fail_streaks(stream, 2, "40 days").writeStream.format("memory").queryName("streaks").outputMode("append").start()
    query.processAllAvailable()
    for n in (1, 2):
        spark.createDataFrame([(-1, -1, last + n * 1200 * HOUR, -n, "PASS")], df.schema).write.mode("append").parquet(path)
        query.processAllAvailable()
    query.stop()
    got, want = spark.table("streaks"), u.fail_streaks(df, ["repo", "head"], 2)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_an_idle_streak_is_forgotten(spark, tmp_path):
    write, stream = in_files(spark, "repo string, head string, ts bigint, seq bigint, verdict string", str(tmp_path / "idle"))
    write(("r", "h", HOUR, 1, "FAIL"), ("r", "h", 2 * HOUR, 2, "FAIL"), ("r", "h", 6 * HOUR, 3, "FAIL"), ("r", "g", HOUR, 4, "FAIL"), ("r", "g", 2 * HOUR, 5, "PASS"), ("r", "g", 2 * HOUR, 6, "FAIL"))
    query = jobs.fail_streaks(stream, 2, "1 hour", idle_minutes=120).writeStream.format("memory").queryName("idle").outputMode("append").start()
    for n in (50, 60, 70):
        query.processAllAvailable()
        write((None, None, n * HOUR, n, None))
    query.processAllAvailable()
    query.stop()
    got = sorted((r.head, r.seq, r.consecutive_fails, r.escalate) for r in spark.table("idle").collect() if r.repo)
    assert got == [("g", 4, 1, False), ("g", 6, 1, False), ("h", 1, 1, False), ("h", 2, 2, True), ("h", 3, 1, False)]


def test_message_ids_count_once(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1000, 5), ("m1", 2000, 5), ("m2", 3000, 7)], "message_id string, ts bigint, weighted bigint")
    run(jobs.dedupe_usage(replay(spark, df, tmp_path, "dedupe")), "dedupe")
    assert sorted(r.message_id for r in spark.table("dedupe").collect()) == ["m1", "m2"]


def test_sessions_close_after_a_gap(spark, tmp_path):
    schema, path = "session_id string, ts bigint, kind string", str(tmp_path / "sessions")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    write([("s", 0, "prompt"), ("s", 60_000, "edit"), ("s", 3 * HOUR, "prompt")])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = jobs.session_activity(stream).writeStream.format("memory").queryName("bursts").outputMode("append").start()
    for later in (100, 300):
        query.processAllAvailable()
        write([("z", later * HOUR, "prompt")])
    query.processAllAvailable()
    query.stop()
    got = sorted((r.session_id, r.prompts, r.edits) for r in spark.table("bursts").collect() if r.session_id == "s")
    assert got == [("s", 1, 0), ("s", 1, 1)]


def chained(bodies, tampered=()):
    import hashlib

    prev, records = "0" * 64, []
    for seq, body in enumerate(bodies, 1):
        digest = hashlib.sha256((prev + body).encode()).hexdigest()
        records.append(("l", seq, prev, digest, body + " " * (seq in tampered), seq * 1000))
        prev = digest
    return records


LEDGER = "ledger string, seq bigint, prev_hash string, record_hash string, body string, ts bigint"


def test_ledger_tail_waits_for_gaps(spark, tmp_path):
    records = chained([f'{{"seq":{n}}}' for n in range(1, 7)], {4})
    write, stream = in_files(spark, LEDGER, str(tmp_path / "tail"))
    for part in ([records[0], records[2], records[1]], [records[5], records[4]], [records[3], records[0]]):
        write(*part)
    run(jobs.verify_tail(stream), "tail")
    got = {r.seq: (r.valid, r.lost) for r in spark.table("tail").collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 0), 4: (False, 0), 5: (True, 0), 6: (True, 0)}


def test_lost_records_are_reported_after_the_timeout(spark, tmp_path):
    records = chained([f'{{"seq":{n}}}' for n in range(1, 9)])
    write, stream = in_files(spark, LEDGER, str(tmp_path / "lost"))
    write(records[0], records[3], records[4], records[7])  # 2, 3 and 6, 7 never come
    query = jobs.verify_tail(stream, timeout_minutes=60, delay="1 minute").writeStream.format("memory").queryName("lost").outputMode("append").start()
    query.processAllAvailable()
    assert [r.seq for r in spark.table("lost").collect()] == [1]
    for n in (10, 20):
        write(("other", None, None, None, None, n * HOUR))
        query.processAllAvailable()
    query.stop()
    got = sorted((r.seq, r.valid, r.lost, r.record_hash is None) for r in spark.table("lost").collect())
    assert got == [(1, True, 0, False), (2, False, 2, True), (4, False, 0, False), (5, True, 0, False), (6, False, 2, True), (8, False, 0, False)]


def test_late_rows_are_counted_over_the_whole_life(spark, tmp_path):
    write, stream = in_files(spark, "repo string, ts bigint, seq bigint, verdict string", str(tmp_path / "late"))
    counter = jobs.count_late_rows(spark)
    query = jobs.follow_through(stream, 60, "1 hour").writeStream.format("memory").queryName("late").outputMode("append").start()
    for n in range(4):  # each hundred hours on, one row that is on time and two that are not
        write(("r", (n + 1) * 100 * HOUR, n, "PASS"))
        query.processAllAvailable()
        write(("r", n * HOUR, 10 + n, "FAIL"), ("s", n * HOUR, 20 + n, "FAIL"))
        query.processAllAvailable()
    query.stop()
    assert counter.total(query) == 8
    spark.streams.removeListener(counter)
    assert spark.table("late").count() == 0


def test_event_sink_appends_by_day(spark, tmp_path):
    df = spark.createDataFrame([(0, "a", 1.4, "/r", None), (86_400_000, "b", 2.6, None, "fail")], "ts bigint, cmd string, durationMs double, repo_root string, outcome string")
    query = jobs.write_events(replay(spark, df, tmp_path, "src"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    got = sorted((r.cmd, r.durationMs, r.outcome, str(r.day)) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("a", 1, "ok", "1970-01-01"), ("b", 3, "fail", "1970-01-02")]


def test_micro_batches_reach_the_merge(spark, tmp_path):
    seen = []
    df = spark.createDataFrame([(1, "a"), (2, "b")], "ts bigint, root string")
    query = jobs.merge_batches(replay(spark, df, tmp_path, "merge"), str(tmp_path / "cp2"), lambda batch, n: seen.append(batch.count()))
    query.awaitTermination()
    assert sum(seen) == 2


class HeldState:
    """State of one key in memory, which counts the calls that would go to the JVM."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getMapState(self, name, *schemas):
        return HeldMap(self, self.states.setdefault(name, {}))

    def getValueState(self, name, *schemas):
        return HeldValue(self, self.states.setdefault(name, {}))

    def registerTimer(self, ts):
        self.calls += 1
        self.timers.add(ts)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.now

    def arrive(self, processor, key, rows):
        return list(processor.handleInputRows(key, iter(rows), self))

    def pass_to(self, processor, key, watermark):
        self.watermark, out = watermark, []
        while any(t < watermark for t in self.timers):
            self.now = min(self.timers)
            self.timers.remove(self.now)
            out += processor.handleExpiredTimer(key, self, self)
        return out


class HeldValue:
    def __init__(self, owner, held):
        self.owner, self.held = owner, held

    def __getattribute__(self, name):
        if name in ("owner", "held"):
            return object.__getattribute__(self, name)
        self.owner.calls += 1
        return object.__getattribute__(self, "_" + name)

    def _get(self):
        return self.held.get(0)

    def _update(self, value):
        self.held[0] = value

    def _clear(self):
        self.held.clear()


class HeldMap(HeldValue):
    def _exists(self):
        return bool(self.held)

    def _getValue(self, key):
        return self.held.get(key)

    def _containsKey(self, key):
        return key in self.held

    def _updateValue(self, key, value):
        self.held[key] = value

    def _removeKey(self, key):
        self.held.pop(key, None)

    def _keys(self):
        return iter(list(self.held))

    def _iterator(self):
        return iter(list(self.held.items()))


def shuffled_runs(n):
    from pyspark.sql import Row

    verdicts = ["FAIL", "WARN", "PASS", "FAIL", "FAIL"]
    rows = [Row(ts=(i * 7919 % n) * 60_000, seq=i, verdict=verdicts[i * 31 % 5], at=None) for i in range(n)]
    return rows, sorted((r.ts, r.seq, r.verdict) for r in rows)


def test_rows_of_a_key_share_their_state_calls(monkeypatch):
    from tallywake.streaming import state

    rows, ordered = shuffled_runs(5000)
    for processor in (state.FollowThrough(90_000), state.FailStreaks(2, None)):
        held = HeldState()
        processor.init(held)
        held.arrive(processor, ("r", "h"), rows)
        out = held.pass_to(processor, ("r", "h"), 10**12)
        assert len(out) == sum(v == "FAIL" or isinstance(processor, state.FollowThrough) and v == "WARN" for _, _, v in ordered)
        assert held.calls < 50 and not held.states["waiting"]


def test_waiting_rows_come_out_in_order_whatever_the_runs_and_watermarks(monkeypatch):
    from tallywake.streaming import state

    monkeypatch.setattr(state, "RUN_ROWS", 300, raising=False)
    monkeypatch.setattr(state, "PIECE_ROWS", 40, raising=False)
    rows, ordered = shuffled_runs(2000)
    follow, streaks = state.FollowThrough(90_000), state.FailStreaks(2, 60_000)
    got = {}
    for processor in (follow, streaks):
        held, out = HeldState(), []
        processor.init(held)
        held.arrive(processor, ("r", "h"), rows[:1500])
        for watermark in (1, 1):  # nothing but the first time has passed, twice
            out += held.pass_to(processor, ("r", "h"), watermark)
        held.arrive(processor, ("r", "h"), [r for r in rows[1500:] if r.ts >= 1])
        for watermark in (60_000, 60_001, 7_777_777, 10**12):
            out += held.pass_to(processor, ("r", "h"), watermark)
        got[processor] = out
    want, fails = [], 0
    for i, (ts, seq, verdict) in enumerate(ordered):
        if verdict in ("WARN", "FAIL"):
            after = ordered[i + 1] if i + 1 < len(ordered) and ordered[i + 1][0] - ts <= 90_000 else (None, None, None)
            want.append((ts, seq, verdict, after[1], after[2]))
    assert [(r.ts, r.seq, r.verdict, r.next_seq, r.next_verdict) for r in got[follow]] == want
    want = []
    for ts, seq, verdict in ordered:
        fails = fails + 1 if verdict == "FAIL" else 0
        if fails:
            want.append((ts, seq, fails))
    assert [(r.ts, r.seq, r.consecutive_fails) for r in got[streaks]] == want


def test_rows_without_a_time_never_come_out():
    from pyspark.sql import Row

    from tallywake.streaming import state

    rows = [Row(ts=ts, seq=n, verdict=v) for n, (ts, v) in enumerate([(5, "FAIL"), (None, "FAIL"), (None, None), (7, None), (3, "FAIL")])]
    processor, held = state.FailStreaks(2, None), HeldState()
    processor.init(held)
    held.arrive(processor, ("r", "h"), rows)
    assert [(r.seq, r.consecutive_fails) for r in held.pass_to(processor, ("r", "h"), 100)] == [(4, 1), (0, 2)]
    held.arrive(processor, ("r", "g"), rows[1:3])
    assert held.pass_to(processor, ("r", "g"), 200) == []


def test_records_of_a_ledger_share_their_state_calls(monkeypatch):
    from pyspark.sql import Row

    from tallywake.streaming import state

    records = [Row(seq=r[1], prev_hash=r[2], record_hash=r[3], body=r[4], ts=r[5]) for r in chained([str(n) for n in range(1, 5001)])]
    tail, held = state.LedgerTail(60_000), HeldState()
    tail.init(held)
    out = held.arrive(tail, ("l",), [r for r in reversed(records) if r.seq not in (3, 4, 2000, 5000)])
    assert [r.seq for r in out] == [1, 2]
    out = held.pass_to(tail, ("l",), 3_000_000)  # records to 2,939 are overdue; those behind them follow
    assert [(r.seq, r.valid, r.lost) for r in out if not r.valid or r.lost] == [(3, False, 2), (5, False, 0), (2000, False, 1), (2001, False, 0)] and out[-1].seq == 4999
    out = held.arrive(tail, ("l",), [records[4999], records[10]])
    assert [(r.seq, r.valid) for r in out] == [(5000, True)]
    assert held.calls < 100 and not held.states["waiting"]


def test_filled_gaps_let_waiting_records_follow(monkeypatch):
    from pyspark.sql import Row

    from tallywake.streaming import state

    monkeypatch.setattr(state, "BLOCK_RECORDS", 4, raising=False)
    monkeypatch.setattr(state, "RUN_ROWS", 7, raising=False)
    records = [Row(seq=r[1], prev_hash=r[2], record_hash=r[3], body=r[4], ts=r[5]) for r in chained([str(n) for n in range(1, 41)])]
    tail, held = state.LedgerTail(60_000), HeldState()
    tail.init(held)
    batches = [records[20:30], records[5:15], [records[0]], records[1:5], [*records[15:17], *records[18:20]], [records[17]], [*reversed(records[31:])]]
    seen = [[r.seq for r in held.arrive(tail, ("l",), batch)] for batch in batches]
    assert seen == [[], [], [1], list(range(2, 16)), [16, 17], list(range(18, 31)), []]
    out = held.pass_to(tail, ("l",), 10**12)
    assert [(r.seq, r.lost) for r in out] == [(31, 1), *[(n, 0) for n in range(32, 41)]] and not held.states["waiting"]
