"""State processors of the streams: typed state and event-time timers per key.

They need the RocksDB state store (``use_state_store``). Rows wait in state until
the watermark has passed them, so what a processor does follows the time of the
rows and not the order in which they arrive. Every read or write of state is a
call from Python to the JVM, so rows are kept and taken many at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import deque
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GENESIS = "0" * 64
#: Rows of a key that are sorted at once; each such run waits in pieces, one state entry each.
RUN_ROWS = 65_536
PIECE_ROWS = 4_096
#: Record numbers of a ledger that wait in one state entry.
BLOCK_RECORDS = 1_024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in the order of (ts, seq), each once the watermark has passed it.

    What arrives of a key is sorted in runs, which wait as pieces under their first
    ts. A timer at the first waiting ts merges what the watermark has passed: of each
    run one piece is in memory at a time. ``load`` and ``save`` bring what a subclass
    keeps of a key, once for all rows of a timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, part bigint", "ts array<bigint>, seq array<bigint>, verdict array<string>")
        self.open()

    def open(self) -> None:
        """Further state of a subclass."""

    def load(self) -> None:
        raise NotImplementedError

    def step(self, key: tuple, ts: int, seq: int, verdict: str) -> Iterator[Row]:
        raise NotImplementedError

    def save(self, key: tuple, watermark: int) -> Iterator[Row]:
        """Keep what is left; what the passing of ``watermark`` does by itself, after the rows before it."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        each = ((r.ts, r.seq, r.verdict) for r in rows if r.ts is not None)  # no watermark ever passes a row without a time
        while run := sorted(islice(each, RUN_ROWS)):
            for i in range(0, len(run), PIECE_ROWS):
                self._wait(run[i : i + PIECE_ROWS])
            self.handle.registerTimer(run[0][0])
        return iter(())

    def _wait(self, piece: list[tuple]) -> None:
        part = 0
        while self.waiting.containsKey((piece[0][0], part)):
            part += 1
        self.waiting.updateValue((piece[0][0], part), tuple(map(list, zip(*piece))))

    def _passed(self, watermark: int) -> Iterator[tuple]:
        """Waiting rows before ``watermark``, in order; they leave the state."""
        held = sorted(tuple(k) for k in self.waiting.keys())
        due, later = deque(k for k in held if k[0] < watermark), [k[0] for k in held if k[0] >= watermark]
        opened: list[tuple] = []  # a heap of (next row, number of the piece, place, rows)
        while opened or due:
            while due and (not opened or due[0][0] <= opened[0][0][0]):
                piece = due.popleft()
                rows = list(zip(*self.waiting.getValue(piece)))
                self.waiting.removeKey(piece)
                heapq.heappush(opened, (rows[0], -len(due), 0, rows))
            row, number, at, rows = heapq.heappop(opened)
            if row[0] >= watermark:
                later.append(row[0])
                self._wait(rows[at:])
                continue
            yield row
            if at + 1 < len(rows):
                heapq.heappush(opened, (rows[at + 1], number, at + 1, rows))
        if later:
            self.handle.registerTimer(min(later))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        self.load()
        for ts, seq, verdict in self._passed(watermark):
            yield from self.step(key, ts, seq, verdict)
        yield from self.save(key, watermark)

    def close(self) -> None:
        pass


class FollowThrough(InOrder):
    """One open alarm a key: the next run answers it, or a timer closes it when the window is over."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def open(self) -> None:
        self.alarm = self.handle.getValueState("alarm", "ts bigint, seq bigint, verdict string")

    def load(self):
        self.was = self.now = self.alarm.get()

    def step(self, key, ts, seq, verdict):
        alarm = self.now
        if alarm is not None:
            inside = ts - alarm[0] <= self.window_ms
            yield Row(repo=key[0], ts=alarm[0], seq=alarm[1], verdict=alarm[2], next_seq=seq if inside else None, next_verdict=verdict if inside else None)
        self.now = (ts, seq, verdict) if verdict in ("WARN", "FAIL") else None

    def save(self, key, watermark):
        alarm = self.now
        if alarm is not None and alarm[0] + self.window_ms + 1 < watermark:
            yield Row(repo=key[0], ts=alarm[0], seq=alarm[1], verdict=alarm[2], next_seq=None, next_verdict=None)
            alarm = None
        if alarm is not None:
            self.alarm.update(tuple(alarm))
            self.handle.registerTimer(alarm[0] + self.window_ms + 1)
        elif self.was is not None:
            self.alarm.clear()


class FailStreaks(InOrder):
    """The running number of fails of a key; any other verdict clears it, and so does ``idle_ms`` without a result."""

    def __init__(self, cap: int, idle_ms: int | None) -> None:
        self.cap, self.idle_ms = cap, idle_ms

    def open(self) -> None:
        self.streak = self.handle.getValueState("streak", "fails bigint, ts bigint")

    def load(self):
        self.was = self.now = self.streak.get()

    def step(self, key, ts, seq, verdict):
        held = self.now
        if verdict != "FAIL":
            self.now = None
            return
        if held is not None and self.idle_ms is not None and held[1] + self.idle_ms < ts:
            held = None
        fails = 1 + (held[0] if held is not None else 0)
        self.now = (fails, ts)
        yield Row(repo=key[0], head=key[1], ts=ts, seq=seq, consecutive_fails=fails, escalate=fails >= self.cap)

    def save(self, key, watermark):
        held = self.now
        if held is not None and self.idle_ms is not None and held[1] + self.idle_ms < watermark:
            held = None
        if held is not None:
            self.streak.update(tuple(held))
            if self.idle_ms is not None:
                self.handle.registerTimer(held[1] + self.idle_ms)
        elif self.was is not None:
            self.streak.clear()
        return iter(())


class LedgerTail(StatefulProcessor):
    """Checks records against the last hash of their ledger; records ahead of their turn wait, but not for ever.

    A record that is still missing ``timeout_ms`` after one behind it came is lost:
    one row tells the first missing number and how many are missing, and the chain
    goes on behind the gap, where the link of the next record is broken. Records wait
    in blocks of ``BLOCK_RECORDS`` numbers, of which one at a time is in memory.
    """

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tip = handle.getValueState("tip", "seq bigint, last string")
        self.waiting = handle.getMapState("waiting", "block bigint", "seq array<bigint>, prev array<string>, digest array<string>, body array<string>, due array<bigint>")

    def _load(self) -> tuple[int, str]:
        """The tip; no block is in memory yet."""
        self.at, self.block, self.changed, self.due = None, {}, False, None
        held = self.tip.get()
        return (held[0], held[1]) if held is not None else (0, GENESIS)

    def _block_of(self, seq: int) -> dict[int, tuple]:
        """Waiting records of the block of ``seq`` by number: (prev, digest, body, due)."""
        if self.at != seq // BLOCK_RECORDS:
            self._store()
            self.at = seq // BLOCK_RECORDS
            held = self.waiting.getValue((self.at,))
            self.block = {} if held is None else {n: rest for n, *rest in zip(*held)}
            self.stored = held is not None
        return self.block

    def _store(self) -> None:
        if self.changed and self.block:
            numbers = sorted(self.block)
            self.waiting.updateValue((self.at,), (numbers, *map(list, zip(*[self.block[n] for n in numbers]))))
        elif self.changed and self.stored:
            self.waiting.removeKey((self.at,))
        self.changed = False

    def _save(self, seq: int, last: str) -> None:
        self._store()
        if self.due is not None:
            self.handle.registerTimer(self.due)
        self.tip.update((seq, last))

    def _take(self, seq: int) -> tuple | None:
        record = self._block_of(seq).pop(seq, None)
        self.changed |= record is not None
        return record

    def _waits_until(self, due: int) -> None:
        self.due = due if self.due is None else min(self.due, due)

    def _verified(self, ledger, seq: int, last: str, record: tuple) -> tuple[Row, str]:
        prev, digest, body = record[:3]
        valid = prev == last and hashlib.sha256((last + body).encode()).hexdigest() == digest
        return Row(ledger=ledger, seq=seq, record_hash=digest, valid=valid, lost=0), digest

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seq, last = self._load()
        some = None  # whether records wait at all: without them a row in its turn needs no look into the state
        each = ((r.seq, r.prev_hash, r.record_hash, r.body, r.ts) for r in rows if r.seq is not None)
        while run := sorted(islice(each, RUN_ROWS), key=lambda r: r[0]):
            for n, prev, digest, body, ts in run:
                if n <= seq:
                    continue  # delivered again
                if n > seq + 1:
                    due = ts + self.timeout_ms
                    self._block_of(n)[n] = (prev, digest, body, due)
                    self.changed = some = True
                    self._waits_until(due)
                    continue
                row, last = self._verified(key[0], n, last, (prev, digest, body))
                seq = n
                yield row
                if some is None:
                    some = self.waiting.exists()
                while some and (record := self._take(seq + 1)) is not None:
                    seq += 1
                    row, last = self._verified(key[0], seq, last, record)
                    yield row
        self._save(seq, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        blocks, until = sorted(k[0] for k in self.waiting.keys()), None
        if not blocks:
            return
        seq, last = self._load()
        for block in reversed(blocks):  # the last record that is overdue; those behind it go on waiting
            held = self._block_of(block * BLOCK_RECORDS)
            until = max((n for n, record in held.items() if record[3] < watermark), default=None)
            for n, record in held.items():
                if until is None or n > until:
                    self._waits_until(record[3])
            if until is not None:
                break
        for block in blocks if until is not None else []:
            if block > until // BLOCK_RECORDS:
                break
            for n in sorted(self._block_of(block * BLOCK_RECORDS)):
                if n > until:
                    break
                record = self._take(n)
                if n <= seq:
                    continue
                if n > seq + 1:
                    yield Row(ledger=key[0], seq=seq + 1, record_hash=None, valid=False, lost=n - seq - 1)
                row, last = self._verified(key[0], n, last, record)
                seq = n
                yield row
        while until is not None and (record := self._take(seq + 1)) is not None:
            seq += 1
            row, last = self._verified(key[0], seq, last, record)
            yield row
        self._save(seq, last)

    def close(self) -> None:
        pass
