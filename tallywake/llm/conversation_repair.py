"""Conversation structure repair: cheapest edits by bidirectional Dijkstra over the edit lattice.

A conversation is a row of symbols, one letter a turn. Node (i, s) of its lattice
means that i turns are read and the output ends with s: nothing, system, user or
assistant. Edits are the edges; a path to an end node is a legal conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywake.llm.storage import reach_workers, stored

#: Costs of the edits, and what a truncated turn costs that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Turns of a slice.
SLICE_BITS = 9
#: White space, as the rules count it.
SPACE = " \t\n\x0b\x0c\r"

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_BEFORE_USER = (_NOTHING, _SYSTEM, _ASSISTANT)
#: Symbols: initial of the role (x: any other); capitals are truncated, digits must be deleted.
SYMBOLS = {"fine": "suax", "truncated": "SUAX", "deleted": "0123"}
_CACHED, _CACHED_TURNS = 1 << 14, 64


def _row_edits(symbol: str) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letter) of every edit of a turn with this symbol."""
    edits = [(s, s, DELETE, "D") for s in range(4)]
    if symbol not in SYMBOLS["deleted"]:
        more = TRUNCATED if symbol in SYMBOLS["truncated"] else 0
        to_user = [(s, _USER) for s in _BEFORE_USER]
        kept = {"s": [(_NOTHING, _SYSTEM)], "u": to_user, "a": [(_USER, _ASSISTANT)]}.get(symbol.lower(), [])
        edits += [(a, b, more, "K") for a, b in kept]
        edits += [(a, b, REROLE + more, "R") for a, b in [*to_user, (_USER, _ASSISTANT)]]
    return edits


_EDITS = {symbol: _row_edits(symbol) for kind in SYMBOLS.values() for symbol in kind}
_INSERTS = [(s, _USER, INSERT, "I") for s in _BEFORE_USER] + [(_USER, _ASSISTANT, INSERT, "I")]


def _by(end: int, edits: list[tuple[int, int, int, str]]) -> list[list[tuple[int, int, str]]]:
    return [[(e[1 - end], e[2], e[3]) for e in edits if e[end] == s] for s in range(4)]


_AHEAD = {symbol: _by(0, edits) for symbol, edits in _EDITS.items()}
_BACK = {symbol: _by(1, edits) for symbol, edits in _EDITS.items()}
_AHEAD_INSERTS, _BACK_INSERTS = _by(0, _INSERTS), _by(1, _INSERTS)


class Lattice:
    """Node 4 i + s; edges in both directions."""

    def __init__(self, symbols: str) -> None:
        self.symbols, self.n = symbols, len(symbols)
        self.ends = (4 * self.n + _NOTHING, 4 * self.n + _ASSISTANT)

    def ahead(self, node: int) -> list[tuple[int, int, str]]:
        i, s = divmod(node, 4)
        out = [(4 * i + t, c, letter) for t, c, letter in _AHEAD_INSERTS[s]]
        if i < self.n:
            out += [(4 * i + 4 + t, c, letter) for t, c, letter in _AHEAD[self.symbols[i]][s]]
        return out

    def back(self, node: int) -> list[tuple[int, int, str]]:
        i, s = divmod(node, 4)
        out = [(4 * i + t, c, letter) for t, c, letter in _BACK_INSERTS[s]]
        if i:
            out += [(4 * i - 4 + t, c, letter) for t, c, letter in _BACK[self.symbols[i - 1]][s]]
        return out

    def cheapest(self) -> tuple[int, str]:
        """Least cost of a legal conversation, and the ASCII-least audit among all paths of that cost.

        Both searches go on until their next distances add up to more than the best
        meeting: then every cheapest path has an edge from a node settled ahead to
        one settled behind. Of all nodes on cheapest paths, those that the least
        letters so far lead to are followed together; they lie at one place of the
        lattice, so at most four nodes are held.
        """
        near, far = {0: 0}, dict.fromkeys(self.ends, 0)
        settled: tuple[dict[int, int], dict[int, int]] = ({}, {})
        heaps = ([(0, 0)], sorted((0, -e) for e in far))
        best = None
        while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
            side = 0 if (heaps[0][0][0], len(settled[0])) <= (heaps[1][0][0], len(settled[1])) else 1
            d, name = heapq.heappop(heaps[side])
            node = name if side == 0 else -name
            if node in settled[side]:
                continue
            settled[side][node] = d
            own, other = (near, far) if side == 0 else (far, near)
            for to, c, _ in self.ahead(node) if side == 0 else self.back(node):
                if d + c < own.get(to, d + c + 1):
                    own[to] = d + c
                    heapq.heappush(heaps[side], (d + c, to if side == 0 else -to))
                if to in other and (best is None or d + c + other[to] < best):
                    best = d + c + other[to]
            if node in other and (best is None or d + other[node] < best):
                best = d + other[node]
        before, behind = settled
        behind.update({e: 0 for e in self.ends})
        assert best is not None  # deleting every turn is always legal
        return best, self._least_audit(best, before, behind)

    def _least_audit(self, best: int, before: dict[int, int], behind: dict[int, int]) -> str:
        def crosses(a: int, d: int, edge: tuple[int, int, str]) -> bool:
            return edge[0] in behind and d + edge[1] + behind[edge[0]] == best

        leads = [a for a, d in before.items() if behind.get(a, best + 1) + d == best or any(crosses(a, d, e) for e in self.ahead(a))]
        marked = set(leads)
        while leads:
            node = leads.pop()
            for a, c, _ in self.back(node):
                if a not in marked and a in before and before[a] + c == before[node]:
                    marked.add(a)
                    leads.append(a)
        letters, held = [], {0}
        while not held.intersection(self.ends):
            options: dict[str, set[int]] = {}
            for a in held:
                for edge in self.ahead(a):
                    b, c, letter = edge
                    inside = a in marked and ((b in marked and before[a] + c == before[b]) or crosses(a, before[a], edge))
                    if inside or (a in behind and b in behind and c + behind[b] == behind[a]):
                        options.setdefault(letter, set()).add(b)
            letters.append(min(options))
            held = options[letters[-1]]
        return "".join(letters)


def plans(symbols: str, audit: str) -> list[str]:
    """What stands for each turn in the repaired conversation: k keep, u or a rerole; U or A insert; "" nothing.

    An insert goes with the next turn that stays, or else with the last one. Output
    roles alternate after a kept system turn, so the audit determines them.
    """
    out, at, pending, said, last = [""] * len(symbols), 0, "", 0, None
    for letter in audit:
        if letter == "D":
            at += 1
            continue
        if letter == "K" and symbols[at] in "sS":
            own = "k"
        else:
            role = "ua"[said % 2]
            said += 1
            own = {"K": "k", "R": role, "I": role.upper()}[letter]
        if letter == "I":
            pending += own
        else:
            out[at], last, pending = pending + own, at, ""
            at += 1
    if last is not None:
        out[last] += pending
    return out


def illegal_pairs(symbols: str) -> int:
    """Neighbours whose role initials are not su, ua or au."""
    plain = symbols.lower().translate(str.maketrans("0123", "suax"))
    return sum(plain[i : i + 2] not in ("su", "ua", "au") for i in range(len(plain) - 1))


def _named(conv: str) -> Column:
    """A key without nulls for a conversation."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def _content() -> Column:
    """A number of what a turn says: equal turns have equal ones."""
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text").cast("binary")))


def _marked(turns: DataFrame) -> DataFrame:
    """cid, turn, content, at (place among all turns), initial and fault of every turn; without its text.

    Turns of a conversation follow each other by turn, nulls first, and by content
    where turns are equal. They are ranged by their whole place, so a conversation
    of any size lies in many parts; the last key only parts rows that are alike.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    rows = turns.select(
        _named("conv_id").alias("cid"),
        "turn",
        _content().alias("content"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (said == "").alias("blank"),
        (~F.substring(said, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("alike"),
    )
    order = ["cid", "turn", "content", "alike"]
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("alike"), "turns")
    again = placed.where("not blank").groupBy("cid", "content").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    fault = F.when(F.col("blank"), "blank").when(F.col("first") < F.col("at"), "duplicate").when(F.col("cut"), "truncated")
    return placed.join(again.select("cid", "content", "first"), ["cid", "content"], "left").select("cid", "turn", "content", "at", "initial", fault.alias("fault"))


def _symbol() -> Column:
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "deleted").when(F.col("fault") == "truncated", "truncated").otherwise("fine")
    at = F.instr(F.lit(SYMBOLS["fine"]), F.col("initial"))
    return F.substring(F.element_at(F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair]), kind), at, F.lit(1))


_SOLVED = "cid string, slices array<long>, illegal long, cost long, audit string, plans array<string>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs whole conversations: their symbols come as one string a slice."""
    known: dict[str, tuple] = {}

    def solved(symbols: str) -> tuple:
        if symbols in known:
            return known[symbols]
        cost, audit = Lattice(symbols).cheapest()
        out = (illegal_pairs(symbols), cost, audit, plans(symbols, audit))
        if len(symbols) <= _CACHED_TURNS and len(known) < _CACHED:
            known[symbols] = out
        return out

    for batch in batches:
        rows = []
        for cid, slices, parts in zip(*(c.to_pylist() for c in batch.columns)):
            illegal, cost, audit, own = solved("".join(parts))
            cut, at = [], 0
            for part in parts:
                cut.append(",".join(own[at : at + len(part)]))
                at += len(part)
            rows.append({"cid": cid, "slices": slices, "illegal": illegal, "cost": cost, "audit": audit, "plans": cut})
        schema = pa.schema([("cid", pa.string()), ("slices", pa.list_(pa.int64())), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("plans", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


class Repair:
    """Faults, cheapest edits and repaired turns of every conversation of ``turns`` (conv_id, turn, role, text).

    Null roles and texts count as one space. A conversation's turns follow each
    other by turn (nulls first), turns that are equal there by the MD5 of what they
    say; rows that repeat are turns of their own. A turn's first fault counts:
    blank (nothing but white space, so also empty), duplicate (an earlier turn of
    that role says the same) or truncated (the last character that is not white
    space is none of ``.!?``). A null conv_id is a conversation like the others. An
    empty table has no conversation. Other columns are not looked at.

    Texts take part once, when the repaired turns are written out. Faults and edits
    come from narrow rows that are ranged by place, so a conversation may hold any
    share of them; only one letter a turn, as many as its audit has, meets in one
    task.
    """

    def __init__(self, turns: DataFrame) -> None:
        reach_workers(turns.sparkSession)
        space = F.lit(" ")
        self.turns = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"))
        self.marked = stored(_marked(self.turns), "marked")
        slices = self.marked.select("cid", F.shiftright("at", SLICE_BITS).alias("slice"), "at", _symbol().alias("symbol"))
        strings = slices.groupBy("cid", "slice").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
        whole = F.array_sort(F.collect_list(F.struct("slice", "symbols")))
        conversations = strings.groupBy("cid").agg(whole.alias("parts"))
        self.solved = stored(conversations.select("cid", "parts.slice", "parts.symbols").mapInArrow(_solve, _SOLVED), "edits")

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, one row per conversation that has turns."""
        distinct = self.marked.groupBy("cid", "turn").agg(F.count("*").alias("n"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
        gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
        counts = distinct.groupBy("cid").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
        return counts.join(self.solved.select("cid", "illegal", "cost", "audit"), "cid")

    def _stream(self) -> DataFrame:
        """Turns with their plans: a plan comes before the turn that it is for."""
        parts = self.solved.select("cid", F.explode(F.arrays_zip("slices", "plans")).alias("p")).select("cid", F.col("p.slices").alias("slice"), F.posexplode(F.split("p.plans", ",", -1)).alias("k", "plan"))
        order = F.array_sort(F.collect_list(F.struct("at", "turn", "content")))
        places = self.marked.groupBy("cid", F.shiftright("at", SLICE_BITS).alias("slice")).agg(order.alias("rows"))
        places = places.select("cid", "slice", F.posexplode("rows").alias("k", "row"))
        planned = places.join(parts.where("plan <> ''"), ["cid", "slice", "k"])
        plan = planned.select("cid", F.col("row.turn").alias("turn"), F.col("row.content").alias("content"), "plan", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
        return plan.union(self.turns.select(_named("conv_id").alias("cid"), "turn", _content().alias("content"), F.lit(None).cast("string"), "role", "text"))

    def repaired_turns(self) -> DataFrame:
        """cid, turn, place (of a turn and what is inserted beside it), role and text of the repaired conversations.

        Inserted turns have an empty text and the turn number of the one they stand beside.
        """
        order = ["cid", "turn", "content"]
        rows = self._stream().repartitionByRange(*order).sortWithinPartitions(*order, F.col("plan").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cid, turn, content, place, role, text in _outputs(batches):
                yield pa.RecordBatch.from_arrays([pa.array([cid], pa.string()), pa.array([turn], turn_type), pa.array([content], pa.binary()), pa.array([place], pa.int32()), pa.array([role], pa.string()), pa.array([text], pa.string())], names=["cid", "turn", "content", "place", "role", "text"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = rows.schema["turn"].dataType
        turn_type = to_arrow_type(kind)
        return rows.mapInArrow(run, f"cid string, turn {kind.simpleString()}, content binary, place int, role string, text string")

    def digests(self) -> DataFrame:
        """cid, repaired_sha256: the hash of ``role:text`` of the repaired turns, joined by newlines.

        The hash of a text is serial, so a conversation goes through one task; the
        rows stream by and only the hash is held. No row where nothing is left.
        """
        rows = self._stream().repartition("cid").sortWithinPartitions("cid", "turn", "content", F.col("plan").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, digest, done = None, hashlib.sha256(), []

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["cid", "repaired_sha256"])

            for cid, _, _, _, role, text in _outputs(batches):
                if cid != held:
                    if held is not None:
                        done.append((held, digest.hexdigest()))
                    held, digest = cid, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
                if len(done) >= 4096:
                    yield out()
                    done.clear()
            if held is not None:
                done.append((held, digest.hexdigest()))
            yield out()

        return rows.mapInArrow(run, "cid string, repaired_sha256 string")


def _outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(cid, turn, content, place, role, text) of the repaired turns of a sorted stream of plans and turns."""
    wanted, plan = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(4))))
        for i, (cid, turn, content, own) in enumerate(keys):
            if own is not None:
                wanted, plan = (cid, turn, content), own
            elif plan is not None and wanted == (cid, turn, content):
                role, text = batch.column(4)[i].as_py(), batch.column(5)[i].as_py()
                for place, letter in enumerate(plan):
                    named = {"k": role, "u": "user", "a": "assistant", "U": "user", "A": "assistant"}[letter]
                    yield cid, turn, content, place, named, "" if letter in "UA" else text
                plan = None


def damage(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls count as one space.

    0 leaves a row out, 1 empties its text, 2 takes the marks ``.!?`` out of it, 3
    repeats the row and 4 makes its role user.
    """
    space = F.lit(" ")
    case = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), case.alias("case")).where("case <> 0")
    harmed = rows.select(
        "conv_id",
        "turn",
        F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return harmed.drop("copy")


def repaired_digests(turns: DataFrame, harmed: DataFrame | None = None) -> DataFrame:
    """Per conv_id of ``turns``: counts, cost, audit and repaired_sha256 of its turns in ``harmed`` (or in ``turns``).

    A conversation without turns in ``harmed`` has zeros, an empty audit and the hash of the empty string.
    """
    repair = Repair(turns if harmed is None else harmed)
    found = repair.conversations().join(repair.digests(), "cid", "left")
    named = turns.select("conv_id").distinct().withColumn("cid", _named("conv_id"))
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return named.join(found, "cid", "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def oracle() -> str:
    """DuckDB SQL for the query's rows: least cost and audit of every rest of a conversation, from its end."""
    crc = """list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ascii(c)::bigint)), lambda v, b:
      list_reduce(list_prepend(xor(v, b), range(8)), lambda w, j: case when w & 1 = 1 then xor(w >> 1, 3988292384::bigint) else w >> 1 end))"""
    space = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def cheapest(*paths: str) -> str:
        return f"list_min([{', '.join(paths)}])"

    def path(cost: str, letter: str, state: str) -> str:
        return f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a}}"

    # s0..s3: rest after nothing, system, user and assistant; p0..p3 the same one turn later.
    def read(state: int) -> str:
        ways = [path("2", "D", f"p{state}")]
        to = 3 if state == 2 else 2
        ways.append(path("r.more + 1 + r.dead", "R", f"p{to}"))
        kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[state]
        ways += [path(f"r.more + r.dead + case when r.i = '{i}' then 0 else 1000000000 end", "K", f"p{t}") for i, t in kept]
        return cheapest(*ways)

    insert = "{{'c': 5 + {0}.c, 'a': 'I' || {0}.a}}"
    return f"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
cased as (select *, xor({crc}, 4294967295::bigint) % 20 as m from keyed),
harmed as (
  select conv_id, turn, case when m = 4 then 'user' else role end as role,
    case when m = 1 then '' when m = 2 then translate(text, '.!?', '') else text end as text
  from cased, unnest(range(case m when 0 then 0 when 3 then 2 else 1 end)) u(copy)),
rows as (
  select *, rtrim(text, {space}) as said, left(role, 1) as i0,
    row_number() over (partition by conv_id order by turn nulls first, md5(length(role)::varchar || ':' || role || ':' || text)) as n from harmed),
numbered as (select *, row_number() over (partition by conv_id, role, text order by n) as again from rows),
faults as (
  select *, case when said = '' then 'blank' when again > 1 then 'duplicate' when right(said, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    case when i0 in ('s', 'u', 'a') then i0 else 'x' end as i,
    lag(i0) over (partition by conv_id order by n) || i0 as pair from numbered),
r as (select conv_id, n, i, case fault when 'truncated' then 5 else 0 end as more, case when fault in ('blank', 'duplicate') then 1000000000 else 0 end as dead from faults),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as turns from faults group by conv_id),
rest(conv_id, n, p0, p1, p2, p3) as (
  select conv_id, turns, {{'c': 0::bigint, 'a': ''}}, {{'c': 10::bigint, 'a': 'II'}}, {{'c': 5::bigint, 'a': 'I'}}, {{'c': 0::bigint, 'a': ''}} from counts
  union all
  select conv_id, n, {cheapest("b0", insert.format("q2"))}, {cheapest("b1", insert.format("q2"))}, q2, {cheapest("b3", insert.format("q2"))} from (
    select *, {cheapest("b2", insert.format("b3"))} as q2 from (
      select rest.conv_id, rest.n - 1 as n, {read(0)} as b0, {read(1)} as b1, {read(2)} as b2, {read(3)} as b3
      from rest join r on rest.conv_id is not distinct from r.conv_id and rest.n = r.n))),
solved as (select conv_id, p0.c as cost, p0.a as audit from rest where n = 0),
letters as (
  select conv_id, g as place, substr(audit, g, 1) as letter,
    sum(case when substr(audit, g, 1) <> 'I' then 1 else 0 end) over (partition by conv_id order by g) as n
  from solved, unnest(range(1, length(audit) + 1)) u(g)),
said as (
  select l.conv_id, l.place, l.letter, f.role, f.text,
    sum(case when l.letter = 'D' or (l.letter = 'K' and f.i = 's') then 0 else 1 end) over (partition by l.conv_id order by l.place) as nth
  from letters l left join faults f on l.conv_id is not distinct from f.conv_id and l.n = f.n),
lines as (
  select conv_id, place, case when letter = 'K' then role when nth % 2 = 1 then 'user' else 'assistant' end || ':' || case when letter = 'I' then '' else text end as line
  from said where letter <> 'D'),
hashed as (select conv_id, sha256(string_agg(line, chr(10) order by place)) as repaired_sha256 from lines group by conv_id),
named as (select distinct conv_id from conversations)
select named.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, coalesce(repaired_sha256, sha256('')) as repaired_sha256
from named left join counts on named.conv_id is not distinct from counts.conv_id
left join solved on named.conv_id is not distinct from solved.conv_id
left join hashed on named.conv_id is not distinct from hashed.conv_id"""
