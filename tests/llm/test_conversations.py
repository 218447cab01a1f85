import hashlib
import itertools
import random
import re

import pytest

from tallywake.llm import conversation_repair as repair

EDITS = {"K": 0, "R": 1, "D": 2, "I": 5}
DEAD, CUT = repair.SYMBOLS["deleted"], repair.SYMBOLS["truncated"]


def least(symbols):
    """Least (cost, audit) of every rest of the row, from its end: after nothing, system, user, assistant."""
    rest = [(0, ""), (10, "II"), (5, "I"), (0, "")]
    for symbol in reversed(symbols):
        more = 5 if symbol in CUT else 0
        ways = [[(2 + c, "D" + a)] for c, a in rest]
        if symbol not in DEAD:
            for s, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                ways[s].append((rest[to][0] + 1 + more, "R" + rest[to][1]))
            for s, to in {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}.get(symbol.lower(), []):
                ways[s].append((rest[to][0] + more, "K" + rest[to][1]))
        for _ in range(3):  # inserts between turns, until nothing gets cheaper
            rest = [min(w) for w in ways]
            for s, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                ways[s].append((rest[to][0] + 5, "I" + rest[to][1]))
        rest = [min(w) for w in ways]
    return rest[0]


def enumerated(symbols):
    """The same by trying all audits with at most three inserts."""
    best = (10**9, "")
    n = len(symbols)
    for inserts in range(4):
        for kept in itertools.product("KRD", repeat=n):
            for at in itertools.combinations_with_replacement(range(n + 1), inserts):
                audit = "".join("I" * at.count(i) + (kept[i] if i < n else "") for i in range(n + 1))
                turn, roles, cost, fine = 0, "", 0, True
                for letter in audit:
                    symbol = symbols[turn] if letter != "I" else ""
                    turn += letter != "I"
                    cost += EDITS[letter] + (5 if letter in "KR" and symbol in CUT else 0)
                    fine &= letter in "DI" or symbol not in DEAD
                    if letter == "K":
                        roles += symbol.lower()
                    elif letter in "RI":
                        roles += "?"
                wanted = "ua" * len(roles) if len(roles) % 2 == 0 else "s" + "ua" * len(roles)
                legal = len(roles) != 1 and all(a == b or (a == "?" and b != "s") for a, b in zip(roles, wanted))
                if fine and legal:
                    best = min(best, (cost, audit))
    return best


def test_lattice_equals_all_edits():
    r = random.Random(1)
    every = "".join(repair.SYMBOLS.values())
    for n in range(5):
        for _ in range(12):
            symbols = "".join(r.choice(every) for _ in range(n))
            assert repair.Lattice(symbols).cheapest() == enumerated(symbols) == least(symbols), symbols


def test_lattice_equals_search_from_the_end():
    r = random.Random(2)
    for _ in range(1500):
        symbols = "".join(r.choices("suax" "SUAX" "0123", [1, 6, 6, 1, 1, 2, 2, 1, 1, 1, 1, 1], k=r.randint(0, 60)))
        assert repair.Lattice(symbols).cheapest() == least(symbols), symbols
    long = "".join(r.choices("uaUAs2", k=20_000))
    assert repair.Lattice(long).cheapest()[0] == least(long[:20_000])[0]


def plain(rows):
    """conv_id -> digest columns of (conv_id, turn, role, text) rows, turn by turn in plain Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        symbols, counts, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kind = {"blank": "deleted", "duplicate": "deleted", "truncated": "truncated", None: "fine"}[fault]
            symbols += repair.SYMBOLS[kind]["suax".index(role[:1]) if role[:1] in ("s", "u", "a") else 3]
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = least(symbols)
        lines, at, said = [], 0, 0
        for letter in audit:
            role, text = own[at][1:] if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                role = "ua"[said % 2] == "u" and "user" or "assistant"
            said += not (letter == "K" and role[:1] == "s")
            lines.append(f"{role}:{text}")
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_awkward_rows(spark):
    long = "word " * 100_000 + "end."
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 4, "user", "cut off"), (1, 5, "assistant", long),
        (2, None, "system", "Rules."), (2, None, None, "Who?"), (2, 3, "assistant", None), (2, 4, "user", ""), (2, 5, "tool", "Result!"),
        (None, 0, "user", "No name."), (None, 1, "user", "No name."), (None, 2, "assistant", " \t\n"),
        (3, 0, None, None), (4, 0, "", "No role."), (5, None, "user", "x"), (5, None, "user", "x"),
        (6, -3, "assistant", "First. \x0b"), (6, 10**9, "user", "Last,\x85"),
        (7, 0, "user", "a:b."), (7, 1, "user:a", "b."),
    ]
    r = random.Random(3)
    rows += [(8, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No", f"Turn {t}.", f"Turn {t}"])) for t in range(1500)]  # several slices
    clashing = ["cid", "slice", "at", "plan", "content", "fault", "audit", "copy", "x.y"]
    table = spark.createDataFrame([(*row, *["z"] * len(clashing)) for row in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in clashing))
    got = repair.repaired_digests(table.repartition(5)).select("conv_id", *COLUMNS).collect()
    assert {row[0]: tuple(row[1:]) for row in got} == plain(rows)
    assert len(got) == len({row[0] for row in rows})
    # The repaired turns are those of the hash.
    turns = repair.Repair(table).repaired_turns().collect()
    for conv, name in ((1, "=1"), (8, "=8"), (None, "")):
        own = sorted((t for t in turns if t.cid == name), key=lambda t: (t.turn is not None, t.turn, bytes(t.content), t.place))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == plain(rows)[conv][-1]


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant" if t % 2 else "user", f"One. Two? {c} {t}!") for c in range(40) for t in range(8)] + [(None, 1, None, None), (1, None, "user", "No turn.")]
    want = []
    for c, t, role, text in rows:
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        want += [(c, t, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in repair.damage(table).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    digests = repair.repaired_digests(table, repair.damage(table)).select("conv_id", *COLUMNS).collect()
    assert {r[0]: tuple(r[1:]) for r in digests} == plain(want) | {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in {r[0] for r in rows} - {r[0] for r in want}}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired_digests(empty).collect() == []
    assert repair.Repair(empty).repaired_turns().collect() == []


@pytest.mark.parametrize("symbols", ["", "s", "uu", "au", "0", "x" * 9])
def test_plans_follow_the_audit(symbols):
    audit = repair.Lattice(symbols).cheapest()[1]
    assert len(repair.plans(symbols, audit)) == len(symbols)
