"""Near copies against brute force over all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

from tallywake.llm import near_dup
from tallywake.llm.components import components
from tallywake.llm.storage import table

from .conftest import AWKWARD

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size):
    w = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute_force(rows, size):
    """(doc_id, n_shingles, component_id, kept) of every row, by comparing all sets."""
    sets = sorted({s for i, t in rows if i is not None and (s := shingles(t, size))}, key=lambda s: sorted(s))
    root = {s: s for s in sets}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for n, a in enumerate(sets):
        for b in sets[:n]:
            if 100 * min(len(a), len(b)) >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[find(a)] = find(b)
    least = {}
    for i, t in rows:
        s = shingles(t, size)
        if i is not None and s:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for i, t in rows:
        s = shingles(t, size)
        own = None if i is None else least[find(s)] if s else i
        out.append((i, len(s), own, own is None or own == i))
    return sorted(out, key=repr)


def result(docs, size):
    return sorted(map(tuple, near_dup.near_duplicates(docs, size).collect()), key=repr)


def test_awkward_rows(documents):
    assert result(documents(AWKWARD), 2) == brute_force(AWKWARD, 2)
    assert near_dup.near_duplicates(documents([])).count() == 0


@pytest.mark.parametrize("size", [2, 5])
def test_given_documents(spark, size):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert result(docs, size) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], size)


def copies():
    """A base with copies at all distances, and texts that share only its beginning."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(60)], []
    for n in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((n + 10, " ".join(w)))
    rows += [(n + 500, " ".join(base[:30] + [word() for _ in range(30)])) for n in range(60)]
    return rows


def test_large_mixed_buckets_are_split(documents, monkeypatch):
    rows = copies()
    want = brute_force(rows, 2)
    assert result(documents(rows), 2) == want
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    assert result(documents(rows), 2) == want


def test_sets_with_one_number_are_told_apart(documents, monkeypatch):
    rows = [*copies()[:60], *AWKWARD]
    want = brute_force(rows, 2)
    numbers = near_dup.set_number
    monkeypatch.setattr(near_dup, "set_number", lambda s: numbers(s) % 5)
    assert result(documents(rows), 2) == want


@pytest.mark.parametrize(("small", "large", "most"), [(4, 5, 1.6e-5), (8, 10, 1.6e-5), (20, 25, 1.6e-5), (64, 80, 1.6e-5)])
def test_pairs_at_the_line_share_a_band(small, large, most):
    rng, missed, n = np.random.default_rng(small), 0, 3000
    low = near_dup._least_agreement(80, near_dup.BANDS * near_dup.ROWS, near_dup.SKETCH_BITS)
    hidden = 0
    for _ in range(n):
        b = rng.integers(0, 2**64, large, dtype=np.uint64)
        a = b[:small]
        ends = [near_dup.ends(x) for x in (a, b)]
        keys = [near_dup.band_keys(x, e) for x, e in zip((a, b), ends)]
        shared = min(map(len, keys))
        missed += not (keys[0][:shared] == keys[1][:shared]).any()
        x, y = (near_dup.sketch(e, near_dup.SKETCH_BITS) for e in ends)
        agree = 64 * near_dup.SKETCH_WORDS - sum(bin(int(v)).count("1") for v in (x ^ y).view(np.uint64))
        hidden += small >= near_dup.SMALL and agree < low
    assert missed <= 2 and hidden <= 2  # far more than n * most


def test_kept_rows_carry_all_columns(documents):
    docs = documents(AWKWARD)
    kept = near_dup.keep_one(docs, 2)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute_force(AWKWARD, 2) if r[3]), key=repr)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (3, 2), (None, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{n: 100 for n in range(101, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
