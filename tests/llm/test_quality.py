"""Statistics, rules and classifier against plain Python."""

import binascii
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallywake.llm import document_statistics, quality, rules, trees
from tallywake.llm.storage import table
from tallywake.llm.words import portions, statistics

from .conftest import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("portion", [50, 1 << 20])
def test_statistics(portion):
    rng = random.Random(8)
    parts = ["a", "b", "A", "é", "\n", " ", "\t", "|", "\x1c", "漢", "ab c ", "the end of it all "]
    texts = [t for _, t in AWKWARD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    got = []
    for p in portions(pa.array(texts), portion):
        s = statistics(p)
        got += zip(s.n_words.tolist(), s.word_chars.tolist(), s.n_symbols.tolist(), s.n_dup_lines.tolist(), s.n_repeat_words.tolist())
    assert got == [plain(t) for t in texts]


def base_failed(p):
    return p[0] < 10 or 100 * p[4] > 20 * p[0]


def test_rules_of_awkward_rows(documents, labels):
    got = rules.quality_rules(documents(AWKWARD), labels([(0, 1, 0), (0, 0, 0), (4, None, 0), (None, 1, 0), (77, 1, 0)])).collect()
    assert sorted((tuple(r)[:6] + (r.base_failed,) for r in got), key=repr) == sorted(((i, *plain(t), base_failed(plain(t))) for i, t in AWKWARD), key=repr)
    assert not any(r.kept and r.base_failed for r in got)
    # Without labels the fixed limits decide alone.
    alone = rules.quality_rules(documents(AWKWARD), labels([])).collect()
    assert all(r.kept != r.base_failed for r in alone)
    assert rules.quality_rules(documents([]), labels([])).count() == 0


def test_rules_on_given_rows(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    verdict = {r.doc_id: r for r in rules.quality_rules(docs, known).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(tuple(r)[1:6] == plain(texts[i]) and r.base_failed == base_failed(plain(texts[i])) for i, r in verdict.items())
    good = [verdict[r.doc_id] for r in known.collect() if r.quality == 1]
    bad = [verdict[r.doc_id] for r in known.collect() if r.quality == 0]
    assert sum(not r.kept and not r.base_failed for r in good) <= 0.01 * len(good)
    assert sum(not r.kept for r in bad) > 0.7 * len(bad)
    kept = rules.keep_good(docs, known)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in verdict.items() if r.kept}


def test_classifier_on_held_out_rows(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in quality.quality_scores(docs, known).collect()}
    assert all(r.held_out == (binascii.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in known.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)
    # Scores do not move with the labels of held-out rows, nor with anything but the text.
    flipped = known.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic")
    again = quality.quality_scores(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "0 as n_chars"), flipped)
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_classifier_of_awkward_rows(documents, labels):
    got = quality.quality_scores(documents(AWKWARD), labels([(0, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1)])).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in quality.quality_scores(documents(AWKWARD), labels([])).collect()} == {0.5}
    assert quality.quality_scores(documents([]), labels([])).count() == 0


def test_kept_awkward_rows(documents, labels):
    docs, known = documents(AWKWARD), labels([(0, 1, 0), (3, 0, 0), (None, 1, 0)])
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    kept = rules.keep_good(docs, known)
    verdict = {(r.doc_id, r.n_words): r.kept for r in rules.quality_rules(docs, known).collect()}
    assert kept.columns == docs.columns
    assert order(kept.collect()) == order(r for r in docs.collect() if verdict[r.doc_id, plain(r.text)[0]])
    judged = quality.keep_good(docs, known)
    assert judged.columns == docs.columns and order(judged.collect()) == order(docs.collect())  # too few labels: 0.5 for all
    for keep in (rules.keep_good, quality.keep_good):
        assert keep(documents([]), labels([])).collect() == []
        assert keep(documents([]), labels([])).columns == docs.columns


def walked(feature, cut, leaves, row, depth):
    """The leaf of one row, from the root of a tree down, by itself."""
    node = 0
    for _ in range(depth):
        node = 2 * node + (1 if row[feature[node]] <= cut[node] else 2)
    return leaves[node - (2**depth - 1)]


def test_flat_trees_equal_a_walk_from_the_root():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 5)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0.3).astype(float)
    boosted = trees.BoostedTrees.fit(x, y, trees=20)
    forest = trees.IsolationForest.fit(x, trees=20, rows=64)
    for row, score, anomaly in zip(x[:80], boosted.score(x[:80]), forest.score(x[:80])):
        raw = boosted.base + sum(walked(f, c, v, row, boosted.depth) for f, c, v in zip(boosted.feature, boosted.cut, boosted.value))
        assert math.isclose(score, 1 / (1 + math.exp(-raw)), rel_tol=1e-9)
        path = np.mean([walked(f, c, p, row, forest.depth) for f, c, p in zip(forest.feature, forest.cut, forest.path)])
        usual = 2 * (math.log(63) + np.euler_gamma) - 2 * 63 / 64
        assert math.isclose(anomaly, 2 ** (-path / usual), rel_tol=1e-9)


def test_histogram_splits_equal_a_search_over_all_cuts():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, size=(300, 3)).astype(float)  # fewer values than bins: every cut is on an edge
    y = ((x[:, 1] > 6) ^ (rng.random(300) < 0.1)).astype(float)
    model = trees.BoostedTrees.fit(x, y, trees=1, depth=1, least=10, ridge=1.0)
    p = 1 / (1 + math.exp(-model.base))
    g, h = y - p, np.full(300, p * (1 - p))

    def gain(f, c):
        left = x[:, f] <= c
        if min(left.sum(), (~left).sum()) < 10:
            return -1
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    best = max((gain(f, c), -f, -c) for f in range(3) for c in np.unique(x[:, f]))
    assert (model.feature[0, 0], model.cut[0, 0]) == (-best[1], -best[2])
    for side, leaf in ((x[:, 1] <= model.cut[0, 0], 0), (x[:, 1] > model.cut[0, 0], 1)):
        assert math.isclose(model.value[0, leaf], 0.15 * g[side].sum() / (h[side].sum() + 1))


def grown(rows, level, depth, total=0.0):
    """Path lengths at the leaves below a node that holds ``rows`` rows: its own level and what a random tree would add."""
    if rows <= 1:
        return level
    return level + (1.0 if rows == 2 else 2 * (math.log(rows - 1) + np.euler_gamma) - 2 * (rows - 1) / rows)


def test_forest_paths_hold_the_rows_that_reach_them():
    x = np.random.default_rng(5).normal(size=(64, 3))
    forest = trees.IsolationForest.fit(x, trees=5, rows=64)  # every tree grows on all rows
    for f, c, path in zip(forest.feature, forest.cut, forest.path):
        todo = [(0, 0, x)]
        while todo:
            node, level, part = todo.pop()
            if level == forest.depth or not np.isfinite(c[node]):
                first = (node + 1) * 2 ** (forest.depth - level) - 1 - (2**forest.depth - 1)
                assert np.allclose(path[first : first + 2 ** (forest.depth - level)], grown(len(part), level, forest.depth))
                continue
            left = part[:, f[node]] <= c[node]
            assert 0 < left.sum() < len(part)
            todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]


def test_statistics_of_a_batch_without_rows():
    assert all(len(v) == 0 for v in document_statistics.of_column(pa.array([], pa.string())).values())
