import math
from collections import Counter

import numpy as np
import pytest

from tallywake.llm import hard_negatives as hard

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50, positives=5, negatives=3):
    sound = {}
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= hard.COMPONENT_LIMIT for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        sound[vec_id] = min(row, sound.get(vec_id, row))
    dims = Counter(len(v) for _, v in sound.values())
    dim = min(dims, key=lambda d: (-dims[d], d), default=0)
    sound = {i: row for i, row in sound.items() if len(row[1]) == dim}
    out = []
    for a, (label, v) in sound.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), b, other == label) for b, (other, w) in sound.items() if b != a)
        for s, b, _ in [x for x in scored if x[2]][:positives]:
            near = [(t, c) for t, c, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(a, b, k + 1, c, -s, -t) for k, (t, c) in enumerate(near)]
    return sorted(out)


def got(spark, rows, **options):
    clashing = ["zone", "chunk", "name", "wanted", "x.y", "score", "v"]
    table = spark.createDataFrame([(*r, *["z"] * len(clashing)) for r in rows], "vec_id long, embedding array<float>, label int, " + ", ".join(f"`{c}` string" for c in clashing))
    return sorted(tuple(r) for r in hard.hard_negatives(table, **options).select(COLUMNS).collect())


@pytest.fixture
def small_zones(monkeypatch):
    monkeypatch.setattr(hard, "ZONE_ROWS", 40)
    monkeypatch.setattr(hard, "CELL_ROWS", 4)
    monkeypatch.setattr(hard, "CHUNK_ANCHORS", 8)


def test_equals_brute_force_over_many_zones(spark, small_zones):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 7))
    vectors = centres[rng.integers(0, 6, 500)] + 0.2 * rng.normal(size=(500, 7))
    vectors[100:260] = vectors[100]  # a cell of more than one zone, and ties
    rows = [(int(i) - 30, [float(x) for x in np.float32(v)], int(rng.integers(0, 4))) for i, v in enumerate(vectors)]
    want = brute(rows, every=10)
    assert len(want) > 300
    assert got(spark, rows, every=10) == want


def test_awkward_rows(spark):
    rows = [
        (0, [0.5, 0.25, 1.0], 1), (1, [0.5, 0.25, 0.9], 1), (2, [0.5, 0.25, 0.8], 2), (3, [0.4, 0.2, 0.6], 2), (4, [0.5, 0.25, 0.8], 2),
        (None, [0.5, 0.25, 0.8], 2), (5, None, 2), (6, [0.5, 0.25, 0.8], None), (7, [0.5, None, 0.8], 2), (8, [0.5, float("nan"), 0.8], 2),
        (9, [0.5, float("inf"), 0.8], 2), (10, [], 2), (11, [0.5], 2), (12, [0.0, 0.0, 0.0], 1), (13, [1e30, 0.0, 0.0], 1),
        (3, [0.4, 0.2, 0.6], 2), (2, [0.9, 0.25, 0.8], 2), (2, [0.1, 0.25, 0.8], 1), (50, [0.0, 0.0, 0.0], 2), (100, [-1.0, -0.5, 0.1], 1), (150, [9.0, 0.1, -3.0], 3),
    ]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, rows, positives=1, negatives=9, every=1) == brute(rows, 1, 1, 9)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4) * 3e5], i % 3) for i in range(60)]
    assert got(spark, rows, every=5) == brute(rows, every=5) != []


def test_empty_and_one_label(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, None, 1)]) == []
    assert got(spark, [(50 * i, [1.0, float(i)], 1) for i in range(4)]) == []


def test_a_zone_visits_cells_by_falling_bounds():
    rng = np.random.default_rng(7)
    vectors = np.floor(rng.normal(size=(300, 6)) * 100).astype(np.int64)
    zone = hard.Zone(hard.Codebooks.fitted(vectors.astype(float), 6), np.arange(300), np.zeros(300, np.int64), vectors)
    for anchor in vectors[:20]:
        cells = list(zone.cells_from_best(anchor))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
        assert sum(b - a for _, _, a, b in cells) == 300
        for upper, low, a, b in cells:
            scores = zone.scores(a, b, anchor)
            assert scores.max() <= upper and scores.min() >= low
