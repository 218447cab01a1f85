"""The permutation index against brute force."""

import numpy as np

from tallywake.llm import neighbours
from tallywake.llm.storage import table


def brute_force(ids, vectors, every, k):
    out = {}
    for q, x in zip(ids, vectors):
        if q % every == 0:
            scores = (vectors * x).sum(1)
            out[int(q)] = sorted([(-s, int(i)) for s, i in zip(scores, ids) if i != q])[:k]
    return out


def test_recall_on_given_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 200)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_force(ids, x, 20, 20)
    got = {}
    for r in neighbours.nearest(vectors, share=0.15, least=1).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    recall = np.mean([len({v for _, v, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    at = {i: v for i, v in zip(ids.tolist(), x)}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - (at[q] * at[v]).sum()) < 1e-12 for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)


def test_ties_repeats_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)], "x") for i in range(12)]
    rows += [(20, [2.0, 1.0], "x"), (20, [2.0, 1.0], "x"), (21, None, "x"), (22, [0.0, 0.0], "x"), (23, [nan, 1.0], "x"), (24, [1.0, inf], "x"), (25, [1.0, None], "x"), (26, [], "x"), (None, [1.0, 1.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string")
    ids, x = np.array([r[0] for r in rows[:14]]), np.array([r[1] for r in rows[:14]], float)
    want = brute_force(ids, x, 5, 4)
    got = {}
    for r in neighbours.nearest(df, k=4, every=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == want
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0
