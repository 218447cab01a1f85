"""The pipeline's stages one by one, each on what the one before kept."""

import corpus_pipeline
from tallywake.llm import jobs, near_dup, quality, rules
from tallywake.llm.storage import table

from .conftest import AWKWARD
from .test_near_dup import brute_force

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs, known = table(spark, SF, "documents"), table(spark, SF, "labels")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "quality classifier", "near copies", "packing"]
    kept, results = docs, []
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SF).cache()
        results.append(kept)
    assert all(r.columns == docs.columns for r in results[:-1])
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in results]
    assert ids[0] == {r.doc_id for r in rules.quality_rules(docs, known).collect() if r.kept}
    assert ids[1] == {r.doc_id for r in quality.quality_scores(results[0], known).collect() if r.predicted}
    assert ids[2] == {i for i, _, _, k in brute_force([(r.doc_id, r.text) for r in results[1].collect()], 5) if k}
    assert ids[3] == ids[2] and len(ids[2]) < len(ids[0]) < 200
    good = {r.doc_id for r in known.collect() if r.quality == 1}
    assert len(good & ids[1]) >= 0.9 * len(good)
    digest = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(corpus_pipeline.run(spark, SF)) == digest(results[-1])


def test_awkward_rows_through_the_pipeline(spark, documents, labels, tmp_path):
    good = [(100 + n, f"Sentence number {n} is a plain one, and it goes on for some words about the {w} of the town. It ends here.") for n, w in enumerate("mill river bridge market school".split())]
    for name, rows in (("rows", [*AWKWARD, *good, good[0], (200, good[1][1])]), ("none", [])):
        sf = str(tmp_path / name)
        documents(rows).write.parquet(f"{sf}/documents.parquet")
        labels([(100, 1, 0), (1, 0, 0), (None, 1, None)] if rows else []).write.parquet(f"{sf}/labels.parquet")
        kept = table(spark, sf, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, sf).cache()
            assert kept.columns == documents([]).columns
        left = sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
        if rows:
            assert {i for i, _ in left} >= {102, 103, 104} and 1 not in dict(left) and 200 not in dict(left)
        packed = corpus_pipeline.run(spark, sf).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}


def test_all_operators_are_registered(spark):
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {name.partition("_")[0] + "_" for name in jobs.QUERIES}
    assert set(jobs.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert near_dup.BANDS * near_dup.ROWS == 2 * near_dup.PERMUTATIONS
