"""Shards and licences against their SQL."""

import random
import re

import duckdb
import pytest

from tallywake.llm import licenses, sharding
from tallywake.llm.storage import table

from .conftest import AWKWARD

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    return lambda text: sorted(con.execute(text).fetchall())


@pytest.mark.parametrize("limit", [64 << 20, 20_000, 1])
def test_shards_equal_sql(spark, sql, limit):
    placed = sharding.with_shards(table(spark, SF, "documents"), limit)
    assert sorted(map(tuple, placed.select("doc_id", "shard", "shard_depth", "n_bytes", "shard_bytes").collect())) == sql(sharding.oracle(limit))


def test_shard_files(documents):
    got = sharding.shard_round_trip(documents(AWKWARD), 100).collect()
    assert sorted(((r.doc_id, r.n_bytes) for r in got), key=repr) == sorted(((i, len((t or "").encode())) for i, t in AWKWARD), key=repr)
    held = {}
    for r in got:
        held.setdefault(r.shard, []).append(r)
    for shard, rows in held.items():
        assert {r.shard_bytes for r in rows} == {sum(r.n_bytes for r in rows)}
        assert rows[0].shard_bytes <= 100 or len(rows) == 1
        assert not any(other != shard and other.startswith(shard) for other in held)
    assert sharding.shard_round_trip(documents([])).count() == 0


def test_an_id_larger_than_a_shard_is_split_by_rows(documents):
    rows = [(7, "x" * 10)] * 60 + [(n, "y") for n in range(20)]
    got = sharding.with_shards(documents(rows), 100).collect()
    assert len(got) == 80 and sum(r.doc_id == 7 for r in got) == 61
    assert all(r.shard_bytes <= 100 for r in got)
    assert len({r.shard for r in got if r.doc_id == 7}) >= 6
    assert all(r.shard_depth == len(r.shard) for r in got)


def test_licenses_equal_sql(spark, sql):
    found = sorted(map(tuple, licenses.scan(table(spark, SF, "documents")).collect()))
    assert found and found == sql(licenses.oracle())


def test_notices_in_any_place_and_nearly_whole(documents):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0"]
    words = mit.split()
    edited = " ".join(w if n not in (20, 60) else "changed" for n, w in enumerate(words))
    broken = " ".join(w if n % 4 else "changed" for n, w in enumerate(words))
    rows = [(n, " ".join(["filler"] * n) + " released\nunder THE (MIT) license! and more words") for n in range(12)]
    rows += [(20, mit), (20, mit), (21, edited), (22, broken), (23, gpl + " " + mit), (24, "Released under the"), (None, "Released under the MIT License.")]
    docs = documents(rows + [r for r in AWKWARD if r[0] != 20])
    got = sorted([(r.doc_id, r.license) for r in licenses.scan(docs).collect()], key=repr)
    want = [(n, "mit-notice") for n in range(12)] + [(20, "mit")] * 2 + [(21, "mit"), (23, "gpl-3.0"), (23, "mit"), (None, "mit-notice")]
    assert got == sorted(want, key=repr)
    assert licenses.scan(documents([])).count() == 0


def test_no_context_hides_a_notice(documents):
    # Each context stood in for the notice in every band of the min-hash that once retrieved the templates.
    contexts = [
        "{} ts vjyjh su zpnbhap az twubhvif iboko xijqegwq qjpf",
        "{} sgmpggx apua wbfcd dpyo rkbh dxmna djguvnnj gzbdo hm",
        "{} lj valily mpxqvzld comiiok tndg kvaqiy tfki jlxph netuaxr",
        "pflgre ygbkk {} vi bpoysh wx uvql fc ibw roizaffm qfwqyv jlex",
        "mtaays {} ky hanpnzm szxqybwr px wphbr qffdx lukeggir cb dzkqjfj",
    ]
    docs = documents([(n, c.format(licenses.TEMPLATES["mit-notice"])) for n, c in enumerate(contexts)])
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == [(n, "mit-notice") for n in range(5)]


def looked_up(rows):
    """(doc_id, license) by looking every shingle of a template up in the text."""

    def words(text):
        return re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    out = []
    for doc_id, text in rows:
        held = shingles(words(text))
        for name, template in licenses.TEMPLATES.items():
            own = shingles(words(template))
            if own and len(own & held) >= licenses.CONTAINED * len(own):
                out.append((doc_id, name))
    return sorted(out)


def test_no_notice_is_missed_among_foreign_words(spark, documents):
    r = random.Random(8)

    def filler(n):
        return [r.choice("abcdefgh") * r.randint(1, 3) for _ in range(n)]

    rows = []
    for k in range(1500):
        words = r.choice(list(licenses.TEMPLATES.values())).split()
        if k % 3 == 0 and len(words) > 25:  # scattered: six words each among foreign ones
            words = [w for i in range(0, len(words) - 5) for w in [*words[i : i + 6], *filler(40)]]
        elif k % 3 == 1 and len(words) > 10:  # nearly whole
            words[r.randrange(len(words))] = "changed"
        rows.append((k, " ".join([*filler(r.randint(0, 60)), *words, *filler(r.randint(0, 60))])))
    want = looked_up(rows)
    assert len(want) > 1200
    assert sorted((x.doc_id, x.license) for x in licenses.scan(documents(rows)).collect()) == want


def test_the_scan_runs_no_python(spark):
    plan = licenses.scan(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
