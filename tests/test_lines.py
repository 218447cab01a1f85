"""Line numbers follow the files, however Spark cuts and packs them."""

import pytest

from tallywake.operators import ledger as l
from tallywake.sources import transcripts as t
from tallywake.sources.lines import numbered_lines


@pytest.fixture
def split_size(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda size: spark.conf.set(key, size)
    spark.conf.set(key, before)


def write(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("".join(line + "\n" for line in lines))


@pytest.mark.parametrize("size", ["1kb", "7kb", "128mb"])
def test_numbers_under_any_split(spark, tmp_path, split_size, size):
    files = {"a.txt": [f"a{n} " + "x" * (n % 90) for n in range(700)], "b.txt": [], "c.txt": ["only", "", "three"], "d.txt": [f"d{n}" for n in range(2500)]}
    for name, lines in files.items():
        write(tmp_path / "in", name, lines)
    split_size(size)
    got = numbered_lines(spark, str(tmp_path / "in"))
    assert size != "1kb" or spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 8
    rows = {(r.file.rsplit("/", 1)[1], r.line): (r.number, r.value) for r in got.collect()}
    want = [(name, n, line) for name in sorted(files) for n, line in enumerate(files[name])]
    assert rows == {(name, n): (k, line) for k, (name, n, line) in enumerate(want)}


@pytest.mark.parametrize("size", ["1kb", "128mb"])
def test_transcripts_in_file_order(spark, tmp_path, split_size, size):
    say = lambda n, more: '{"type":"%s","sessionId":"s","timestamp":"2024-01-01T00:00:%02dZ",%s}' % (*more[:1], n % 60, more[1])
    user = lambda n: say(n, ("user", '"message":{"content":"prompt %d"}' % n))
    reply = lambda n, key: say(n, ("assistant", '"message":{"id":"%s","content":[{"type":"tool_use","name":"Edit","input":{"file_path":"f%d"}},{"type":"tool_use","name":"Edit","input":{"file_path":"g%d"}}],"usage":{"input_tokens":%d}}' % (key, n, n, n)))
    write(tmp_path / "t", "1.jsonl", [user(n) if n % 2 else reply(n, f"m{n % 5}") for n in range(60)])
    write(tmp_path / "t" / "deep", "2.jsonl", [reply(n, f"m{n % 7}") for n in range(100, 160)])
    write(tmp_path / "t", "skip.txt", [user(1)])
    split_size(size)
    lines = t.read_transcript_lines(spark, str(tmp_path / "t"))
    events = t.parse_sessions(lines).orderBy("seq").collect()
    files = [e.file or e.text for e in events]
    want = [x for n in range(60) for x in ([f"prompt {n}"] if n % 2 else [f"f{n}", f"g{n}"])] + [x for n in range(100, 160) for x in (f"f{n}", f"g{n}")]
    assert files == want and len({e.seq for e in events}) == len(events)
    # The first record of a message id in file order wins.
    first = {}
    for n in [n for n in range(60) if n % 2 == 0]:
        first.setdefault(f"m{n % 5}", n)
    for n in range(100, 160):
        first.setdefault(f"m{n % 7}", n)
    assert {r.message_id: r.weighted for r in t.parse_usage(lines).collect()} == first


def test_a_ledger_is_read_in_file_order(spark, tmp_path, split_size):
    fields = spark.createDataFrame([("l", n, n) for n in range(1, 200)], "ledger string, line bigint, pr bigint").selectExpr("ledger", "line", "map('pr', parse_json(cast(pr as string))) as fields")
    done = l.append_records(fields).orderBy("seq").collect()
    write(tmp_path / "ledger", "one.jsonl", [r.body[:-1] + f',"recordHash":"{r.hash}"}}' for r in done])
    split_size("1kb")
    lines = l.read_ledger_lines(spark, str(tmp_path / "ledger"))
    summary = l.ledger_summary(l.verify_ledger(l.parse_ledger(lines))).first()
    assert (summary.records, summary.broken, summary.tip) == (199, 0, done[-1].hash)
