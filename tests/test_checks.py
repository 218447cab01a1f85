"""Credentials, tests of a request and related files on literal rows."""

import math

from pyspark.sql import functions as F

from tallywake.functions.text import entropy
from tallywake.operators import checks as k
from tallywake.operators import context as x


def test_entropy(spark):
    words = ["", "a", "aaaaaaaa", "abababab", "abcdefgh", "aab", "漢字漢字", "\n\na "]
    want = [-sum((c := w.count(ch) / len(w)) * math.log2(c) for ch in set(w)) if w else 0.0 for w in words]
    got = [r.e for r in spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, w string").orderBy("n").select(entropy(F.col("w")).alias("e")).collect()]
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want))


KEY = "AKIA" + "3F7QZL2MXN8RTVWB"


def found(spark, files, added=()):
    f = spark.createDataFrame(list(files), "change_id string, path string, content string")
    a = spark.createDataFrame(list(added), "change_id string, path string, line int, text string")
    changes = f.select("change_id").distinct()
    findings = k.secret_findings(k.scanned_lines(f, a))
    status = {r.change_id: r.status for r in k.secret_content(changes, findings).collect()}
    rows = sorted((r.change_id, r.path, r.line, r.severity) for r in findings.collect())
    return status, rows, {r.change_id: (r.scanned, r.whole_files, r.unavailable) for r in k.secret_coverage(f, a).collect()}


def test_a_credential_in_ordinary_source(spark):
    status, rows, covered = found(spark, [("c", "src/config.js", f'export const config = {{ key: "{KEY}" }};\n'), ("d", "src/config.js", "export const config = {};\n"), ("e", "src/a.js", None)])
    assert status == {"c": "FAIL", "d": "PASS", "e": "PASS"} and rows == [("c", "src/config.js", 0, "FAIL")]
    assert covered == {"c": (1, 1, 0), "d": (1, 1, 0), "e": (0, 0, 1)}


def test_only_added_lines_count_where_they_are_known(spark):
    old = f"one\nkey {KEY}\nthree"
    status, rows, covered = found(spark, [("c", "a.js", old), ("d", "a.js", old), ("d", "b.js", old)], [("c", "a.js", 2, "three"), ("d", "a.js", 1, f"key {KEY}")])
    assert status == {"c": "PASS", "d": "FAIL"} and rows == [("d", "a.js", 1, "FAIL"), ("d", "b.js", 1, "FAIL")]
    assert covered == {"c": (1, 0, 0), "d": (2, 1, 0)}


def test_assigned_words_need_entropy_and_templates_a_format(spark):
    files = [
        ("low", "a.ts", "token = 'aaaaaaaaaaaaaaaaaaaa'"), ("words", "a.ts", "password: passwordpassword"), ("high", "a.ts", "api_key = 'q8Zk2LwV9xPb4TnR7cYs'"),
        ("late", "a.ts", "token=aaaaaaaaaaaaaaaaaaaa secret=q8Zk2LwV9xPb4TnR7cYs"), ("template", ".env.example", "TOKEN=q8Zk2LwV9xPb4TnR7cYs"), ("leaked", ".env.example", f"AWS_ACCESS_KEY_ID={KEY}"), ("short", "a.ts", "token = q8Zk2LwV9xPb4"),
    ]
    status, _, _ = found(spark, files)
    assert status == {"low": "PASS", "words": "PASS", "high": "WARN", "late": "WARN", "template": "PASS", "leaked": "FAIL", "short": "PASS"}


FILES = [
    ("r", "src/pay/a.ts", "source", "pay"), ("r", "src/user/b.ts", "source", "user"), ("r", "tests/z.test.ts", "test", "tests"), ("r", "tests/payment.test.ts", "test", "tests"),
    ("r", "tests/a.test.ts", "test", "pay"), ("r", "tests/readme.md", "test", "pay"), ("q", "tests/pay.test.ts", "test", "x"), ("r", "tests/free.test.ts", "test", "x"), ("r", "tests/both.test.ts", "test", "pay"),
]


def test_selected_tests(spark):
    files = spark.createDataFrame(FILES, "repo_id string, path string, kind string, domain string")
    edges = spark.createDataFrame([("r", "tests/z.test.ts", "src/pay/a.ts"), ("r", "tests/both.test.ts", "src/pay/a.ts"), ("r", "tests/free.test.ts", "src/user/b.ts"), ("q", "tests/pay.test.ts", "src/pay/a.ts")], "repo_id string, src string, dst string")
    scored = spark.createDataFrame([("1", "r", "tests/a.test.ts", "test", 30), ("1", "r", "tests/readme.md", "test", 90), ("1", "r", "src/pay/a.ts", "source", 50), ("1", "r", "tests/both.test.ts", "test", 12)], "request_id string, repo_id string, path string, kind string, score int")
    primary = spark.createDataFrame([("1", "r", "src/pay/a.ts")], "request_id string, repo_id string, path string")
    got = [(r.repo_id, r.path, r.score) for r in x.select_tests(scored, primary, edges, files).orderBy("position").collect()]
    want = [("r", "tests/a.test.ts", 30), ("r", "tests/both.test.ts", 16), ("r", "tests/z.test.ts", 16), ("q", "tests/pay.test.ts", 8), ("r", "tests/payment.test.ts", 8)]
    assert got == want
    for limit in (1, 2, 3, 4):
        assert [(r.repo_id, r.path, r.score) for r in x.select_tests(scored, primary, edges, files, limit).orderBy("position").collect()] == want[:limit]
    assert x.select_tests(scored, primary.where("false"), edges, files).count() == 2


def test_files_alike_are_bounded_without_loss(spark):
    rows = [("r", f"d/f{n:02}.md", "doc", "dom") for n in range(40)] + [("r", "s.ts", "source", "dom")]
    files = spark.createDataFrame(rows, "repo_id string, path string, kind string, domain string")
    primary = spark.createDataFrame([("1", "r", "d/f00.md"), ("1", "r", "d/f03.md"), ("2", "r", "s.ts")], "request_id string, repo_id string, path string")
    # A file that is alike has 10 points, whatever its own score is, however far down the list it stands.
    scored = spark.createDataFrame([("1", "r", "d/f39.md", "doc", 50), ("1", "r", "s.ts", "source", 11)], "request_id string, repo_id string, path string, kind string, score int")
    edges = spark.createDataFrame([], "repo_id string, src string, dst string")
    for limit in (1, 3, 12):
        got = [(r.path, r.score) for r in x.related_files(primary, scored, edges, files, limit).where("request_id = '1'").orderBy("position").collect()]
        assert got == [("s.ts", 11), *[(f"d/f{n:02}.md", 10) for n in range(40) if n not in (0, 3)]][:limit]
