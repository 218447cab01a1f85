"""Keyed owner rules against testing every rule by its expression."""

import random
import re

from pyspark.sql import functions as F

from tallywake.operators import ownership as o

PATTERNS = [
    "*", "*.ts", "*.test.ts", "*_test.go", "docs/", "/docs/", "/src/api/", "src/api", "/src/api/a.ts", "a.ts", "api/a.ts", "/a.ts", "apps/**", "/apps/**", "apps/*/src", "**/lib/", "lib/**/x.ts", "src/?.ts", "api/lib/", "*.", ".env", "*.md", "/lib", "deep/er/",
]
PARTS = ["src", "api", "docs", "apps", "lib", "deep", "er", "x"]
NAMES = ["a.ts", "x.ts", "b.test.ts", "util_test.go", "README.md", ".env", "lib", "noext", "a.", "weird..ts"]


def test_keys_equal_every_expression(spark):
    r = random.Random(9)
    paths = sorted({"/".join([*r.choices(PARTS, k=r.randint(0, 4)), r.choice(NAMES)]) for _ in range(400)})
    rules = [(repo, n, p, [f"@o{n}"]) for repo in range(6) for n, p in enumerate(r.sample(PATTERNS, r.randint(0, len(PATTERNS))))]
    files = spark.createDataFrame([(repo, p, k) for repo in range(6) for k, p in enumerate(paths)], "repo_id int, path string, k int")
    table = spark.createDataFrame(rules, "repo_id int, rule_no int, pattern string, owners array<string>")
    tests = {(x.repo_id, x.rule_no): x.e for x in table.select("repo_id", "rule_no", o.pattern_regex(F.col("pattern")).alias("e")).collect()}
    got = {(x.repo_id, x.path): (x.rule_no, x.owners) for x in o.match_owners(files, table).collect()}
    assert len(got) == 6 * len(paths)
    for (repo, path), (rule, owners) in got.items():
        want = max((n for q, n, _, _ in rules if q == repo and re.search(tests[q, n], path)), default=None)
        assert rule == want and owners == ([] if want is None else [f"@o{want}"]), (path, rule, want)


def test_repeated_files_and_no_rules(spark):
    files = spark.createDataFrame([(1, "a.ts"), (1, "a.ts"), (2, "b/c.ts")], "repo_id int, path string")
    rules = spark.createDataFrame([(1, 0, "*.ts", ["@x"])], "repo_id int, rule_no int, pattern string, owners array<string>")
    assert sorted(((r.repo_id, r.path, r.rule_no) for r in o.match_owners(files, rules).collect()), key=repr) == [(1, "a.ts", 0), (1, "a.ts", 0), (2, "b/c.ts", None)]
    assert [r.owners for r in o.match_owners(files, rules.where("false")).collect()] == [[], [], []]
