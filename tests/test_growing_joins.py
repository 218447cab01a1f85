"""Joins and tables of queries whose inputs grow, as they are planned."""

import pytest
from pyspark.sql import functions as F

from tallywake.plans import changes as plans

PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
ITEM = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A few parts, orders and line items, some with null or repeated keys."""
    folder = tmp_path_factory.mktemp("shop")
    kinds = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    part = [(k, f"old ring{k % 3}", f"Brand#{k % 5}", kinds[k % 6], k % 50, 1.0) for k in [*range(60), 7]]
    orders = [(k, k % 4, "FOP"[k % 3], float(k), "1-URGENT") for k in range(30)] + [(None, 1, "F", 1.0, "1-URGENT"), (3, None, "F", 1.0, "1-URGENT")]
    items = [(k // 4, (k * 7) % 60, k % 20, k % 4 + 1, float(k % 50), 1.0, "ANR"[k % 3], "OF"[k % 2]) for k in range(120)]
    items += items[:9] + [(5, None, 1, 2, 9.0, 1.0, "A", "O"), (None, 3, 1, 1, 9.0, 1.0, "A", "O"), (6, 3, 1, None, 9.0, 1.0, "A", "O")]
    tables = {"part": (part, PART), "orders": (orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string"), "lineitem": (items, ITEM),
              "supplier": ([(k, f"s{k}", k % 25, 1.0) for k in range(20)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_and_their_owners_are_not_sent_through_the_driver(spark, shop):
    assert "Broadcast" not in planned(plans.items(spark, shop))
    assert "Broadcast" not in planned(plans.owned_paths(spark, shop))
    # Only the few team members go to every task.
    assert planned(plans.approval_rows(spark, shop)).count("BroadcastHashJoin") <= 1


@pytest.mark.parametrize("name", ["j11_infer_scope", "j12_declared_closure", "a29_convergence", "c13_scope_contract"])
def test_items_are_joined_once(spark, shop, monkeypatch, name):
    """Every rule reads the rows that were written, not the joins they come from."""
    made, real = [], plans.items

    def counted(*args):
        made.append(args)
        return real(*args)

    monkeypatch.setattr(plans, "items", counted)
    assert plans.QUERIES[name][0](spark, shop).count() > 0
    assert len(made) == 1


def test_files_and_their_imports_are_not_sent_through_the_driver(spark, shop):
    from tallywake.plans import graph

    assert "Broadcast" not in planned(graph.files(spark, shop))
    # Only the declared packages may go to every task.
    assert planned(graph.edges(spark, shop)).count("BroadcastHashJoin") <= 1
    assert graph.g1_dependents(spark, shop).count() > 0


def test_paths_of_items_are_shuffled_once(spark, shop):
    """Lines meet their part and then their order; the line after is looked up where they lie by then."""
    made = plans.items(spark, shop)
    assert planned(made).count("Exchange hashpartitioning") == 4
    rows = made.select("l_orderkey", "l_linenumber", "path", "next_path").collect()
    after = lambda r: [x.path for x in rows if x.l_orderkey == r.l_orderkey and r.l_linenumber is not None and x.l_linenumber == r.l_linenumber + 1]
    assert {r.l_orderkey for r in rows} == set(range(30)) and any(r.l_linenumber is None for r in rows)
    assert all(r.next_path == min(after(r), default=None) for r in rows)


def test_finished_steps_let_their_shuffle_files_go(spark, monkeypatch):
    """A driver that collects by chance kept the files of all steps until the end; how soon they go is up to the JVM."""
    from tallywake import session

    asked, real = [], session.release

    def counted(spark):
        asked.append(spark)
        return real(spark)

    monkeypatch.setattr(session, "release", counted)
    counts = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    assert session.written(counts, "step").count() == session.cut_lineage(counts).count() == 7
    assert len(asked) == 2


def test_predicted_and_changed_files_are_compared_in_one_shuffle(spark):
    from tallywake.operators import changes as c

    schema = "change_id int, path string"
    said = [(1, "a", "advisory"), (1, "a", "required"), (1, "b", "supporting"), (1, "c", "advisory"), (1, "d", "required"), (1, "e", "other"), (None, "a", "required"), (1, None, "required")]
    touched = [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "e"), (1, "f"), (1, ""), (1, None), (None, "a")]
    out = c.compare_predicted(spark.createDataFrame(said, schema + ", role string"), spark.createDataFrame(touched, schema))
    assert planned(out).count("Exchange hashpartitioning") == 1
    want = [(1, "a", "direct"), (1, "b", "related"), (1, "c", "advisory"), (1, "d", "unconfirmed"), (1, "e", "missed"), (1, "f", "missed"), (1, None, "unconfirmed"), (None, "a", "missed"), (None, "a", "unconfirmed")]
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, want))


def test_flags_of_paths_are_bits(spark):
    from tallywake.functions import fixed_values as fixed
    from tallywake.operators import changes as c

    paths = ["src/auth/billing/schema.sql", ".env", "docs/auth/a.md", "config/Dockerfile", "package.json", "src/a.ts"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(c.drift_flags(F.col("path")).alias("names"), c.drift_mask(F.col("path")).alias("mask"), c.drift_mask(F.col("path"), fixed.SEVERE_FLAGS).alias("severe")).collect()
    assert {f for r in rows for f in r.names} >= {"auth/security", "money flow", "data model", "configuration", "dependency", "secret"}
    assert all([f for i, f in enumerate(c.DRIFT_FLAGS) if r.mask >> i & 1] == sorted(r.names, key=c.DRIFT_FLAGS.index) for r in rows)
    assert all({f for i, f in enumerate(c.DRIFT_FLAGS) if r.severe >> i & 1} == set(r.names) & set(fixed.SEVERE_FLAGS) for r in rows)


def test_the_subject_of_a_test_is_worked_out_once(spark):
    """It was cut out of the path anew for every letter of it."""
    from tallywake.operators import changes as c

    tests = spark.createDataFrame([(1, "src/a/cart-total.view.test.ts")], "change_id int, path string")
    rows = c._cover_rows(tests)
    assert planned(rows).count(r"(?i)\.snap$") == 1
    assert {(r.stem, r.suffixed) for r in rows.collect()} == {("cart-total.view", False), ("cart-total", False), ("cart", True)}


def test_links_of_a_closure_are_read_either_way(spark):
    from tallywake.operators import changes as c

    df = lambda *paths: spark.createDataFrame([(1, p) for p in paths], "change_id int, path string")
    none = lambda schema: spark.createDataFrame([], schema)
    edges = spark.createDataFrame([(1, "src/x/b.ts", "src/y/a.ts"), (1, "src/y/a.ts", "src/z/c.ts"), (1, "src/w/d.ts", "src/z/c.ts"), (1, "src/v/pop.ts", "src/y/a.ts"), (1, "src/y/a.ts", "src/auth/e.ts"), (1, "src/x/b.ts", "src/u/far.ts")], "change_id int, src string, dst string")
    importers = spark.createDataFrame([(1, "src/y/a.ts", 2), (1, "src/z/c.ts", 9), (1, "src/auth/e.ts", 1)], "change_id int, path string, importers int")
    out = c.declared_closure(
        df("src/y/a.ts"), df("src/x/b.ts", "src/z/c.ts", "src/w/d.ts", "src/v/pop.ts", "src/auth/e.ts", "src/u/far.ts", "docs/n.md"), none("change_id int, path string"),
        none("change_id int, term string"), none("change_id int, directory string"), edges, importers, none("change_id int, path string, line int, text string"),
    )
    # c.ts has too many importers and e.ts a severe flag of its own; far.ts joins in the second round, over an edge without a number.
    assert {r.path: (r.rule, r.anchor) for r in out.collect()} == {
        "src/x/b.ts": ("scope-import", "src/y/a.ts"), "src/v/pop.ts": ("scope-import", "src/y/a.ts"), "src/u/far.ts": ("scope-import", "src/x/b.ts"), "docs/n.md": ("scope-doc", "src/u/far.ts"),
    }


def test_closure_takes_generic_sources_beside_their_tests_only(spark):
    from tallywake.operators import changes as c

    df = lambda *paths: spark.createDataFrame([(1, p) for p in paths], "change_id int, path string")
    none = lambda schema: spark.createDataFrame([], schema)
    out = c.declared_closure(
        df("src/a/index.ts", "src/b/cart.ts"), df("src/a/index.test.ts", "src/b/index.test.ts", "tests/cart-total.test.ts", "src/c/other.test.ts"), none("change_id int, path string"),
        none("change_id int, term string"), none("change_id int, directory string"), none("change_id int, src string, dst string"), none("change_id int, path string, importers int"),
        none("change_id int, path string, line int, text string"),
    )
    assert {r.path: (r.rule, r.anchor) for r in out.collect()} == {"src/a/index.test.ts": ("scope-test", "src/a/index.ts"), "tests/cart-total.test.ts": ("scope-test", "src/b/cart.ts")}


def test_terms_of_files_meet_the_few_wanted_ones_unshuffled(spark):
    from tallywake.operators import impact as m

    files = spark.createDataFrame(
        [("r", f"src/pay{i}/cart{i}.ts", "source", "en", None, None, False, [(f"pay cart {i}", "function")], ["cart"], []) for i in range(6)] + [("r", "tests/cart.test.ts", "test", "en", None, None, False, [("x", "function")], [], [])],
        "repo_id string, path string, kind string, domain string, route string, controller string, is_vendor boolean, symbols array<struct<name:string,type:string>>, exports array<string>, imports array<string>",
    )
    scored = m.score_files(spark.createDataFrame([(1, "r", "fix the cart payments")], "request_id int, repo_id string, text string"), files)
    assert planned(scored).count("BroadcastHashJoin") >= 3
    assert scored.count() == 7
    tests = m.related_tests(m.top_files(scored, 2), files)
    assert "LeftSemi, BuildRight" in planned(tests)
    assert [r.test for r in tests.collect()] == ["tests/cart.test.ts"]


def test_words_of_files_meet_the_wanted_ones_unshuffled(spark):
    """Scores by field shuffle each file once, and symbols only what matched."""
    from tallywake.functions import fixed_values as fixed
    from tallywake.operators import context as x
    from tallywake.session import written

    none = []
    rows = [("r", f"src/pay{i}/cart{i}.ts", "source", "en", ["en"], None, None, "r", None, False, none, none, ["cart"], none, none, none, [(f"pay cart cart {i}", "method", 1, none)], 0) for i in range(6)]
    files = spark.createDataFrame(
        [*rows, rows[0]],
        "repo_id string, path string, kind string, domain string, domains array<string>, route string, controller string, repo_name string, package_name string, is_vendor boolean, http array<string>, "
        "imports array<string>, exports array<string>, form array<string>, navigation array<string>, local array<string>, symbols array<struct<name:string,type:string,line:int,terms:array<string>>>, data_access int",
    )
    requests = spark.createDataFrame([(1, "r", "fix the cart payments"), (2, "r", "art")], "request_id int, repo_id string, text string")
    tokens = written(x.request_tokens(requests), "tokens")
    terms = x.term_table(x.by_file(files))
    matched = x.matched_terms(terms, tokens)
    assert "BroadcastHashJoin" in planned(matched) and {r.word for r in matched.select("word").collect()} <= {"cart", "art", "payments", "payment", "fix"}
    factors = written(x._factors(x.file_words(matched), tokens, files), "factors")
    scores = x.field_scores(tokens, terms, factors, fixed.CATALOG_WEIGHTS, collections=(), caps={})
    assert planned(scores).count("hashpartitioning") == 1  # the files themselves
    # "cart" is a word of the path and of the symbol, and the export by itself; repeated rows are one file.
    weights = fixed.CATALOG_WEIGHTS
    want = {r.path: r.points for r in scores.where("request_id = 1").collect()}
    factor = factors.where("token = 'cart'").first().factor
    half_up = lambda v: int(v + 0.5)
    assert set(want.values()) == {half_up(weights["path"] * factor) + half_up(weights["symbol"] * factor) + half_up(2 * weights["export"] * factor)} and len(want) == 6
    assert scores.where("request_id = 2").count() == 6  # inside the longer word


def test_words_meet_spellings_unshuffled_however_many_there_are(spark):
    """Spellings go to all tasks by their first letters; before, the words of a corpus that held one went there while they were few."""
    from tallywake.operators import context as x
    from tallywake.session import written

    named = "repo_id string, path string, field string, value_no int, word string, alone boolean, own boolean"
    words = ["cart", "carts", "xcartx", "art", "a", "banana", "é", "", None]
    terms = spark.createDataFrame([("r", f"f{i}", "symbol", 0, w, False, True) for i, w in enumerate(words)], named)
    tokens = spark.createDataFrame(
        [(1, "r", "cart", 0, ["cart", "carts"], None), (1, "r", "an", 1, ["an"], None), (2, "r", "a", 0, ["a"], None), (2, "s", "art", 0, ["art"], None), (3, "r", "é", 0, ["é"], None)],
        "request_id int, repo_id string, token string, pos int, variants array<string>, partners array<string>",
    )
    factors = spark.createDataFrame([("r", "cart", 1.0)], "repo_id string, token string, factor double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = x.field_scores(tokens, written(terms, "terms"), factors, {"symbol": 10}, caps={})
        matched = x.matched_terms(terms, tokens)
        assert "gram" in planned(scores) and planned(scores).count("BroadcastHashJoin") == 1
        assert planned(matched).count("BroadcastHashJoin") == 1
        got = {(r.request_id, r.path): r.points for r in scores.collect()}
        want = {(q, f"f{i}"): 10 * sum(any(v in w for v in vs) for vs in asked) for q, asked in ((1, [["cart", "carts"], ["an"]]), (2, [["a"]]), (3, [["é"]])) for i, w in enumerate(words) if w}
        assert got == {k: v for k, v in want.items() if v}
        assert {r.word for r in matched.collect()} == {"cart", "carts", "a", "é"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_added_lines_are_read_where_the_diffs_lie(spark):
    """Only ranges are shuffled, and no line of a diff."""
    import re

    from tallywake.sources import history as h

    header = r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"

    def wanted(text):
        path, head, out = None, False, set()
        for line in text.split("\n"):
            if line.startswith("diff --git "):
                head, path = True, (re.findall(r" b/(.*)$", line) or [None])[0] or None
            elif m := re.match(header, line):
                head = False
                out |= {(path, n) for n in range(int(m[1]), int(m[1]) + (1 if m[2] is None else int(m[2]))) if path is not None}
            elif head and line.startswith("+++ "):
                name = re.sub(r"\t$", "", line[4:])
                name = re.sub(r'\\(["\\])', r"\1", name[1:-1]) if re.match('^".*"$', name) else name
                path = None if name == "/dev/null" else re.sub("^b/", "", name)
        return out

    diffs = [
        (1, "noise\n@@ -1 +1 @@\ndiff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n+++ b/other\n@@ -9 +9 @@\n@@ broken @@\n@@ -1 +5,0 @@"),
        (2, "diff --git a/x b/only\nrename\n@@ -1 +98,205 @@\n@@ -1 +100,3 @@\ndiff --git a/y b/y\n+++ /dev/null\n@@ -1 +7 @@\ndiff --git nothing\n@@ -1 +8 @@"),
        (3, 'diff --git a/q b/q\n+++ b/first\n+++ "b/q\\"t"\t\n@@ -1 +1,2 @@\n a line that says diff --git a/z b/z\n@@ -1 +2,2 @@\ndiff --git a/q b/q\n+++ b/none'),
        (None, "diff --git a/n b/n\n+++ b/n\n@@ -0,0 +1,3 @@"), (4, None), (5, ""), (1, "diff --git a/x b/x\n@@ -1 +6,3 @@"),
    ]
    out = h.parse_added_lines(spark.createDataFrame(diffs, "change_id int, value string"))
    assert planned(out).count("Exchange hashpartitioning") == 1
    want = {(key, *x) for key, text in diffs for x in wanted(text or "")}
    got = [(r.change_id, r.path, r.line) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and (2, "only", 302) in want and (3, 'q"t', 3) in want


def test_lines_are_written_to_as_many_files_as_they_need(spark, monkeypatch):
    from tallywake.plans import tables

    monkeypatch.setattr(tables, "LINES_A_FILE", 100)
    folder = tables.as_text_files(spark.range(1000).selectExpr("id", "cast(id as string) as value"), ["id"])
    held = spark.read.text(folder).select("value", "_metadata.file_name").collect()
    firsts = [min(int(r.value) for r in held if r.file_name == name) for name in sorted({r.file_name for r in held})]
    assert len(held) == 1000 and len(firsts) == 10 and firsts == sorted(firsts)



def test_parts_of_few_splits_are_read_by_all_cores(spark, shop):
    from tallywake.plans import corpus

    assert "RoundRobinPartitioning" in planned(corpus.dep_texts(spark, shop))
    assert "RoundRobinPartitioning" in planned(corpus.dep_requests(spark, shop))


def test_words_are_runs_cut_at_capitals(spark):
    from pyspark.sql import functions as F

    from tallywake.functions import fixed_values as fixed
    from tallywake.operators import terms as t

    texts = ["HTTPServerError parseURLs2Go aB1C", "éclairÉa K1 Kelvin İx naïveCase", "the the cart-carts_CARTS", "", None, "x\ty\n9Z"]
    replaced = F.lower(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " "))
    want = F.filter(F.split(replaced, " "), lambda w: (w != "") & ~w.isin(*fixed.IMPACT_STOP_WORDS))
    got = spark.createDataFrame([(x,) for x in texts], "text string").select(t.impact_tokens(F.col("text")).alias("got"), t.distinct_impact_tokens(F.col("text")).alias("once"), want.alias("want")).collect()
    assert got[0].got == ["httpserver", "error", "parse", "urls2", "go", "b1", "c"]
    assert [(r.got, r.once) for r in got] == [(r.want, list(dict.fromkeys(r.want))) for r in got]


def test_terms_of_files_are_counted_once_and_weighed_by_field(spark):
    from pyspark.sql import functions as F

    from tallywake.operators import impact as m

    rows = [("r", "src/pay/cart.service.ts", "service", "en", None, "PayController", False, [("pay cartTotal", "function"), (None, "function")], ["pay"], ["auth"]), (None, "a.md", "doc", None, "x", None, False, None, None, None)]
    files = spark.createDataFrame(
        [*rows, rows[0]],
        "repo_id string, path string, kind string, domain string, route string, controller string, is_vendor boolean, symbols array<struct<name:string,type:string>>, exports array<string>, imports array<string>",
    )
    got = m.file_terms(files)
    key = ["repo_id", "path", "term"]
    assert sorted(map(str, got.where("counted").select(*key).collect())) == sorted(map(str, m.file_frequency_terms(files).select(*key).collect()))
    # Twice, as the file comes twice: path, symbol, export and controller; the extension and the domain weigh nothing.
    weighed = got.where("weight is not null")
    assert weighed.where("term = 'pay'").count() == 8 and weighed.where("term in ('ts', 'en')").count() == 0
    assert not weighed.where("term = 'auth'").first().direct
    assert {r.term for r in got.where(F.contains("term", F.lit(":"))).collect()} == {"concept:auth/security", "concept:money flow"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A few documents in two repositories and the requests of both."""
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(k, f"Word{k % 5} session docs\ncheckout tests {k}", ["en", "fr", "de", "es"][k % 4], f"src{k % 2}", 30) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, f"word{k % 5} login") for k in (0, 1, 20, 21)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["j25_related_files", "j25_related_files_all", "j24_selected_tests"])
def test_texts_of_documents_are_cut_up_once(spark, corpus, monkeypatch, name):
    """One pass over the texts gives the terms, one the names of the files; every join reads those."""
    from pyspark.sql import functions as F

    from tallywake.plans import context, impact

    read, real = spark.sparkContext.accumulator(0), impact.table

    def passed(text):
        read.add(1)
        return text

    def counted(spark, sf_dir, table):
        rows = real(spark, sf_dir, table)
        return rows.withColumn("text", F.udf(passed, "string").asNondeterministic()("text")) if table == "documents" else rows

    monkeypatch.setattr(impact, "table", counted)
    assert context.QUERIES[name][0](spark, corpus).count() > 0
    assert read.value <= 2 * 60
