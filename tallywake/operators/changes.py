"""Score changes: predicted against changed, scope, risk, convergence.

Everything is keyed by change_id. Rules that look for an anchor first reduce the
possible anchors to one row per (change, folder or stem, flag set) and then
equi-join, so a change with very many files never forms pairs of its files.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.functions.stats import round_int
from tallywake.functions.text import lit_array
from tallywake.operators import graph
from tallywake.operators import terms as T
from tallywake.session import cut_lineage, shuffled, written

KEY = ["change_id", "path"]
#: Every flag a path may raise by ``drift_flags``; the place is its bit in ``drift_mask``.
DRIFT_FLAGS = [*fixed.RISK_WEIGHTS, "secret"]


def compare_predicted(predictions: DataFrame, changes: DataFrame) -> DataFrame:
    """Every predicted or changed path with its place.

    predictions(change_id, path, role), changes(change_id, path). ``place`` is
    direct, related, advisory, missed for changed paths and unconfirmed for a
    required path left alone. Other untouched predictions are not rows.
    """
    role, changed = F.col("role"), F.col("changed")
    rank = F.when(role == "required", 0).when(role == "supporting", 1).when(role == "advisory", 2).otherwise(3)
    rows = predictions.select(*KEY, rank.alias("role"), F.lit(False).alias("changed")).unionByName(
        changes.where("path <> ''").select(*KEY, F.lit(None).cast("int").alias("role"), F.lit(True).alias("changed"))
    )
    # One shuffle of small rows. Files without a change are no one's: what was predicted and what was changed stay apart.
    both = rows.groupBy(*KEY, F.when(F.col("change_id").isNull(), changed).alias("_apart")).agg(F.min("role").alias("role"), F.max("changed").alias("changed"))
    place = (
        F.when(changed & (role == 0), "direct")
        .when(changed & (role == 1), "related")
        .when(changed & (role == 2), "advisory")
        .when(changed, "missed")
        .when(role == 0, "unconfirmed")
    )
    return both.select(*KEY, place.alias("place")).where("place is not null")


def prediction_verdicts(compared: DataFrame) -> DataFrame:
    """Counts and confirmed / missed / partial per change."""
    is_ = lambda place: F.count_if(F.col("place") == place)
    counted = compared.groupBy("change_id").agg(
        is_("direct").alias("direct"), is_("related").alias("related"), is_("advisory").alias("advisory"),
        is_("missed").alias("missed"), is_("unconfirmed").alias("unconfirmed"),
    )
    verdict = (
        F.when((F.col("direct") > 0) & (F.col("missed") == 0), "confirmed")
        .when((F.col("direct") == 0) & (F.col("related") == 0), "missed")
        .otherwise("partial")
    )
    return counted.withColumn("verdict", verdict)


def compare_declared(declared: DataFrame, changes: DataFrame) -> DataFrame:
    """The same against a declared scope(change_id, path, role owner|related); nothing is advisory."""
    as_roles = declared.select(*KEY, F.when(F.col("role") == "owner", "required").otherwise("supporting").alias("role"))
    return compare_predicted(as_roles, changes)


# ---------------------------------------------------------------- flags of drift
def drift_flags(path: Column) -> Column:
    """Risk flags that count as drift: none for docs and test data, plus secret."""
    plain = F.when(P.is_doc(path) | P.is_test_data(path), F.array().cast("array<string>")).otherwise(P.risk_flags(path))
    return F.concat(plain, F.when(P.is_secret(path), lit_array(["secret"])).otherwise(F.array().cast("array<string>")))


def drift_weight(path: Column) -> Column:
    """The worst weight among a path's drift flags; the default without any."""
    weights = F.create_map(*[F.lit(x) for pair in fixed.DRIFT_WEIGHTS.items() for x in pair])
    each = F.transform(drift_flags(path), lambda f: F.coalesce(F.try_element_at(weights, f), F.lit(fixed.DRIFT_DEFAULT)))
    return F.coalesce(F.array_max(each), F.lit(fixed.DRIFT_DEFAULT))


def drift_mask(path: Column, names: Sequence[str] = DRIFT_FLAGS) -> Column:
    """Those of ``drift_flags`` that are ``names`` as the bits of a number, which rows carry instead of an array of words."""
    bits = F.create_map(*[F.lit(x) for i, name in enumerate(DRIFT_FLAGS) if name in names for x in (name, 1 << i)])
    return F.aggregate(drift_flags(path), F.lit(0), lambda mask, f: mask.bitwiseOR(F.coalesce(F.try_element_at(bits, f), F.lit(0))))


def _covers(mask: Column, of: Column) -> Column:
    """Whether every flag of ``of`` is one of ``mask``."""
    return of.bitwiseAND(F.bitwise_not(mask)) == 0


def _severe(path: Column) -> Column:
    return drift_mask(path, fixed.SEVERE_FLAGS)


# ---------------------------------------------------------------- tests covering sources
def test_subject(path: Column) -> Column:
    name = P.basename(path)
    for pattern in (r"(?i)\.snap$", r"\.[^.]+$", r"(?i)(?:[._-](?:test|spec|e2e))+$", r"(?i)^test[_-]"):
        name = F.regexp_replace(name, pattern, "")
    return F.lower(name)


def _source_stem(path: Column) -> Column:
    return F.lower(F.regexp_replace(P.basename(path), r"\.[^.]+$", ""))


def _cover_keys_of_test(path: Column) -> Column:
    """Stems a test may cover: its subject, and what stands before each '.', '-' or '_' of it."""

    def stems(subject: Column) -> Column:
        cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(subject), F.lit(1))), lambda i: F.substring(subject, i, F.lit(1)).isin(".", "-", "_"))
        heads = F.transform(cuts, lambda i: F.struct(F.substring(subject, F.lit(1), i - 1).alias("stem"), (F.substring(subject, i, F.lit(1)) != ".").alias("suffixed")))
        whole = F.array(F.struct(subject.alias("stem"), F.lit(False).alias("suffixed")))
        return F.filter(F.concat(whole, heads), lambda k: k["stem"] != "")

    return P.let(test_subject(path), stems)


def tests_covering(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(change_id, path, anchor): each test with the first source of its change it covers.

    A generic source name (index, utils) only counts beside the test.
    """
    stem, folder = _source_stem(F.col("path")), P.dirname(F.col("path"))
    named = sources.select("change_id", "path", stem.alias("stem"), folder.alias("folder"), stem.isin(*fixed.GENERIC_STEMS).alias("generic"))
    plain = named.where("not generic").groupBy("change_id", "stem").agg(F.min("path").alias("anchor"))
    homes = F.array(F.col("folder"), *[P.normalize(F.concat(F.col("folder"), F.lit(f"/{d}"))) for d in ("__tests__", "test", "tests")])
    near = named.where("generic").select("change_id", "stem", F.explode(homes).alias("folder"), "path").groupBy("change_id", "stem", "folder").agg(F.min("path").alias("anchor"))
    return _first_covered(_cover_rows(tests), plain, near)


def _cover_rows(tests: DataFrame) -> DataFrame:
    """(change_id, path, folder, stem, suffixed, generic): the stems each test may cover."""
    return tests.select(*KEY, P.dirname(F.col("path")).alias("folder"), F.explode(_cover_keys_of_test(F.col("path"))).alias("k")).select(
        *KEY, "folder", "k.*", F.col("k.stem").isin(*fixed.GENERIC_STEMS).alias("generic")
    )


def _first_covered(keys: DataFrame, plain: DataFrame, near: DataFrame) -> DataFrame:
    """The first source per test: a telling stem anywhere in the change, a generic one only beside the test."""
    wide = keys.where("not generic").select(*KEY, "stem").join(shuffled(plain), ["change_id", "stem"]).select(*KEY, "anchor")
    close = keys.where("generic and not suffixed").join(shuffled(near), ["change_id", "stem", "folder"]).select(*KEY, "anchor")
    return wide.unionByName(close).groupBy(*KEY).agg(F.min("anchor").alias("anchor"))


def added_imports(added_lines: DataFrame, targets: DataFrame, importers: DataFrame | None = None) -> DataFrame:
    """(change_id, path, target): files among ``targets`` that a file's added lines import, of ``importers``(change_id, path) if they are given."""
    specs = F.regexp_extract_all("text", F.lit(fixed.IMPORT_SPECIFIER), 1)
    # The specifiers meet the files that are asked for, not the lines: those are longer, and most hold none.
    wanted = added_lines.select(*KEY, F.explode(specs).alias("specifier"))
    if importers is not None:
        wanted = wanted.join(shuffled(importers), KEY, "left_semi")
    wanted = wanted.select(F.col("change_id").alias("repo_id"), F.col("path").alias("src"), "specifier").distinct()
    files = targets.select(F.col("change_id").alias("repo_id"), "path").distinct()
    found = graph.resolve_imports(wanted, files)
    return found.select(F.col("repo_id").alias("change_id"), F.col("src").alias("path"), F.col("dst").alias("target")).distinct()


def _first_covering_flags(pending: DataFrame, anchors: DataFrame, keys: list[str], flags: Column) -> DataFrame:
    """The first anchor per pending row whose flags include all of the row's flags.

    anchors are first reduced to one row per key and flag set.
    """
    sets = anchors.groupBy(*keys, flags.alias("anchor_flags")).agg(F.min("anchor").alias("anchor"))
    return (
        pending.join(sets, keys)
        .where(_covers(F.col("anchor_flags"), F.col("flags")))
        .groupBy(*KEY)
        .agg(F.min("anchor").alias("anchor"))
    )


def infer_scope(compared: DataFrame, added_files: DataFrame, mapped_files: DataFrame, added_lines: DataFrame) -> DataFrame:
    """(change_id, path, rule, anchor) for missed or advisory files explained by the change; first rule wins.

    compared is J9 or J10; added_files and mapped_files(change_id, path);
    added_lines(change_id, path, line, text).
    """
    path = F.col("path")
    # Seven rules read these rows: what a path says is worked out once per distinct path and kept.
    touched = shuffled(written(compared.where(F.col("place").isin("missed", "advisory", "direct", "related")).select(*KEY, "place"), "compared"))
    facts = {"is_test": P.is_test(path), "is_doc": P.is_doc(path), "is_secret": P.is_secret(path), "is_data": P.is_test_data(path), "flags": drift_mask(path)}
    rows = shuffled(written(P.with_path_facts(touched, facts), "compared"))
    pending = rows.where("place in ('missed', 'advisory') and not is_secret").drop("place")
    direct = rows.where("place = 'direct'")
    confirmed = rows.where("place in ('direct', 'related')")

    # owner-sibling: an added, mapped file beside an owner, bringing no flag of its own
    fresh = pending.join(shuffled(added_files.select(*KEY).distinct()), KEY, "left_semi").join(shuffled(mapped_files.select(*KEY).distinct()), KEY, "left_semi")
    beside = direct.where(path.contains("/")).select("change_id", P.dirname(path).alias("folder"), path.alias("anchor"), F.col("flags").alias("owner_flags"))
    sibling = cut_lineage(_first_covering_flags(fresh.withColumn("folder", P.dirname(path)), beside, ["change_id", "folder"], F.col("owner_flags")).withColumn("rule", F.lit("owner-sibling")))

    # owner-test: a test named after a file already in scope
    sources = confirmed.where("not is_test").select(*KEY).unionByName(sibling.where(~P.is_test(path)).select(*KEY))
    tests = pending.where("is_test").join(sibling, KEY, "left_anti")
    covered = tests_covering(tests, sources).withColumn("rule", F.lit("owner-test"))

    # owner-import: added lines import a confirmed file
    settled = cut_lineage(sibling.unionByName(covered))
    rest = pending.where("not is_doc").select(*KEY).join(settled, KEY, "left_anti")
    imported = added_imports(added_lines, confirmed, rest)
    of_test = F.col("is_test") & ~P.is_test(F.col("target"))
    of_code = ~F.col("is_test") & _covers(drift_mask(F.col("target")), F.col("flags"))
    by_import = (
        pending.select(*KEY, "is_test", "flags").join(shuffled(imported), KEY).where(of_test | of_code).groupBy(*KEY, "is_test").agg(F.min("target").alias("anchor"))
        .select(*KEY, "anchor", F.when(F.col("is_test"), "owner-test").otherwise("owner-import").alias("rule"))
    )

    # owner-changelog, owner-test-data: beside any owner at all
    settled = cut_lineage(settled.unionByName(by_import))
    first_owner = direct.groupBy("change_id").agg(F.min("path").alias("anchor"))
    changelog = F.lower(P.basename(path)).isin(*fixed.CHANGELOG_NAMES)
    data = F.col("is_data") & ~F.col("is_test")
    noted = (
        pending.where(changelog | data).join(settled, KEY, "left_anti").join(first_owner, "change_id")
        .select(*KEY, "anchor", F.when(changelog, "owner-changelog").otherwise("owner-test-data").alias("rule"))
    )

    # owner-doc: added lines write the path or the telling name of a file in scope
    settled = settled.unionByName(cut_lineage(noted))
    named = confirmed.where("not is_doc").select(*KEY, "is_data").unionByName(settled.where(~P.is_doc(path)).select(*KEY, P.is_test_data(path).alias("is_data")))
    base = P.basename(path)
    telling = base.contains(".") & ~F.lower(F.regexp_replace(base, r"\.[^.]+$", "")).isin(*fixed.GENERIC_STEMS)
    marks = named.select(
        "change_id", F.explode(F.array_compact(F.array(path, F.when(telling, base)))).alias("mark"), F.struct(F.col("is_data").alias("data"), path.alias("path")).alias("target"),
    ).groupBy("change_id", "mark").agg(F.min("target").alias("target"))
    docs = pending.where("is_doc").join(settled, KEY, "left_anti").select(*KEY)
    # A mention is a whole word of a line: the path itself, or its last segment.
    spoken = F.transform(F.regexp_extract_all("text", F.lit(r"([\w./@()\[\]-]+)"), 1), lambda w: F.regexp_replace(F.regexp_replace(w, r"^(?:[@~#.(]*/)+", ""), r"[.)\]]+$", ""))
    marked = F.array_distinct(F.flatten(F.transform(spoken, lambda w: F.array(w, F.substring_index(w, "/", -1)))))
    said = added_lines.where(P.is_doc(path)).join(shuffled(docs), KEY, "left_semi").select(*KEY, F.explode(marked).alias("mark"))
    by_doc = said.join(shuffled(marks), ["change_id", "mark"]).groupBy(*KEY).agg(F.min("target").alias("t")).select(*KEY, F.col("t.path").alias("anchor"), F.lit("owner-doc").alias("rule"))
    return settled.unionByName(by_doc).select(*KEY, "rule", "anchor")


def declared_closure(
    scope: DataFrame, candidates: DataFrame, owners: DataFrame, terms: DataFrame, modules: DataFrame, edges: DataFrame, importers: DataFrame, added_lines: DataFrame
) -> DataFrame:
    """What a declared intent covers beyond its files, to a fixed point.

    scope, candidates, owners(change_id, path); terms(change_id, term);
    modules(change_id, directory); edges(change_id, src, dst) among the changed
    files; importers(change_id, path, importers). The named rules run once; the
    import and test rules join the files of the last round to the pending ones
    until no file joins, and every round is checkpointed. What a path says, which ties
    can bring a file in, and the stems a test may cover are worked out before the rounds.
    """
    path = F.col("path")
    facts = {"is_secret": P.is_secret(path), "is_test": P.is_test(path), "is_doc": P.is_doc(path), "severe": _severe(path), "stem": _source_stem(path), "folder": P.dirname(path), "tokens": T.path_scope_tokens(path)}
    # One row per file of the change: candidates, files in scope, owners, or several of these.
    parts = {"waits": candidates, "scoped": scope, "owns": owners}
    either = reduce(DataFrame.unionByName, [df.select(*KEY, *[F.lit(name == own).alias(name) for name in parts]) for own, df in parts.items()])
    files = shuffled(written(either.where("path is not null").groupBy(*KEY).agg(*[F.max(name).alias(name) for name in parts]), "closure"))
    files = shuffled(written(P.with_path_facts(files, facts), "closure"))
    pending = files.where("waits and not is_secret").select(*KEY, "is_test", "is_doc", "severe")
    # Most words of files are words of no intent: they are left out before the rest meet the intents of their change.
    terms = shuffled(written(terms.select("change_id", "term").distinct(), "terms"))
    asked = written(terms.select("term").distinct(), "asked")
    rows = files.where("waits and not is_secret").select(*KEY, F.posexplode("tokens").alias("pos", "term")).join(asked, "term", "left_semi")
    by_word = cut_lineage(rows.join(terms, ["change_id", "term"]).groupBy(*KEY).agg(F.min(F.struct("pos", "term")).alias("first")).select(*KEY, F.col("first.term").alias("anchor"), F.lit("request-word").alias("rule")))

    def above(df: DataFrame, *columns: str) -> DataFrame:
        parts = P.directories(path)
        ups = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))
        return df.select(*KEY, *columns, F.explode(ups).alias("directory"))

    left = pending.join(by_word, KEY, "left_anti")
    by_module = above(left).join(shuffled(modules), ["change_id", "directory"]).groupBy(*KEY).agg(F.min("directory").alias("anchor")).withColumn("rule", F.lit("request-module"))
    settled = by_word.unionByName(cut_lineage(by_module))
    configs = pending.where(path.rlike(fixed.CONFIG_FILE) & ~F.col("is_doc")).join(settled, KEY, "left_anti").select(*KEY)
    # Files that are no configuration are left out before the lines of the others meet them.
    said = added_lines.where(path.rlike(fixed.CONFIG_FILE)).join(configs, KEY, "left_semi").select(*KEY, "line", F.posexplode(T.scope_tokens(F.col("text"))).alias("pos", "term")).join(asked, "term", "left_semi")
    by_config = said.join(terms, ["change_id", "term"]).groupBy(*KEY).agg(F.min_by("term", F.struct("line", "pos")).alias("anchor")).withColumn("rule", F.lit("request-config"))
    settled = settled.unionByName(cut_lineage(by_config))

    homes = files.where("owns").select("change_id", F.col("folder").alias("directory"), path.alias("anchor"), F.col("severe").alias("anchor_severe")).where(
        F.size(F.split("directory", "/")) >= 2
    )
    homes = homes.groupBy("change_id", "directory", "anchor_severe").agg(F.min("anchor").alias("anchor"))
    by_owner = (
        above(pending.join(settled, KEY, "left_anti"), "severe").join(shuffled(homes), ["change_id", "directory"])
        .where(_covers(F.col("anchor_severe"), F.col("severe")))
        .groupBy(*KEY).agg(F.min("anchor").alias("anchor")).withColumn("rule", F.lit("owner-module"))
    )
    settled = cut_lineage(settled.unionByName(by_owner).select(*KEY, "rule", "anchor"))

    few = importers.groupBy("change_id", path.alias("dst")).agg(F.max(F.coalesce(F.col("importers") <= graph.SPECIFIC_IMPORTERS, F.lit(False))).alias("few"))
    specific = edges.select("change_id", "src", "dst").join(shuffled(few), ["change_id", "dst"], "left").where(F.coalesce("few", F.lit(True)))
    # Files that bring others in are neither tests nor docs; code also needs its severe flags on the anchor.
    # Both ends of an edge get what their paths say, and then the edge is read either way.
    traits = F.struct((F.col("waits") & ~F.col("is_secret") & (~F.col("is_doc") | F.col("is_test"))).alias("joins"), (~F.col("is_test") & ~F.col("is_doc")).alias("brings"), "is_test", "severe")
    ends = files.where("waits or scoped").select("change_id", path.alias("end"), traits.alias("t"))
    paired = specific.join(shuffled(ends.select("change_id", F.col("end").alias("dst"), F.col("t").alias("d"))), ["change_id", "dst"])
    paired = paired.join(shuffled(ends.select("change_id", F.col("end").alias("src"), F.col("t").alias("s"))), ["change_id", "src"])

    def link(file: str, of: str, anchor: str, by: str) -> Column:
        usable = F.col(f"{of}.joins") & F.col(f"{by}.brings") & (F.col(f"{of}.is_test") | _covers(F.col(f"{by}.severe"), F.col(f"{of}.severe")))
        return F.when(usable, F.struct(F.col(file).alias("path"), F.col(anchor).alias("anchor"), F.col(f"{of}.is_test").alias("is_test")))

    either_way = F.array_compact(F.array(link("src", "s", "dst", "d"), link("dst", "d", "src", "s")))
    links = shuffled(written(paired.select("change_id", F.explode(either_way).alias("l")).select("change_id", "l.*"), "links"))
    covers = shuffled(written(_cover_rows(pending.where("is_test")), "covers"))
    generic = F.col("stem").isin(*fixed.GENERIC_STEMS)
    homes = F.array(F.col("folder"), *[P.normalize(F.concat(F.col("folder"), F.lit(f"/{d}"))) for d in ("__tests__", "test", "tests")])
    named = files.where("(waits or scoped) and not is_test and not is_doc").select(*KEY, "scoped", "stem", "folder", generic.alias("generic"))
    frontier = named.join(settled.select(*KEY, F.lit(True).alias("joined")), KEY, "left").where("scoped or joined").select(*KEY, "stem", "folder", "generic")
    while True:
        near = links.join(frontier.select("change_id", path.alias("anchor")), ["change_id", "anchor"], "left_semi")
        tied = near.groupBy(*KEY, "is_test").agg(F.min("anchor").alias("anchor")).select(*KEY, "is_test", F.lit(0).alias("order"), "anchor")
        plain = frontier.where("not generic").groupBy("change_id", "stem").agg(F.min("path").alias("anchor"))
        close = frontier.where("generic").select("change_id", "stem", F.explode(homes).alias("folder"), "path").groupBy("change_id", "stem", "folder").agg(F.min("path").alias("anchor"))
        by_name = _first_covered(covers, plain, close).select(*KEY, F.lit(True).alias("is_test"), F.lit(1).alias("order"), "anchor")
        found = tied.unionByName(by_name).groupBy(*KEY, "is_test").agg(F.min_by("anchor", "order").alias("anchor"))
        fresh = cut_lineage(
            found.join(shuffled(settled.select(*KEY)), KEY, "left_anti").select(*KEY, F.when(F.col("is_test"), "scope-test").otherwise("scope-import").alias("rule"), "anchor")
        )
        if fresh.isEmpty():
            break
        settled = settled.unionByName(fresh)
        frontier = named.join(fresh.select(*KEY), KEY, "left_semi").select(*KEY, "stem", "folder", "generic")
    code_file = (
        named.join(settled.select(*KEY, F.lit(True).alias("joined")), KEY, "left").where("scoped or joined").groupBy("change_id").agg(F.min("path").alias("anchor"))
    )
    docs = pending.where(F.col("is_doc") | path.rlike("(?i)" + fixed.TEMPLATE_SUFFIX)).join(settled, KEY, "left_anti").join(shuffled(code_file), "change_id")
    return settled.unionByName(docs.select(*KEY, F.lit("scope-doc").alias("rule"), "anchor"))


# ---------------------------------------------------------------- scores
def convergence(compared: DataFrame, inferred: DataFrame) -> DataFrame:
    """Score, band and parts per change. compared is J9/J10, inferred is J11 (+ J12)."""
    rows = compared.join(inferred.select(*KEY, F.lit(True).alias("inferred")).distinct(), KEY, "left")
    place = F.col("place")
    lost = (place == "missed") & F.col("inferred").isNull()
    counted = rows.groupBy("change_id").agg(
        F.count_if(place == "direct").alias("direct"),
        F.count_if(place.isin("direct", "unconfirmed")).alias("predicted"),
        F.count_if(place != "unconfirmed").alias("changed"),
        F.count_if(place.isin("direct", "related") | F.col("inferred")).alias("on_task"),
        F.coalesce(F.sum(F.when(lost, drift_weight(F.col("path")))), F.lit(0)).alias("penalty"),
    )
    grounded = F.col("predicted") > 0
    coverage = F.when(grounded, 100 * F.col("direct") / F.col("predicted"))
    scope = F.when(grounded, F.when(F.col("changed") > 0, 100 * F.col("on_task") / F.col("changed")).otherwise(0.0))
    risk = F.when(grounded, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("penalty"))))
    w = fixed.CONVERGENCE_WEIGHTS
    scored = counted.withColumns({"_c": coverage, "_s": scope, "_r": risk})
    total = round_int(w["coverage"] * F.col("_c") + w["scope"] * F.col("_s") + w["risk"] * F.col("_r"))
    from tallywake.operators.grading import convergence_band

    return scored.select(
        "change_id", "direct", "predicted", "changed", "on_task",
        round_int(F.col("_c")).alias("coverage"), round_int(F.col("_s")).alias("scope"), round_int(F.col("_r")).alias("risk_alignment"),
        total.alias("convergence"), convergence_band(total).alias("band"),
    )


def enrich_changes(changes: DataFrame, files: DataFrame) -> DataFrame:
    """Kind and domain of a changed file from the map by path, else by previous path, else from the path itself.

    changes(change_id, repo_id, path, previous_path, additions, deletions).
    """
    now = files.select("repo_id", "path", F.col("kind").alias("k1"), F.col("domain").alias("d1"))
    before = files.select("repo_id", F.col("path").alias("previous_path"), F.col("kind").alias("k2"), F.col("domain").alias("d2"))
    joined = changes.join(now, ["repo_id", "path"], "left").join(before, ["repo_id", "previous_path"], "left")
    return joined.select(
        *changes.columns,
        F.coalesce("k1", "k2", P.kind(F.col("path"))).alias("kind"),
        F.coalesce("d1", "d2", P.domains(F.col("path"))["primary"]).alias("domain"),
        (F.col("k1").isNotNull() | F.col("k2").isNotNull()).alias("mapped"),
    )


def domain_summary(enriched: DataFrame) -> DataFrame:
    """Files, lines and kinds per change and domain."""
    return enriched.groupBy("change_id", "domain").agg(
        F.count("*").alias("files"), F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"),
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
    )


def change_risk(enriched: DataFrame, comments: DataFrame | None = None) -> DataFrame:
    """Level, score and flags per change. A flag is one bit of a maximum, never a collected list.

    enriched(change_id, path, kind, additions, deletions), comments(change_id, comments).
    """
    known = P.with_path_facts(enriched, {"_flags": P.risk_flags(F.col("path"), F.col("kind"))}, ("path", "kind"))
    lines = F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))
    large = F.when(lines >= fixed.LARGE_DIFF_LINES, lit_array(["large file diff"])).otherwise(F.array().cast("array<string>"))
    rows = known.select("change_id", "kind", "additions", "deletions", F.when(F.col("kind") != "test", F.concat("_flags", large)).alias("flags"))
    names = list(fixed.RISK_WEIGHTS)
    counted = rows.groupBy("change_id").agg(
        F.sum(F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("lines"),
        F.count_if(F.col("kind") == "test").alias("tests"),
        F.count_if(~F.col("kind").isin("test", "config", "dependency")).alias("behavior"),
        *[F.max(F.coalesce(F.array_contains("flags", n), F.lit(False))).alias(f"_f{i}") for i, n in enumerate(names)],
    )
    if comments is not None:
        counted = counted.join(comments, "change_id", "left")
    else:
        counted = counted.withColumn("comments", F.lit(0))
    talk = F.coalesce("comments", F.lit(0))
    large, untested = F.col("lines") >= 800, (F.col("behavior") > 0) & (F.col("tests") == 0)
    score = sum((F.when(F.col(f"_f{i}"), F.lit(fixed.RISK_WEIGHTS[n])).otherwise(0) for i, n in enumerate(names)), F.lit(0))
    score = score + F.when(large, 2).otherwise(0) + F.when(untested, 2).otherwise(0) + F.least(talk, F.lit(3))
    score = F.when(F.col("tests") > 0, F.greatest(F.lit(0), score - 1)).otherwise(score)
    found = F.array_compact(F.array(
        *[F.when(F.col(f"_f{i}"), F.lit(n)) for i, n in enumerate(names)],
        F.when(large, F.lit("large PR")), F.when(untested, F.lit("no test files changed")), F.when(talk > 0, F.lit("has PR discussion to resolve")),
    ))
    from tallywake.operators.grading import risk_level

    return counted.select("change_id", score.cast("int").alias("score"), risk_level(score).alias("level"), F.array_sort(found).alias("flags"))


def review_targets(files: DataFrame) -> DataFrame:
    """What a reviewer should open per change: routes, then symbols of the files, config and tests.

    files(change_id, path, kind, route, controller, http_methods array<struct<method, path>>,
    symbols array<struct<type, name>>). A file with a route of its own is that route; others
    are their methods.
    ``position`` counts per change and target kind, in path order; a reader may cut there.
    """
    methods = F.transform(F.coalesce("http_methods", F.array().cast("array<struct<method:string,path:string>>")), lambda m: F.concat(
        m["method"], F.lit(" "), F.regexp_replace(F.concat(F.lit("/"), F.coalesce("controller", F.lit("")), F.lit("/"), m["path"]), "/+", "/")))
    routes = F.when(F.col("route").isNotNull(), F.array("route")).otherwise(methods)
    symbols = F.coalesce("symbols", F.array().cast("array<struct<type:string,name:string>>"))
    entries = F.concat(
        F.transform(routes, lambda r: F.struct(F.lit("route").alias("target"), r.alias("value"))),
        F.transform(symbols, lambda s: F.struct(F.lit("symbol").alias("target"), F.concat_ws(" ", s["type"], s["name"]).alias("value"))),
        F.when(F.col("kind") == "config", F.array(F.struct(F.lit("config").alias("target"), F.col("path").alias("value")))).otherwise(F.array().cast("array<struct<target:string,value:string>>")),
        F.when(F.col("kind") == "test", F.array(F.struct(F.lit("test").alias("target"), F.col("path").alias("value")))).otherwise(F.array().cast("array<struct<target:string,value:string>>")),
    )
    each = files.select("change_id", "path", F.explode(entries).alias("e")).select("change_id", "path", "e.*").dropDuplicates(["change_id", "target", "value"])
    order = Window.partitionBy("change_id", "target").orderBy("value")
    return each.withColumn("position", F.row_number().over(order)).select("change_id", "target", "value", "position")


def union_comments(review_comments: DataFrame, comments: DataFrame, reviews: DataFrame) -> DataFrame:
    """One table of what reviewers wrote; a review counts only with a body."""
    named = review_comments.withColumn("source", F.lit("review comment")).unionByName(
        comments.withColumn("source", F.lit("comment")), allowMissingColumns=True
    )
    with_body = reviews.where(F.trim(F.coalesce("body", F.lit(""))) != "").withColumn("source", F.lit("review"))
    return named.unionByName(with_body, allowMissingColumns=True)


def comment_counts(comments: DataFrame) -> DataFrame:
    return comments.groupBy("change_id").agg(F.count("*").alias("comments"))


def review_confidence(verdict: Column, concepts: Column, files: Column, level: Column) -> Column:
    """70, moved by the verdict, the grounding and the risk, kept within 0..100."""
    score = F.lit(70) + F.when(verdict == "PASS", 15).when(verdict == "FAIL", -35).otherwise(0)
    score = score + F.when(concepts > 0, 5).otherwise(0) - F.when(files == 0, 10).otherwise(0)
    score = score - F.when(level == "high", 15).when(level == "medium", 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score))
