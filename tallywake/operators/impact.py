"""Impact ranking: which files a request is likely to change.

files(repo_id, path, kind, domain, route, controller, is_vendor,
symbols array<struct<name, type>>, exports array<string>, imports array<string>).
A file's terms are rows built once and shared by all requests; a request meets a
file only through a term, concept or hint both carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.functions.stats import round_half_up
from tallywake.functions.text import let, lit_array
from tallywake.operators import terms as T
from tallywake.session import cut_lineage, written

NONE = "array<string>"


def _names(symbols: str = "symbols") -> Column:
    return F.transform(F.coalesce(F.col(symbols), F.array().cast("array<struct<name:string,type:string>>")), lambda s: F.coalesce(s["name"], F.lit("")))


def _text(values: Column) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast(NONE)), " ")


def file_terms(files: DataFrame) -> DataFrame:
    """(repo_id, path, kind, term, weight, direct, counted): all terms of the files, each file read and cut up once.

    One row per field and distinct term with the field's weight, not summed per
    file: scores add up over the fields anyway. The ``counted`` rows are the terms of
    ``file_frequency_terms``, one each; those that no field but the name of the kind,
    the domain or the extension has carry no weight, nor do the markers (``concept:``
    and ``hint:``, which no term can start with).
    """
    # The extension names the language, not the change.
    plain = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    fields = {
        "path": plain, "export": _text(F.col("exports")), "import": _text(F.col("imports")), "route": F.concat_ws(" ", F.col("controller"), F.col("route")),
    }
    rest = F.concat_ws(" ", "path", "kind", "domain", "route", "controller", _text(F.col("exports")), _text(F.col("imports")))
    cut = files.select("repo_id", "path", "kind", T.distinct_impact_tokens(F.array_join(_names(), " ")).alias("_symbols"), T.distinct_impact_tokens(rest).alias("_rest"),
                       _markers().alias("_markers"), *[T.distinct_impact_tokens(text).alias(f"_{name}") for name, text in fields.items()])

    def part(terms: Column, name: str | None = None, counted: bool = False) -> Column:
        weight = F.lit(fixed.IMPACT_WEIGHTS[name] if name else None).cast("double")
        return F.struct(terms.alias("terms"), weight.alias("weight"), F.lit(name is not None and name != "import").alias("direct"), F.lit(counted).alias("counted"))

    parts = [part(F.col("_symbols"), "symbol", True), part(F.array_except("_rest", "_symbols"), None, True), part(F.col("_markers")), *[part(F.col(f"_{name}"), name) for name in fields]]
    each = cut.select("repo_id", "path", "kind", F.explode(F.array(*parts)).alias("f"))
    return each.select("repo_id", "path", "kind", F.explode("f.terms").alias("term"), "f.weight", "f.direct", "f.counted")


def file_frequency_terms(files: DataFrame) -> DataFrame:
    """Distinct (repo_id, path, term) over path, kind, domain, route, exports, imports and symbols."""
    text = F.concat_ws(" ", "path", "kind", "domain", "route", "controller", _text(F.col("exports")), _text(F.col("imports")), F.array_join(_names(), " "))
    return files.select("repo_id", "path", F.explode(T.distinct_impact_tokens(text)).alias("term"))


def file_concepts() -> Column:
    """Concepts a file implies by its path, or by a name that holds one of the concept's words."""
    names = F.concat(_names(), F.coalesce("exports", F.array().cast(NONE)), F.coalesce("imports", F.array().cast(NONE)))
    haystack = F.lower(F.array_join(names, "\n"))

    def named(text: Column) -> Column:
        # Plain substring tests stop at the first word found, and beat one large pattern by far.
        return F.array_compact(F.array(*[F.when(_any(text, words), F.lit(c)) for c, words in fixed.CONCEPT_WORDS.items()]))

    by_path = P.risk_flags(F.col("path"), F.col("kind"))
    return F.array_intersect(F.array_union(by_path, let(haystack, named)), lit_array(list(fixed.CONCEPT_WORDS)))


def _any(text: Column, words: list[str]) -> Column:
    # A word that holds another one is found only where that one is.
    least = [word for word in words if not any(other != word and other in word for other in words)]
    found = text.contains(least[0])
    for word in least[1:]:
        found = found | text.contains(word)
    return found


def _markers() -> Column:
    """Concepts and configuration hints of a file."""
    low = F.lower("path")
    hints = [
        F.when(low.rlike("|".join(h.replace(".", r"\.") for h in hints)), F.lit(f"hint:{term}")) for term, hints in fixed.CONFIG_HINTS.items()
    ]
    return F.concat(F.transform(file_concepts(), lambda c: F.concat(F.lit("concept:"), c)), F.array_compact(F.array(*hints)))


def request_profile(requests: DataFrame) -> DataFrame:
    """request_id, repo_id, concepts and the switches its words turn on."""
    tokens = T.weighted_terms(requests).groupBy("request_id").agg(F.collect_set("term").alias("terms"))
    has = lambda words: F.coalesce(F.arrays_overlap("terms", lit_array(words)), F.lit(False))
    base = requests.select("request_id", "repo_id", T.concepts(F.col("text")).alias("concepts"), T.impact_tokens(F.col("text")).alias("raw"))
    return base.join(tokens, "request_id", "left").select(
        "request_id", "repo_id", "concepts", F.coalesce("terms", F.array().cast(NONE)).alias("terms"), "raw",
        has(fixed.TEST_WORDS).alias("wants_tests"), has(fixed.DOC_WORDS).alias("wants_docs"), has(fixed.COPY_WORDS).alias("wants_copy"),
        has(fixed.GIT_HOOK_WORDS).alias("wants_git_hook"),
    )


def score_files(requests: DataFrame, files: DataFrame) -> DataFrame:
    """R1 before boosts: (request_id, repo_id, path, kind, score, direct)."""
    # What requests ask for is written before it meets the files: Spark then knows how small it is,
    # and the terms of all files are not shuffled to be thrown away.
    wanted = written(T.weighted_terms(requests).join(requests.select("request_id", "repo_id"), "request_id"), "wanted")
    profile = written(request_profile(requests), "profile")
    asked = written(profile.select(
        "request_id", "repo_id",
        F.explode(F.concat(
            F.transform("concepts", lambda c: F.concat(F.lit("concept:"), c)),
            F.transform(F.array_intersect("terms", lit_array(list(fixed.CONFIG_HINTS))), lambda t: F.concat(F.lit("hint:"), t)),
        )).alias("term"),
    ), "asked")
    sought = written(wanted.select("repo_id", "term").unionByName(asked.select("repo_id", "term")).distinct(), "sought")
    found = written(file_terms(files).join(sought, ["repo_id", "term"]), "found")
    frequency = T.document_frequency(found.where("counted").select("repo_id", "path", "term"), wanted, files).select("repo_id", "term", "factor")
    weighted = wanted.join(frequency, ["repo_id", "term"], "left").withColumn("q", F.col("weight") * F.coalesce("factor", F.lit(1.0)))
    text = (
        written(weighted.select("request_id", "repo_id", "term", "q"), "weighted")
        .join(found.where("weight is not null"), ["repo_id", "term"])
        .select("request_id", "repo_id", "path", "kind", (F.col("q") * F.col("weight")).alias("text"), F.lit(0).alias("concepts"), F.lit(0).alias("hints"), "direct")
    )
    marked = asked.join(found, ["repo_id", "term"]).select(
        "request_id", "repo_id", "path", "kind", F.lit(0.0).alias("text"), F.col("term").startswith("concept:").cast("int").alias("concepts"),
        F.col("term").startswith("hint:").cast("int").alias("hints"), F.lit(False).alias("direct"),
    )
    summed = text.unionByName(marked).groupBy("request_id", "repo_id", "path", "kind").agg(
        F.sum("text").alias("text"), F.sum("concepts").alias("implied"), F.sum("hints").alias("hints"), F.max("direct").alias("direct")
    )
    rows = summed.join(profile.drop("raw", "terms"), ["request_id", "repo_id"])
    n = F.size("concepts")
    demote = F.when(n <= 1, 0.5).otherwise(F.least(F.lit(0.8), 0.5 + 0.15 * (n - 1)))
    score = F.when(F.col("implied") > 0, F.col("text") * 1.4 + fixed.CONCEPT_BONUS * F.col("implied")).when(n > 0, F.col("text") * demote).otherwise(F.col("text"))
    score = score + fixed.CONFIG_HINT_BONUS * F.col("hints")
    kind, path = F.col("kind"), F.col("path")
    factor = F.when(kind == "test", F.when(F.col("wants_tests"), 0.9).otherwise(0.45)).otherwise(1.0)
    factor = factor * (
        F.when(path.startswith("scripts/") | path.startswith("src/scripts/"), 0.55)
        .when(path.startswith("documentation/"), 0.3)
        .when(path.startswith("docs/") & ~F.col("wants_docs"), 0.6)
        .otherwise(1.0)
    )
    factor = factor * F.when((kind == "translation") & ~F.col("wants_copy"), 0.3).otherwise(1.0)
    factor = factor * F.when(kind.isin(*fixed.OWNER_KINDS), 1.15).otherwise(1.0)
    factor = factor * F.when((kind == "gitHook") & F.col("wants_git_hook"), 1.4).otherwise(1.0)
    # Sums of doubles arrive in any order; six digits make the score the same every time.
    return rows.select("request_id", "repo_id", "path", "kind", round_half_up(score * factor, 6).alias("score"), "direct").where("score > 0")


def top_files(scored: DataFrame, top: int = 10, keys: tuple[str, ...] = ("request_id",)) -> DataFrame:
    """The best files per key, by score, then repository and path. Spark keeps only
    ``top`` rows per key before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "repo_id", "path")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def boost_imports(scored: DataFrame, edges: DataFrame, pinned: DataFrame | None = None, seeds: int = 15) -> DataFrame:
    """Neighbours of the best files gain part of their score.

    edges(repo_id, src, dst): a seed lifts what it imports. One simultaneous pass
    over the scores before any boost, so the result does not depend on seed order.
    """
    scored = cut_lineage(scored)  # read twice: once for the seeds, once for the scores
    best = top_files(scored, seeds).select("request_id", "repo_id", F.col("path").alias("src"), F.least(F.col("score") * 0.16, F.lit(8.0)).alias("gain"))
    if pinned is not None:
        full = pinned.select("request_id", "repo_id", F.col("path").alias("src"), F.lit(8.0).alias("gain"))
        best = best.unionByName(full).groupBy("request_id", "repo_id", "src").agg(F.max("gain").alias("gain"))
    gains = (
        best.join(edges.select("repo_id", "src", "dst").distinct(), ["repo_id", "src"])
        .where("src <> dst")
        .groupBy("request_id", "repo_id", F.col("dst").alias("path"))
        .agg(F.sum("gain").alias("gain"))
    )
    both = scored.select("request_id", "repo_id", "path", "score").join(gains, ["request_id", "repo_id", "path"], "full_outer")
    return both.select(
        "request_id", "repo_id", "path", round_half_up(F.coalesce("score", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0)), 6).alias("score"),
        F.col("gain").isNotNull().alias("boosted"),
    )


def lift_pinned(scored: DataFrame, pinned: DataFrame, margins: dict[str, float] | None = None) -> DataFrame:
    """A named file goes above every file the request did not name.

    pinned(request_id, repo_id, path, rule). The ceiling is one number per
    request, found by a combined maximum and joined back.
    """
    margins = fixed.PIN_MARGIN if margins is None else margins
    margin = F.create_map(*[F.lit(x) for pair in margins.items() for x in pair])[F.col("rule")]
    named = pinned.select("request_id", "repo_id", "path", "rule").dropDuplicates(["request_id", "repo_id", "path"])
    both = cut_lineage(scored.join(named, ["request_id", "repo_id", "path"], "full_outer").withColumn("score", F.coalesce("score", F.lit(0.0))))
    ceiling = both.groupBy("request_id").agg(F.coalesce(F.max(F.when(F.col("rule").isNull(), F.col("score"))), F.lit(0.0)).alias("ceiling"))
    lifted = F.when(F.col("rule").isNotNull(), F.greatest("score", "ceiling") + margin).otherwise(F.col("score"))
    return both.join(ceiling, "request_id").withColumn("score", lifted).drop("ceiling")


def collapse_locales(ranked: DataFrame, pinned: Column | None = None) -> DataFrame:
    """The best locale of a translation catalogue stands for the others.

    ranked(request_id, repo_id, path, kind, rank); the folded paths are counted
    and listed in ``siblings``.
    """
    pin = F.lit(False) if pinned is None else pinned
    catalog = F.when((F.col("kind") == "translation"), P.locale_catalog(F.col("path")))
    rows = ranked.withColumns({"_catalog": catalog, "_pin": pin})
    group = ["request_id", "repo_id", "_catalog"]
    heads = rows.where("_catalog is not null").groupBy(*group).agg(
        F.min("rank").alias("_head"),
        F.array_sort(F.collect_set(F.when(~F.col("_pin"), F.col("path")))).alias("_paths"),
    )
    joined = rows.join(heads, group, "left")
    kept = joined.where(F.col("_head").isNull() | (F.col("_head") == F.col("rank")) | F.col("_pin"))
    others = F.when(F.col("_head") == F.col("rank"), F.array_except("_paths", F.array("path"))).otherwise(F.array().cast(NONE))
    return kept.select(*ranked.columns, others.alias("siblings"))


def request_paths(text: Column) -> Column:
    """Path-shaped words of a request."""
    raw = F.regexp_extract_all(text, F.lit(r"([^\s`'\"<>,;|]+)"), 1)

    def clean(word: Column) -> Column:
        for pattern in (r"^[(\[{]+", r"[.,:;!?)\]}]+$", r"(?i)#L\d+.*$", r":\d+(?::\d+)?$", r"^\.?/"):
            word = F.regexp_replace(word, pattern, "")
        return word

    extension = rf"(?i)[\w$\])-]\.(?:{'|'.join(fixed.NAMED_EXTENSIONS)})$"
    folder = r"^[\w.@$()\[\]-]+(?:/[\w.@$()\[\]-]+)+$"
    return F.array_distinct(F.filter(F.transform(raw, clean), lambda w: (w != "") & ~w.contains("://") & (w.rlike(extension) | w.rlike(folder))))


def request_symbols(text: Column) -> Column:
    """Identifier-shaped words that are not part of a file name."""
    extension = rf"(?i)[^\s`'\"<>,;|]*[\w$\])-]\.(?:{'|'.join(fixed.NAMED_EXTENSIONS)})(?=$|[\s`'\"<>,;|.:!?)\]}}])"
    rest = F.regexp_replace(text, extension, " ")
    shaped = lambda w: w.rlike("[a-z0-9][A-Z]|[A-Z]{2}[a-z]|[A-Za-z0-9]_[A-Za-z0-9]")
    return F.array_distinct(F.filter(F.regexp_extract_all(rest, F.lit(r"([A-Za-z_$][\w$]*)"), 1), shaped))


def named_paths(requests: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """Files named by path or path ending; a name that means more than three files names none.

    Each file is listed under its trailing segments, with and without extension,
    so this is one equi-join.
    """
    literals = requests.select("request_id", "repo_id", F.explode(request_paths(F.col("text"))).alias("literal"))
    extension = rf"(?i)\.(?:{'|'.join(fixed.NAMED_EXTENSIONS)})$"
    bare = F.regexp_replace(F.lower("literal"), r"\.[^./]+$", "")
    asked = literals.select(
        "request_id", "repo_id", "literal",
        F.explode(F.array_compact(F.array(
            F.when(F.col("literal").rlike(extension), F.struct(F.lit(0).alias("form"), F.lower("literal").alias("key"))),
            F.struct(F.lit(1).alias("form"), bare.alias("key")),
        ))).alias("k"),
    ).select("request_id", "repo_id", "literal", "k.*")

    def endings(path: Column) -> Column:
        parts = F.split(path, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))

    low = F.lower("path")
    keyed = files.where(~F.col("is_vendor")).select(
        "repo_id", "path",
        F.explode(F.concat(
            F.transform(endings(low), lambda k: F.struct(F.lit(0).alias("form"), k.alias("key"))),
            F.transform(endings(F.regexp_replace(low, r"\.[^./]+$", "")), lambda k: F.struct(F.lit(1).alias("form"), k.alias("key"))),
        )).alias("k"),
    ).select("repo_id", "path", "k.*")
    hits = asked.join(keyed, ["repo_id", "form", "key"])
    group = Window.partitionBy("request_id", "repo_id", "literal")
    # The exact form decides when it matched anything at all.
    forms = hits.groupBy("request_id", "repo_id", "literal", "form").agg(F.count_distinct("path").alias("n"))
    chosen = forms.withColumn("first", F.min("form").over(group)).where("form = first").where(F.col("n") <= most)
    return hits.join(chosen.select("request_id", "repo_id", "literal", "form"), ["request_id", "repo_id", "literal", "form"]).select(
        "request_id", "repo_id", "path", "literal", F.lit("path").alias("rule")
    ).distinct()


def named_symbols(requests: DataFrame, files: DataFrame, degrees: DataFrame, most: int = 3) -> DataFrame:
    """Files defining a named symbol; pinned when exported and imported, else a definer.

    degrees(repo_id, path, importers).
    """
    asked = requests.select("request_id", "repo_id", F.explode(request_symbols(F.col("text"))).alias("literal"))
    defined = files.where(~F.col("is_vendor") & (F.col("kind") != "test")).select(
        "repo_id", "path", F.explode("symbols").alias("s"), "exports"
    ).where(~F.col("s.type").isin("config", "heading", "frontmatter", "template") & ~((F.col("s.type") == "registered") & P.is_test_data(F.col("path"))))
    owners = defined.select(
        "repo_id", "path", F.col("s.name").alias("literal"), F.array_contains("exports", F.col("s.name")).alias("exported")
    ).distinct()
    few = owners.groupBy("repo_id", "literal").agg(F.count_distinct("path").alias("n")).where(F.col("n") <= most).drop("n")
    hits = asked.join(few, ["repo_id", "literal"]).join(owners, ["repo_id", "literal"]).join(degrees.select("repo_id", "path", "importers"), ["repo_id", "path"], "left")
    used = F.coalesce("exported", F.lit(False)) & (F.coalesce("importers", F.lit(0)) > 0)
    return hits.select("request_id", "repo_id", "path", "literal", F.when(used, "symbol").otherwise("definer").alias("rule"))


def implementers(named: DataFrame, registry: DataFrame, imports: DataFrame, files: DataFrame, most: int = 3) -> DataFrame:
    """The modules a registry calls for a registered name, those sharing most words with it.

    named(request_id, repo_id, literal), registry(repo_id, path, name, calls),
    imports(repo_id, src, dst) resolved, files(repo_id, path, kind, exports).
    """
    calls = registry.where(~P.is_test_data(F.col("path"))).select(
        "repo_id", F.col("path").alias("src"), F.col("name").alias("literal"), F.explode("calls").alias("call")
    )
    targets = files.where((F.col("kind") != "test") & ~P.is_test_data(F.col("path"))).select(
        "repo_id", F.col("path").alias("dst"), F.explode("exports").alias("call")
    )
    from tallywake.functions.text import words

    shared = F.size(F.array_intersect(words(F.col("call")), words(F.col("literal"))))
    found = (
        named.select("request_id", "repo_id", "literal").distinct()
        .join(calls, ["repo_id", "literal"])
        .join(imports.select("repo_id", "src", "dst").distinct(), ["repo_id", "src"])
        .where("src <> dst")
        .join(targets, ["repo_id", "dst", "call"])
        .groupBy("request_id", "repo_id", "literal", "src", F.col("dst").alias("path"))
        .agg(F.max(shared).alias("overlap"))
    )
    order = Window.partitionBy("request_id", "repo_id", "literal")
    best = found.withColumn("best", F.max("overlap").over(Window.partitionBy("request_id", "repo_id", "literal", "src"))).where("overlap = best")
    return best.withColumn("n", F.row_number().over(order.orderBy("src", "path"))).where(F.col("n") <= most).select(
        "request_id", "repo_id", "path", "literal", F.lit("implements").alias("rule"), F.col("src").alias("via")
    )


def roles(scored: DataFrame, requests: DataFrame, edges: DataFrame, degrees: DataFrame, files: DataFrame, pinned: DataFrame | None = None) -> DataFrame:
    """Required owners, supporting fan-out, the rest advisory.

    scored(request_id, repo_id, path, kind, score, direct), edges(repo_id, src,
    dst), degrees(repo_id, path, importers, imports). When no word settles an
    owner, the import graph does: the only file named like a request word, or
    the only one exporting it, that has an edge.
    """
    scored = cut_lineage(scored)  # every rule below reads the scores
    profile = request_profile(requests)
    has = lambda words: F.arrays_overlap(F.array_union("terms", "raw"), lit_array(words))
    switches = profile.select(
        "request_id", has(fixed.BOUNDARY_WORDS).alias("boundary"), has(fixed.SKILL_WORDS).alias("skills"), has(fixed.OWNER_DOC_WORDS).alias("docs"),
        has(fixed.TEMPLATE_WORDS).alias("templates"), has(fixed.RELEASE_WORDS).alias("release"),
        (F.array_contains("terms", "feature") & (F.array_contains("terms", "flag") | F.array_contains("terms", "flags"))).alias("flags"),
        F.array_union("terms", "raw").alias("words"),
    )
    rows = scored.join(switches, "request_id")
    if pinned is not None:
        rows = rows.join(pinned.select("request_id", "repo_id", "path").distinct().withColumn("pin", F.lit(True)), ["request_id", "repo_id", "path"], "left")
    else:
        rows = rows.withColumn("pin", F.lit(None).cast("boolean"))
    kind, path = F.col("kind"), F.col("path")
    free = F.col("pin").isNull() & F.col("direct")
    gated = F.when(kind == "skill", F.col("skills")).when(kind == "doc", F.col("docs")).otherwise(True)
    conventional = free & kind.isin(*fixed.OWNER_KINDS) & (F.col("boundary") | ~kind.isin(*fixed.BOUNDARY_KINDS)) & gated
    generic = free & ~kind.isin(*fixed.NEVER_OWNER_KINDS) & ~P.is_test(path) & ~P.is_doc(path)
    rows = rows.withColumns({"conventional": conventional, "generic": generic})
    facts = rows.groupBy("request_id").agg(
        F.bool_or(F.col("conventional") & (kind != "template")).alias("has_plain"),
        F.max(F.when(F.col("generic"), F.col("score"))).alias("generic_best"),
    )
    in_pool = (F.col("conventional") & (~F.col("has_plain") | (kind != "template"))) | (F.col("generic") & (F.coalesce("generic_best", F.lit(0.0)) >= 20))
    rows = rows.join(facts, "request_id").withColumn("in_pool", in_pool)
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "path")
    pool = rows.where("in_pool").withColumn("n", F.row_number().over(order)).where("n <= 3")
    bar = F.max("score").over(Window.partitionBy("request_id"))
    by_words = pool.withColumn("bar", bar * 0.8).where("score >= bar").select("request_id", "repo_id", "path")
    by_pin = rows.where("pin").select("request_id", "repo_id", "path")
    owners = by_words.unionByName(by_pin).distinct()

    anchors = _graph_anchors(rows, switches, requests, degrees, files).join(owners.select("request_id").distinct(), "request_id", "left_anti")
    required = owners.unionByName(anchors).withColumn("role", F.lit("required"))

    predicted = (
        (F.col("templates") & kind.isin("template", "translation"))
        | (F.col("flags") & ((kind == "config") | path.rlike("(?i)feature[-_]?flags?")))
        | (F.col("templates") & (kind == "test") & F.arrays_overlap(T.impact_tokens(path), "words"))
        | (F.col("release") & (kind == "changelog"))
    )
    flow = requests.select("request_id", "repo_id").join(switches.where("templates or flags or release"), "request_id").join(
        files.select("repo_id", "path", "kind"), "repo_id"
    ).where(predicted).select("request_id", "repo_id", "path")
    ties = edges.select("repo_id", "src", "dst").unionByName(edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    fan = required.select("request_id", "repo_id", F.col("path").alias("src")).join(ties, ["repo_id", "src"]).select("request_id", "repo_id", F.col("dst").alias("path"))
    manifest = requests.select("request_id", "repo_id").join(switches.where("release").select("request_id"), "request_id").select("request_id", "repo_id", F.lit("package.json").alias("path"))
    supporting = flow.unionByName(fan).unionByName(manifest).withColumn("role", F.lit("supporting"))
    advisory = scored.select("request_id", "repo_id", "path", F.lit("advisory").alias("role"))
    rank = F.when(F.col("role") == "required", 0).when(F.col("role") == "supporting", 1).otherwise(2)
    every = required.unionByName(supporting).unionByName(advisory)
    return every.groupBy("request_id", "repo_id", "path").agg(F.min_by("role", rank).alias("role"))


def _graph_anchors(rows: DataFrame, switches: DataFrame, requests: DataFrame, degrees: DataFrame, files: DataFrame) -> DataFrame:
    usable = files.where(
        ~F.col("is_vendor") & ~F.col("kind").isin(*fixed.NEVER_OWNER_KINDS) & ~P.is_test(F.col("path")) & ~P.is_doc(F.col("path"))
    )
    name = F.lower(F.substring_index(P.basename(F.col("path")), ".", 1))
    keys = usable.select("repo_id", "path", F.explode(F.concat(
        F.array(F.struct(F.lit("name").alias("what"), name.alias("term"))),
        F.transform(F.coalesce("exports", F.array().cast(NONE)), lambda e: F.struct(F.lit("export").alias("what"), F.lower(e).alias("term"))),
    )).alias("k")).select("repo_id", "path", "k.*").distinct()
    only = keys.groupBy("repo_id", "what", "term").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    asked = requests.select("request_id", "repo_id").join(switches.select("request_id", F.explode("words").alias("term")), "request_id").where(
        (F.length("term") >= 3) & ~F.col("term").isin(*fixed.GRAPH_ANCHOR_STOP_TERMS)
    )
    linked = degrees.where("importers + imports > 0").select("repo_id", "path", "importers")
    found = (
        asked.join(only, ["repo_id", "term"]).select("request_id", "repo_id", "path").distinct()
        .join(linked, ["repo_id", "path"])
        .join(rows.where("pin is null").select("request_id", "repo_id", "path", "score"), ["request_id", "repo_id", "path"])
    )
    order = Window.partitionBy("request_id").orderBy(F.desc("importers"), F.desc("score"), "path")
    return found.withColumn("n", F.row_number().over(order)).where("n <= 3").select("request_id", "repo_id", "path")


def merge_diff(scored: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """Changed files first, mapped or not, then the ranked rest.

    changed(request_id, repo_id, path). ``section`` is changed, unmapped or ranked.
    """
    keys = ["request_id", "repo_id", "path"]
    c = changed.select(*keys).distinct().withColumn("changed", F.lit(True))
    known = files.select("repo_id", "path").withColumn("mapped", F.lit(True))
    both = scored.select(*keys, "score").join(c, keys, "full_outer").join(known, ["repo_id", "path"], "left")
    section = F.when(F.col("changed") & F.col("mapped"), "changed").when(F.col("changed"), "unmapped").otherwise("ranked")
    rows = both.select(*keys, F.coalesce("score", F.lit(0.0)).alias("score"), section.alias("section"))
    order = Window.partitionBy("request_id", "section").orderBy(F.desc("score"), "path")
    return rows.withColumn("position", F.row_number().over(order))


def related_tests(ranked: DataFrame, files: DataFrame, top: int = 8) -> DataFrame:
    """Runnable tests sharing words with the ranked files, most shared words first.

    ranked(request_id, repo_id, path) with the files' names; words of all its symbols count.
    """
    def kept(tokens: Column) -> Column:
        return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*fixed.TEST_MATCH_STOP_TERMS)))

    words_of = F.concat(T.impact_tokens(F.col("path")), T.impact_tokens(F.array_join(_names(), " ")))
    # Only the ranked files are cut into words.
    ranked = written(ranked.select("request_id", "repo_id", "path"), "ranked")
    about = files.join(ranked, ["repo_id", "path"], "left_semi").select("repo_id", "path", F.explode(kept(words_of)).alias("term"))
    asked = ranked.join(about, ["repo_id", "path"]).select("request_id", "repo_id", "term").distinct()
    tests = files.where((F.col("kind") == "test") & P.is_runnable_test(F.col("path"))).select(
        "repo_id", F.col("path").alias("test"), F.explode(kept(T.impact_tokens(F.col("path")))).alias("term")
    )
    shared = asked.join(tests, ["repo_id", "term"]).groupBy("request_id", "repo_id", "test").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("request_id", "repo_id").orderBy(F.desc("overlap"), "test")
    return shared.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)
