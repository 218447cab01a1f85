"""What a request asks for: terms, concepts, intent, phrases, scope words.

requests(request_id, repo_id, text). A request is short, so its own tokens may
be held in an array; anything per file is a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.functions.text import lit_array, singular, words



def _lower_words(text: Column) -> Column:
    """Runs of letters and digits of ASCII, cut where a capital follows a small letter or a digit, in lower case.

    Runs are taken out of the text: replacing what lies between them costs several times as much.
    """
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Z]+[a-z0-9]*|[a-z0-9]+)"), 1), F.lower)


def impact_tokens(text: Column) -> Column:
    """Words without the stop words of impact ranking, repeats kept."""
    return F.filter(_lower_words(text), lambda w: ~w.isin(*fixed.IMPACT_STOP_WORDS))


def distinct_impact_tokens(text: Column) -> Column:
    """``impact_tokens`` without repeats."""
    return F.array_except(_lower_words(text), lit_array(fixed.IMPACT_STOP_WORDS))


def joined_camel_words(text: Column) -> Column:
    """A camel-case name written as one lower-case word."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9]+)"), 1)
    return F.array_distinct(F.transform(F.filter(found, lambda w: w.rlike("[a-z0-9][A-Z]")), F.lower))


def strip_extensions(text: Column) -> Column:
    """File extensions written in a request name a language, not a change."""
    return F.regexp_replace(text, rf"(?i)(?<=[\w$\])-])\.(?:{'|'.join(fixed.NAMED_EXTENSIONS)})(?![\w$])", "")


def weighted_terms(requests: DataFrame) -> DataFrame:
    """R2: (request_id, term, weight).

    Count, +1 from six letters, +2 for a domain word. A plural longer than four
    letters also adds its singular one lighter, unless the singular is written
    later in the request. Camel-case names are added joined.
    """
    tokens = requests.select("request_id", F.posexplode(impact_tokens(F.col("text"))).alias("pos", "term"))
    own = tokens.groupBy("request_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    weight = F.col("n") + F.when(F.length("term") >= 6, 1).otherwise(0) + F.when(F.col("term").isin(*fixed.DOMAIN_KEYWORDS), 2).otherwise(0)
    own = own.select("request_id", "term", "pos", weight.alias("weight"))
    folded = own.where((F.length("term") > 4) & (singular(F.col("term")) != F.col("term"))).select(
        "request_id", singular(F.col("term")).alias("term"), "pos", F.greatest(F.lit(1), F.col("weight") - 1).alias("weight")
    )
    joined = requests.select("request_id", F.explode(joined_camel_words(F.col("text"))).alias("term"))
    every = (
        own.select("request_id", "term", F.struct(F.lit(0).alias("src"), "pos", "weight").alias("e"))
        .unionByName(folded.select("request_id", "term", F.struct(F.lit(1).alias("src"), "pos", "weight").alias("e")))
        .unionByName(
            joined.select(
                "request_id", "term",
                F.struct(F.lit(2).alias("src"), F.lit(0).alias("pos"), F.when(F.length("term") >= 6, 2).otherwise(1).cast("bigint").alias("weight")).alias("e"),
            )
        )
    )
    # At most one own row, one joined row and a row per plural spelling.
    grouped = every.groupBy("request_id", "term").agg(F.collect_list("e").alias("e"))
    own_row = F.get(F.filter("e", lambda e: e["src"] == 0), F.lit(0))
    later = F.filter("e", lambda e: (e["src"] == 1) & (own_row.isNull() | (e["pos"] > own_row["pos"])))
    best = F.array_max(F.transform(later, lambda e: e["weight"]))
    camel = F.get(F.filter("e", lambda e: e["src"] == 2), F.lit(0))["weight"]
    return grouped.select("request_id", "term", F.coalesce(F.greatest(own_row["weight"], best), camel).cast("bigint").alias("weight"))


def concepts(text: Column) -> Column:
    """Concepts a request implies."""
    return P.concepts_of_tokens(P.concept_tokens(text))


# ---------------------------------------------------------------- document frequency
def damping(df: Column, total: Column, smallest: int = 0) -> Column:
    """A term on a large share of files says little about any of them; nothing is damped below ``smallest`` files."""
    ratio = df / total
    return (
        F.when((total < smallest) | (F.coalesce(df, F.lit(0)) == 0), 1.0)
        .when(ratio <= 0.02, 1.4)
        .when(ratio <= 0.06, 1.0)
        .when(ratio <= 0.15, 0.55)
        .otherwise(0.2)
    )


def document_frequency(file_terms: DataFrame, wanted: DataFrame, files: DataFrame, keys: Sequence[str] = ("repo_id",), smallest: int = 0) -> DataFrame:
    """(keys..., term, df, total, factor) for the wanted terms only.

    file_terms(keys..., repo_id, path, term) are distinct per file; the wanted terms
    cut them down before anything is counted.
    """
    keys = list(keys)
    terms = wanted.select(*keys, "term").distinct()
    counted = file_terms.join(terms, [*keys, "term"], "left_semi").groupBy(*keys, "term").agg(F.count("*").alias("df"))
    if keys:
        totals = files.groupBy(*keys).agg(F.count("*").alias("total"))
        sized = counted.join(totals, keys)
    else:
        sized = counted.withColumn("total", files.agg(F.count("*")).scalar())
    return sized.withColumn("factor", damping(F.col("df"), F.col("total"), smallest))


# ---------------------------------------------------------------- intent
def context_tokens(text: Column) -> Column:
    """Words over one letter without the stop words of context ranking."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(*fixed.CONTEXT_STOP_WORDS))


def context_singular(token: Column) -> Column:
    n = F.length(token)
    return (
        F.when(token.endswith("ies") & (n > 4), F.concat(token.substr(F.lit(1), n - 3), F.lit("y")))
        .when(token.endswith("s") & ~token.endswith("ss") & (n > 3), token.substr(F.lit(1), n - 1))
        .otherwise(token)
    )


def unique_concept_tokens(tokens: Column) -> Column:
    """One token per word; a plural is kept over its singular, first place kept."""
    def step(kept: Column, token: Column) -> Column:
        same = F.filter(kept, lambda k: context_singular(k) == context_singular(token))
        replace = (F.size(same) > 0) & (F.get(same, F.lit(0)) == context_singular(token)) & (token != context_singular(token))
        return (
            F.when(F.size(same) == 0, F.concat(kept, F.array(token)))
            .when(replace, F.transform(kept, lambda k: F.when(k == context_singular(token), token).otherwise(k)))
            .otherwise(kept)
        )

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def action_word(token: Column) -> Column:
    """The action a token inflects: reviewing -> review, fixed -> fix, debugging -> debug; null otherwise."""
    stem = F.regexp_replace(token, r"(?:ing|ed|es|s)$", "")
    undoubled = F.regexp_replace(stem, r"(.)\1$", "$1")
    is_action = lambda c: c.isin(*fixed.ACTION_WORDS)
    with_e = F.concat(stem, F.lit("e"))
    return (
        F.when(is_action(token), token)
        .when(stem == token, F.lit(None).cast("string"))
        .when(is_action(stem), stem)
        .when(is_action(with_e), with_e)
        .when(is_action(undoubled), undoubled)
    )


def intent(text: Column, tokens: Column) -> Column:
    """struct(action, topics)."""
    symptom = F.exists(tokens, lambda t: t.isin(*fixed.SYMPTOM_WORDS))
    named = F.get(F.filter(F.transform(tokens, action_word), lambda a: a.isNotNull()), F.lit(0))
    action = (
        F.when(F.trim(text).rlike(fixed.QUESTION_SHAPE), F.when(symptom, "debug").otherwise("explain"))
        .when(named.isNotNull(), named)
        .when(symptom, "debug")
        .otherwise("unknown")
    )
    topics = F.slice(F.filter(tokens, lambda t: action_word(t).isNull()), 1, 8)
    return F.struct(action.alias("action"), topics.alias("topics"))


def token_variants(token: Column) -> Column:
    """The token, its singular and its listed spellings."""
    listed = F.lit(None).cast("array<string>")
    for word, others in fixed.WORD_VARIANTS.items():
        listed = F.when(token == word, lit_array(others)).otherwise(listed)
    return F.array_distinct(F.concat(F.array(token, context_singular(token)), F.coalesce(listed, F.array().cast("array<string>"))))


def compound_partners(requests: DataFrame) -> DataFrame:
    """(request_id, token, partners): words of a camel-case name that only count together."""
    raw = requests.select("request_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9]+)"), 1)).alias("w"))
    parts = raw.select("request_id", F.array_distinct(context_tokens(F.col("w"))).alias("parts"), F.size(context_tokens(F.col("w"))).alias("n"))
    alone = parts.where("n < 2").select("request_id", F.explode("parts").alias("token")).distinct()
    each = parts.where("n >= 2").select("request_id", "parts", F.explode("parts").alias("token"))
    return (
        each.groupBy("request_id", "token")
        .agg(F.array_distinct(F.flatten(F.collect_list("parts"))).alias("parts"))
        .select("request_id", "token", F.array_except("parts", F.array("token")).alias("partners"))
        .join(alone, ["request_id", "token"], "left_anti")
    )


# ---------------------------------------------------------------- phrases
def phrases(requests: DataFrame) -> DataFrame:
    """(request_id, phrase, content_only, weight).

    A span of three or four content words, or two tied by a preposition. Words
    are numbered and each start looks at the few words after it.
    """
    stop, link = lit_array(fixed.CONTEXT_STOP_WORDS), lit_array(fixed.PHRASE_CONNECTORS)
    all_words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    starts = requests.select("request_id", all_words.alias("w")).select("request_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1)))).alias("i"))
    first = F.try_element_at("w", F.col("i"))
    starts = starts.where((F.length(first) > 1) & ~F.array_contains(stop, first))
    tail = F.slice("w", F.col("i") + 1, 7)
    state = F.struct(
        F.array(first).alias("words"), F.lit(1).alias("content"), F.lit(None).cast("string").alias("pending"), F.lit(False).alias("over"),
        F.array().cast("array<struct<phrase:string,content_only:string,weight:int>>").alias("found"),
    )

    def step(acc: Column, word: Column) -> Column:
        is_stop = F.array_contains(stop, word)
        ends = acc["over"] | (acc["content"] >= 4) | (F.length(word) <= 1) | (is_stop & (acc["pending"].isNotNull() | ~F.array_contains(link, word)))
        hold = F.struct(acc["words"].alias("words"), acc["content"].alias("content"), word.alias("pending"), F.lit(False).alias("over"), acc["found"].alias("found"))
        grown = F.concat(acc["words"], F.array_compact(F.array(acc["pending"])), F.array(word))
        content = acc["content"] + 1
        counts = (content >= 3) | ((content == 2) & (F.size(grown) == 3))
        entry = F.struct(
            F.array_join(grown, " ").alias("phrase"),
            F.array_join(F.filter(grown, lambda x: ~F.array_contains(link, x)), " ").alias("content_only"),
            F.least(40 + (content - 2) * 25, F.lit(110)).cast("int").alias("weight"),
        )
        added = F.struct(
            grown.alias("words"), content.alias("content"), F.lit(None).cast("string").alias("pending"), F.lit(False).alias("over"),
            F.when(counts, F.concat(acc["found"], F.array(entry))).otherwise(acc["found"]).alias("found"),
        )
        stopped = F.struct(acc["words"].alias("words"), acc["content"].alias("content"), acc["pending"].alias("pending"), F.lit(True).alias("over"), acc["found"].alias("found"))
        return F.when(ends, stopped).when(is_stop, hold).otherwise(added)

    found = starts.select("request_id", F.explode(F.aggregate(tail, state, step)["found"]).alias("p")).select("request_id", "p.*")
    return found.groupBy("request_id", "phrase").agg(F.max("content_only").alias("content_only"), F.max("weight").alias("weight"))


# ---------------------------------------------------------------- scope words
def scope_tokens(text: Column) -> Column:
    """Tokens and their singulars, without bare numbers and single letters."""
    kept = F.filter(impact_tokens(text), lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))
    both = F.transform(kept, lambda t: F.array(F.when(F.length(t) > 4, singular(t)).otherwise(t), singular(t)))
    return F.array_distinct(F.flatten(both))


def path_scope_tokens(path: Column) -> Column:
    return scope_tokens(F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", ""))


def without_tracked_paths(requests: DataFrame, files: DataFrame) -> DataFrame:
    """The requests without the words that are paths of their repository: those name files."""
    each = requests.select("request_id", "repo_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("word", "^[`'\"(<]+", ""), "[`'\")>,.:;]+$", ""), r"^\./", "")
    kept = each.withColumn("path", bare).join(files.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"])
    return kept.groupBy("request_id", "repo_id").agg(F.array_join(ordered, " ").alias("text"))


def request_scope_terms(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, repo_id, term): request words few paths of the repository carry.

    A word on no path is kept too, unless it is only a file extension.
    """
    tree = sorted({t for name in fixed.TREE_NAMES if name.isalpha() for t in (name, name.rstrip("s"))} | {"tests"})
    prose = without_tracked_paths(requests, files)
    asked = prose.select("request_id", "repo_id", F.explode(scope_tokens(F.col("text"))).alias("term")).where(~F.col("term").isin(*tree))
    wanted = asked.select("repo_id", "term").distinct()
    on_path = files.select("repo_id", "path", F.explode(path_scope_tokens(F.col("path"))).alias("term"))
    carried = on_path.join(wanted, ["repo_id", "term"], "left_semi").groupBy("repo_id", "term").agg(F.count("*").alias("paths"))
    ends = files.select("repo_id", F.explode(scope_tokens(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))).alias("term")).distinct()
    sizes = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    scoped = (
        asked.join(carried, ["repo_id", "term"], "left")
        .join(ends.withColumn("is_end", F.lit(True)), ["repo_id", "term"], "left")
        .join(sizes, "repo_id")
    )
    held = F.coalesce("paths", F.lit(0))
    most = F.greatest(F.lit(20), F.ceil(F.col("files") * 0.03))
    return scoped.where((held <= most) & ~((held == 0) & F.coalesce("is_end", F.lit(False)))).select("request_id", "repo_id", "term")


def request_modules(requests: DataFrame, files: DataFrame) -> DataFrame:
    """(request_id, repo_id, directory, n): folders named for a request word.

    At most a fifth of the files, outermost only; ``n`` is how many the request
    names in the repository, for a reader to whom many are as good as none.
    """
    parts = F.split("path", "/")
    depths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    each = files.select("repo_id", F.explode(F.transform(depths, lambda d: F.array_join(F.slice(parts, 1, d), "/"))).alias("directory"))
    sizes = files.groupBy("repo_id").agg(F.count("*").alias("files"))
    name = F.lower(P.basename(F.col("directory")))
    folders = (
        each.groupBy("repo_id", "directory").agg(F.count("*").alias("held")).join(sizes, "repo_id")
        .where((F.col("held") <= F.col("files") * 0.2) & ~name.isin(*fixed.TREE_NAMES) & ~name.startswith("."))
    )
    compact = F.regexp_replace(name, "[^a-z0-9]+", "")
    asked = without_tracked_paths(requests, files).select("request_id", "repo_id", F.explode(scope_tokens(F.col("text"))).alias("term"))

    def hit(tokens: Column) -> DataFrame:
        named = folders.select("repo_id", "directory", F.explode(tokens).alias("term"))
        return asked.join(named, ["repo_id", "term"]).select("request_id", "repo_id", "directory").distinct()

    # Both the parts of the name and the name as one word must be asked for.
    found = hit(scope_tokens(name)).intersect(hit(scope_tokens(compact)))
    # A folder inside a named folder: one of its ancestors is in the list.
    above = F.split("directory", "/")
    ups = F.when(F.size(above) > 1, F.transform(F.sequence(F.lit(1), F.size(above) - 1), lambda d: F.array_join(F.slice(above, 1, d), "/"))).otherwise(F.array().cast("array<string>"))
    nested = (
        found.select("request_id", "repo_id", "directory", F.explode(ups).alias("up"))
        .join(found.withColumnRenamed("directory", "up"), ["request_id", "repo_id", "up"], "left_semi")
        .select("request_id", "repo_id", "directory").distinct()
    )
    outer = found.join(nested, ["request_id", "repo_id", "directory"], "left_anti")
    total = F.count("*").over(Window.partitionBy("request_id", "repo_id"))
    return outer.withColumn("n", total)
