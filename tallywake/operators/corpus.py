"""Summaries over indexed files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions.text import lit_array
from tallywake.sources.corpus import dependency_role

# Vocabulary of dependency requests.
DEPENDENCY_WORDS = ["dependency", "dependencies", "deps", "dep", "dependabot", "renovate", "lockfile", "lockfiles"]
MANAGERS = {
    "npm": ("node", "npm"), "yarn": ("node", "yarn"), "pnpm": ("node", "pnpm"), "bun": ("node", "bun"), "pip": ("python", None),
    "pipenv": ("python", "pipenv"), "poetry": ("python", "poetry"), "cargo": ("rust", None), "bundler": ("ruby", None), "composer": ("php", None),
}
MANAGER_COMMANDS = ["up", "add", "install", "remove", "dedupe", "outdated"]
SECURITY_WORDS = ["vulnerable", "vulnerability", "vulnerabilities", "cve", "cves", "ghsa"]
ADVISORY_WORDS = ["advisory", "advisories"]
STRICT_UPGRADES = ["upgrade", "upgrades", "upgraded", "upgrading", "bump", "bumps", "bumped", "bumping", "downgrade"]
UPGRADES = [*STRICT_UPGRADES, "update", "updates", "updated", "updating", "patch", "patched", "patches", "pin", "unpin"]
OTHER_VOCABULARY = (
    "audit security severity high critical moderate low minor major latest version versions transitive override overrides resolution "
    "resolutions package packages manifest manifests lock apply fix fixes install reinstall to and the all other remaining"
).split()
SOURCE_NAME = r"(?i)\.(?:[cm]?[jt]sx?|py|go|rb|rs|java|kt|cs|php|swift|md|mdx|json|ya?ml|toml|hbs|sql|prisma)$"


def kind_counts(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Files per kind."""
    return files.groupBy(*keys, "kind").agg(F.count("*").alias("files"))


def domain_summary(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Per domain its files and its kinds, most files first."""
    per_kind = files.groupBy(*keys, "domain", "kind").agg(F.count("*").alias("n"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "kind", "n"))), lambda k: F.concat(k["kind"], F.lit(":"), k["n"].cast("string")))
    return per_kind.groupBy(*keys, "domain").agg(F.sum("n").alias("files"), F.array_join(kinds, ",").alias("kinds"))


def language_counts(files: DataFrame, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Files per extension."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy(*keys, F.when(extension == "", "(none)").otherwise(extension).alias("extension")).agg(F.count("*").alias("files"))


def repository_counters(files: DataFrame) -> DataFrame:
    """One row of counters per repository. files(repo_id, kind, symbols int, data_access int)."""
    kinds = ["route", "apiRoute", "controller", "service", "module", "schema", "component", "test", "doc", "config"]
    return files.groupBy("repo_id").agg(
        F.count("*").alias("files"), F.sum("symbols").alias("symbols"), F.sum("data_access").alias("data_access"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
    )


def data_access_report(hits: DataFrame) -> DataFrame:
    """Counts by operation, by table ('?' unknown) and by source from one pass. hits(repo_id, source, op, table)."""
    rows = hits.select("repo_id", "op", F.coalesce("table", F.lit("?")).alias("table"), "source")
    counted = rows.groupingSets([["repo_id", "op"], ["repo_id", "table"], ["repo_id", "source"]], "repo_id", "op", "table", "source").agg(
        F.count("*").alias("n"), F.grouping("op").alias("_o"), F.grouping("table").alias("_t")
    )
    by = F.when(F.col("_o") == 0, "op").when(F.col("_t") == 0, "table").otherwise("source")
    return counted.select("repo_id", by.alias("by"), F.coalesce(F.when(F.col("_o") == 0, F.col("op")), F.when(F.col("_t") == 0, F.col("table")), F.col("source")).alias("key"), F.col("n").alias("count"))


def data_access_by_file(hits: DataFrame, samples: int = 5) -> DataFrame:
    """Per file its hits, distinct operations and tables, and the first few sites."""
    order = Window.partitionBy("repo_id", "path").orderBy("line", "source", "op", "table")
    first = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= samples)
    shown = F.concat_ws(":", F.col("line").cast("string"), "op", "table")
    sampled = first.groupBy("repo_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", shown.alias("s")))), lambda x: x["s"]), " ").alias("samples"))
    counted = hits.groupBy("repo_id", "path").agg(
        F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("op")), ",").alias("operations"), F.array_join(F.array_sort(F.collect_set("table")), ",").alias("tables")
    )
    return counted.join(sampled, ["repo_id", "path"])


def integrations(files: DataFrame, order: DataFrame) -> DataFrame:
    """Domains with clients in the first front-end repository and an owner in the first back-end one.

    files(workspace, repo_id, kind, domain), order(workspace, repo_id, position).
    """
    c = lambda k: F.count_if(F.col("kind").isin(*k))
    repos = files.groupBy("workspace", "repo_id").agg(c(["apiClient", "route"]).alias("front"), c(["controller", "service"]).alias("back")).join(order, ["workspace", "repo_id"])
    first = lambda col: F.min_by("repo_id", F.when(F.col(col) > 0, F.col("position")))
    picked = repos.groupBy("workspace").agg(first("front").alias("front_repo"), first("back").alias("back_repo")).where("front_repo is not null and back_repo is not null")
    rows = files.join(picked, "workspace")
    per_domain = rows.groupBy("workspace", "domain").agg(
        F.count_if((F.col("repo_id") == F.col("front_repo")) & (F.col("kind") == "apiClient")).alias("clients"),
        F.count_if((F.col("repo_id") == F.col("back_repo")) & (F.col("kind") == "controller")).alias("controllers"),
        F.count_if((F.col("repo_id") == F.col("back_repo")) & (F.col("kind") == "service")).alias("services"),
    )
    score = F.least("clients", F.lit(1)) * 10 + F.col("controllers") * 2 + F.col("services")
    return per_domain.where("clients > 0 and (controllers > 0 or services > 0)").withColumn("score", score)


def filter_map(files: DataFrame, domain: str | None = None, kind: str | None = None, route: str | None = None) -> DataFrame:
    """Files by domain part, exact kind and a route pattern over path, route, names and methods.

    A pattern that is no regular expression is searched as plain text.
    """
    out = files
    if domain:
        out = out.where(F.exists("domains", lambda d: F.lower(d).contains(domain.lower())))
    if kind:
        out = out.where(F.col("kind") == kind)
    if route:
        import re

        none = F.array().cast("array<string>")
        texts = F.array_compact(F.concat(F.array("path", "route", "controller"), *[F.coalesce(c, none) for c in ("domains", "imports", "exports", "method_paths")]))
        try:
            re.compile(route)
            out = out.where(F.exists(texts, lambda t: t.rlike("(?i)" + route)))
        except re.error:
            out = out.where(F.exists(texts, lambda t: F.lower(t).contains(route.lower())))
    return out


def search_lines(files: DataFrame, text: str, limit: int | None = None) -> DataFrame:
    """Lines holding a text in any case: (repo_id, path, line from 1, text)."""
    lines = files.where(F.lower("text").contains(text.lower())).select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    hits = lines.where(F.lower("raw").contains(text.lower())).select("repo_id", "path", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("text"))
    return hits if limit is None else hits.orderBy("repo_id", "path", "line").limit(limit)


# ---------------------------------------------------------------- dependency requests
def _package(literal: Column) -> Column:
    return F.regexp_replace(F.lower(literal), r"(?<=.)@[^/]*$", "")


def _shaped(literal: Column) -> Column:
    scoped = literal.rlike(r"(?i)^@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*(?:@.*)?$")
    pinned = literal.rlike(r"(?i)^[a-z0-9][\w.-]*@[\w.^~*<>=-]+$")
    dotted = literal.rlike(r"^[a-z][a-z0-9]*(?:[-.][a-z0-9]+)+$") & ~literal.rlike(r"(?i)^(?:cve|ghsa)-")
    return scoped | pinned | dotted


def dependency_requests(requests: DataFrame, dep_files: DataFrame) -> DataFrame:
    """P10: requests that are about dependencies, with their packages and left-over scoring words.

    requests(request_id, repo_id, text), dep_files(repo_id, packages).
    """
    split = F.filter(
        F.transform(F.split("text", r"[\s,;()\[\]{}\"'`]+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[.:!?]+|[.:!?]+$", ""), r"^\.?/", "")), lambda w: w != ""
    )
    base = requests.select("request_id", "repo_id", "text", split.alias("literals"), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "").alias("words"))
    known = dep_files.select("repo_id", F.explode("packages").alias("package")).distinct()
    each = base.select("request_id", "repo_id", F.posexplode("literals").alias("pos", "literal")).withColumn("package", _package(F.col("literal")))
    marked = each.join(known.withColumn("known", F.lit(True)), ["repo_id", "package"], "left").withColumns({
        "known": F.coalesce("known", F.lit(False)), "is_file": dependency_role(F.col("literal")).isNotNull(), "shaped": _shaped(F.col("literal")),
        "named": F.col("literal").contains("/") | F.col("literal").rlike(SOURCE_NAME), "number": F.col("literal").rlike(r"(?i)^v?\d[\w.^~*<>=-]*$"),
    })
    skip = F.col("is_file") | F.col("number")
    is_package = ~skip & (F.col("known") | (~F.col("named") & F.col("shaped")))
    vocabulary = lit_array(sorted({*DEPENDENCY_WORDS, *MANAGERS, *MANAGER_COMMANDS, *SECURITY_WORDS, *ADVISORY_WORDS, *UPGRADES, *OTHER_VOCABULARY}))
    rest = F.array_join(F.filter(F.split("literal", "[^A-Za-z0-9_]+"), lambda w: (w != "") & ~F.array_contains(vocabulary, F.lower(w))), " ")
    kept = F.when(skip | is_package, "").when(F.col("named"), F.col("literal")).otherwise(rest)
    per = marked.groupBy("request_id", "repo_id").agg(
        F.max("is_file").alias("names_file"), F.max(F.col("known") & F.col("shaped")).alias("names_shaped"), F.max("known").alias("names_known"),
        F.array_sort(F.collect_set(F.when(is_package, F.col("package")))).alias("packages"),
        F.array_sort(F.collect_list(F.when(kept != "", F.struct("pos", kept.alias("w"))))).alias("kept"),
    )
    has = lambda words: F.arrays_overlap("words", lit_array(words))
    versioned = F.col("text").rlike(r"(?:^|[\s@])(?:v|\^|~)?\d+(?:\.\d+)*(?:[\s,;)]|$)")
    advisory = F.col("text").rlike(r"(?i)\b(?:cve-\d{4}-\d+|ghsa(?:-[a-z0-9]{4}){3})\b")
    names_package = F.col("names_shaped") | (F.col("names_known") & versioned)
    about = (
        has(DEPENDENCY_WORDS) | F.col("names_file") | (has(list(MANAGERS)) & (has(UPGRADES) | has(SECURITY_WORDS) | has(["audit"]) | has(MANAGER_COMMANDS)))
        | (has(SECURITY_WORDS) & has(STRICT_UPGRADES)) | (advisory & has(UPGRADES)) | (has(STRICT_UPGRADES) & names_package)
    )
    return base.join(per, ["request_id", "repo_id"]).where(about).select(
        "request_id", "repo_id", "packages", F.array_join(F.transform("kept", lambda k: k["w"]), " ").alias("scoring_query"),
        F.array_distinct(F.filter("words", lambda w: w.isin(*MANAGERS))).alias("managers"),
    )


def owned_dependency_files(requests: DataFrame, dep_files: DataFrame) -> DataFrame:
    """(request_id, repo_id, path, role required|supporting) from P10's requests and S14's files.

    Manifests declaring a named package anchor the change; without one, the
    shallowest folders do. A lockfile belongs when its folder holds an anchor.
    """
    eco = F.create_map(*[F.lit(x) for m, (e, _) in MANAGERS.items() for x in (m, e)])
    man = F.create_map(*[F.lit(x) for m, (_, n) in MANAGERS.items() if n for x in (m, n)])
    wanted = requests.withColumns({
        "ecosystems": F.transform("managers", lambda m: F.element_at(eco, m)), "names": F.filter(F.transform("managers", lambda m: F.try_element_at(man, m)), lambda x: x.isNotNull()),
    })
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    scope = wanted.join(dep_files.select("repo_id", "path", F.col("role").alias("file_role"), "ecosystem", "manager", F.col("packages").alias("file_packages")), "repo_id").where(
        ((F.size("ecosystems") == 0) | F.array_contains("ecosystems", F.col("ecosystem")))
        & (F.col("manager").isNull() | (F.size("names") == 0) | F.array_contains("names", F.col("manager")))
    ).withColumns({"folder": folder, "depth": F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/"))), "declares": (F.col("file_role") == "manifest") & F.arrays_overlap("packages", "file_packages")})
    facts = scope.groupBy("request_id").agg(F.max("declares").alias("any_declares"), F.min(F.when(F.col("file_role") != "config", F.col("depth"))).alias("shallowest"))
    rows = scope.join(facts, "request_id")
    anchors = rows.where(F.when(F.col("any_declares"), F.col("declares")).otherwise(F.col("depth") == F.col("shallowest"))).select("request_id", F.col("folder").alias("anchor")).distinct()
    parts = F.split("anchor", "/")
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    reach = anchors.select("request_id", F.explode(F.array_distinct(ups)).alias("folder")).distinct().withColumn("reached", F.lit(True))
    rows = rows.join(anchors.select("request_id", F.col("anchor").alias("folder"), F.lit(True).alias("anchored")), ["request_id", "folder"], "left").join(reach, ["request_id", "folder"], "left")
    role = (
        F.when((F.col("file_role") == "manifest") & F.col("anchored"), F.when((F.size("packages") == 0) | F.col("declares"), "required").otherwise("supporting"))
        .when((F.col("file_role") == "lockfile") & F.col("reached"), "required").when((F.col("file_role") == "config") & F.col("reached"), "supporting")
    )
    return rows.select("request_id", "repo_id", "path", role.alias("role")).where("role is not null")
