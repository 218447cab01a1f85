"""Source trees, dependency files, catalogues and saved documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywake.functions import fixed_values as fixed
from tallywake.functions import paths as P
from tallywake.functions.slices import with_running

# What a source scan reads.
SOURCE_SUFFIX = r"(?i)\.(ts|tsx|js|jsx|mjs|cjs|mts|cts|go|cs|py|java|rb|rs|hbs|handlebars|json|ya?ml|snap|md|mdx|markdown|sql|prisma)$"
NO_SOURCE = ["package.json", "package-lock.json", "tsconfig.json"]
SQL_SOURCE = r"(?i)(^|/)migrations?/|(^|/)(schema|structure)\.sql$"
FLAG_SNAPSHOT = r"(?i)(^|/)(feature[-_]?flags?|flags?|config)/([^/]+/)*\.snapshot$"
IGNORED_FILE = r"(?i)(^|/)(\.DS_Store|\.eslintcache|\.env|\.env\.[^/]*)$|\.(log|tsbuildinfo|pem|key|crt|p12|gz|tar)$"
IGNORED_FOLDERS = ["node_modules", ".git", "dist", "build", "coverage", ".next", ".turbo", ".cache"]
# Dependency files, as (name pattern, role, ecosystem, manager).
DEPENDENCY_FILES = [
    (r"package\.json", "manifest", "node", None),
    (r"package-lock\.json", "lockfile", "node", "npm"),
    (r"npm-shrinkwrap\.json", "lockfile", "node", "npm"),
    (r"\.npmrc", "config", "node", "npm"),
    (r"yarn\.lock", "lockfile", "node", "yarn"),
    (r"\.yarnrc\.yml", "config", "node", "yarn"),
    (r"\.yarnrc", "config", "node", "yarn"),
    (r"pnpm-lock\.yaml", "lockfile", "node", "pnpm"),
    (r"pnpm-workspace\.yaml", "config", "node", "pnpm"),
    (r"bun\.lockb?", "lockfile", "node", "bun"),
    (r"requirements(?:[-_.][\w.-]+)?\.txt", "manifest", "python", None),
    (r"pyproject\.toml", "manifest", "python", None),
    (r"Pipfile", "manifest", "python", None),
    (r"Pipfile\.lock", "lockfile", "python", "pipenv"),
    (r"poetry\.lock", "lockfile", "python", "poetry"),
    (r"uv\.lock", "lockfile", "python", "uv"),
    (r"go\.mod", "manifest", "go", None),
    (r"go\.sum", "lockfile", "go", None),
    (r"Cargo\.toml", "manifest", "rust", None),
    (r"Cargo\.lock", "lockfile", "rust", None),
    (r"Gemfile", "manifest", "ruby", None),
    (r"Gemfile\.lock", "lockfile", "ruby", None),
    (r"composer\.json", "manifest", "php", None),
    (r"composer\.lock", "lockfile", "php", None),
]
# Data access written as SQL text or as ORM calls.
SQL_LITERAL = r"\"\"\"[\s\S]*?\"\"\"|@\"(?:[^\"]|\"\")*\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"
SQL_VERB = r"(?i)^(SELECT|INSERT\s+INTO|UPDATE|DELETE\s+FROM|CREATE\s+TABLE|ALTER\s+TABLE|DROP\s+TABLE|MERGE\s+INTO|TRUNCATE|WITH)\b"
SQL_STRUCTURE = r"(?i)\b(FROM|INTO|SET|VALUES|WHERE|JOIN|TABLE|GROUP\s+BY|ORDER\s+BY)\b"
ORM_CALL = (
    r"\b(?:prisma|db|tx|ctx\.db|this\.db)\.([a-z][a-zA-Z0-9_]*)\.(findUnique|findUniqueOrThrow|findFirst|findFirstOrThrow|findMany|create"
    r"|createMany|update|updateMany|upsert|delete|deleteMany|count|aggregate|groupBy)\b"
)
DECLARATIONS = {
    "class": r"\bclass\s+([A-Za-z_$][\w$]*)",
    "function": r"\bfunction\s+([A-Za-z_$][\w$]*)",
    "interface": r"\binterface\s+([A-Za-z_$][\w$]*)",
    "type": r"\btype\s+([A-Za-z_$][\w$]*)\s*=",
    "enum": r"\benum\s+([A-Za-z_$][\w$]*)",
    "const": r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=",
}


def read_source_files(spark: SparkSession, root: str, repo_id: str, hidden: tuple[str, ...] = ()) -> DataFrame:
    """files(repo_id, path, length, text) below a folder, of any size.

    Spark's file listing skips names that start with a dot, so dotted folders
    to be read (``.github``, ``.husky``) are named in ``hidden``.
    """
    roots = [root, *[f"{root.rstrip('/')}/{name}" for name in hidden]]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(roots)
    shown = F.regexp_replace("path", r"^[a-z0-9]+:/{0,3}", "/")
    relative = F.regexp_replace(shown, "^.*?" + root.strip("/").replace(".", r"\.") + "/", "")
    name = P.basename(F.col("rel"))
    lockfile = name.rlike(r"(lock|lock\.json|lock\.yaml|lockb|\.sum|shrinkwrap\.json)$")
    # SQL outside migrations is a dump or a seed; manifests and compiler settings own no change.
    source = F.when(F.col("rel").rlike(r"(?i)\.sql$"), F.col("rel").rlike(SQL_SOURCE)).otherwise(F.col("rel").rlike(SOURCE_SUFFIX) | F.col("rel").rlike(FLAG_SNAPSHOT))
    kept = files.withColumn("rel", relative).where(
        ((source | lockfile) & ~name.isin(*NO_SOURCE) & ~F.col("rel").rlike(IGNORED_FILE) | P.is_git_hook(F.col("rel")))
        & ~F.exists(P.directories(F.col("rel")), lambda d: d.isin(*IGNORED_FOLDERS))
    )
    return kept.select(F.lit(repo_id).alias("repo_id"), F.col("rel").alias("path"), "length", F.decode("content", "UTF-8").alias("text"))


def dependency_role(path: Column) -> Column:
    """struct(role, ecosystem, manager) of a dependency file; null for other and vendored files."""
    name = P.basename(path)
    chain = None
    for pattern, role, ecosystem, manager in DEPENDENCY_FILES:
        entry = F.struct(F.lit(role).alias("role"), F.lit(ecosystem).alias("ecosystem"), F.lit(manager).cast("string").alias("manager"))
        rule = name.rlike(f"^{pattern}$")
        chain = F.when(rule, entry) if chain is None else chain.when(rule, entry)
    return F.when(~path.rlike(r"(^|/)(node_modules|vendor|\.yarn)/"), chain)


def _json_keys(doc: Column, sections: list[str]) -> Column:
    keys = [F.coalesce(F.map_keys(F.try_variant_get(doc, f"$['{s}']", "map<string,variant>")), F.array().cast("array<string>")) for s in sections]
    return F.concat(*keys)


def package_names(path: Column, text: Column) -> Column:
    """Names a manifest declares or a lockfile resolves, lower case and sorted."""
    name = P.basename(path)
    doc = F.try_parse_json(text)
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 1)
    locked = F.transform(_json_keys(doc, ["packages", "dependencies"]), lambda k: F.regexp_extract(k, r"(?:^|node_modules/)((?:@[^/]+/)?[^/]+)$", 1))
    rules = [
        (name.isin("package.json", "composer.json"), _json_keys(doc, ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "require", "require-dev"])),
        (name.endswith(".txt"), found(r"(?m)^[ \t]*([A-Za-z0-9][\w.-]*)")),
        (name == "go.mod", found(r"(?m)^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+v\d")),
        (name == "Gemfile", found(r"(?m)^\s*gem\s+[\"']([^\"']+)[\"']")),
        (name == "yarn.lock", F.flatten(F.transform(
            F.filter(F.split(text, r"\r?\n"), lambda l: l.rlike(r"^[^\s#]") & F.rtrim(l).endswith(":")),
            lambda l: F.transform(F.split(l, r",\s*"), lambda s: F.regexp_extract(s, r"^\"?(@?[^@\s\",]+)@", 1))))),
        (name.isin("package-lock.json", "npm-shrinkwrap.json"), locked),
        (name.isin("pnpm-lock.yaml", "bun.lock"), found(r"(?m)^\s+['\"]?/?((?:@[\w.-]+/)?[\w.-]+)[@/]\d")),
        (name.isin("Cargo.lock", "poetry.lock", "uv.lock"), found(r'(?m)^name = "([^"]+)"')),
        (name == "go.sum", found(r"(?m)^(\S+)")),
        (name == "Gemfile.lock", found(r"(?m)^ {4}([\w.-]+) \(")),
        (name == "Pipfile.lock", _json_keys(doc, ["default", "develop"])),
        (name == "composer.lock", F.transform(
            F.concat(*[F.coalesce(F.try_variant_get(doc, f"$['{s}']", "array<struct<name:string>>"), F.array().cast("array<struct<name:string>>")) for s in ("packages", "packages-dev")]),
            lambda p: F.coalesce(p["name"], F.lit("")))),
    ]
    chain = F.when(*rules[0])
    for rule, value in rules[1:]:
        chain = chain.when(rule, value)
    names = F.filter(chain.otherwise(F.array().cast("array<string>")), lambda n: n != "")
    return F.array_sort(F.array_distinct(F.transform(names, F.lower)))


def dependency_files(files: DataFrame) -> DataFrame:
    """dep_files(repo_id, path, role, ecosystem, manager, packages) from files(repo_id, path, text)."""
    rows = files.withColumn("_d", dependency_role(F.col("path"))).where("_d is not null")
    packages = F.when(F.col("_d.role") != "config", package_names(F.col("path"), F.col("text"))).otherwise(F.array().cast("array<string>"))
    return rows.select("repo_id", "path", "_d.role", "_d.ecosystem", "_d.manager", packages.alias("packages"))


def upsert_catalog(catalog: DataFrame, entries: DataFrame, live: DataFrame) -> DataFrame:
    """Replace by root, drop entries whose root is gone, newest entry of a batch wins.

    entries(root, name, seq, ...) may repeat a root; live(root). The caller
    writes the result as the next catalogue.
    """
    columns = [c for c in entries.columns if c not in ("root", "seq")]
    newest = entries.groupBy("root").agg(F.max_by(F.struct(*columns), "seq").alias("e")).select("root", "e.*")
    kept = catalog.join(newest, "root", "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True).join(live, "root", "left_semi")


def saved_run(lines: DataFrame) -> DataFrame:
    """Graded rows of saved runs(run_id, value); a run without signals or answers raises.

    The check is part of the row expression, so a bad run fails the query and
    no run is collected.
    """
    schema = (
        "method STRUCT<windowDays: INT, minSample: INT>, commits ARRAY<STRUCT<sha: STRING, subject: STRING, ax: DOUBLE, candidates: INT,"
        " containment: DOUBLE, riskPaths: ARRAY<STRING>, repairedAfter: BIGINT, inputs: STRUCT<offline: STRUCT<"
        "specificity: STRUCT<score: DOUBLE>, blast_radius: STRUCT<score: DOUBLE>, novelty: STRUCT<noul: DOUBLE>>>>>"
    )
    run = lines.select("run_id", F.from_json("value", schema).alias("r"))
    whole = F.when(
        F.col("r.method").isNull() | (F.coalesce(F.size("r.commits"), F.lit(0)) <= 0), F.raise_error(F.lit("not a saved run")).cast("int")
    ).otherwise(F.col("r.method.windowDays"))
    rows = run.select("run_id", whole.alias("window_days"), F.col("r.method.minSample").alias("min_sample"), F.explode_outer("r.commits").alias("c"))
    kept = F.coalesce(F.col("c.containment").isNotNull() & F.col("c.inputs.offline").isNotNull(), F.lit(False))
    missing = F.raise_error(F.lit("the run kept no signals or answers to rescore; replay it"))
    checked = F.when(kept, F.col("c.containment")).otherwise(missing.cast("double"))
    return rows.select("run_id", "window_days", "min_sample", "c.*", checked.alias("_checked")).withColumn("containment", F.col("_checked")).drop("_checked")


def eval_corpus(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, risk labels and thresholds of corpora(corpus_id, value)."""
    schema = (
        "k INT, thresholds STRUCT<retrieval: MAP<STRING, DOUBLE>, risk: MAP<STRING, DOUBLE>>,"
        " retrieval ARRAY<STRUCT<name: STRING, query: STRING, expectedPrimary: ARRAY<STRING>, expectedAnyOf: ARRAY<STRING>, knownGap: BOOLEAN>>,"
        " risk ARRAY<STRUCT<name: STRING, mode: STRING, query: STRING, path: STRING, expectedConcepts: ARRAY<STRING>, notExpectedConcepts: ARRAY<STRING>>>"
    )
    parsed = docs.select("corpus_id", F.from_json("value", schema).alias("c"))
    cases = parsed.select("corpus_id", F.coalesce("c.k", F.lit(5)).alias("k"), F.explode("c.retrieval").alias("x")).select("corpus_id", "k", "x.*")
    risk = parsed.select("corpus_id", F.explode("c.risk").alias("x")).select("corpus_id", "x.*")
    floors = parsed.select("corpus_id", F.explode(F.map_concat(
        F.transform_keys(F.coalesce("c.thresholds.retrieval", F.create_map().cast("map<string,double>")), lambda k, _: F.concat(F.lit("retrieval."), k)),
        F.transform_keys(F.coalesce("c.thresholds.risk", F.create_map().cast("map<string,double>")), lambda k, _: F.concat(F.lit("risk."), k)),
    )).alias("metric", "floor"))
    return cases, risk, floors


# ---------------------------------------------------------------- facts from text
#: Lines of a slice, in which a state is carried along a file.
SLICE_LINES = 4096
_FACT = "array<struct<fact:string,type:string,name:string>>"


def _ending(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _facts(rule: Column, fact: str, kind: str, names: Column) -> Column:
    made = F.transform(names, lambda n: F.struct(F.lit(fact).alias("fact"), F.lit(kind).alias("type"), n.alias("name")))
    return F.when(rule, made).otherwise(F.array().cast(_FACT))


def _exported(listed: Column) -> Column:
    """The names of a part of an export list."""
    named = F.transform(F.split(listed, ","), lambda s: F.trim(F.regexp_replace(F.trim(s), fixed.EXPORT_RENAMED, "")))
    return F.filter(named, lambda n: (n != "") & ~n.startswith("//"))


def source_facts(files: DataFrame) -> DataFrame:
    """(repo_id, path, fact, type, name, line) of imports, exports, declarations and artefact names.

    Work is per line, so a fact's line number is the line's place; the first
    line of a name counts. files(repo_id, path, text). Export lists over several
    lines and front matter depend on the lines before; only files that have one go
    through ``_over_lines``.
    """
    lines = files.select("repo_id", "path", _ending("path").alias("end"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    code = ~F.col("end").isin(fixed.ARTEFACT_ENDINGS)
    whole = F.flatten(F.transform(F.regexp_extract_all("text", F.lit(fixed.EXPORT_OPENS + r"\s*([^}]+)\s*" + fixed.EXPORT_CLOSES), 1), _exported))
    parts = [_facts(code, "export", "name", whole), *[_facts(code, "symbol", kind, F.regexp_extract_all("text", F.lit(pattern), 1)) for kind, pattern in DECLARATIONS.items()]]
    for endings, fact, kind, pattern in fixed.FACT_PATTERNS:
        names = F.regexp_extract_all("text", F.lit(pattern), 1)
        if kind in fixed.FACT_ENDINGS:
            names = _cut(names, fixed.FACT_ENDINGS[kind])
        parts.append(_facts(F.col("end").isin(endings) if endings else code, fact, kind, names))
    each = lines.select("repo_id", "path", (F.col("pos") + 1).alias("line"), F.explode(F.concat(*parts)).alias("f")).select("repo_id", "path", "line", "f.*")
    every = each.unionByName(_over_lines(files)).where("name <> ''")
    # What looks like a heading inside front matter is a comment there.
    inside = _front_matter(files).withColumn("type", F.lit("heading"))
    kept = every.join(inside.select("repo_id", "path", "line", "type"), ["repo_id", "path", "line", "type"], "left_anti")
    return kept.groupBy("repo_id", "path", "fact", "type", "name").agg(F.min("line").alias("line"))


def _cut(names: Column, ending: str) -> Column:
    return F.transform(names, lambda n: F.regexp_replace(F.trim(n), ending, ""))


def _front_matter(files: DataFrame) -> DataFrame:
    """(repo_id, path, line, text) of the lines between the first line of dashes, at the very beginning, and the next."""
    marked = F.col("text").startswith(fixed.FRONT_MATTER + "\n") & _ending("path").isin(".md", ".mdx", ".markdown")
    lines = files.where(marked).select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "text")).where("pos > 0")
    ends = lines.where(F.col("text").startswith(fixed.FRONT_MATTER)).groupBy("repo_id", "path").agg(F.min("pos").alias("end"))
    return lines.join(ends, ["repo_id", "path"]).where("pos < end").select("repo_id", "path", (F.col("pos") + 1).alias("line"), "text")


def _over_lines(files: DataFrame) -> DataFrame:
    """Facts that depend on earlier lines: names of export lists over several lines, keys and values of front matter.

    A line opens a list, closes one or does neither, whatever the lines before it
    are; a line lies in a list if the last line that did either opened one. So the
    state along a file is a running maximum, carried over slices of lines.
    """
    keys = ["repo_id", "path"]
    spans = F.col("text").rlike(fixed.EXPORT_OPENS + r"[^}]*\n") & ~_ending("path").isin(fixed.ARTEFACT_ENDINGS)
    lines = files.where(spans).select(*keys, F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    after = F.regexp_extract("text", rf"(?:.*){fixed.EXPORT_OPENS}([^}}]*)$", 1)
    opens, closes = F.col("text").rlike(rf"{fixed.EXPORT_OPENS}[^}}]*$"), F.col("text").rlike(fixed.EXPORT_CLOSES)
    # A list that nothing closes is none: names count up to the last line that closes one.
    last = F.max(F.when(closes, F.col("pos")))
    lines = lines.join(lines.groupBy(*keys).agg(last.alias("_closed")), keys)
    event = F.when(opens, F.struct("pos", F.lit(True).alias("open"))).when(closes, F.struct("pos", F.lit(False).alias("open")))
    carried = with_running(lines.withColumn("_slice", F.floor(F.col("pos") / SLICE_LINES)), keys, "_slice", ["pos"], maxima={"_last": event}, include_current=False)
    before = F.when(F.coalesce(F.col("_last.open"), F.lit(False)) & (F.col("pos") <= F.col("_closed")), _exported(F.regexp_extract("text", r"^([^}]*)", 1))).otherwise(F.array().cast("array<string>"))
    behind = F.when(opens & (F.col("pos") < F.col("_closed")), _exported(after)).otherwise(F.array().cast("array<string>"))
    listed = carried.select(*keys, (F.col("pos") + 1).alias("line"), F.explode(F.concat(before, behind)).alias("name"))
    exports = listed.select(*keys, "line", F.lit("export").alias("fact"), F.lit("name").alias("type"), "name")
    value = F.trim(F.regexp_extract("text", fixed.FRONT_VALUE, 1))
    named = F.array(F.regexp_extract("text", fixed.FRONT_KEY, 1), F.when(F.length(value) <= fixed.FRONT_VALUE_LENGTH, value).otherwise(""))
    front = _front_matter(files).select(*keys, "line", F.lit("symbol").alias("fact"), F.lit("frontmatter").alias("type"), F.explode(named).alias("name"))
    return exports.unionByName(front)


def data_access(files: DataFrame) -> DataFrame:
    """P20: (repo_id, path, source, op, table, line) for SQL in string literals and ORM calls.

    files(repo_id, path, text). A literal may span lines, so it is found in the
    whole text and its line is counted from the text before it.
    """
    literals = F.regexp_extract_all("text", F.lit(f"({SQL_LITERAL})"), 1)
    verb = lambda s: F.upper(F.regexp_extract(s, SQL_VERB, 1))
    # Cutting the text at each literal gives the text before it: lines add up along the pieces.
    pieces = F.split("text", SQL_LITERAL)
    newlines = lambda s: F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    found = F.transform(literals, lambda s, i: F.struct(s.alias("s"), F.get(pieces, i).alias("before")))
    each = files.withColumn("_file", F.monotonically_increasing_id()).select("_file", "repo_id", "path", F.posexplode(found).alias("i", "l"))
    above = Window.partitionBy("_file").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    own, before = newlines(F.col("l.s")), newlines(F.col("l.before"))
    numbered = each.withColumn("line", (1 + F.sum(before + own).over(above) - own).cast("int"))
    body = F.trim(F.regexp_replace(F.regexp_replace("l.s", r'^(@"|"""|["\'`])', ""), r'("""|["\'`])$', ""))
    sql = numbered.withColumn("q", body).where(F.col("q").rlike(SQL_VERB) & F.col("q").rlike(SQL_STRUCTURE))
    op = F.regexp_extract(verb(F.col("q")), r"^(\w+)", 1)
    table = (
        F.when(op.isin("SELECT", "DELETE"), F.regexp_extract("q", r"(?i)\bFROM\s+([A-Za-z_][\w.]*)", 1))
        .when(op == "INSERT", F.regexp_extract("q", r"(?i)\bINSERT\s+INTO\s+([A-Za-z_][\w.]*)", 1))
        .when(op == "UPDATE", F.regexp_extract("q", r"(?i)\bUPDATE\s+([A-Za-z_][\w.]*)", 1))
        .when(op.isin("CREATE", "DROP", "ALTER", "TRUNCATE"), F.regexp_extract("q", r"(?i)\bTABLE\s+(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([A-Za-z_][\w.]*)", 1))
        .when(op == "MERGE", F.regexp_extract("q", r"(?i)\bINTO\s+([A-Za-z_][\w.]*)", 1))
    )
    in_sql = sql.select("repo_id", "path", F.lit("sql").alias("source"), op.alias("op"), F.when(table != "", table).alias("table"), "line")
    lines = files.select("repo_id", "path", F.posexplode(F.split("text", "\n")).alias("pos", "t")).where(F.col("t").rlike(ORM_CALL))
    calls = F.arrays_zip(F.regexp_extract_all("t", F.lit(ORM_CALL), 1).alias("table"), F.regexp_extract_all("t", F.lit(ORM_CALL), 2).alias("op"))
    in_orm = lines.select("repo_id", "path", (F.col("pos") + 1).alias("line"), F.explode(calls).alias("c")).select(
        "repo_id", "path", F.lit("prisma").alias("source"), F.col("c.op").alias("op"), F.col("c.table").alias("table"), "line"
    )
    return in_sql.unionByName(in_orm).distinct()
