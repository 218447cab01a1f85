"""Import edges, degrees and bounded dependents.

files(repo_id, path, kind, is_vendor, imports array<string>, import_dirs array<string>).
All joins are equi-joins on (repo_id, key); a specifier is turned into the few
keys it may be found under, and so is a file, so neither side is compared with
every member of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywake.functions import paths as P
from tallywake.session import cut_lineage, shuffled

# Endings tried after a specifier, in order of preference.
IMPORT_SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
SPECIFIC_IMPORTERS = 5


def _file_keys(files: DataFrame) -> DataFrame:
    """(repo_id, key, path, suffix_rank): every name a specifier may use for a file."""
    path = F.col("path")
    entries = [
        F.when(path.endswith(s), F.struct(path.substr(F.lit(1), F.length(path) - len(s)).alias("key"), F.lit(i).alias("suffix_rank")))
        for i, s in enumerate(IMPORT_SUFFIXES)
    ]
    return files.select("repo_id", "path", F.explode(F.array_compact(F.array(*entries))).alias("e")).select(
        "repo_id", F.col("e.key").alias("key"), "path", F.col("e.suffix_rank").alias("suffix_rank")
    )


def _specifier_keys(spec: Column, importer: Column) -> Column:
    """Ordered array of keys for a specifier; empty for bare package names."""
    joined = P.normalize(F.concat(P.dirname(importer), F.lit("/"), spec))
    alias = P.normalize(F.regexp_extract(spec, r"^[@~#]/(.+)$", 1))
    bases = (
        F.when(spec.startswith("."), F.array(joined))
        .when(spec.rlike(r"^[@~#]/."), F.array(alias, F.concat(F.lit("src/"), alias)))
        .otherwise(F.array().cast("array<string>"))
    )

    def variants(base: Column) -> Column:
        emitted = F.array(base, F.regexp_replace(base, r"\.([cm]?)js$", ".$1ts"), F.regexp_replace(base, r"\.js$", ".tsx"))
        return F.when(base.rlike(r"\.[cm]?js$"), emitted).otherwise(F.array(base))

    return F.flatten(F.transform(bases, variants))


def import_rows(files: DataFrame) -> DataFrame:
    """(repo_id, src, specifier), one row per import."""
    return files.select("repo_id", F.col("path").alias("src"), F.explode("imports").alias("specifier")).distinct()


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The file each relative or aliased specifier names; unresolved ones are absent."""
    wanted = imports.select(
        "repo_id", "src", "specifier", F.posexplode(_specifier_keys(F.col("specifier"), F.col("src"))).alias("key_rank", "key")
    )
    found = wanted.join(shuffled(_file_keys(files)), ["repo_id", "key"])
    return found.groupBy("repo_id", "src", "specifier").agg(
        F.min_by("path", F.struct("key_rank", "suffix_rank")).alias("dst")
    )


def _stem_keys(files: DataFrame) -> DataFrame:
    """Trailing runs of two or more segments of each file's stem, kept when one file alone has them."""
    parts = F.split(F.regexp_replace(P.stem(F.col("path")), r"/index$", ""), "/")
    starts = F.when(F.size(parts) >= 2, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    keys = F.transform(starts, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = files.select("repo_id", "path", F.explode(keys).alias("key"))
    return (
        each.groupBy("repo_id", "key")
        .agg(F.count("*").alias("n"), F.min("path").alias("dst"))
        .where("n = 1")
        .drop("n")
    )


def infer_imports(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Bare specifiers with a folder that match exactly one file and no declared package.

    packages(repo_id, package).
    """
    spec = F.col("specifier")
    bare = imports.where(~spec.startswith(".") & ~spec.startswith("node:") & ~spec.rlike(r"^[@~#]/") & spec.contains("/"))
    name = F.when(spec.startswith("@"), F.substring_index(spec, "/", 2)).otherwise(F.substring_index(spec, "/", 1))
    key = F.regexp_replace(F.regexp_replace(spec, r"\.[cm]?[jt]sx?$", ""), r"/index$", "")
    open_specs = bare.withColumns({"package": name, "key": key}).join(packages.select("repo_id", "package").distinct(), ["repo_id", "package"], "left_anti")
    return open_specs.join(shuffled(_stem_keys(files)), ["repo_id", "key"]).select("repo_id", "src", "specifier", "dst")


def package_dirs(imports: DataFrame, modules: DataFrame, files: DataFrame) -> DataFrame:
    """The folder a module-qualified specifier names, by the longest module that begins it.

    modules(repo_id, module, dir). Only folders holding a non-test file of the
    language count. Returns (repo_id, src, dir).
    """
    parts = F.split("specifier", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    candidates = imports.select("repo_id", "src", "specifier", F.explode(prefixes).alias("module"))
    best = (
        candidates.join(modules, ["repo_id", "module"])
        .groupBy("repo_id", "src", "specifier")
        .agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
    )
    rest = F.expr("substring(specifier, length(m.module) + 2)")
    joined = F.concat_ws("/", F.when(~F.col("m.dir").isin("", "."), F.col("m.dir")), F.when(rest != "", rest))
    named = best.select("repo_id", "src", F.when(joined == "", ".").otherwise(joined).alias("dir"))
    homes = files.where(~P.is_test(F.col("path"))).select("repo_id", P.dirname(F.col("path")).alias("dir")).distinct()
    return named.join(homes, ["repo_id", "dir"], "left_semi").distinct()


def directory_edges(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Importer -> every non-test file of the folders it imports."""
    targets = files.where(~P.is_test(F.col("path"))).select("repo_id", F.col("path").alias("dst"), P.dirname(F.col("path")).alias("dir"))
    return dirs.join(targets, ["repo_id", "dir"]).select("repo_id", "src", "dst")


def build_edges(files: DataFrame, packages: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """(repo_id, src, dst, provenance); an extracted edge replaces an inferred one."""
    sources = files.where(~F.col("is_vendor") & (F.col("kind") != "doc"))
    imports = import_rows(sources)
    extracted = resolve_imports(imports, sources)
    open_specs = imports.join(shuffled(extracted), ["repo_id", "src", "specifier"], "left_anti")
    inferred = infer_imports(open_specs, sources, packages)
    edges = extracted.select("repo_id", "src", "dst", F.lit(0).alias("rank")).unionByName(
        inferred.select("repo_id", "src", "dst", F.lit(1).alias("rank"))
    )
    if dirs is not None:
        edges = edges.unionByName(directory_edges(dirs, sources).withColumn("rank", F.lit(0)))
    return (
        edges.where("src <> dst")
        .groupBy("repo_id", "src", "dst")
        .agg(F.min("rank").alias("rank"))
        .select("repo_id", "src", "dst", F.when(F.col("rank") == 0, "EXTRACTED").otherwise("INFERRED").alias("provenance"))
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("repo_id").agg(
        F.count("*").alias("edges"), F.count_if(F.col("provenance") == "INFERRED").alias("inferred_edges")
    )


def import_degrees(files: DataFrame) -> DataFrame:
    """Distinct importers and imports of each file; tests and vendored files do not import."""
    importers = import_rows(files.where(~F.col("is_vendor") & (F.col("kind") != "test")))
    edges = resolve_imports(importers, files).where("src <> dst").select("repo_id", "src", "dst").distinct()
    ends = edges.select("repo_id", F.explode(F.array(
        F.struct(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")),
    )).alias("e"))
    return ends.groupBy("repo_id", F.col("e.path").alias("path")).agg(
        F.sum("e.i").cast("bigint").alias("importers"), F.sum("e.o").cast("bigint").alias("imports")
    )


def specific_edges(edges: DataFrame, most: int = SPECIFIC_IMPORTERS) -> DataFrame:
    """Edges whose target has few importers."""
    narrow = edges.groupBy("repo_id", "dst").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return edges.join(narrow.drop("n"), ["repo_id", "dst"], "left_semi")


def dependents(edges: DataFrame, starts: DataFrame, max_depth: int = 3, limit: int | None = 20) -> DataFrame:
    """G1: files that import the starts within ``max_depth`` hops, at their shortest distance.

    starts(repo_id, start_set, path). One join per hop against the edges; a file
    reached before, or a start, is never reached again. At one depth a path made
    only of extracted edges wins, then the first parent in path order. ``limit``
    keeps the first rows of each start set and sets ``truncated``.
    """
    # Every hop reads the edges: write them once instead of resolving imports per hop.
    edges = cut_lineage(edges.select("repo_id", "src", "dst", "provenance"))
    reached = starts.select("repo_id", "start_set", "path", F.lit(0).alias("depth"), F.lit("EXTRACTED").alias("provenance"), F.lit(None).cast("string").alias("via"))
    frontier = reached
    layers = []
    keys = ["repo_id", "start_set", "path"]
    for depth in range(1, max_depth + 1):
        step = (
            frontier.select("repo_id", "start_set", F.col("path").alias("dst"), F.col("provenance").alias("before"))
            .join(edges, ["repo_id", "dst"])
            .select(
                "repo_id",
                "start_set",
                F.col("src").alias("path"),
                F.when((F.col("before") == "EXTRACTED") & (F.col("provenance") == "EXTRACTED"), 0).otherwise(1).alias("rank"),
                F.col("dst").alias("via"),
            )
        )
        layer = (
            step.groupBy(*keys)
            .agg(F.min(F.struct("rank", "via")).alias("best"))
            .join(reached, keys, "left_anti")
            .select(*keys, F.lit(depth).alias("depth"), F.when(F.col("best.rank") == 0, "EXTRACTED").otherwise("INFERRED").alias("provenance"), F.col("best.via").alias("via"))
        )
        # One hop is one stage of work; keeping it makes the next hop's plan short.
        layer = cut_lineage(layer)
        layers.append(layer)
        reached = reached.unionByName(layer)
        frontier = layer
    out = layers[0]
    for layer in layers[1:]:
        out = out.unionByName(layer)
    if limit is None:
        return out.withColumn("truncated", F.lit(False))
    group = Window.partitionBy("repo_id", "start_set")
    order = group.orderBy("depth", F.when(F.col("provenance") == "EXTRACTED", 0).otherwise(1), "path")
    totals = out.groupBy("repo_id", "start_set").agg((F.count("*") > limit).alias("truncated"))
    return out.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).join(totals, ["repo_id", "start_set"])


def loose_candidates(imports: DataFrame, files: DataFrame, most: int | None = None, folders: bool = True) -> DataFrame:
    """Every file a specifier may loosely mean, with its ``kind`` and ``position``, or the best ``most`` of them.

    A relative specifier means the file of its path (kind 0), of that stem (1),
    the index of that folder (2), and the files of the folder it points into
    (3), which are left out without ``folders``; a bare one the files named as its last segment (0), then those whose
    stem is its stem (1). Positions go by kind and then path.
    """
    spec, src = F.col("specifier"), F.col("src")
    joined = P.normalize(F.concat(P.dirname(src), F.lit("/"), spec))
    relative = imports.where(spec.startswith(".")).select("repo_id", "src", "specifier", joined.alias("joined"))

    def listed(places: DataFrame, *keys: str) -> DataFrame:
        """With a limit, no key needs more than its first ``most`` files: better kinds are joined on their own."""
        if most is None:
            return places
        first = Window.partitionBy(*keys).orderBy("path")
        return places.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).drop("_n")

    at = F.col("joined")
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    meant = relative.select("repo_id", "src", "specifier", F.posexplode(F.array(at, at, F.concat(at, F.lit("/index")))).alias("kind", "name"))
    by_path = files.select("repo_id", "path", F.posexplode(F.array(F.col("path"), stem, stem)).alias("kind", "name"))
    exact = meant.join(listed(by_path, "repo_id", "kind", "name"), ["repo_id", "kind", "name"]).select("repo_id", "src", "specifier", "path", "kind")

    folder = F.when(at.contains("/"), F.regexp_replace(at, r"/[^/]+$", "")).otherwise(at)
    # A file lies under every folder above it, so it is listed once per ancestor.
    parts = P.directories(F.col("path"))
    ancestors = F.when(
        F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    ).otherwise(F.array().cast("array<string>"))
    by_folder = listed(files.select("repo_id", "path", F.explode(ancestors).alias("folder")), "repo_id", "folder")
    in_folder = relative.withColumn("folder", folder).join(by_folder, ["repo_id", "folder"]).select("repo_id", "src", "specifier", "path", F.lit(3).alias("kind"))

    tail = F.substring_index(spec, "/", -1)
    def forms(name: Column) -> Column:
        return F.posexplode(F.array(name, F.regexp_replace(name, r"\.[^.]+$", ""))).alias("kind", "name")

    by_name = listed(files.select("repo_id", "path", forms(P.basename(F.col("path")))), "repo_id", "kind", "name")
    bare = imports.where(~spec.startswith(".")).select("repo_id", "src", "specifier", forms(tail))
    named = bare.join(by_name, ["repo_id", "kind", "name"]).select("repo_id", "src", "specifier", "path", "kind")
    order = Window.partitionBy("repo_id", "src", "specifier").orderBy("kind", "path")
    every = exact.unionByName(named)
    every = every.unionByName(in_folder) if folders else every
    both = every.groupBy("repo_id", "src", "specifier", "path").agg(F.min("kind").alias("kind"))
    ranked = both.withColumn("position", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("position") <= most)
