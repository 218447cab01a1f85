"""Exports of version history and diffs as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.functions.slices import with_running

LINES_PER_SLICE = 5_000
LINES_PER_BLOCK = 100


def read_history(spark: SparkSession, path: str, separator: str, repo_id: str) -> DataFrame:
    """chunks(repo_id, value) of a log written with a record separator before each commit."""
    return spark.read.option("lineSep", separator).text(path).select(F.lit(repo_id).alias("repo_id"), "value")


def parse_commits(chunks: DataFrame) -> DataFrame:
    """commits(repo_id, sha, parents, time, subject, files) from chunks(repo_id, value).

    The first line holds sha, parents, time and subject between tabs; the rest
    are numstat rows. Binary rows ('-') are dropped.
    """
    lines = F.split("value", "\n")
    head = F.split(lines[0], "\t")
    rows = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), lambda s: F.trim(s)), lambda s: s.rlike(r"^[0-9]+\t[0-9]*\t."))
    part = lambda s, i: F.regexp_extract(s, r"^([0-9]+)\t([0-9]*)\t([^\t]+)", i)
    number = lambda s: F.coalesce(s.try_cast("int"), F.lit(0))
    files = F.transform(rows, lambda s: F.struct(part(s, 3).alias("path"), number(part(s, 1)).alias("additions"), number(part(s, 2)).alias("deletions")))
    return chunks.where(head[0] != "").select(
        "repo_id",
        head[0].alias("sha"),
        F.filter(F.split(F.coalesce(F.get(head, F.lit(1)), F.lit("")), " "), lambda p: p != "").alias("parents"),
        F.coalesce(F.get(head, F.lit(2)).cast("bigint"), F.lit(0)).alias("time"),
        F.array_join(F.slice(head, 4, F.size(head)), "\t").alias("subject"),
        files.alias("files"),
    )


def commit_files(commits: DataFrame) -> DataFrame:
    return commits.select("repo_id", "sha", F.explode("files").alias("f")).select("repo_id", "sha", "f.*")


def _diff_lines(diffs: DataFrame, key: str) -> DataFrame:
    return diffs.select(key, F.posexplode(F.split("value", "\n")).alias("pos", "text")).withColumn("slice", F.floor(F.col("pos") / LINES_PER_SLICE))


def parse_hunks(diffs: DataFrame, key: str = "fix_sha") -> DataFrame:
    """Pre-image ranges (key, path, from_line, to_line) of zero-context diffs(key, value).

    The current file is the last '+++ b/' line before a hunk header. Pure
    insertions rewrote nothing.
    """
    lines = _diff_lines(diffs, key)
    named = F.when(F.col("text").startswith("+++ b/"), F.struct("pos", F.expr("substring(text, 7)").alias("path")))
    known = with_running(lines, [key], "slice", ["pos"], maxima={"_file": named})
    header = r"^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"
    count = F.regexp_extract("text", header, 2)
    ranges = known.where(F.col("text").rlike(header) & F.col("_file").isNotNull()).select(
        key,
        F.col("_file.path").alias("path"),
        F.regexp_extract("text", header, 1).cast("int").alias("from_line"),
        F.when(count == "", 1).otherwise(count.cast("int")).alias("n"),
    ).where("n > 0")
    return ranges.select(key, "path", "from_line", (F.col("from_line") + F.col("n") - 1).alias("to_line"))


def parse_added_lines(diffs: DataFrame, key: str = "change_id") -> DataFrame:
    """Post-image line numbers (key, path, line) added by each diff.

    A '+++' line names a file only between a 'diff --git' line and its first
    hunk; '/dev/null' is no file.
    """
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    # What stands before the first 'diff --git' line has no file.
    parts = diffs.select(key, F.explode(F.split("value", r"\n(?=diff --git )")).alias("part")).where(F.col("part").startswith("diff --git "))
    cut = parts.select(key, F.split("part", "\n").alias("lines")).select(
        key, F.get("lines", F.lit(0)).alias("opens"), F.filter("lines", lambda s: s.startswith("+++ ") | s.rlike(header)).alias("marks"),
    )
    hunks = F.filter("marks", lambda s: ~s.startswith("+++ "))
    first = F.coalesce(F.array_position(F.transform("marks", lambda s: s.startswith("@@")), F.lit(True)), F.lit(0))
    # The last '+++' line before the first hunk names the file, else the line that opens the part.
    named = F.get("marks", (first - 2).cast("int"))
    target = F.regexp_replace(F.expr("substring(named, 5)"), r"\t$", "")
    unquoted = F.when(target.rlike('^".*"$'), F.regexp_replace(target.substr(F.lit(2), F.length(target) - 2), r'\\(["\\])', "$1")).otherwise(target)
    path = F.when(target == "/dev/null", F.lit(None)).otherwise(F.regexp_replace(unquoted, "^b/", ""))
    from_open = F.regexp_extract("opens", r" b/(.*)$", 1)
    known = cut.where(first > 0).select(key, "opens", F.when(first > 1, named).alias("named"), hunks.alias("hunks")).select(
        key, F.when(F.col("named").isNotNull(), path).when(from_open != "", from_open).alias("path"), F.explode("hunks").alias("text")
    )
    count = F.regexp_extract("text", header, 2)
    start = F.regexp_extract("text", header, 1).cast("int")
    n = F.when(count == "", 1).otherwise(count.cast("int"))
    ranges = known.where("path is not null").select(key, "path", start.alias("start"), n.alias("n")).where("n > 0")
    # Ranges are cut at every LINES_PER_BLOCK lines and shuffled as they are: lines that several name meet in their block.
    block = F.sequence(F.floor(F.col("start") / LINES_PER_BLOCK), F.floor((F.col("start") + F.col("n") - 1) / LINES_PER_BLOCK))
    pieces = ranges.select("*", F.explode(block).alias("block")).select(
        key, "path", "block",
        F.struct(
            F.greatest(F.col("start"), F.col("block") * LINES_PER_BLOCK).cast("int").alias("first"),
            F.least(F.col("start") + F.col("n") - 1, (F.col("block") + 1) * LINES_PER_BLOCK - 1).cast("int").alias("last"),
        ).alias("r"),
    )
    held = pieces.groupBy(key, "path", "block").agg(F.collect_set("r").alias("r"))
    every = F.array_distinct(F.flatten(F.transform("r", lambda r: F.sequence(r["first"], r["last"]))))
    return held.select(key, "path", F.explode(every).alias("line"))


def parse_name_status(lines: DataFrame) -> DataFrame:
    """(…, status, score, previous_path, path) from lines(…, value); renames and copies carry a score."""
    parts = F.split("value", "\t")
    status = F.when(parts[0] == "", "X").otherwise(F.substring(parts[0], 1, 1))
    moved = status.isin("R", "C")
    score = F.expr("substring(split(value, '\t')[0], 2)")
    rows = lines.where(F.trim("value") != "").select(
        *[c for c in lines.columns if c != "value"],
        status.alias("status"),
        F.when(moved & (score != ""), score).alias("score"),
        F.when(moved, F.get(parts, F.lit(1))).alias("previous_path"),
        F.when(moved, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(1))).alias("path"),
    )
    return rows.where(F.coalesce("path", F.lit("")) != "")


def numstat_path(path: Column) -> Column:
    """The new path of 'a => b' rows, with the folder both share in front."""
    before = F.regexp_replace(F.regexp_extract(path, r"^(.*) => (.*)$", 1), r"^\{", "")
    after = F.regexp_replace(F.regexp_extract(path, r"^(.*) => (.*)$", 2), r"\}$", "")
    return F.when(path.contains(" => "), F.concat(F.regexp_extract(before, r"^(.*/)", 1), after)).otherwise(path)


def parse_numstat(lines: DataFrame) -> DataFrame:
    """(…, path, additions, deletions) from lines(…, value); a binary count is 0."""
    parts = F.split("value", "\t")
    number = lambda c: F.coalesce(F.when(c.rlike("^[0-9]+$"), c).cast("int"), F.lit(0))
    return lines.where(F.trim("value") != "").select(
        *[c for c in lines.columns if c != "value"],
        numstat_path(F.array_join(F.slice(parts, 3, F.size(parts)), "\t")).alias("path"),
        number(parts[0]).alias("additions"),
        number(F.get(parts, F.lit(1))).alias("deletions"),
    )
