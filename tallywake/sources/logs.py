"""JSON-lines logs: usage events, trial decisions, saved artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA_VERSION = 1

SIGNALS = (
    "tokenEstimate: BIGINT, verdict: STRING, confidence: DOUBLE, ax: DOUBLE, convergence: DOUBLE, band: STRING,"
    " receiptId: STRING, validationVerdict: STRING, savedTokens: BIGINT, savedPct: DOUBLE, evalPassed: BOOLEAN,"
    " checks: MAP<STRING, STRING>, gateMode: STRING, repoId: STRING, changeId: STRING, requestId: STRING, resultBytes: BIGINT"
)
EVENT_SCHEMA = (
    "v INT, ts BIGINT, surface STRING, cmd STRING, requested STRING,"
    " argsShape STRUCT<positionals: INT, flags: ARRAY<STRING>>, outcome STRING, error STRING, durationMs DOUBLE,"
    f" repo STRING, engineVersion STRING, node STRING, signals STRUCT<{SIGNALS}>"
)
DECISION_SCHEMA = (
    "v INT, ts STRING, tool STRING, repo STRING, root STRING, branch STRING, head STRING, mode STRING, arm STRING,"
    " shownShare DOUBLE, withheld BOOLEAN, shownBecause STRING, requestHash STRING, requestChars INT, verdict STRING,"
    " convergence DOUBLE, band STRING, receiptId STRING"
)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line with the file it came from; a rotated log is just a second path."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def classify_event_lines(lines: DataFrame) -> DataFrame:
    """Each non-blank line as event, skipped (unparseable) or skippedNewerSchema.

    A line is unparseable only when it is not JSON; a JSON line with odd fields
    stays an event with those fields null. Unknown fields stay in ``raw``.
    """
    raw = F.try_parse_json("value")
    version = F.try_variant_get(F.col("raw"), "$.v", "double")
    return (
        lines.where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
        .withColumn("raw", raw)
        .withColumn(
            "status",
            F.when(F.col("raw").isNull(), "skipped")
            .when(F.coalesce(version > EVENT_SCHEMA_VERSION, F.lit(False)), "skippedNewerSchema")
            .otherwise("event"),
        )
    )


def parse_events(lines: DataFrame) -> DataFrame:
    """The usable events, typed; use ``classify_event_lines`` for the counters."""
    usable = classify_event_lines(lines).where("status = 'event'")
    return usable.select("raw", F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"}).alias("e")).select("e.*", "raw")


def event_line_counts(lines: DataFrame) -> DataFrame:
    """One row of counters: events, skipped, skippedNewerSchema."""
    status = F.col("status")
    return classify_event_lines(lines).agg(
        F.count_if(status == "event").alias("events"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "skippedNewerSchema").alias("skipped_newer_schema"),
    )


def short_hash(value: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, length)


def normalize_events(df: DataFrame) -> DataFrame:
    """What is written for one event: rounded duration, hashed repository, default outcome."""
    return df.withColumns(
        {
            "v": F.lit(EVENT_SCHEMA_VERSION),
            "durationMs": F.floor(F.col("durationMs") + 0.5).cast("bigint"),
            "repo": F.when(F.col("repo_root").isNotNull(), short_hash(F.col("repo_root"))),
            "outcome": F.coalesce("outcome", F.lit("ok")),
        }
    ).drop("repo_root")


def append_events(df: DataFrame, path: str) -> None:
    """Append as JSON lines in one folder per day, so no file needs rotation."""
    day = F.to_date(F.timestamp_millis("ts")).alias("day")
    normalize_events(df).withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def duration_bucket(ms: Column) -> Column:
    """Five duration classes; null, NaN and negative are unknown."""
    return (
        F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 0), "unknown")
        .when(ms < 100, "under_100ms")
        .when(ms < 1000, "100ms_to_1s")
        .when(ms < 5000, "1s_to_5s")
        .when(ms < 30000, "5s_to_30s")
        .otherwise("over_30s")
    )


def shared_payload(events: DataFrame) -> DataFrame:
    """S3: the anonymous projection of an event; nothing else may leave the log."""
    cmd = F.lower("cmd")
    major = F.regexp_extract("node", r"^v?(\d{1,9})", 1)
    node = F.when(major != "", major.cast("int"))
    version = F.coalesce("engineVersion", F.lit(""))
    return events.select(
        F.when(F.col("surface") == "mcp", "mcp").otherwise("cli").alias("surface"),
        F.when(cmd.rlike(r"^[a-z][a-z0-9_-]{0,63}$"), cmd).otherwise("other").alias("command"),
        F.when(F.col("outcome").isin("error", "fail", "ok"), F.col("outcome")).otherwise("error").alias("outcome"),
        duration_bucket(F.col("durationMs")).alias("duration_bucket"),
        F.when(version.rlike(r"^\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?$"), version).otherwise("0.0.0").alias("version"),
        F.when(node.between(18, 100), node).otherwise(18).alias("node_major"),
        F.when(F.col("platform").isin("darwin", "linux", "win32"), F.col("platform")).otherwise("other").alias("platform"),
    )


def parse_decisions(lines: DataFrame) -> DataFrame:
    """Trial decisions of version 1 with a string head; torn lines vanish."""
    raw = F.try_parse_json("value")
    parsed = lines.select(raw.alias("raw"), F.from_json("value", DECISION_SCHEMA).alias("d"))
    return parsed.where(
        (F.try_variant_get("raw", "$.v", "double") == 1)
        & (F.try_variant_get("raw", "$.mode", "string") == "trial")
        & (F.schema_of_variant(F.try_variant_get("raw", "$.head", "variant")) == "STRING")
    ).select("d.*")


def _kind(doc: Column, path: str) -> Column:
    """The JSON type at a path, null when absent."""
    return F.schema_of_variant(F.try_variant_get(doc, path, "variant"))


def _is_number(doc: Column, path: str) -> Column:
    return F.coalesce(_kind(doc, path).rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def _is_string(doc: Column, path: str) -> Column:
    return F.coalesce(_kind(doc, path) == "STRING", F.lit(False))


def _present(doc: Column, path: str) -> Column:
    """Present and not null, false, zero or the empty string."""
    text = F.try_variant_get(doc, path, "string")
    return F.coalesce((_kind(doc, path) != "VOID") & ~text.isin("", "false", "0"), _kind(doc, path).rlike("^(OBJECT|ARRAY)"), F.lit(False))


def artifact_kind(doc: Column) -> Column:
    """What a saved JSON result is, by the fields it holds; the first rule that fits wins."""
    return (
        F.when(_is_number(doc, "$.convergence") | _present(doc, "$.convergenceEngineVersion"), "converge")
        .when(_is_number(doc, "$.ax"), "ax")
        .when(_is_number(doc, "$.totals.savedTokens"), "eval")
        .when(_present(doc, "$.validation"), "impact")
        .when(_is_string(doc, "$.verdict"), "gate")
        .when(_present(doc, "$.summary") & F.coalesce(_kind(doc, "$.files").startswith("ARRAY"), F.lit(False)), "map")
        .otherwise("report")
    )


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON result below a folder, classified; index and catalogue files are not results."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    named = files.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.try_parse_json("value").alias("doc"))
    kept = named.where(F.col("doc").isNotNull() & ~F.col("file").isin("index.json", "catalog.json"))
    return kept.withColumn("kind", artifact_kind(F.col("doc")))


def extract_signals(doc: Column) -> Column:
    """The typed value fields of a result; absent or wrongly typed fields are null."""

    def number(path: str) -> Column:
        return F.when(_is_number(doc, path), F.try_variant_get(doc, path, "double"))

    def text(path: str) -> Column:
        return F.when(_is_string(doc, path), F.try_variant_get(doc, path, "string"))

    scored = _is_string(doc, "$.verdict") | _is_number(doc, "$.convergence")
    checks = F.coalesce(
        F.try_variant_get(doc, "$.checks", "array<struct<name:string,status:string>>"),
        F.try_variant_get(doc, "$.pass.checks", "array<struct<name:string,status:string>>"),
    )
    named = F.filter(checks, lambda c: c["name"].isNotNull() & c["status"].isNotNull())
    request = F.trim(F.coalesce(text("$.request"), text("$.task"), F.lit("")))
    paths = F.try_variant_get(doc, "$.changedFiles", "array<string>")
    return F.struct(
        number("$.tokenEstimate.fullJson").alias("tokenEstimate"),
        text("$.verdict").alias("verdict"),
        number("$.confidence").alias("confidence"),
        number("$.ax").alias("ax"),
        number("$.convergence").alias("convergence"),
        text("$.band").alias("band"),
        text("$.receipt.id").alias("receiptId"),
        text("$.validation.verdict").alias("validationVerdict"),
        number("$.totals.savedTokens").alias("savedTokens"),
        number("$.totals.savedPct").alias("savedPct"),
        F.try_variant_get(doc, "$.passed", "boolean").alias("evalPassed"),
        F.when(
            scored & checks.isNotNull(),
            F.aggregate(
                named,
                F.create_map().cast("map<string,string>"),
                lambda acc, c: F.map_concat(F.map_filter(acc, lambda k, _: k != c["name"]), F.create_map(c["name"], c["status"])),
            ),
        ).alias("checks"),
        F.when(_is_string(doc, "$.verdict"), F.when(_present(doc, "$.pr"), "pr").otherwise("local")).alias("gateMode"),
        F.when(scored, short_hash(text("$.repo.root"))).alias("repoId"),
        F.when(
            scored & paths.isNotNull(),
            short_hash(F.to_json(F.struct(text("$.scope").alias("scope"), text("$.subject.treeSha").alias("tree"), F.array_sort(paths).alias("paths")))),
        ).alias("changeId"),
        F.when(scored & (request != ""), short_hash(request)).alias("requestId"),
    )
