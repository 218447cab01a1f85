"""Session transcripts as typed events and billed usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.sources.lines import numbered_lines

# Tools that edit files, tools that are checks, and what opens a prompt nobody typed.
EDIT_TOOLS = ["Edit", "Write", "MultiEdit", "NotebookEdit", "str_replace_based_edit_tool"]
CHECK_TOOL = r"(?:^|__)(convergence_score|review_gate)$"
INTERRUPT = r"^\[Request interrupted by user"
HARNESS = r"^<(task-notification|ci-monitor-event|bash-input)[\s>]"
REMINDERS = r"^(?:<system-reminder>[\s\S]*?</system-reminder>\s*)+"
# Price of each kind of token in input tokens.
BILLED = {"input": 1.0, "cache_read": 0.1, "cache_write_5m": 1.25, "cache_write_1h": 2.0, "output": 5.0}


#: Places that a line's blocks may take in ``seq``.
LINE_BITS = 20


def read_transcript_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every transcript at most one folder deep: value, file and line, a number over all files in path order."""
    lines = numbered_lines(spark, f"{path}/*", "*.jsonl")  # files here, and those of the folders here
    return lines.select("value", "file", F.col("number").alias("line"))


def prompt_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def is_harness(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), REMINDERS, "").rlike(HARNESS)


def _millis(iso: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(iso))


def _text(doc: Column, path: str) -> Column:
    """A string field; null when absent or not a string."""
    kind = F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(doc, path, "string"))


def _flag(doc: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(doc, path, "boolean"), F.lit(False))


def parse_sessions(lines: DataFrame) -> DataFrame:
    """events(session_id, seq, ts, kind, text, file, tool, hash) from lines(value, line).

    ``seq`` keeps line order and then block order, so events of one instant stay
    in the order they were written. Side chains, rows without a session or a
    time, tool results and meta rows are dropped. Repeated prompts are dropped
    afterwards by the session job.
    """
    doc = F.col("doc")
    rows = (
        lines.where(F.col("value").rlike('"type":"(user|assistant|queue-operation)"'))
        .select("line", F.try_parse_json("value").alias("doc"))
        .select(
            "line",
            doc,
            _text(doc, "$.type").alias("type"),
            _text(doc, "$.sessionId").alias("session_id"),
            _millis(_text(doc, "$.timestamp")).alias("ts"),
        )
        .where(F.col("session_id").isNotNull() & (F.col("session_id") != "") & F.col("ts").isNotNull() & ~_flag(doc, "$.isSidechain"))
    )
    content = F.try_variant_get(doc, "$.message.content", "array<variant>")
    blocks = F.coalesce(content, F.array().cast("array<variant>"))

    block = F.col("block")
    name = F.coalesce(_text(block, "$.name"), F.lit(""))
    check_tool = F.regexp_extract(name, CHECK_TOOL, 1)
    file = F.coalesce(_text(block, "$.input.file_path"), _text(block, "$.input.path"))
    asked = F.coalesce(_text(block, "$.input.query"), _text(block, "$.input.request"), F.lit(""))
    calls = (
        rows.where("type = 'assistant'")
        .select("line", "session_id", "ts", F.posexplode(blocks).alias("pos", "block"))
        .where(_text(block, "$.type") == "tool_use")
        .select(
            "session_id",
            F.struct("line", "pos").alias("seq"),
            "ts",
            F.when(check_tool != "", "check").when(name.isin(*EDIT_TOOLS) & (file != ""), "edit").alias("kind"),
            F.lit(None).cast("string").alias("text"),
            F.when(check_tool == "", file).alias("file"),
            F.when(check_tool != "", check_tool).alias("tool"),
            F.when(check_tool != "", prompt_hash(asked)).alias("hash"),
        )
        .where("kind is not null")
    )
    texts = F.filter(blocks, lambda b: _text(b, "$.type") == "text")
    joined = F.array_join(F.transform(texts, lambda b: F.coalesce(_text(b, "$.text"), F.lit(""))), "\n")
    said = F.coalesce(_text(doc, "$.message.content"), joined)
    queued = (F.col("type") == "queue-operation") & (_text(doc, "$.operation") == "enqueue")
    typed = (F.col("type") == "user") & ~_flag(doc, "$.isMeta") & F.try_variant_get(doc, "$.toolUseResult", "variant").isNull()
    text = F.when(typed, F.trim(said)).when(queued, _text(doc, "$.content"))
    kind = (
        F.when(is_harness(F.col("text")), "harness")
        .when(F.col("queued"), F.lit(None))
        .when(F.col("text").rlike(INTERRUPT), "interrupt")
        .otherwise("prompt")
    )
    prompts = (
        rows.where("type in ('user', 'queue-operation')")
        .select("session_id", F.struct("line", F.lit(0).alias("pos")).alias("seq"), "ts", text.alias("text"), queued.alias("queued"))
        .where(F.col("text").isNotNull() & (F.col("text") != ""))
        .withColumn("kind", kind)
        .where("kind is not null")
        .select(
            "session_id",
            "seq",
            "ts",
            "kind",
            F.when(F.col("kind") != "harness", F.col("text")).alias("text"),
            F.lit(None).cast("string").alias("file"),
            F.lit(None).cast("string").alias("tool"),
            prompt_hash(F.col("text")).alias("hash"),
        )
    )
    both = calls.unionByName(prompts)
    return both.withColumn("seq", F.shiftleft("seq.line", LINE_BITS) + F.col("seq.pos"))


def _count(doc: Column, path: str) -> Column:
    value = F.try_variant_get(doc, path, "double")
    return F.when(value > 0, value).otherwise(0.0)


def weighted_tokens(usage: Column) -> Column:
    """Billed tokens of one reply in input tokens; a one-hour write is part of the cache write."""
    write = _count(usage, "$.cache_creation_input_tokens")
    hour = F.least(write, _count(usage, "$.cache_creation.ephemeral_1h_input_tokens"))
    total = (
        _count(usage, "$.input_tokens") * BILLED["input"]
        + _count(usage, "$.cache_read_input_tokens") * BILLED["cache_read"]
        + (write - hour) * BILLED["cache_write_5m"]
        + hour * BILLED["cache_write_1h"]
        + _count(usage, "$.output_tokens") * BILLED["output"]
    )
    return F.floor(total + 0.5).cast("bigint")


def parse_usage(lines: DataFrame) -> DataFrame:
    """usage(session_id, message_id, ts, weighted); the first record of a message id wins.

    The first is found with a combined minimum, so a message id repeated in
    millions of lines is reduced before the shuffle.
    """
    doc = F.col("doc")
    rows = (
        lines.where(F.col("value").contains('"type":"assistant"') & F.col("value").contains('"usage"'))
        .select("line", F.try_parse_json("value").alias("doc"))
        .select(
            "line",
            _text(doc, "$.sessionId").alias("session_id"),
            _millis(_text(doc, "$.timestamp")).alias("ts"),
            F.coalesce(_text(doc, "$.message.id"), _text(doc, "$.requestId")).alias("message_id"),
            F.try_variant_get(doc, "$.message.usage", "variant").alias("usage"),
            _text(doc, "$.type").alias("type"),
            _flag(doc, "$.isSidechain").alias("side"),
        )
        .where("type = 'assistant' and session_id is not null and ts is not null and not side and usage is not null")
    )
    # A reply without any id is its own.
    key = F.coalesce("message_id", F.concat(F.lit("line:"), F.col("line").cast("string")))
    reply = F.struct("line", "session_id", "ts", weighted_tokens(F.col("usage")).alias("weighted"), "message_id")
    first = rows.groupBy(key.alias("_key")).agg(F.min(reply).alias("r"))
    return first.select("r.session_id", "r.message_id", "r.ts", "r.weighted")
