"""Hash chains and receipts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.functions.slices import with_running
from tallywake.session import cut_lineage
from tallywake.sources.lines import numbered_lines

GENESIS = "0" * 64
LINES_PER_SLICE = 10_000
_MARK = "@@previous@@"


def read_ledger_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """lines(ledger, line, value) of JSON-lines ledgers, one file each, in file order; lines count from 1."""
    return numbered_lines(spark, path).select(F.col("file").alias("ledger"), (F.col("line") + 1).alias("line"), "value")


def parse_ledger(lines: DataFrame) -> DataFrame:
    """records(ledger, line, body variant) from lines(ledger, line, value); bad JSON is an error."""
    return lines.where(F.trim("value") != "").select("ledger", "line", F.parse_json("value").alias("record"))


def canonical(fields: Column) -> Column:
    """A map<string, variant> as JSON with its keys in order; nested objects are kept in order by VARIANT."""
    keys = F.array_sort(F.map_keys(fields))
    ordered = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(fields, k)))
    return F.to_json(ordered)


def verify_ledger(records: DataFrame) -> DataFrame:
    """Each record with ``valid``: its hash covers the previous hash and its body, and it links to it.

    Signatures are outside the hash and are only told apart as present or not.
    """
    fields = F.col("record").cast("map<string,variant>")
    body = F.map_filter(fields, lambda k, _: ~k.isin("recordHash", "signature"))
    text = lambda name: F.try_variant_get("record", f"$.{name}", "string")
    rows = records.select(
        "ledger", "line", text("recordHash").alias("record_hash"), text("prevHash").alias("prev_hash"), canonical(body).alias("body"),
        F.try_variant_get("record", "$.signature", "variant").isNotNull().alias("signed"), F.floor(F.col("line") / LINES_PER_SLICE).alias("slice"),
    )
    linked = with_running(rows, ["ledger"], "slice", ["line"], maxima={"_last": F.struct("line", "record_hash")}, include_current=False)
    before = F.coalesce("_last.record_hash", F.lit(GENESIS))
    valid = (F.sha2(F.concat(before, F.col("body")), 256) == F.col("record_hash")) & (F.col("prev_hash") == before)
    return linked.select("ledger", "line", "record_hash", F.coalesce(valid, F.lit(False)).alias("valid"), "signed")


def ledger_summary(verified: DataFrame) -> DataFrame:
    """One row per ledger: records, the tip and whether the whole chain holds."""
    return verified.groupBy("ledger").agg(
        F.count("*").alias("records"), F.count_if(~F.col("valid")).alias("broken"), F.max_by("record_hash", "line").alias("tip"), F.count_if("signed").alias("signed")
    )


def append_records(bodies: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Chain new records onto their ledgers.

    bodies(ledger, line from 1, fields map<string, variant>), tips(ledger, seq,
    tip). A hash covers the one before it, so a ledger is hashed in order by one
    task; the task streams its sorted rows and keeps one hash, never a ledger.
    """
    offset = F.coalesce("seq", F.lit(0)) if tips is not None else F.lit(0)
    joined = bodies.join(tips, "ledger", "left") if tips is not None else bodies.withColumn("tip", F.lit(None).cast("string"))
    numbered = joined.withColumn("_seq", F.col("line") + offset)
    added = F.map_from_arrays(
        F.array(F.lit("prevHash"), F.lit("seq")),
        F.array(F.parse_json(F.lit(f'"{_MARK}"')), F.parse_json(F.col("_seq").cast("string"))),
    )
    rows = numbered.select(
        "ledger", F.col("line").cast("bigint").alias("line"), F.col("_seq").cast("bigint").alias("seq"), F.coalesce("tip", F.lit(GENESIS)).alias("first_prev"),
        canonical(F.map_concat(F.map_filter("fields", lambda k, _: ~k.isin("prevHash", "seq")), added)).alias("body"),
    )
    text, number = T.StringType(), T.LongType()
    schema = T.StructType([rows.schema["ledger"], *[T.StructField(n, t) for n, t in (("line", number), ("seq", number), ("prev", text), ("hash", text), ("body", text))]])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        current, last = None, ""
        for batch in batches:
            before, hashes, whole = [], [], []
            for ledger, first, body in zip(*(batch.column(c).to_pylist() for c in ("ledger", "first_prev", "body"))):
                if ledger != current:
                    current, last = ledger, first
                before.append(last)
                whole.append(body.replace(_MARK, last))
                last = sha256((last + whole[-1]).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("ledger", "line", "seq")), *(pa.array(c, pa.string()) for c in (before, hashes, whole))], names=schema.names)

    return cut_lineage(rows.repartition("ledger").sortWithinPartitions("ledger", "line").mapInArrow(link, schema))


def contract_hash(contract: Column, *, with_scope: bool = True) -> Column:
    """Hash of what was declared, lists sorted; scope words count only when present."""
    fields = ["schema", "request", "head", "impactEngineVersion"]
    lists = ["owners", "supporting", "dirtyAtDeclaration"]
    base = [contract[f].alias(f) for f in fields] + [F.array_sort(contract[f]).alias(f) for f in lists]
    plain = F.to_json(F.struct(*base), {"ignoreNullFields": "false"})
    if not with_scope:
        return F.sha2(plain, 256)
    words = [F.array_sort(contract[f]).alias(f) for f in ("terms", "modules")]
    full = F.to_json(F.struct(*base, *words), {"ignoreNullFields": "false"})
    terms_only = F.to_json(F.struct(*base, words[0]), {"ignoreNullFields": "false"})
    modules_only = F.to_json(F.struct(*base, words[1]), {"ignoreNullFields": "false"})
    has_terms, has_modules = contract["terms"].isNotNull(), contract["modules"].isNotNull()
    return F.sha2(F.when(has_terms & has_modules, full).when(has_terms, terms_only).when(has_modules, modules_only).otherwise(plain), 256)


def amendment_hash(previous: Column, seq: Column, files: Column, reason: Column) -> Column:
    payload = F.to_json(F.struct(seq.alias("seq"), F.array_sort(files).alias("files"), reason.alias("reason")))
    return F.sha2(F.concat(previous, payload), 256)


def verify_contracts(contracts: DataFrame) -> DataFrame:
    """contracts(contract_id, contract struct, contract_hash, amendments array<struct<seq, files,
    reason, prev_hash, hash>>) with ``valid``, the first broken amendment and the tip."""
    tail = F.col("amendments")

    def sound(a: Column, i: Column) -> Column:
        before = F.when(i == 0, F.col("contract_hash")).otherwise(F.get(tail, i - 1)["hash"])
        filled = (a["seq"] == i + 1) & (F.size(a["files"]) > 0) & (F.trim(a["reason"]) != "")
        return F.coalesce(filled & (a["prev_hash"] == before) & (a["hash"] == amendment_hash(before, a["seq"], a["files"], a["reason"])), F.lit(False))

    checks = F.transform(tail, sound)
    first_bad = F.array_position(checks, F.lit(False))
    declared = F.coalesce(contract_hash(F.col("contract")) == F.col("contract_hash"), F.lit(False))
    request = F.coalesce(F.trim(F.col("contract.request")) != "", F.lit(False))
    tip = F.coalesce(F.try_element_at(tail, F.lit(-1))["hash"], F.col("contract_hash"))
    return contracts.select(
        "contract_id", (declared & request & (first_bad == 0)).alias("valid"), (declared & request).alias("declared_valid"),
        F.when(first_bad > 0, first_bad.cast("int")).alias("broken_amendment"), F.when(declared & request & (first_bad == 0), tip).alias("tip"),
    )


def receipts(rows: DataFrame, keys: Sequence[str], item: Column, scalars: DataFrame | None = None, prefix: str = "rcpt_") -> DataFrame:
    """A hash per key over its set of items in sorted order, whatever order they came in.

    Items are first hashed in 256 buckets per key, so a key with very many items
    is spread over tasks; the receipt hashes the bucket hashes in order. Extra
    ``scalars`` (keys..., payload) are part of the hash.
    """
    keys = list(keys)
    distinct = rows.select(*keys, item.cast("string").alias("_item")).distinct().withColumn("_bucket", F.substring(F.sha2("_item", 256), 1, 2))
    parts = distinct.groupBy(*keys, "_bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_item")), "\n"), 256).alias("_h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_h"))), lambda p: F.concat(p["_bucket"], p["_h"])), "")
    whole = parts.groupBy(*keys).agg(joined.alias("_all"))
    if scalars is not None:
        whole = whole.join(scalars, keys, "left").withColumn("_all", F.concat(F.coalesce("payload", F.lit("")), F.lit("\n"), F.col("_all")))
    digest = F.sha2("_all", 256)
    return whole.select(*keys, F.concat(F.lit(prefix), F.substring(digest, 1, 12)).alias("receipt"), digest.alias("inputs_hash"))
