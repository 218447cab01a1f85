"""Shards by extendible hashing: a directory of hash prefixes, in which only oversized buckets split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywake.llm.storage import new_folder, stored

#: Most bytes of text in a shard.
SHARD_BYTES = 64 << 20
#: Hash bits that one directory may use; a bucket that needs more gets a directory of its own.
DIRECTORY_BITS = 20
#: Hash bits of an id, and as many more of its row, for ids that stand for more than a shard holds.
ID_BITS = 60


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, ID_BITS // 4), 16, 10).cast("long")


def _bits(level: int) -> Column:
    """The DIRECTORY_BITS hash bits of a level; the levels of the id come first."""
    per_hash = ID_BITS // DIRECTORY_BITS
    source = F.col("_id_hash") if level < per_hash else F.col("_row_hash")
    return F.shiftright(source, ID_BITS - DIRECTORY_BITS * (level % per_hash + 1)).bitwiseAND(2**DIRECTORY_BITS - 1)


def _directory(sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Buckets of one level, as (parent, entry) -> depth, prefix, shard_bytes, and its global depths.

    ``sizes`` has parent (the prefix of earlier levels), bits and n_bytes. Every
    bucket has the smallest depth at which its bytes fit, or DIRECTORY_BITS and
    ``full`` where they never do.
    """
    fine = stored(sizes.groupBy("parent", "bits").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n")), "prefixes")
    steps = fine.select("*", F.explode(F.sequence(F.lit(0), F.lit(DIRECTORY_BITS))).alias("depth"))
    steps = steps.withColumn("prefix", F.expr(f"shiftright(bits, {DIRECTORY_BITS} - depth)"))
    totals = steps.groupBy("parent", "depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("n"))
    fits = totals.where((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == DIRECTORY_BITS))
    # A bucket is a shard if no shorter prefix of it is one: its own parent does not fit.
    over = totals.where((F.col("shard_bytes") > limit) & (F.col("n") > 1) & (F.col("depth") < DIRECTORY_BITS)).select("parent", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
    split = fits.withColumn("_up", F.shiftright("prefix", 1)).join(over, ["parent", "depth", "_up"], "left_semi")
    whole = fits.where("depth = 0")
    shards = split.select(whole.columns).union(whole).withColumn("full", (F.col("shard_bytes") > limit) & (F.col("n") > 1))
    return stored(shards, "shards"), fine


def with_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Rows of ``docs`` with shard (hash prefix as text), shard_depth, n_bytes and shard_bytes.

    Shards hold at most ``limit`` bytes of text. A shard is the shortest prefix of
    the hash of doc_id under which all rows fit; ids that alone stand for more
    are split on by a hash of their rows, so repeated rows may lie in several
    shards. One row that is larger than a shard is a shard of its own. A null
    doc_id hashes as the empty text, a null text has no bytes. Columns of these
    names in ``docs`` are replaced.
    """
    added = ["shard", "shard_depth", "n_bytes", "shard_bytes"]
    kept = [c for c in docs.columns if c not in added]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        _number(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))).alias("_id_hash"),
        _number(F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))).alias("_row_hash"),
        F.lit("").alias("parent"),
    )
    done: list[DataFrame] = []
    levels = 2 * ID_BITS // DIRECTORY_BITS
    for level in range(levels):
        rows = rows.withColumn("bits", _bits(level))
        shards, _ = _directory(rows.select("parent", "bits", "n_bytes"), limit)
        depth = shards.agg(F.max("depth")).first()[0] or 0
        # The directory: 2^depth entries per parent, each pointing to its bucket.
        pointers = shards.select(
            "parent",
            F.explode(F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)")).alias("entry"),
            F.concat("parent", F.expr("right(lpad(bin(prefix), depth, '0'), depth)")).alias("shard"),
            "shard_bytes",
            "full",
        )
        placed = rows.withColumn("entry", F.shiftright("bits", DIRECTORY_BITS - depth)).join(pointers, ["parent", "entry"])
        deeper = level + 1 < levels and not shards.where("full").isEmpty()
        ready = placed.where("not full") if deeper else placed
        done.append(ready.select("doc.*", "shard", F.length("shard").alias("shard_depth"), "n_bytes", "shard_bytes"))
        if not deeper:
            break
        rows = placed.where("full").select("doc", "n_bytes", "_id_hash", "_row_hash", F.col("shard").alias("parent"))
    return reduce(DataFrame.union, done)


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write every row of ``docs`` as Parquet, one folder ``shard=<prefix>`` for each shard; the root shard is ``shard=root``."""
    placed = with_shards(docs, limit).withColumn("shard", F.when(F.col("shard") == "", "root").otherwise(F.concat(F.lit("p"), "shard")))
    placed.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_round_trip(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """Write the shards in the shared folder and list what lies in them.

    Returns doc_id, shard, shard_depth, n_bytes and shard_bytes, one row per input
    row, read from the files; an empty table gives no row.
    """
    spark = docs.sparkSession
    path = new_folder(spark, "shards")
    own = docs.select("doc_id", "text")
    write_shards(own, path, limit)
    added = [("shard_depth", T.IntegerType()), ("n_bytes", T.LongType()), ("shard_bytes", T.LongType()), ("shard", T.StringType())]
    schema = T.StructType([*own.schema, *[T.StructField(n, kind) for n, kind in added]])
    read = spark.read.schema(schema).parquet(path)
    return read.select(
        "doc_id",
        F.when(F.col("shard") == "root", "").otherwise(F.substring("shard", 2, 200)).alias("shard"),
        "shard_depth",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "shard_bytes",
    )


def oracle(limit: int = SHARD_BYTES, bits: int = DIRECTORY_BITS) -> str:
    """DuckDB SQL for the same rows, for tables whose ids need no more than one directory."""
    return f"""
with d as (
  select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {ID_BITS // 4}))::bigint >> {ID_BITS - bits} as bits
  from documents),
t as (
  select depth, bits >> ({bits} - depth) as prefix, sum(n_bytes)::bigint as shard_bytes, count(*) as n
  from d, (select unnest(range(0, {bits + 1}))::int as depth) group by all),
s as (
  select d.doc_id, d.n_bytes, d.bits, min(t.depth) as shard_depth
  from d join t on t.prefix = d.bits >> ({bits} - t.depth)
  where t.shard_bytes <= {limit} or t.n = 1 or t.depth = {bits}
  group by d.doc_id, d.n_bytes, d.bits)
select s.doc_id, case when shard_depth = 0 then '' else right(lpad(bin(t.prefix), {bits}, '0'), shard_depth) end as shard,
       shard_depth, s.n_bytes, t.shard_bytes
from s join t on t.depth = s.shard_depth and t.prefix = s.bits >> ({bits} - s.shard_depth)"""
