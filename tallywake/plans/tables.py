"""Load the given tables and shape them as the operators' inputs.

Each shape has the same text on the SQL side (the ``*_CTE`` constants), so a
query and its SQL start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywake.session import ensure_checkpoint_dir


LINES_A_FILE = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_text_files(lines: DataFrame, order: list[str]) -> str:
    """Write the column ``value`` as text files whose names follow ``order``; returns the folder, in the shared one.

    The number of files grows with the lines, so none of them and no task that sorts one does.
    """
    folder = f"{ensure_checkpoint_dir(lines.sparkSession)}/lines-{uuid.uuid4().hex}"
    files = max(4, -(-lines.count() // LINES_A_FILE))
    lines.repartitionByRange(files, *order).sortWithinPartitions(*order).select("value").write.text(folder)
    return folder


def epoch_s(name: str) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return F.expr(f"cast(cast(({name} - timestamp_ntz'1970-01-01 00:00:00') as interval second) as bigint)")


def epoch_ms(name: str) -> Column:
    micros = f"cast(cast(({name} - timestamp_ntz'1970-01-01 00:00:00') as interval second) as decimal(20,6))"
    return F.expr(f"cast(floor({micros} * 1000) as bigint)")


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits one partition per core before costly row work.

    A table of any size has far more splits than cores and is left as it is, so
    nothing is shuffled there.
    """
    if not hasattr(df.sparkSession, "sparkContext"):  # a remote session does not show its cores
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


# Orders are changes; returned line items are their repairs.
CHANGES_CTE = """
repairs as (
  select o_orderkey, min(cast(epoch(l_shipdate) - epoch(o_orderdate) as bigint)) as repaired_after
  from orders join lineitem on l_orderkey = o_orderkey
  where l_returnflag = 'R' and l_shipdate >= o_orderdate
  group by 1),
changes as (
  select o.o_orderkey as sha, o.o_custkey as repo_id, cast(epoch(o.o_orderdate) as bigint) as time, r.repaired_after,
         o.o_orderpriority as priority,
         case o.o_orderstatus when 'F' then 'FAIL' when 'O' then 'PASS' else 'WARN' end as verdict,
         o.o_totalprice as price
  from orders o left join repairs r on r.o_orderkey = o.o_orderkey)
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem")
    repairs = (
        items.where("l_returnflag = 'R'")
        .join(orders.select("o_orderkey", "o_orderdate"), items.l_orderkey == F.col("o_orderkey"))
        .where("l_shipdate >= o_orderdate")
        .groupBy("o_orderkey")
        .agg(F.min(epoch_s("l_shipdate") - epoch_s("o_orderdate")).alias("repaired_after"))
    )
    verdict = F.when(F.col("o_orderstatus") == "F", "FAIL").when(F.col("o_orderstatus") == "O", "PASS").otherwise("WARN")
    return orders.join(repairs, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("sha"),
        F.col("o_custkey").alias("repo_id"),
        epoch_s("o_orderdate").alias("time"),
        "repaired_after",
        F.col("o_orderpriority").alias("priority"),
        verdict.alias("verdict"),
        F.col("o_totalprice").alias("price"),
    )




def sql_round3(x: str) -> str:
    return f"(floor(({x}) * 1000.0 + 0.5) / 1000.0)"


def _wilson_sql(h: str, n: str) -> tuple[str, str]:
    p = f"(cast({h} as double) / {n})"
    z2 = "(1.96::double * 1.96::double)"
    den = f"(1.0::double + {z2} / {n})"
    centre = f"(({p} + {z2} / ({n} * 2)) / {den})"
    half = f"(sqrt(({p} * (1.0::double - {p})) / {n} + {z2} / ({n} * {n} * 4)) * 1.96::double / {den})"
    return f"{centre} - {half}", f"{centre} + {half}"


def sql_proportion(h: str, n: str, floor: int) -> str:
    """rate, ci_low, ci_high, publishable for DuckDB."""
    low, high = _wilson_sql(h, n)
    shown = f"{n} >= {floor} and {n} > 0"
    return f"""
case when {shown} then floor(cast({h} as double) / {n} * 1000.0 + 0.5) / 1000.0 end as rate,
case when {shown} then floor(greatest(0.0::double, {low}) * 1000.0 + 0.5) / 1000.0 end as ci_low,
case when {shown} then floor(least(1.0::double, {high}) * 1000.0 + 0.5) / 1000.0 end as ci_high,
{n} >= {floor} as publishable"""
