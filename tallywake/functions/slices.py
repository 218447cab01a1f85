"""Window results over groups that may be far too large for one task.

A plain window sends every row of a group to one task. Here a group is cut into
slices along its ordering (an hour of time, a span of line numbers). Each slice
is a task-sized window; what a slice needs from earlier or later slices comes
from a summary with one row per slice, so the group itself is never gathered.
The slice column must not decrease along the ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    include_current: bool = True,
) -> DataFrame:
    """Running sums and running maxima along each group.

    A running maximum of ``struct(order..., value)`` is a "last known value".
    Keys must not be null.
    """
    sums, maxima = sums or {}, maxima or {}
    group = [*keys, slice_col]
    end = 0 if include_current else -1
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)

    summary = df.groupBy(*group).agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()],
        *[F.max(c).alias(f"_m_{n}") for n, c in maxima.items()],
    )
    carried = summary.select(
        *group,
        *[F.sum(f"_s_{n}").over(earlier).alias(f"_cs_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(earlier).alias(f"_cm_{n}") for n in maxima],
    )
    inside = df.select(
        "*",
        *[F.sum(c).over(local).alias(f"_ls_{n}") for n, c in sums.items()],
        *[F.max(c).over(local).alias(f"_lm_{n}") for n, c in maxima.items()],
    )
    joined = inside.join(carried, group, "left")
    out = joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_ls_{n}"), F.lit(0)) + F.coalesce(F.col(f"_cs_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(f"_lm_{n}"), F.col(f"_cm_{n}")).alias(n) for n in maxima],
    )
    return out


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    slice_col: str,
    order: Sequence[str],
    value: Column,
    out: str,
) -> DataFrame:
    """The ``value`` of the following row of the group, across slices."""
    group = [*keys, slice_col]
    local = Window.partitionBy(*group).orderBy(*order)
    later = Window.partitionBy(*keys).orderBy(slice_col)
    heads = (
        df.groupBy(*group)
        .agg(F.min_by(value, F.struct(*order)).alias("_head"))
        .select(*group, F.lead("_head").over(later).alias("_next_head"))
    )
    return (
        df.select("*", F.lead(value).over(local).alias("_lead"))
        .join(heads, group, "left")
        .select(*df.columns, F.coalesce(F.col("_lead"), F.col("_next_head")).alias(out))
    )


def magnitude_bucket(value: Column) -> Column:
    """A bucket number that never decreases with the value, about 1% wide."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1) * 64)).cast("bigint")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    positions: dict[str, Column],
) -> DataFrame:
    """Exact n-th smallest values per group, without sorting a group in one task.

    ``positions`` maps an output name to a 0-based index over the column ``n``
    (the group's number of non-null values). Equal values are first counted,
    then a small histogram tells which bucket holds each wanted position, and
    only those buckets are ordered.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_b", magnitude_bucket(F.col("_v").cast("double")))
    prior = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .select(
            *keys,
            "_b",
            "_bc",
            F.coalesce(F.sum("_bc").over(prior), F.lit(0)).alias("_start"),
            F.sum("_bc").over(whole).alias("n"),
        )
    )
    wanted = buckets.select(
        *keys,
        "_b",
        "_start",
        "n",
        F.explode(F.array(*[F.struct(F.lit(name).alias("name"), pos.cast("bigint").alias("pos")) for name, pos in positions.items()])).alias("_w"),
        "_bc",
    ).where((F.col("_w.pos") >= F.col("_start")) & (F.col("_w.pos") < F.col("_start") + F.col("_bc")))
    needed = wanted.select(*keys, "_b", "_start").distinct()
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(needed, [*keys, "_b"]).select(
        *keys,
        "_b",
        "_v",
        (F.col("_start") + F.sum("_c").over(inside) - F.col("_c")).alias("_from"),
        (F.col("_start") + F.sum("_c").over(inside)).alias("_to"),
    )
    picked = (
        wanted.select(*keys, "_b", "n", F.col("_w.name").alias("_name"), F.col("_w.pos").alias("_pos"))
        .join(ranked, [*keys, "_b"])
        .where((F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to")))
    )
    return picked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in positions],
    )


def medians(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Columns n, low, high: the two middle values (equal when n is odd)."""
    n = F.col("n")
    return order_statistics(df, keys, value, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
