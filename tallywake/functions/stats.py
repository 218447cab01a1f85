"""Rates, intervals and rounding used by every grading job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400
Z95 = 1.96
DEFAULT_MIN_SAMPLE = 30


def round_half_up(value: Column, digits: int = 3) -> Column:
    """Half always goes up, also below zero (Spark's round goes away from zero)."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def round_int(value: Column) -> Column:
    return F.floor(value + 0.5).cast("bigint")


def publishable(n: Column, min_sample: int) -> Column:
    return n >= min_sample


def rate(hits: Column, n: Column, min_sample: int) -> Column:
    """Rounded share; null below the sample floor or when nothing was counted."""
    return F.when((n >= min_sample) & (n > 0), round_half_up(hits / n))


def _wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    z2 = Z95 * Z95
    share = hits / n
    denominator = F.lit(1.0) + F.lit(z2) / n
    centre = (share + F.lit(z2) / (n * 2)) / denominator
    spread = F.sqrt((share * (F.lit(1.0) - share)) / n + F.lit(z2) / (n * n * 4))
    half = (spread * Z95) / denominator
    return centre - half, centre + half


def wilson_low(hits: Column, n: Column) -> Column:
    low, _ = _wilson(hits, n)
    return F.when(n > 0, round_half_up(F.greatest(F.lit(0.0), low))).otherwise(F.lit(0.0))


def wilson_high(hits: Column, n: Column) -> Column:
    _, high = _wilson(hits, n)
    return F.when(n > 0, round_half_up(F.least(F.lit(1.0), high))).otherwise(F.lit(0.0))


def proportion(hits: str, n: str, min_sample: int, prefix: str = "") -> list[Column]:
    """rate, ci_low, ci_high and publishable columns for counts already present."""
    h, total = F.col(hits), F.col(n)
    shown = (total >= min_sample) & (total > 0)
    return [
        rate(h, total, min_sample).alias(f"{prefix}rate"),
        F.when(shown, wilson_low(h, total)).alias(f"{prefix}ci_low"),
        F.when(shown, wilson_high(h, total)).alias(f"{prefix}ci_high"),
        (total >= min_sample).alias(f"{prefix}publishable"),
    ]


def repaired_within(elapsed: Column, days: int | float) -> Column:
    return F.coalesce(elapsed <= int(days * DAY_SECONDS), F.lit(False))


def lift(share: Column, base_share: Column) -> Column:
    return F.when(base_share != 0, round_half_up(share / base_share))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ordered(lower: Column, middle: Column, upper: Column) -> Column:
    """Strictly rising, or null when any of the three was withheld."""
    known = lower.isNotNull() & middle.isNotNull() & upper.isNotNull()
    return F.when(known, (lower < middle) & (middle < upper))
