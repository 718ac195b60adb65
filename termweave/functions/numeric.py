"""Numeric functions. Text that is no number is the default, never an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def to_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(default))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def safe_log(c: Column) -> Column:
    return F.when(c <= 0, 0.0).otherwise(F.ln(F.greatest(c, F.lit(0)) + 1.0))


def log_share(c: Column, full: float) -> Column:
    """The logarithm as a share of `full`, at most 1."""
    return F.when(c <= 0, 0.0).otherwise(clamp(F.ln(F.greatest(c, F.lit(0)) + 1.0) / full))


def round6(c: Column) -> Column:
    return F.round(c, 6)


def frequency_bonus(c: Column) -> Column:
    return F.least(F.ln(c + 1.0) / 20.0, F.lit(0.20))


def size_text(c: Column) -> Column:
    """Bytes as MB, or GB from one on."""
    gb = c / float(1 << 30)
    return F.when(gb >= 1, F.format_string("%.2f GB", gb)).otherwise(F.format_string("%.2f MB", c / float(1 << 20)))
