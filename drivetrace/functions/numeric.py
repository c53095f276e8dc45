"""Numeric coercion, linear transforms and bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: str | Column) -> Column:
    """Double or null: text that is no number and NaN both become null."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def linear(c: Column, scale: float, offset: float) -> Column:
    if scale == 1.0 and offset == 0.0:
        return c
    return c * F.lit(float(scale)) + F.lit(float(offset))


def bin_index(value: Column, width: float) -> Column:
    """Number of the bin holding ``value``; a long, so the grouping key is never a double."""
    return F.floor(value / F.lit(float(width))).cast("long")


def bin_start(index: Column, width: float) -> Column:
    return F.round(index * F.lit(float(width)), 9)


def bin_end(index: Column, width: float) -> Column:
    return F.round(F.round(index * F.lit(float(width)), 9) + F.lit(float(width)), 9)


def step_decimals(step: Column) -> Column:
    """Decimals that the notation of a step needs, read off its seven leading digits: 0.025 needs 3.

    At most 9; a step that is null, infinite or not positive counts as one with a single decimal.
    """
    notation = F.format_string("%.6e", step)
    digits = F.length(F.regexp_extract(notation, r"\.(\d*?)0*e", 1))
    power = F.regexp_extract(notation, r"e([+-]\d+)", 1).cast("int")
    needed = F.least(F.greatest(digits - power, F.lit(0)), F.lit(9))
    return F.when((step > 0) & (step < float("inf")), needed).otherwise(F.lit(1)).cast("int")
