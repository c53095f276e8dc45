"""Putting periods side by side: unions, axes, range checks, backend comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.config import PERIOD
from drivetrace.functions.numeric import number
from drivetrace.functions.timegrain import micros, to_local
from drivetrace.operators.histogram import smooth


def union_periods(*results: DataFrame) -> DataFrame:
    """Rows of several results under one schema; columns a result lacks are null."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def with_labels(rows: DataFrame, periods: DataFrame) -> DataFrame:
    return rows.join(periods.select(PERIOD, "label"), PERIOD)


def visible(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Only the chosen periods; choosing none shows none."""
    return rows.filter(F.col("label").isin(*labels)) if labels else rows.filter(F.lit(False))


def axis_mode(rows: DataFrame, wanted: str, by: Sequence[str]) -> DataFrame:
    """Axis that each compared set of rows can be drawn on, as ``by..., x_mode``.

    Distance needs one known distance anywhere in the set; elapsed time needs a time column; else
    the axis is time.
    """
    if wanted == "distance" and "cum_dist_km" in rows.columns:
        known = F.count(number("cum_dist_km")) > 0
        mode = F.when(known, F.lit("distance")).otherwise(F.lit("time"))
    elif wanted == "elapsed" and "sec_time" in rows.columns:
        mode = F.when(F.count("*") > 0, F.lit("elapsed")).otherwise(F.lit("time"))
    else:
        mode = F.first(F.lit("time"))
    return rows.groupBy(*by).agg(mode.alias("x_mode"))


def xy_rows(rows: DataFrame, value: str, mode: str, start: str | Column | None = None) -> DataFrame:
    """Rows with ``x`` and a numeric value, without those lacking either.

    ``distance`` is in km, ``elapsed`` in minutes since ``start``, ``time`` is local wall-clock.
    """
    if mode == "distance":
        x = number("cum_dist_km")
    elif mode == "elapsed":
        if start is None:
            raise ValueError("elapsed time needs the start of the period")
        x = (micros("sec_time") - micros(start)) / F.lit(6e7)
    elif mode == "time":
        x = to_local("sec_time")
    else:
        raise ValueError(f"unknown axis mode: {mode}")
    return rows.withColumn(value, number(value)).withColumn("x", x).dropna(subset=["x", value])


def _check(lo: Column, hi: Column, limits: tuple[float, float], item: str, axis: str) -> Column:
    low, high = F.lit(float(limits[0])), F.lit(float(limits[1]))
    return F.struct(
        F.lit(item).alias("item"),
        F.lit(axis).alias("axis"),
        low.alias("limit_lo"),
        high.alias("limit_hi"),
        lo.alias("data_lo"),
        hi.alias("data_hi"),
        (lo.isNotNull() & ((lo < low) | (hi > high))).alias("out_of_range"),
    )


def _as_rows(df: DataFrame, aggs: list[Column], checks: list[Column]) -> DataFrame:
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*checks))).filter(F.col("data_lo").isNotNull())


def scatter_range_check(
    rows: DataFrame,
    item: str,
    value: str,
    *,
    ylim: tuple[float, float] | None = None,
    xlim: tuple[float, float] | None = None,
) -> DataFrame:
    """Data extremes against the axis limits, over all series at once.

    The x limit holds only on the distance axis, so it is checked only if a distance is known.
    """
    aggs, checks = [], []
    if ylim is not None:
        aggs += [F.min(number(value)).alias("ylo"), F.max(number(value)).alias("yhi")]
        checks.append(_check(F.col("ylo"), F.col("yhi"), ylim, item, "y"))
    if xlim is not None and "cum_dist_km" in rows.columns:
        aggs += [F.min(number("cum_dist_km")).alias("xlo"), F.max(number("cum_dist_km")).alias("xhi")]
        checks.append(_check(F.col("xlo"), F.col("xhi"), xlim, item, "x"))
    return _as_rows(rows, aggs, checks)


def hist_range_check(
    hist: DataFrame,
    item: str,
    keys: Sequence[str],
    *,
    xlim: tuple[float, float] | None = None,
    ylim: tuple[float, float] | None = None,
    window: int = 1,
) -> DataFrame:
    """Bins against the x limits and smoothed shares, counted from 0, against the y limits."""
    aggs, checks, source = [], [], hist
    if xlim is not None:
        aggs += [F.min("bin_start").alias("xlo"), F.max("bin_end").alias("xhi")]
        checks.append(_check(F.col("xlo"), F.col("xhi"), xlim, item, "x"))
    if ylim is not None:
        source = smooth(hist, ("ratio_auto", "ratio_manual"), window, keys)
        top = F.max(F.greatest("ratio_auto_smooth", "ratio_manual_smooth"))
        aggs += [F.when(top.isNotNull(), F.lit(0.0)).alias("zlo"), top.alias("zhi")]
        checks.append(_check(F.col("zlo"), F.col("zhi"), ylim, item, "y"))
    return _as_rows(source, aggs, checks)


def range_warnings(*checks: DataFrame) -> DataFrame:
    """Distinct violations of several checks."""
    return union_periods(*checks).filter("out_of_range").drop("out_of_range").distinct()


def new_warnings(now: DataFrame, before: DataFrame) -> DataFrame:
    """Violations that the last look did not have."""
    return now.subtract(before)


def backend_difference(
    a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Full outer join of two result sets, with absolute differences that take null and NaN as 0."""
    left = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in columns])
    right = b.select(*on, *[F.col(c).alias(f"{c}_b") for c in columns])
    zero = F.lit(0.0)
    return left.join(right, list(on), "full").withColumns(
        {
            f"{c}_abs_diff": F.abs(F.coalesce(number(f"{c}_a"), zero) - F.coalesce(number(f"{c}_b"), zero))
            for c in columns
        }
    )
