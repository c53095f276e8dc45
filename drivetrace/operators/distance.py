"""Cumulative distance by position or by speed, and its continuation across chunks.

A running sum over one vehicle would put that vehicle into one task.  Here each vehicle's time is
cut into slices: sums run inside a slice, slice totals run over the few slices, and the two are
added.  A slice holds at most one row per fine-grain unit of its width, whatever the row count.

A step of a position is added up in two parts, whole 1/1024 metres and the rest.  Sums of the former
are exact (to 8.8e9 km) and those of the latter small, so a distance has the error of its last rounding
and of its steps, not one for each addition, and does not depend on where slices end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.config import CHUNK, KEYS, PERIOD, VEHICLE
from drivetrace.functions.geo import haversine_m
from drivetrace.functions.timegrain import floor_micros, floor_time, grain_us, micros

SLICE_UNITS = 4096
#: Part of a metre that steps are counted in; a power of two divides without rounding.
STEP_UNITS = 1024.0


def _slices(df: DataFrame, ts: str, width_us: int) -> DataFrame:
    return df.withColumn("_slice", floor_micros(micros(ts), width_us))


def running_distance(
    points: DataFrame, keys: Sequence[str], *, ts: str, lat: str, lon: str, width_us: int
) -> DataFrame:
    """Add ``cum_dist_km`` along time.  Instants must be unique per key.

    A step from or to an unknown position counts zero, as does the first one.
    """
    here = F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))

    def step(a: Column, b: Column) -> Column:
        return F.coalesce(haversine_m(a["lat"], a["lon"], b["lat"], b["lon"]), F.lit(0.0))

    def whole(m: str) -> Column:
        return F.rint(F.col(m) * STEP_UNITS) / STEP_UNITS

    in_slice = W.partitionBy(*keys, "_slice").orderBy(ts)
    so_far = in_slice.rowsBetween(W.unboundedPreceding, 0)
    inner = (
        _slices(points, ts, width_us)
        .withColumn("_here", here)
        .withColumn("_step", step(F.lag("_here").over(in_slice), F.col("_here")))
        .withColumn("_whole", whole("_step"))
        .withColumn("_rest", F.col("_step") - F.col("_whole"))
        .withColumns({"_run": F.sum("_whole").over(so_far), "_run_rest": F.sum("_rest").over(so_far)})
    )
    ends = inner.groupBy(*keys, "_slice").agg(
        F.sum("_whole").alias("_total"),
        F.sum("_rest").alias("_total_rest"),
        F.min_by("_here", ts).alias("_first"),
        F.max_by("_here", ts).alias("_last"),
    )
    over = W.partitionBy(*keys).orderBy("_slice")
    before = over.rowsBetween(W.unboundedPreceding, 0)

    def base(gap: Column, total: str) -> Column:
        return F.sum(gap + F.col(total)).over(before) - F.col(total)

    starts = (
        ends.withColumn("_gap", step(F.lag("_last").over(over), F.col("_first")))
        .withColumn("_gap_whole", whole("_gap"))
        .withColumn("_base", base(F.col("_gap_whole"), "_total"))
        .withColumn("_base_rest", base(F.col("_gap") - F.col("_gap_whole"), "_total_rest"))
        .select(*keys, "_slice", "_base", "_base_rest")
    )
    metres = (F.col("_base") + F.col("_run")) + (F.col("_base_rest") + F.col("_run_rest"))
    return (
        inner.join(starts, [*keys, "_slice"])
        .withColumn("cum_dist_km", metres / 1000.0)
        .drop("_slice", "_here", "_step", "_whole", "_rest", "_run", "_run_rest", "_base", "_base_rest")
    )


def running_total(
    rows: DataFrame, keys: Sequence[str], *, ts: str, value: str, out: str, width_us: int
) -> DataFrame:
    """Add the running sum of ``value`` along time; null until the first value."""
    in_slice = W.partitionBy(*keys, "_slice").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    sliced = _slices(rows, ts, width_us)
    inner = sliced.withColumn("_run", F.sum(value).over(in_slice))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_base", F.sum("_total").over(before))
        .select(*keys, "_slice", "_base")
    )
    known = F.col("_run").isNotNull() | F.col("_base").isNotNull()
    total = F.coalesce("_base", F.lit(0.0)) + F.coalesce("_run", F.lit(0.0))
    return (
        inner.join(starts, [*keys, "_slice"])
        .withColumn(out, F.when(known, total))
        .drop("_slice", "_run", "_base")
    )


def distance_by_position(
    control: DataFrame, keys: Sequence[str] = KEYS, fine: str = "second"
) -> DataFrame:
    """``keys, sec_time, cum_dist_km`` from the mean position of each second."""
    per_second = control.groupBy(*keys, floor_time("ts", fine).alias("sec_time")).agg(
        F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon")
    )
    return running_distance(
        per_second, keys, ts="sec_time", lat="lat", lon="lon", width_us=grain_us(fine) * SLICE_UNITS
    ).select(*keys, "sec_time", "cum_dist_km")


def distance_by_speed(speed: DataFrame, keys: Sequence[str] = KEYS, fine: str = "second") -> DataFrame:
    """``keys, sec_time, cum_dist_km`` from the mean speed of each second, one second each."""
    per_second = speed.groupBy(*keys, floor_time("ts", fine).alias("sec_time")).agg(
        F.avg("speed_mps").alias("_step")
    )
    return running_total(
        per_second, keys, ts="sec_time", value="_step", out="_m", width_us=grain_us(fine) * SLICE_UNITS
    ).select(*keys, "sec_time", (F.col("_m") / 1000.0).alias("cum_dist_km"))


def cumulative_distance(
    mode: str, control: DataFrame, speed: DataFrame, keys: Sequence[str] = KEYS, fine: str = "second"
) -> DataFrame:
    if mode == "latlon":
        return distance_by_position(control, keys, fine)
    if mode == "speed":
        return distance_by_speed(speed, keys, fine)
    raise ValueError(f"unknown distance mode: {mode}")


def stitch_distance(
    rows: DataFrame, period_keys: Sequence[str] = (VEHICLE, PERIOD), chunk: str = CHUNK
) -> DataFrame:
    """Continue ``cum_dist_km`` across the chunks of a period.

    A chunk starts where the largest distance among the rows of the chunks before it ends; chunks
    without distance move nothing, and null distances stay null.
    """
    reach = rows.groupBy(*period_keys, chunk).agg(F.max("cum_dist_km").alias("_reach"))
    before = W.partitionBy(*period_keys).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    offsets = reach.withColumn("_offset", F.coalesce(F.sum("_reach").over(before), F.lit(0.0)))
    return (
        rows.join(offsets.drop("_reach"), [*period_keys, chunk])
        .withColumn("cum_dist_km", F.col("cum_dist_km") + F.col("_offset"))
        .drop("_offset")
    )
