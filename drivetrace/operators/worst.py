"""Worst sample per window while driving automatically, and mean time series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.config import KEYS, Grain
from drivetrace.functions.numeric import linear
from drivetrace.functions.timegrain import floor_time


def _worst(size: str, name: str, carry: Sequence[str], tie: Sequence[str]) -> Column:
    """The row with the largest size, then earliest time, then smallest tie-break column."""
    return F.min(F.struct((-F.col(size)).alias("_neg"), *tie, F.col(name), *carry)).alias("_w")


def worst_per_second(
    samples: DataFrame,
    value: Column,
    name: str,
    threshold: float,
    keys: Sequence[str] = KEYS,
    *,
    fine: str = "second",
    carry: Sequence[str] = ("latitude", "longitude"),
    tie: Sequence[str] = ("ts",),
) -> DataFrame:
    """Per second the sample of largest absolute value, if that reaches the threshold.

    The threshold comes before the grouping, and the grouping combines on the map side, so one row
    per second and task is shuffled.
    """
    return (
        samples.withColumn(name, value)
        .withColumn("_size", F.abs(F.col(name)))
        .filter((F.col("_size") >= F.lit(float(threshold))) & ~F.isnan("_size"))
        .groupBy(*keys, floor_time("ts", fine).alias("sec_time"))
        .agg(_worst("_size", name, carry, tie))
        .select(
            *keys,
            "sec_time",
            *[F.col(f"_w.{c}").alias(c) for c in (*tie, name, *carry)],
            (-F.col("_w._neg")).alias(f"abs_{name}"),
        )
    )


def worst_per_window(
    samples: DataFrame,
    auto_seconds: DataFrame,
    value: Column,
    name: str,
    threshold: float,
    keys: Sequence[str] = KEYS,
    *,
    distance: DataFrame | None = None,
    grain: Grain = Grain(),
    carry: Sequence[str] = ("latitude", "longitude"),
    tie: Sequence[str] = ("ts",),
    along: Sequence[str] = (),
) -> DataFrame:
    """Worst second of each window among the automatic seconds, with its distance.

    ``auto_seconds`` holds ``keys, sec_time`` of the seconds that count, and the columns ``along`` of
    theirs that come with the result.
    """
    picks = worst_per_second(
        samples, value, name, threshold, keys, fine=grain.fine, carry=carry, tie=tie
    )
    driven = picks.join(auto_seconds.select(*keys, "sec_time", *along), [*keys, "sec_time"])
    best = (
        driven.groupBy(*keys, floor_time("sec_time", grain.coarse).alias("win"))
        .agg(_worst(f"abs_{name}", name, (*carry, *along), ("sec_time", *tie)))
        .select(
            *keys,
            "win",
            F.col("_w.sec_time").alias("sec_time"),
            *[F.col(f"_w.{c}").alias(c) for c in carry],
            F.col(f"_w.{name}").alias(name),
            (-F.col("_w._neg")).alias(f"abs_{name}"),
            *[F.col(f"_w.{c}").alias(c) for c in along],
        )
    )
    if distance is None:
        return best
    return best.join(distance, [*keys, "sec_time"], "left")


def auto_seconds(states_1s: DataFrame, auto: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Seconds whose state is the automatic one of their key."""
    return (
        states_1s.join(auto.select(*keys, "auto_value"), list(keys))
        .filter(F.col("system_state") == F.col("auto_value"))
        .select(*keys, "sec_time")
    )


def mean_per_second(
    samples: DataFrame,
    value: Column,
    keys: Sequence[str] = KEYS,
    *,
    scale: float = 1.0,
    offset: float = 0.0,
    fine: str = "second",
    with_position: bool = True,
    distance: DataFrame | None = None,
) -> DataFrame:
    """Mean of each second, transformed after averaging, with mean position and distance."""
    means = [F.avg(value).alias("_mean")]
    if with_position:
        means += [F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude")]
    out = (
        samples.groupBy(*keys, floor_time("ts", fine).alias("sec_time"))
        .agg(*means)
        .withColumn("value", linear(F.col("_mean"), scale, offset))
        .drop("_mean")
    )
    if distance is None:
        return out
    return out.join(distance, [*keys, "sec_time"], "left")
