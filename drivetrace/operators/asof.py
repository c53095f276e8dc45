"""Nearest-in-time join with tolerance.

Rows on both sides are reduced to one narrow row per key and instant, so copies of one instant
never pile up.  Time is cut into slices that bound what one window holds; inside a slice the last
right row before and the first right row after each instant come from two running windows, and the
nearest right rows outside the slice are copied into it from a summary with one row per slice.  The
slice width therefore does not depend on the tolerance.  The summary itself is cut into stretches of many
slices, at least as long as the tolerance, each beside its two neighbours: it is never one window either, not
even without keys.  Wide left rows are shuffled once, for the final join, where AQE can split a hot instant.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.functions.timegrain import SECOND_US, floor_micros, micros

SLICE_SECONDS = 60.0
#: Slices in a stretch of the summary, if the tolerance does not ask for more.
STRETCH = 4096


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    tolerance_s: float,
    columns: Sequence[str],
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_ts_as: str = "right_ts",
    order: Sequence[str] = (),
    slice_s: float = SLICE_SECONDS,
) -> DataFrame:
    """Left rows with ``columns`` of the nearest right row of the same ``by``, or nulls.

    The distance must not exceed the tolerance.  At equal distance the earlier right row wins; of
    right rows at one instant the last in ``order`` counts looking back, the first looking ahead.
    ``right_ts_as`` names the matched right instant in the result.
    """
    width = int(slice_s * SECOND_US)
    tolerance = int(round(tolerance_s * SECOND_US))
    payload = F.struct(F.col("_t").alias("t"), *[F.col(c) for c in columns])
    rank = F.struct(*[F.col(c) for c in (order or columns)])

    # One row per key and instant on either side, combined on the map side.
    at_one = F.struct(rank.alias("o"), payload.alias("p"))
    r = (
        right.select(*by, micros(right_ts).alias("_t"), *dict.fromkeys([*columns, *order]))
        .dropna(subset=[*by, "_t"])
        .groupBy(*by, "_t")
        .agg(F.min(at_one).alias("_first"), F.max(at_one).alias("_last"))
        .select(*by, "_t", F.col("_first.p").alias("_first"), F.col("_last.p").alias("_last"), F.lit(False).alias("_is_left"))
    )
    wide = left.withColumn("_t", micros(left_ts))
    none = F.lit(None).cast(r.schema["_first"].dataType)
    l = (
        wide.select(*by, "_t")
        .dropna(subset=[*by, "_t"])
        .distinct()
        .select(*by, "_t", none.alias("_first"), none.alias("_last"), F.lit(True).alias("_is_left"))
    )
    l, r = (side.withColumn("_s", floor_micros(F.col("_t"), width)) for side in (l, r))

    # Every slice with left rows gets copies of the nearest right rows before and after it.  In
    # either direction a slice's left row comes first, so it sees only right rows of other slices.
    ends = r.groupBy(*by, "_s").agg(
        F.max(F.struct("_t", "_last")).alias("_e"), F.min(F.struct("_t", "_first")).alias("_b")
    )
    used = l.select(*by, "_s").distinct().withColumn("_used", F.lit(True))
    stretch = width * max(STRETCH, -(-tolerance // width))
    own = floor_micros(F.col("_s"), stretch)
    # What is near enough lies in the same stretch or in one beside it.
    around = F.explode(F.array(own - stretch, own, own + stretch)).alias("_p")
    summary = ends.select("*", F.lit(False).alias("_used"), around).unionByName(used.withColumn("_p", own), allowMissingColumns=True)
    slices = W.partitionBy(*by, "_p")
    earlier = (W.unboundedPreceding, -1)
    before = slices.orderBy("_s", F.desc("_used")).rowsBetween(*earlier)
    after = slices.orderBy(F.desc("_s"), F.desc("_used")).rowsBetween(*earlier)
    outside = F.array(
        F.last("_e._last", ignorenulls=True).over(before), F.last("_b._first", ignorenulls=True).over(after)
    )
    copies = (
        summary.select(*by, "_s", "_used", outside.alias("_outside"))
        .filter("_used")
        .select(*by, "_s", F.explode("_outside").alias("_p"))
        .filter(F.col("_p").isNotNull())
        .select(
            *by,
            F.col("_p.t").alias("_t"),
            F.col("_p").alias("_first"),
            F.col("_p").alias("_last"),
            F.lit(False).alias("_is_left"),
            "_s",
        )
    )

    # Inside a slice; at one instant the right row comes before the left one either way.
    part = W.partitionBy(*by, "_s")
    until_now = (W.unboundedPreceding, 0)
    forward = part.orderBy("_t", "_is_left").rowsBetween(*until_now)
    backward = part.orderBy(F.desc("_t"), "_is_left").rowsBetween(*until_now)
    back, ahead = F.col("_back"), F.col("_ahead")
    gap_back, gap_ahead = F.col("_t") - back["t"], ahead["t"] - F.col("_t")
    take_back = gap_back.isNotNull() & (gap_ahead.isNull() | (gap_back <= gap_ahead))
    nearest = (
        l.unionByName(r)
        .unionByName(copies)
        .withColumn("_back", F.last("_last", ignorenulls=True).over(forward))
        .withColumn("_ahead", F.last("_first", ignorenulls=True).over(backward))
        .filter("_is_left")
        .withColumn("_m", F.when(take_back, back).otherwise(ahead))
        .filter(F.abs(F.col("_t") - F.col("_m.t")) <= tolerance)
        .select(*by, "_t", "_m")
    )
    return wide.join(nearest, [*by, "_t"], "left").select(
        *[F.col(f"`{c}`") for c in left.columns],
        *[F.col(f"_m.{c}").alias(c) for c in columns],
        F.timestamp_micros("_m.t").alias(right_ts_as),
    )


def signed_gap_seconds(left_ts: str, right_ts: str):
    """Left minus right instant in seconds."""
    return (micros(left_ts) - micros(right_ts)) / F.lit(float(SECOND_US))


def match_sweep(joined: DataFrame, gap: str, tolerances_s: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Match counts and gap statistics per tolerance, from one join at the largest tolerance.

    One pass: the rows are aggregated per key with one set of counters for each tolerance, and the
    sets become rows afterwards.
    """
    names, aggs = [], [F.count("*").alias("total")]
    for n, tol in enumerate(tolerances_s):
        hit = F.when(F.abs(F.col(gap)) <= F.lit(float(tol)), F.col(gap))
        aggs.append(
            F.struct(
                F.lit(float(tol)).alias("tolerance_s"),
                F.count(hit).alias("matched"),
                F.avg(hit).alias("gap_mean"),
                F.stddev_samp(hit).alias("gap_std"),
                F.min(hit).alias("gap_min"),
                F.max(hit).alias("gap_max"),
            ).alias(f"_t{n}")
        )
        names.append(f"_t{n}")
    stats = joined.groupBy(*by).agg(*aggs)
    return (
        stats.select(*by, "total", F.explode(F.array(*names)).alias("_s"))
        .select(*by, "total", "_s.*")
        .withColumn("pct", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0))
    )
