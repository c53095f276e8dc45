"""Join of instants with half-open intervals, planned as an equi-join on time buckets.

Each interval is repeated once per bucket it touches, each instant falls into one bucket, so the
join has an equality key.  Catalyst then broadcasts the intervals when their measured size is under
its threshold and otherwise shuffles both sides, where AQE splits a hot bucket; there is no nested
loop and no forced broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.functions.timegrain import GRAIN_US, floor_micros, micros

_BUCKET = "_bucket"


def over_buckets(intervals: DataFrame, start: str, end: str, width_us: int = GRAIN_US["day"]) -> DataFrame:
    """Repeat each non-empty interval once per bucket it touches."""
    lo = floor_micros(micros(start), width_us)
    hi = floor_micros(micros(end) - 1, width_us)
    return intervals.filter(F.col(start) < F.col(end)).withColumn(
        _BUCKET, F.explode(F.sequence(lo, hi, F.lit(width_us)))
    )


def join_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    on: Sequence[str] = (),
    how: str = "inner",
    width_us: int = GRAIN_US["day"],
) -> DataFrame:
    """Join rows to the intervals that hold their instant (``start <= ts < end``).

    ``how`` is inner, left_semi or left_anti.  The inner join adds the intervals' other columns.
    """
    p = points.withColumn(_BUCKET, floor_micros(micros(ts), width_us)).alias("p")
    i = over_buckets(intervals, start, end, width_us).alias("i")
    keys = [_BUCKET, *on]
    cond = (F.col(f"p.{ts}") >= F.col(f"i.{start}")) & (F.col(f"p.{ts}") < F.col(f"i.{end}"))
    for k in keys:
        cond = (F.col(f"p.{k}") == F.col(f"i.{k}")) & cond
    joined = p.join(i, cond, how)
    if how != "inner":
        return joined.drop(_BUCKET)
    extra = [c for c in intervals.columns if c not in on]
    return joined.select(
        *[F.col(f"p.`{c}`") for c in points.columns], *[F.col(f"i.`{c}`") for c in extra]
    )


def disjoint_pieces(
    intervals: DataFrame, start: str, end: str, on: Sequence[str] = (), width_us: int = GRAIN_US["day"]
) -> DataFrame:
    """The instants covered by any interval, as ranges that do not overlap, cut at bucket edges."""
    by = [_BUCKET, *on]
    clipped = over_buckets(intervals, start, end, width_us).select(
        *by,
        F.greatest(F.col(start), F.timestamp_micros(_BUCKET)).alias("_s"),
        F.least(F.col(end), F.timestamp_micros(F.col(_BUCKET) + F.lit(width_us))).alias("_e"),
    )
    in_order = W.partitionBy(*by).orderBy("_s", "_e")
    reach = F.max("_e").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0)
    return (
        clipped.withColumn("_opens", opens)
        .withColumn("_piece", F.sum("_opens").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*by, "_piece")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
        .drop("_piece")
    )


def flag_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    out: str,
    *,
    ts: str = "ts",
    start: str = "start_ts",
    end: str = "end_ts",
    on: Sequence[str] = (),
    width_us: int = GRAIN_US["day"],
) -> DataFrame:
    """All rows, with ``out`` telling whether any interval holds their instant; one pass."""
    p = points.withColumn(_BUCKET, floor_micros(micros(ts), width_us)).alias("p")
    i = disjoint_pieces(intervals, start, end, on, width_us).alias("i")
    cond = (F.col(f"p.{ts}") >= F.col("i._s")) & (F.col(f"p.{ts}") < F.col("i._e"))
    for k in [_BUCKET, *on]:
        cond = (F.col(f"p.{k}") == F.col(f"i.{k}")) & cond
    return p.join(i, cond, "left").select(
        *[F.col(f"p.`{c}`") for c in points.columns], F.col("i._s").isNotNull().alias(out)
    )
