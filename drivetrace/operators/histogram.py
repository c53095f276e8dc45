"""Value histograms split by automatic and manual driving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.config import KEYS, PERIOD, VEHICLE
from drivetrace.functions.numeric import bin_end, bin_index, bin_start
from drivetrace.functions.timegrain import floor_time

BIN = ("bin_start", "bin_end")
COUNTS = ("cnt_auto", "cnt_manual")


def _name_bins(counts: DataFrame, width: float) -> DataFrame:
    return counts.withColumns(
        {"bin_start": bin_start(F.col("bin_idx"), width), "bin_end": bin_end(F.col("bin_idx"), width)}
    )


def histogram(
    samples: DataFrame,
    modes: DataFrame,
    value: Column,
    width: float,
    keys: Sequence[str] = KEYS,
    *,
    fine: str = "second",
) -> DataFrame:
    """Counts per bin for automatic and manual seconds, in one pass over the samples.

    ``modes`` holds the seconds with a state and ``is_auto``.  Samples are counted per second and bin
    first (combined on the map side), so a second or bin holding many samples becomes one row before it
    meets the states.  Seconds without a state count in neither class; values that are null count in no bin.
    """
    counted = _per_second(samples, value, width, keys, fine)
    return _name_bins(
        counted.join(modes, [*keys, "sec_time"])
        .groupBy(*keys, "bin_idx")
        .agg(
            F.coalesce(F.sum(F.when(F.col("is_auto"), F.col("_n"))), F.lit(0)).alias("cnt_auto"),
            F.coalesce(F.sum(F.when(~F.col("is_auto"), F.col("_n"))), F.lit(0)).alias("cnt_manual"),
        ),
        width,
    ).drop("bin_idx")


def histogram_of_mode(
    samples: DataFrame,
    modes: DataFrame,
    value: Column,
    width: float,
    mode: str,
    keys: Sequence[str] = KEYS,
    *,
    fine: str = "second",
) -> DataFrame:
    """Counts per bin (``cnt_<mode>``) for the seconds of one mode, ``auto`` or ``manual``, alone."""
    if mode not in ("auto", "manual"):
        raise ValueError(f"unknown mode: {mode}")
    seconds = modes.filter(F.col("is_auto") == F.lit(mode == "auto")).select(*keys, "sec_time")
    counted = _per_second(samples, value, width, keys, fine).join(seconds, [*keys, "sec_time"])
    return _name_bins(counted.groupBy(*keys, "bin_idx").agg(F.sum("_n").alias(f"cnt_{mode}")), width).drop("bin_idx")


def _per_second(samples: DataFrame, value: Column, width: float, keys: Sequence[str], fine: str) -> DataFrame:
    """Samples with a value, counted per second and bin."""
    return (
        samples.withColumn("_v", value)
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, floor_time("ts", fine).alias("sec_time"), bin_index(F.col("_v"), width).alias("bin_idx"))
        .agg(F.count("*").alias("_n"))
    )


def masked_histogram(
    samples: DataFrame, value: Column, auto: Column, width: float, keys: Sequence[str]
) -> DataFrame:
    """The same for samples that already know whether they were driven automatically."""
    return _name_bins(
        samples.withColumn("_v", value)
        .withColumn("_auto", auto)
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, bin_index(F.col("_v"), width).alias("bin_idx"))
        .agg(F.count_if(F.col("_auto")).alias("cnt_auto"), F.count_if(~F.col("_auto")).alias("cnt_manual")),
        width,
    ).drop("bin_idx")


def with_ratios(hist: DataFrame, keys: Sequence[str] = KEYS, modes: Sequence[str] = ("auto", "manual")) -> DataFrame:
    """Add each count's share of its key's total; 0 where the total is 0."""
    total = W.partitionBy(*keys)
    return hist.withColumns(
        {
            f"ratio_{m}": F.when(
                F.sum(f"cnt_{m}").over(total) > 0, F.col(f"cnt_{m}") / F.sum(f"cnt_{m}").over(total)
            ).otherwise(F.lit(0.0))
            for m in modes
        }
    )


def merge_modes(auto: DataFrame, manual: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Full outer join of two counted histograms on their bins; what one side lacks is 0."""
    on = [*keys, *BIN]
    merged = auto.join(manual, on, "full")
    return merged.select(
        *on,
        *[
            F.coalesce(F.col(c), F.lit(0)).alias(c)
            for c in ("cnt_auto", "ratio_auto", "cnt_manual", "ratio_manual")
        ],
    )


def sum_bins(hist: DataFrame, keys: Sequence[str] = (VEHICLE, PERIOD)) -> DataFrame:
    """Histograms of several chunks as one, ratios recomputed."""
    summed = hist.groupBy(*keys, *BIN).agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_ratios(summed, keys)


def rebin(hist: DataFrame, target: float, keys: Sequence[str] = (VEHICLE, PERIOD)) -> DataFrame:
    """Coarser bins: the nearest whole multiple of the present width to ``target``.

    Where that multiple is 1 the histogram stays as it is.  Halves round to even.
    """
    base = hist.groupBy(*keys).agg(
        F.median(F.round(F.col("bin_end") - F.col("bin_start"), 9)).alias("_base")
    )
    times = F.greatest(F.lit(1.0), F.rint(F.lit(float(target)) / F.col("_base")))
    plan = base.withColumn("_n", F.when(F.col("_base") > 0, times).otherwise(1.0)).withColumn(
        "_w", F.round(F.col("_n") * F.col("_base"), 9)
    )
    coarse = F.col("_n") > 1
    start = F.round(F.floor(F.col("bin_start") / F.col("_w") + 1e-9) * F.col("_w"), 9)
    moved = (
        hist.join(plan, list(keys))
        .withColumn("_s", F.when(coarse, start).otherwise(F.col("bin_start")))
        .withColumn("_e", F.when(coarse, F.round(F.col("_s") + F.col("_w"), 9)).otherwise(F.col("bin_end")))
        .select(*keys, F.col("_s").alias("bin_start"), F.col("_e").alias("bin_end"), *COUNTS)
    )
    return sum_bins(moved, keys)


def smooth(
    hist: DataFrame, columns: Sequence[str], window: int, keys: Sequence[str] = (VEHICLE, PERIOD)
) -> DataFrame:
    """Centred moving average over neighbouring bin rows, shorter at the edges."""
    w = max(1, int(window))
    around = W.partitionBy(*keys).orderBy("bin_start").rowsBetween(-(w // 2), (w - 1) // 2)
    return hist.withColumns(
        {f"{c}_smooth": F.avg(F.coalesce(F.col(c), F.lit(0.0))).over(around) for c in columns}
    )
