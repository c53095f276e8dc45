"""Replacing one metric of one period by rows from exported CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.config import LOCAL_TZ, STATE_TOLERANCE_SECONDS
from drivetrace.functions.generators import computed_once
from drivetrace.functions.numeric import number
from drivetrace.functions.text import parse_instant
from drivetrace.functions.timegrain import plus_seconds, whole_div
from drivetrace.operators.asof import asof_nearest
from drivetrace.operators.states import auto_mask


def mask_by_state(
    rows: DataFrame,
    states: DataFrame,
    by: Sequence[str],
    *,
    auto_value: Column,
    ts: str = "ts",
    tolerance_s: float = STATE_TOLERANCE_SECONDS,
    order: Sequence[str] = (),
    slice_s: float = 60.0,
) -> DataFrame:
    """Rows with the nearest ``system_state`` and ``is_auto``; without a near state not automatic."""
    joined = asof_nearest(
        rows,
        states,
        by=by,
        left_ts=ts,
        tolerance_s=tolerance_s,
        columns=["system_state"],
        order=order,
        right_ts_as="state_ts",
        slice_s=slice_s,
    )
    return joined.withColumn("is_auto", auto_mask(F.col("system_state"), auto_value))


def resolve_drive_mode(
    rows: DataFrame, mode: str, states: DataFrame | None = None, by: Sequence[str] = (), **options
) -> DataFrame:
    """Add ``is_auto`` by mode: ``auto`` and ``manual`` set it for all, ``state`` looks it up.

    Without states the ``state`` mode refuses; nothing is guessed.
    """
    if mode in ("auto", "manual"):
        return rows.withColumn("is_auto", F.lit(mode == "auto"))
    if mode != "state":
        raise ValueError(f"unknown drive mode: {mode}")
    if states is None:
        raise ValueError("drive mode 'state' needs states; give them or choose 'auto' or 'manual'")
    return mask_by_state(rows, states, by, **options)


def override_funnel(
    rows: DataFrame, value: Column, threshold: float, keys: Sequence[str]
) -> DataFrame:
    """Rows in the period, automatic ones among them, and those of them over the threshold."""
    auto = F.col("is_auto")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_period"),
        F.count_if(auto).alias("n_auto"),
        F.count_if(auto & (F.abs(value) >= F.lit(float(threshold)))).alias("n_threshold"),
    )


def apply_overrides(base: DataFrame, replacement: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replacement rows instead of the base rows with the same keys.

    Keys without replacement rows keep their base rows, so an empty replacement changes nothing.
    """
    replaced = replacement.select(*keys).distinct()
    return base.join(replaced, list(keys), "left_anti").withColumn(
        "overridden", F.lit(False)
    ).unionByName(replacement.withColumn("overridden", F.lit(True)), allowMissingColumns=True)


def latest_recipes(recipes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the recipes for one period and target, the one applied last.

    Combined on the map side: one row per key is shuffled, whatever its history.
    """
    rest = [c for c in recipes.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    return recipes.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def csv_bounds(rows: DataFrame, keys: Sequence[str], *, ts: str = "sec_time") -> DataFrame:
    """Period of imported rows: from their first second to one after their last."""
    return rows.groupBy(*keys).agg(F.min(ts).alias("start_ts"), plus_seconds(F.max(ts), 1).alias("end_ts"))


def epoch_to_instant(
    rows: DataFrame, column: str, keys: Sequence[str], out: str = "ts", naive_tz: str = LOCAL_TZ, *, refuse: bool = False
) -> DataFrame:
    """Time column of a file as instant, with the unit found per file.

    When at least 90 % of a file's values (and at least one) are numbers the median size tells
    nanoseconds, microseconds, milliseconds or seconds; otherwise the values are text.  The median
    is only compared with powers of ten, so counts per size class and the classes' extremes decide
    it exactly, without gathering the values.  With ``refuse`` a file of text of which none is a time
    raises.
    """
    # Smallest median of each unit, and its microseconds per unit.
    limits = (("s", 0.0, 1e6), ("ms", 1e11, 1e3), ("us", 1e14, 1.0), ("ns", 1e17, 1e-3))
    v = number(column)
    size = F.abs(v)

    text = parse_instant(F.col(column).cast("string"), naive_tz)
    aggs = [F.count("*").alias("_rows"), F.count(v).alias("_n")]
    if refuse:
        aggs.append(F.max(F.when(v.isNull(), text.isNotNull())).alias("_some"))
    for n, (_, low, _) in enumerate(limits):
        above = size >= limits[n + 1][1] if n + 1 < len(limits) else F.lit(False)
        here = F.when((size >= low) & ~above, size)
        aggs += [F.count(here).alias(f"_c{n}"), F.min(here).alias(f"_a{n}"), F.max(here).alias(f"_z{n}")]
    stats = rows.groupBy(*keys).agg(*aggs)

    upto = [F.lit(0)]
    for n in range(len(limits)):
        upto.append(upto[-1] + F.col(f"_c{n}"))

    def class_of(rank: Column) -> Column:
        return F.coalesce(*[F.when(rank < upto[n + 1], F.lit(n)) for n in range(len(limits))])

    low_rank, high_rank = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    low_class, high_class = class_of(low_rank), class_of(high_rank)
    top = F.coalesce(*[F.when(low_class == n, F.col(f"_z{n}")) for n in range(len(limits))])
    bottom = F.coalesce(*[F.when(high_class == n, F.col(f"_a{n}")) for n in range(len(limits))])
    between = (top + bottom) / 2.0
    mixed = F.coalesce(*[F.when(between >= limits[n][1], F.lit(n)) for n in reversed(range(len(limits)))])
    unit_no = F.when(low_class == high_class, low_class).otherwise(mixed)
    numeric = F.col("_n") >= F.greatest(F.lit(1), F.floor(F.col("_rows") * 0.9))
    units = stats.select(
        *keys,
        F.when(numeric, F.element_at(F.array(*[F.lit(x[0]) for x in limits]), unit_no + 1))
        .otherwise(F.lit("text"))
        .alias("time_unit"),
        F.when(numeric, F.element_at(F.array(*[F.lit(x[2]) for x in limits]), unit_no + 1)).alias("_us"),
        *([(numeric | F.col("_some")).alias("_some")] if refuse else []),
    )
    tagged = rows.join(units, list(keys))
    whole = F.col(column).try_cast("long")
    exact_us = (
        F.when(F.col("time_unit") == "ns", whole_div(whole, 1000))
        .when(F.col("time_unit") == "us", whole)
        .when(F.col("time_unit") == "ms", F.try_multiply(whole, F.lit(1000)))
        .when(F.col("time_unit") == "s", F.try_multiply(whole, F.lit(1_000_000)))
    )
    # Instants that epoch nanoseconds cannot hold are unreadable.
    in_reach = F.abs(v * F.col("_us")) < 9.2e15
    rounded = F.when(in_reach, F.floor(v * F.col("_us")).cast("long"))
    as_number = F.when(in_reach, F.timestamp_micros(F.coalesce(exact_us, rounded)))
    instant = F.when(F.col("time_unit") == "text", text).otherwise(as_number)
    if refuse:
        told = F.concat(F.lit("no readable time in "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
        instant = F.when(F.coalesce("_some", F.lit(False)), instant).otherwise(F.raise_error(told).cast("timestamp"))
    return tagged.select("*", computed_once(**{out: instant})).drop("_us", "_some")

