"""Drive state: per-second state, enum generation, automatic masks, names, tracks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.config import (
    AUTO_LABEL,
    AUTO_VALUE_NEW,
    AUTO_VALUE_OLD,
    CUTOVER_UTC,
    GEN_DETECT,
    GEN_NEW,
    GEN_OLD,
    KEYS,
    STATES_NEW,
    STATES_OLD,
    TRACK_BUCKET_SECONDS,
)
from drivetrace.functions.numeric import number
from drivetrace.functions.timegrain import floor_time


def state_per_second(states: DataFrame, keys: Sequence[str] = KEYS, fine: str = "second") -> DataFrame:
    """Largest state of each second (not the last one)."""
    return states.groupBy(*keys, floor_time("ts", fine).alias("sec_time")).agg(
        F.max("system_state").alias("system_state")
    )


def value_by_date(start: str | Column) -> Column:
    """Automatic value by start date; an unknown date counts as new."""
    c = F.col(start) if isinstance(start, str) else start
    old = c < F.lit(CUTOVER_UTC).cast("timestamp")
    return F.when(old, F.lit(AUTO_VALUE_OLD)).otherwise(F.lit(AUTO_VALUE_NEW))


def detect_auto_value(
    states: DataFrame, starts: DataFrame, keys: Sequence[str] = KEYS, generation: str = GEN_DETECT
) -> DataFrame:
    """``keys, auto_value, basis`` for every row of ``starts`` (``keys, start_ts``).

    An explicit generation decides; else a state of 5 or more proves the new enum; else the date.
    """
    top = states.groupBy(*keys).agg(F.max(number("system_state")).alias("_top"))
    return decide_auto(starts.join(top, list(keys), "left"), keys, generation)


def auto_of_chunks(
    states_1s: DataFrame, chunks: DataFrame, keys: Sequence[str] = KEYS, generation: str = GEN_DETECT,
    known: DataFrame | None = None,
) -> DataFrame:
    """The automatic value of every chunk that has states, or of all ``known``, by its states and its start."""
    on = [c for c in keys if c in chunks.columns]
    top = states_1s.groupBy(*keys).agg(F.max(number("system_state")).alias("_top"))
    top = top if known is None else known.join(top, list(keys), "left")
    starts = chunks.select(*on, F.col("chunk_start").alias("start_ts"))
    return decide_auto(top.join(starts, on), keys, generation)


def decide_auto(tops: DataFrame, keys: Sequence[str], generation: str) -> DataFrame:
    """``keys, auto_value, basis`` from the largest state (``_top``) and ``start_ts``."""
    if generation in (GEN_NEW, GEN_OLD):
        fixed = AUTO_VALUE_NEW if generation == GEN_NEW else AUTO_VALUE_OLD
        return tops.select(*keys, F.lit(fixed).alias("auto_value"), F.lit("explicit").alias("basis"))
    seen = F.coalesce(F.col("_top") >= len(STATES_OLD), F.lit(False))
    return tops.select(
        *keys,
        F.when(seen, F.lit(AUTO_VALUE_NEW)).otherwise(value_by_date("start_ts")).alias("auto_value"),
        F.when(seen, F.lit("state")).otherwise(F.lit("date")).alias("basis"),
    )


def second_modes(states_1s: DataFrame, auto: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``keys, sec_time, is_auto`` of the seconds with a state: whether it is the automatic one of their key."""
    return (
        states_1s.filter(F.col("system_state").isNotNull())
        .join(auto.select(*keys, "auto_value"), list(keys))
        .select(*keys, "sec_time", (F.col("system_state") == F.col("auto_value")).alias("is_auto"))
    )


def auto_mask(state: Column, auto_value: Column) -> Column:
    """Whether a state, given as number or as enum name, means automatic driving; null does not."""
    by_number = number(state) == auto_value
    by_name = F.trim(state.cast("string")) == AUTO_LABEL
    return F.coalesce(by_number, F.lit(False)) | F.coalesce(by_name, F.lit(False))


def state_seconds(states_1s: DataFrame, auto: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Automatic and other seconds per key, beside the value and basis used; keys without a state have 0."""
    counts = auto.join(states_1s.select(*keys, "system_state"), list(keys), "left")
    hit = F.col("system_state") == F.col("auto_value")
    return counts.groupBy(*keys, "auto_value", "basis").agg(
        F.count_if(hit).alias("auto_seconds"), F.count_if(~hit).alias("other_seconds")
    )


def state_names(spark: SparkSession) -> DataFrame:
    """``auto_value, system_state, state_label, position`` for both generations (23 rows)."""
    rows = [
        F.struct(
            F.lit(auto).alias("auto_value"),
            F.lit(n).alias("system_state"),
            F.lit(name).alias("state_label"),
        )
        for auto, names in ((AUTO_VALUE_NEW, STATES_NEW), (AUTO_VALUE_OLD, STATES_OLD))
        for n, name in enumerate(names)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def label_states(df: DataFrame) -> DataFrame:
    """Add ``state_label`` by ``auto_value`` and ``system_state``; unknown states are ``"null"``.

    ``position`` orders the labels as in the enum, with ``"null"`` last.
    """
    named = df.join(state_names(df.sparkSession), ["auto_value", "system_state"], "left")
    last = F.when(F.col("auto_value") == AUTO_VALUE_NEW, len(STATES_NEW)).otherwise(len(STATES_OLD))
    known = F.col("state_label").isNotNull()
    return named.withColumn(
        "position", F.when(known, F.col("system_state")).otherwise(last).cast("int")
    ).withColumn("state_label", F.coalesce("state_label", F.lit("null")))


def state_track(
    states: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    bucket: str | int = TRACK_BUCKET_SECONDS,
    values: Sequence[str] = ("latitude", "longitude", "kp"),
    tie: Sequence[str] = (),
) -> DataFrame:
    """One position per time bucket and state: that of the earliest row, all values from one row."""
    first = F.min(F.struct("ts", *tie, *values)).alias("first")
    return (
        states.groupBy(*keys, floor_time("ts", bucket).alias("sec_time"), "system_state")
        .agg(first)
        .select(*keys, "sec_time", "system_state", *[F.col(f"first.{v}").alias(v) for v in values])
    )


def prefer_states(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``primary``; rows of ``fallback`` only for keys ``primary`` lacks altogether.

    ``primary`` rows whose state is not a number do not count.
    """
    usable = primary.withColumn("system_state", number("system_state")).filter(
        F.col("system_state").isNotNull()
    ).withColumn("system_state", F.col("system_state").cast("long").cast("string"))
    have = usable.select(*keys).distinct()
    rest = fallback.withColumn("system_state", F.col("system_state").cast("string"))
    return usable.withColumn("source", F.lit("primary")).unionByName(
        rest.join(have, list(keys), "left_anti").withColumn("source", F.lit("fallback"))
    )
