"""Labelled periods, their chunks, and exclusion ranges."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.config import CHUNK, DEFAULT_SPLIT_MINUTES, PERIOD, VEHICLE, Range
from drivetrace.functions.timegrain import GRAIN_US, floor_micros, instant, micros, plus_seconds, within
from drivetrace.operators.intervals import flag_in_intervals, join_intervals, over_buckets


def _inline(spark: SparkSession, rows: list[Column], schema: str) -> DataFrame:
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def periods_frame(spark: SparkSession, ranges: Sequence[Range]) -> DataFrame:
    """``period_id, label, start_ts, end_ts`` in input order, numbered from 1."""
    rows = [
        F.struct(
            F.lit(n).alias(PERIOD),
            F.lit(r.label).alias("label"),
            instant(r.start).alias("start_ts"),
            instant(r.end).alias("end_ts"),
        )
        for n, r in enumerate(ranges, start=1)
    ]
    return with_default_labels(
        _inline(spark, rows, f"{PERIOD} int, label string, start_ts timestamp, end_ts timestamp")
    )


def excludes_frame(spark: SparkSession, ranges: Sequence[Range]) -> DataFrame:
    rows = [
        F.struct(instant(r.start).alias("start_ts"), instant(r.end).alias("end_ts")) for r in ranges
    ]
    return _inline(spark, rows, "start_ts timestamp, end_ts timestamp")


def with_default_labels(periods: DataFrame) -> DataFrame:
    """A blank label becomes ``期間`` and the period's number."""
    blank = F.concat(F.lit("期間"), F.col(PERIOD).cast("string"))
    return periods.withColumn("label", F.coalesce(F.nullif(F.col("label"), F.lit("")), blank))


def chunk_periods(periods: DataFrame, minutes: int) -> DataFrame:
    """One row per chunk of ``minutes``; the last one is clipped; no splitting if not positive."""
    start, end = micros("start_ts"), micros("end_ts")
    if minutes <= 0:
        return periods.withColumn(CHUNK, F.lit(0)).withColumns(
            {"chunk_start": F.col("start_ts"), "chunk_end": F.col("end_ts")}
        )
    step = F.lit(int(minutes) * GRAIN_US["minute"])
    return (
        periods.filter(F.col("start_ts") < F.col("end_ts"))
        .select("*", F.posexplode(F.sequence(start, end - 1, step)).alias(CHUNK, "_us"))
        .withColumn("chunk_start", F.timestamp_micros("_us"))
        .withColumn("chunk_end", F.least(F.timestamp_micros(F.col("_us") + step), F.col("end_ts")))
        .drop("_us")
    )


def tag_chunks(df: DataFrame, chunks: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Rows inside a chunk, with its period and chunk number; a row may lie in several periods.

    Chunks that carry a vehicle apply to that vehicle only.
    """
    on = [VEHICLE] if VEHICLE in chunks.columns else []
    windows = chunks.select(*on, PERIOD, CHUNK, "chunk_start", "chunk_end")
    return join_intervals(
        df, windows, ts=ts, start="chunk_start", end="chunk_end", on=on
    ).drop("chunk_start", "chunk_end")


def drop_excluded(df: DataFrame, excludes: DataFrame | None, *, ts: str = "ts") -> DataFrame:
    """Rows outside every exclusion range."""
    if excludes is None:
        return df
    return join_intervals(df, excludes, ts=ts, how="left_anti")


def flag_excluded(df: DataFrame, excludes: DataFrame, *, ts: str = "ts") -> DataFrame:
    """All rows, with ``excluded`` telling whether an exclusion range holds them."""
    return flag_in_intervals(df, excludes, "excluded", ts=ts)


def select_rows(
    df: DataFrame,
    chunks: DataFrame,
    excludes: DataFrame | None = None,
    *,
    ts: str = "ts",
    span: tuple[datetime, datetime] | None = None,
) -> DataFrame:
    """The row filter of every run: inside a chunk and outside all exclusions.

    ``span`` is the envelope of the periods when the caller knows it; it reaches the file scan, so
    files and row groups outside it are not read.
    """
    if span is not None:
        df = df.filter(within(ts, *span))
    return drop_excluded(tag_chunks(df, chunks, ts=ts), excludes, ts=ts)


def span_of(ranges: Sequence[Range]) -> tuple[datetime, datetime]:
    return min(r.start for r in ranges), max(r.end for r in ranges)


def union_excludes(*parts: DataFrame) -> DataFrame:
    """Distinct ranges; overlapping ones stay apart."""
    out = parts[0].select("start_ts", "end_ts")
    for p in parts[1:]:
        out = out.unionByName(p.select("start_ts", "end_ts"))
    return out.distinct()


def pending_excludes(current: DataFrame, applied: DataFrame) -> DataFrame:
    """Ranges entered since the last run."""
    keys = ["start_ts", "end_ts"]
    return current.join(applied.select(keys).distinct(), keys, "left_anti")


def exclude_from_points(points: DataFrame, by: Sequence[str], *, ts: str = "sec_time") -> DataFrame:
    """One range per selection, from its first point to one second after its last."""
    return points.groupBy(*by).agg(
        F.min(ts).alias("start_ts"), plus_seconds(F.max(ts), 1).alias("end_ts")
    )


def compare_window(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Envelope of the periods."""
    return periods.groupBy(*by).agg(
        F.min("start_ts").alias("win_start"), F.max("end_ts").alias("win_end")
    )


def suggested_split(periods: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Minutes that leave the longest period in one chunk; 60 without periods."""
    minutes = F.ceil((micros("end_ts") - micros("start_ts")) / F.lit(float(GRAIN_US["minute"])))
    longest = F.greatest(F.lit(1), F.max(minutes))
    return periods.groupBy(*by).agg(
        F.coalesce(F.when(F.count("*") > 0, longest), F.lit(DEFAULT_SPLIT_MINUTES))
        .cast("int")
        .alias("split_minutes")
    )


def choose_period(
    files: DataFrame,
    periods: DataFrame,
    *,
    file_key: str = "file",
    on: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Per file the period with the largest time overlap, the earlier number winning ties.

    ``files`` holds ``first_ts, last_ts`` per ``file_key`` and ``extra``; ``on`` names columns both
    sides must share.  Both sides meet in day buckets, so only ranges that touch the same day are
    compared.
    """
    f = over_buckets(files.withColumn("_to", plus_seconds("last_ts", 1e-6)), "first_ts", "_to").alias("f")
    p = over_buckets(periods, "start_ts", "end_ts").alias("p")
    low, high = F.greatest("first_ts", "start_ts"), F.least("last_ts", "end_ts")
    # Ranges that share several buckets meet in the first one only.
    meet = (low < high) & (F.col("f._bucket") == floor_micros(micros(low), GRAIN_US["day"]))
    for c in ("_bucket", *on):
        meet = (F.col(f"f.{c}") == F.col(f"p.{c}")) & meet
    candidates = f.join(p, meet).select(
        *[F.col(f"f.{c}").alias(c) for c in (*on, *extra, file_key)],
        F.col(f"p.{PERIOD}").alias(PERIOD),
        "label",
        ((micros(high) - micros(low)) / F.lit(1e6)).alias("overlap_s"),
    )
    best = F.min(F.struct((-F.col("overlap_s")).alias("neg"), F.col(PERIOD), F.col("label"))).alias("best")
    keys = [*on, *extra, file_key]
    return candidates.groupBy(*keys).agg(best).select(
        *keys,
        F.col(f"best.{PERIOD}").alias(PERIOD),
        F.col("best.label").alias("label"),
        (-F.col("best.neg")).alias("overlap_s"),
    )


def choose_by_label(
    files: DataFrame, periods: DataFrame, *, wanted: str = "wanted_label", on: Sequence[str] = ()
) -> DataFrame:
    """Files that name their period; of equal labels the first period is taken.

    ``on`` names columns both sides must share, such as the vehicle of periods that have one.
    """
    first = periods.groupBy(*on, F.col("label").alias(wanted)).agg(F.min(PERIOD).alias(PERIOD))
    return files.join(first, [*on, wanted], "inner").withColumn("label", F.col(wanted))


def attach_meta(periods: DataFrame, legs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metadata of the leg with the same label, as a map; of equal labels the latest leg counts."""
    rest = [c for c in columns if c != "guid"]
    latest = F.max(F.struct("start_ts", "guid", *rest)).alias("_leg")
    meta = (
        legs.groupBy(F.col("display_name").alias("label"))
        .agg(latest)
        .select("label", F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"_leg.{c}"))]).alias("meta"))
    )
    return periods.join(meta, "label", "left")
