"""Exported CSV as new periods, and as replacement for one metric of a fetched period."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.config import HIST_BASE_BIN, STATE_TOLERANCE_SECONDS, Grain, RunSpec
from drivetrace.functions.numeric import number
from drivetrace.functions.timegrain import floor_time
from drivetrace.operators.asof import SLICE_SECONDS, asof_nearest
from drivetrace.operators.histogram import masked_histogram, with_ratios
from drivetrace.operators.intervals import join_intervals
from drivetrace.operators.overrides import csv_bounds, resolve_drive_mode
from drivetrace.operators.periods import drop_excluded
from drivetrace.operators.positions import attach_positions
from drivetrace.operators.states import auto_mask, decide_auto, detect_auto_value
from drivetrace.sources.shared import stored
from drivetrace.sources.topic_csv import chosen_columns, file_columns, read_topic_csv, read_values, state_rows

_POSITION = ("latitude", "longitude", "cum_dist_km")


def _without_position(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in _POSITION})


def csv_metric(
    rows: DataFrame, value: Column, name: str, threshold: float, keys: Sequence[str], grain: Grain = Grain(),
    tie: Sequence[str] = ("ts",),
) -> DataFrame:
    """Worst automatic row per window; the earliest row wins ties; no position of its own."""
    size = F.abs(F.col(name))
    best = F.min(F.struct((-size).alias("_neg"), *tie, "sec_time", name)).alias("_w")
    return _without_position(
        rows.filter("is_auto")
        .withColumn(name, value)
        .filter(size >= F.lit(float(threshold)))
        .groupBy(*keys, floor_time("sec_time", grain.coarse).alias("win"))
        .agg(best)
        .select(
            *keys,
            "win",
            F.col("_w.sec_time").alias("sec_time"),
            F.col(f"_w.{name}").alias(name),
            (-F.col("_w._neg")).alias(f"abs_{name}"),
        )
    )


def csv_timeseries(rows: DataFrame, value: Column, keys: Sequence[str]) -> DataFrame:
    """Mean of each second over all rows with a value."""
    return _without_position(
        rows.withColumn("_v", value)
        .filter(F.col("_v").isNotNull())
        .groupBy(*keys, "sec_time")
        .agg(F.avg("_v").alias("value"))
    )


def csv_hist(rows: DataFrame, value: Column, width: float, keys: Sequence[str]) -> DataFrame:
    return with_ratios(masked_histogram(rows, value, F.col("is_auto"), width, keys), keys)


def masked_rows(
    rows: DataFrame,
    states: DataFrame | None,
    keys: Sequence[str],
    mode: str,
    generation: str,
    starts: DataFrame,
    **options,
) -> DataFrame:
    """Rows with ``is_auto``; the automatic value is found per key from its states and its start."""
    if mode != "state" or states is None:
        return resolve_drive_mode(rows, mode, states)
    auto = detect_auto_value(states, starts, keys, generation).select(*keys, "auto_value")
    return resolve_drive_mode(
        rows.join(auto, list(keys)), mode, states, keys, auto_value=F.col("auto_value"), **options
    )


@dataclass(frozen=True)
class CsvEntry:
    """One file to import: under which label, for which target, from which column."""

    label: str
    path: str
    target: str
    column: str = ""
    scale: float = 1.0
    offset: float = 0.0


def csv_periods(
    rows: DataFrame,
    entries: DataFrame,
    spec: RunSpec,
    *,
    states: DataFrame | None = None,
    excludes: DataFrame | None = None,
    state_order: Sequence[str] = ("t_ns",),
    tolerance_s: float = STATE_TOLERANCE_SECONDS,
    slice_s: float = SLICE_SECONDS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Results of imported files by name, keyed by ``label``, with ``bounds`` of the new periods, and notes.

    ``rows`` are those of all files: file, ts, sec_time, t_ns and values (map of numbers by column).
    ``entries`` has label, file, target, column, scale and offset; a blank column is guessed. One plan
    serves all of them, however many there are; the rows they use are stored once and read by each result. ``states`` (ts, system_state) hold for every file; without
    any state row all rows count as automatic. Built-in metrics take scale and offset from the entry,
    custom fields from the field; a time series gets no histogram. The notes are the entries with their
    column and ``note``, which tells why an entry cannot be used, or is empty.
    """
    targets = {m.key: ("metric", m.name, spec.threshold(m), m.column, None) for m in spec.metrics}
    for f in spec.fields:
        targets[f.key] = ("series" if f.mode == "timeseries" else "custom", "value", f.threshold, f.column, f)

    def by_target(of) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for t, v in targets.items() for x in (t, of(v))]), F.col("target"))

    told = entries.withColumn("token", by_target(lambda v: v[3].split(".")[-1]))
    files = stored(file_columns(rows), "import-files")
    told = chosen_columns(told, files, "column", "token").join(files.select("file", F.lit(True).alias("_rows")), "file", "left")
    note = (
        F.when(F.col("token").isNull(), F.lit("unknown target"))
        .when(F.col("_rows").isNull(), F.lit("no rows"))
        .when(F.col("column").isNull(), F.lit("no value column"))
        .otherwise(F.lit(""))
    )
    told = stored(told.withColumn("note", note).drop("token", "_rows"), "import-entries")
    own = by_target(lambda v: v[4] is not None)
    scale = F.when(own, by_target(lambda v: v[4].scale if v[4] else 1.0)).otherwise(F.col("scale"))
    offset = F.when(own, by_target(lambda v: v[4].offset if v[4] else 0.0)).otherwise(F.col("offset"))
    used = told.filter("note = ''").select("file", "label", "target", "column", scale.alias("_scale"), offset.alias("_offset"))
    inside = drop_excluded(rows, excludes, ts="sec_time")
    if states is not None:
        inside = asof_nearest(
            inside, states, by=[], tolerance_s=tolerance_s, columns=["system_state"], order=state_order, right_ts_as="state_ts", slice_s=slice_s
        )
    value = F.element_at("values", F.col("column")) * F.col("_scale") + F.col("_offset")
    columns = ["label", "target", "sec_time", "t_ns", *(["system_state"] if states is not None else [])]
    body = stored(inside.join(used, "file").select(*columns, value.alias("_value")), "import-rows")
    bounds = csv_bounds(body, ["label"])
    body = _automatic(body, states, bounds, spec.generation)
    out = {"bounds": bounds}
    for target, (kind, name, threshold, _, cf) in targets.items():
        mine = body.filter(F.col("target") == target)
        if kind == "series":
            out[f"custom:{target}"] = csv_timeseries(mine, F.col("_value"), ["label"])
            continue
        prefix = "metric" if cf is None else "custom"
        out[f"{prefix}:{target}"] = csv_metric(mine, F.col("_value"), name, threshold, ["label"], spec.grain, ("t_ns",))
        if cf is not None:
            out[f"customhist:{target}"] = csv_hist(mine, F.col("_value"), cf.hist_bin, ["label"])
    return out, told


def _automatic(body: DataFrame, states: DataFrame | None, bounds: DataFrame, generation: str) -> DataFrame:
    """``is_auto`` of rows that carry their nearest state; the automatic value is found per label."""
    if states is None:
        return body.withColumn("is_auto", F.lit(True))
    one = states.agg(F.struct(F.max(number("system_state")).alias("top"), F.count("*").alias("n"))).scalar()
    auto = decide_auto(bounds.withColumn("_top", one["top"]), ["label"], generation).select("label", "auto_value", (one["n"] > 0).alias("_some"))
    auto = stored(auto, "import-labels")
    return body.join(auto, "label").withColumn("is_auto", ~F.col("_some") | auto_mask(F.col("system_state"), F.col("auto_value")))


def read_csv_periods(
    spark: SparkSession,
    entries: Sequence[CsvEntry],
    spec: RunSpec,
    *,
    state_path: str | None = None,
    excludes: DataFrame | None = None,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """``csv_periods`` of files; files that cannot be opened, and the state file, have no rows."""

    def readable(path: str) -> bool:
        try:
            spark.read.text(path)
        except AnalysisException:
            return False
        return path != state_path

    table = spark.createDataFrame(
        [(e.label, e.path, e.target, e.column, float(e.scale), float(e.offset)) for e in entries],
        "label string, file string, target string, column string, scale double, offset double",
    )
    rows = read_values(spark, [p for p in dict.fromkeys(e.path for e in entries) if readable(p)])
    states = state_rows(read_topic_csv(spark, state_path)) if state_path else None
    return csv_periods(rows, table, spec, states=states, excludes=excludes)


def override_rows(
    rows: DataFrame, windows: DataFrame, keys: Sequence[str], excludes: DataFrame | None = None
) -> DataFrame:
    """Replacement rows inside their period (by second) and outside the exclusions."""
    clipped = join_intervals(rows, windows, ts="sec_time", on=keys, how="left_semi")
    return drop_excluded(clipped, excludes, ts="sec_time")


def override_results(
    rows: DataFrame,
    target: str,
    value: Column,
    keys: Sequence[str],
    *,
    name: str = "value",
    threshold: float = 0.0,
    width: float = HIST_BASE_BIN,
    grain: Grain = Grain(),
    positions: DataFrame | None = None,
    position_order: Sequence[str] = ("ts",),
    tolerance_s: float | None = None,
    tie: Sequence[str] = ("ts",),
) -> dict[str, DataFrame]:
    """Replacement frames of one target: ``points`` and, where the target has one, ``hist``.

    Targets are ``metric``, ``hist``, ``custom_metric`` and ``custom_timeseries``.  Here a time
    series gets a histogram too.  Points take their position from ``positions``.
    """
    out = {}
    if target in ("hist", "custom_metric", "custom_timeseries"):
        out["hist"] = csv_hist(rows, value, width, keys)
    if target in ("metric", "custom_metric"):
        out["points"] = csv_metric(rows, value, name, threshold, keys, grain, tie)
    elif target == "custom_timeseries":
        out["points"] = csv_timeseries(rows, value, keys)
    if not out:
        raise ValueError(f"unknown override target: {target}")
    if positions is not None and "points" in out:
        out["points"] = attach_positions(
            out["points"], positions, keys, order=position_order, tolerance_s=tolerance_s
        )
    return out
