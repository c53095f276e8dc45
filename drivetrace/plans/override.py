"""Overrides as a user enters them, and saved ones applied again, all at once.

Recipes are rows. They meet the rows of all files in one join by file, and each target of the run is
replaced by one anti-join, so the plan does not grow with the number of recipes or files. What became of the
recipes, and the few columns of the rows that they use, are stored once and shared by all targets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.config import PERIOD, STATE_TOLERANCE_SECONDS, VEHICLE, CustomField, RunSpec
from drivetrace.operators.asof import SLICE_SECONDS
from drivetrace.operators.overrides import apply_overrides, latest_recipes, mask_by_state
from drivetrace.operators.periods import choose_by_label, choose_period
from drivetrace.operators.states import detect_auto_value
from drivetrace.plans.csv_import import override_results, override_rows
from drivetrace.sources.shared import stored
from drivetrace.sources.topic_csv import chosen_columns, file_columns, read_values

KEYS = (VEHICLE, PERIOD)
HIST_TARGET = "q3"
RECIPE = "file string, target string, column string, scale double, offset double, period_label string, drive_mode string"
#: One override: of a vehicle, a target and a period, which may be left to the file's times.
PLACE = (VEHICLE, "period_label", "target")


@dataclass(frozen=True)
class OverrideEntry:
    """Replace ``target`` of one vehicle and period by a column of a file.

    Without a label the period with the largest time overlap is taken, without a column the one that
    fits the target.  ``drive_mode`` is ``state``, ``auto`` or ``manual``.
    """

    path: str
    vehicle: object
    target: str
    column: str = ""
    scale: float = 1.0
    offset: float = 0.0
    period_label: str = ""
    drive_mode: str = "state"


def targets_of(spec: RunSpec) -> dict[str, tuple]:
    """What can be overridden: kind, result names of points and histogram, metric or field, column token."""
    out: dict[str, tuple] = {HIST_TARGET: ("hist", None, "hist", None, spec.hist_column)}
    for m in spec.metrics:
        out[m.key] = ("metric", f"metric:{m.key}", None, m, m.column)
    for f in spec.fields:
        kind = "custom_timeseries" if f.mode == "timeseries" else "custom_metric"
        out[f.key] = (kind, f"custom:{f.key}", f"customhist:{f.key}", f, f.column)
    return out


def replay(
    results: Mapping[str, DataFrame],
    recipes: DataFrame,
    rows: DataFrame,
    spec: RunSpec,
    periods: DataFrame,
    *,
    order: Sequence[str],
    states: DataFrame | None = None,
    positions: DataFrame | None = None,
    position_order: Sequence[str] = ("ts",),
    excludes: DataFrame | None = None,
    state_order: Sequence[str] = (),
    tolerance_s: float = STATE_TOLERANCE_SECONDS,
    slice_s: float = SLICE_SECONDS,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """The results with all recipes applied, and what became of each recipe that still holds.

    ``recipes`` has the vehicle, the columns of RECIPE and those of ``order``; of several for one vehicle,
    period and target the last in that order holds.  ``rows`` are those of all files: file, ts, sec_time,
    t_ns and values (map of numbers by column).  ``states`` and ``positions`` carry vehicle and period;
    periods with a vehicle apply to it only.  The second frame has the recipe's place, file, period and
    ``note``: a recipe without period, column or, in state mode, states changes nothing and says so; a file
    without rows in its period changes nothing either.
    """
    targets = targets_of(spec)
    known = recipes.filter(F.col("target").isin(*targets))
    files = stored(file_columns(rows), "override-files")
    told = _placed(known, files, periods, {t: x[4].split(".")[-1] for t, x in targets.items()}, order)
    told = stored(_noted(told, states, order), "override-recipes")
    used = told.filter(F.col("note") == "").select("file", VEHICLE, PERIOD, "target", "column", "scale", "offset", "drive_mode")
    value = F.element_at("values", F.col("column")) * F.col("scale") + F.col("offset")
    body = rows.join(used, "file").select(
        VEHICLE, PERIOD, "target", "drive_mode", "ts", "sec_time", "t_ns", value.alias("_value")
    )
    on = [VEHICLE, PERIOD] if VEHICLE in periods.columns else [PERIOD]
    inside = stored(override_rows(body, periods.select(*on, "start_ts", "end_ts"), on, excludes), "override-rows")
    masked = stored(_masked(inside, states, periods, spec, order=state_order, tolerance_s=tolerance_s, slice_s=slice_s), "override-masked")
    out = dict(results)
    for name, (kind, points, hist, target, _) in targets.items():
        if not {points, hist} & set(out):
            continue
        new = override_results(
            masked.filter(F.col("target") == name),
            kind,
            F.col("_value"),
            KEYS,
            name="value" if target is None or isinstance(target, CustomField) else target.name,
            threshold=0.0 if target is None else target.threshold if isinstance(target, CustomField) else spec.threshold(target),
            width=target.hist_bin if isinstance(target, CustomField) else spec.hist_bin,
            grain=spec.grain,
            positions=positions,
            position_order=position_order,
            tie=("t_ns",),
        )
        for part, result in (("points", points), ("hist", hist)):
            if part in new and result in out:
                out[result] = apply_overrides(out[result].drop("overridden"), new[part], KEYS)
    return out, told


def _placed(recipes: DataFrame, files: DataFrame, periods: DataFrame, tokens: Mapping[str, str], order: Sequence[str]) -> DataFrame:
    """The recipes that hold, each with its period and column, or null."""
    last = latest_recipes(recipes, PLACE, order)
    last = last.withColumn("token", F.element_at(F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv]), F.col("target")))
    last = chosen_columns(last, files, "column", "token").drop("token")
    extent = last.select(*PLACE, "file").join(files.select("file", "first_ts", "last_ts"), "file")
    on = [VEHICLE] if VEHICLE in periods.columns else []
    own = [c for c in PLACE if c not in on]
    named = choose_by_label(extent.filter("period_label <> ''"), periods, wanted="period_label", on=on)
    found = choose_period(extent.filter("period_label = ''"), periods, on=on, extra=own)
    chosen = named.select(*PLACE, "file", PERIOD).unionByName(found.select(*PLACE, "file", PERIOD))
    return last.join(chosen, [*PLACE, "file"], "left")


def _noted(placed: DataFrame, states: DataFrame | None, order: Sequence[str]) -> DataFrame:
    if states is None:
        have = F.lit(False)
    else:
        known = states.select(*KEYS).distinct().withColumn("_have", F.lit(True))
        placed, have = placed.join(known, list(KEYS), "left"), F.coalesce("_have", F.lit(False))
    note = (
        F.when(F.col(PERIOD).isNull(), F.lit("no period"))
        .when(F.col("column").isNull(), F.lit("no column"))
        .when((F.col("drive_mode") == "state") & ~have, F.lit("no states"))
        .otherwise(F.lit(""))
    )
    noted = placed.withColumn("note", note).drop("_have")
    # A label and a blank one may mean the same period: of those that can be applied the last holds.
    usable = latest_recipes(noted.filter("note = ''"), [VEHICLE, PERIOD, "target"], order)
    return usable.unionByName(noted.filter("note <> ''"))


def _masked(rows: DataFrame, states: DataFrame | None, periods: DataFrame, spec: RunSpec, **options) -> DataFrame:
    """Rows with ``is_auto``: set by the recipe's mode, or by the nearest state of vehicle and period."""
    fixed = rows.filter("drive_mode <> 'state'").withColumn("is_auto", F.col("drive_mode") == "auto")
    if states is None:
        return fixed
    on = list(KEYS) if VEHICLE in periods.columns else [PERIOD]
    starts = states.select(*KEYS).distinct().join(periods.select(*on, "start_ts"), on)
    auto = detect_auto_value(states, starts, KEYS, spec.generation).select(*KEYS, "auto_value")
    looked = rows.filter("drive_mode = 'state'").join(auto, list(KEYS))
    looked = mask_by_state(looked, states, KEYS, auto_value=F.col("auto_value"), **options)
    return fixed.unionByName(looked.select(*fixed.columns))


def recipes_frame(spark: SparkSession, entries: Sequence[OverrideEntry], vehicle_type: str) -> DataFrame:
    """Entries as recipes, in their order (``seq``)."""
    rows = [(n, e.path, e.target, e.column, float(e.scale), float(e.offset), e.period_label, e.drive_mode, str(e.vehicle)) for n, e in enumerate(entries)]
    df = spark.createDataFrame(rows, f"seq int, {RECIPE}, {VEHICLE} string")
    return df.withColumn(VEHICLE, F.col(VEHICLE).cast(vehicle_type))


def override(
    spark: SparkSession,
    results: Mapping[str, DataFrame],
    entries: OverrideEntry | Sequence[OverrideEntry],
    spec: RunSpec,
    periods: DataFrame,
    *,
    states: DataFrame | None = None,
    **sources,
) -> dict[str, DataFrame]:
    """The results with the targets of one or several entries replaced by their files.

    Refuses unknown targets and, before anything is read, the ``state`` mode without states; a key
    whose states are empty refuses when the result is computed.
    """
    entries = [entries] if isinstance(entries, OverrideEntry) else list(entries)
    unknown = {e.target for e in entries} - set(targets_of(spec))
    if unknown:
        raise ValueError(f"unknown override target {sorted(unknown)}")
    if states is None and any(e.drive_mode == "state" for e in entries):
        raise ValueError("drive mode 'state' needs states; give them or choose 'auto' or 'manual'")
    some = next(r for r in results.values() if VEHICLE in r.columns)
    recipes = recipes_frame(spark, entries, dict(some.dtypes)[VEHICLE])
    rows = read_values(spark, {e.path for e in entries})
    out, told = replay(results, recipes, rows, spec, periods, order=["seq"], states=states, **sources)
    refused = told.filter("note = 'no states'").select(F.raise_error(F.concat(F.lit("no states for "), F.col("file"))).cast("int").alias("_r"))
    stop = F.coalesce(refused.limit(1).scalar(), F.lit(0)) == 0
    changed = {n for n in out if out[n] is not results[n]}
    return {n: df.filter(stop) if n in changed else df for n, df in out.items()}
