"""Imported CSV as periods, and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.config import CHUNK, GEN_DETECT, PERIOD, VEHICLE
from drivetrace.functions.timegrain import floor_time
from drivetrace.operators.overrides import (
    apply_overrides,
    csv_bounds,
    latest_recipes,
    override_funnel,
    resolve_drive_mode,
)
from drivetrace.operators.periods import drop_excluded
from drivetrace.plans.csv_import import (
    csv_hist,
    csv_metric,
    csv_timeseries,
    masked_rows,
    override_results,
    override_rows,
)
from drivetrace.plans.run import metric
from drivetrace.registry.base import (
    GRAIN,
    SLICE_S,
    TOLERANCE_S,
    excludes,
    nearest_sql,
    oracle,
    periods,
    query,
    run_of,
    table,
    telemetry,
)
from drivetrace.registry.metrics import SPEC

TOL_US = str(int(TOLERANCE_S * 1e6))

# Imported rows: all telemetry outside the exclusions, one period per vehicle; states come from the
# rows of two kinds and are matched by nearest time.
_ROWS = (
    """src AS (SELECT * FROM tel WHERE NOT EXISTS (SELECT 1 FROM excludes x
  WHERE date_trunc('second', ts) >= x.start_ts AND date_trunc('second', ts) < x.end_ts)),
lft AS (SELECT event_id AS rid, vehicle_id, ts, signal_a, signal_b FROM src),
rgt AS (SELECT vehicle_id, ts, system_state FROM tel WHERE state_name IN ('purchase', 'error')),"""
    + nearest_sql("lft", "rgt", "system_state", TOL_US)
    + """,
rows_ AS (SELECT *, 'vehicle ' || vehicle_id AS label, date_trunc('second', ts) AS sec_time, coalesce(m_system_state =
  (SELECT CASE WHEN max(system_state) >= 5 THEN 16 ELSE 4 END FROM rgt r WHERE r.vehicle_id = near.vehicle_id), FALSE)
  AS is_auto FROM near)
"""
)


def _label():
    return F.concat(F.lit("vehicle "), F.col("vehicle_id")).alias("label")


def unmasked(spark, sf):
    rows = telemetry(spark, sf).withColumn("sec_time", floor_time("ts", "second"))
    return drop_excluded(rows, excludes(spark), ts="sec_time").select(
        "event_id", _label(), "ts", "sec_time", "signal_a", "signal_b"
    )


def imported(spark, sf):
    rows = unmasked(spark, sf)
    states = (
        telemetry(spark, sf)
        .filter("state_name IN ('purchase', 'error')")
        .select(_label(), "ts", "event_id", "system_state")
    )
    starts = rows.groupBy("label").agg(F.min("sec_time").alias("start_ts"))
    return masked_rows(
        rows, states, ["label"], "state", GEN_DETECT, starts,
        order=["event_id"], tolerance_s=TOLERANCE_S, slice_s=SLICE_S,
    )


@query(
    "csv_metric",
    oracle(
        "tel excludes",
        _ROWS
        + """SELECT label, win, sec_time, round(value, 9) AS value, round(abs_value, 9) AS abs_value,
          CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS cum_dist_km
        FROM (SELECT *, date_trunc('day', sec_time) AS win, abs(value) AS abs_value, row_number() OVER (
            PARTITION BY label, date_trunc('day', sec_time) ORDER BY abs(value) DESC, ts, rid) AS n
          FROM (SELECT *, signal_a * 2 + 1 AS value FROM rows_) WHERE is_auto AND abs(value) >= 30) WHERE n = 1""",
    ),
)
def csv_metric_(spark, sf):
    return csv_metric(
        imported(spark, sf), F.col("signal_a") * 2.0 + 1.0, "value", 30.0, ["label"], GRAIN, ("ts", "event_id")
    )


@query(
    "csv_hist",
    oracle(
        "tel excludes",
        _ROWS
        + """, c AS (SELECT label, round(i * 0.5, 9) AS bin_start, round(i * 0.5 + 0.5, 9) AS bin_end,
            count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
          FROM (SELECT *, floor(signal_b / 0.5) AS i FROM rows_) GROUP BY 1, 2, 3)
        SELECT *, CASE WHEN sum(cnt_auto) OVER w > 0 THEN round(cnt_auto / sum(cnt_auto) OVER w, 9) ELSE 0 END AS ratio_auto,
          CASE WHEN sum(cnt_manual) OVER w > 0 THEN round(cnt_manual / sum(cnt_manual) OVER w, 9) ELSE 0 END AS ratio_manual
        FROM c WINDOW w AS (PARTITION BY label)""",
    ),
)
def csv_hist_(spark, sf):
    return csv_hist(imported(spark, sf), F.col("signal_b"), 0.5, ["label"])


@query(
    "csv_timeseries",
    oracle(
        "tel",
        """SELECT 'vehicle ' || vehicle_id AS label, date_trunc('second', ts) AS sec_time,
          round(avg(signal_b * 2 + 1), 9) AS value, CAST(NULL AS DOUBLE) AS latitude,
          CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS cum_dist_km FROM tel GROUP BY 1, 2""",
    ),
)
def csv_timeseries_(spark, sf):
    rows = telemetry(spark, sf).select(
        F.concat(F.lit("vehicle "), F.col("vehicle_id")).alias("label"),
        floor_time("ts", "second").alias("sec_time"),
        "signal_b",
    )
    return csv_timeseries(rows, F.col("signal_b") * 2.0 + 1.0, ["label"])


@query(
    "csv_period_bounds",
    oracle(
        "tel excludes",
        """SELECT vehicle_id, min(date_trunc('second', ts)) AS start_ts,
          max(date_trunc('second', ts)) + INTERVAL 1 SECOND AS end_ts
        FROM tel WHERE NOT EXISTS (SELECT 1 FROM excludes x
          WHERE date_trunc('second', ts) >= x.start_ts AND date_trunc('second', ts) < x.end_ts) GROUP BY 1""",
    ),
)
def csv_period_bounds(spark, sf):
    rows = telemetry(spark, sf).select("vehicle_id", floor_time("ts", "second").alias("sec_time"))
    return csv_bounds(drop_excluded(rows, excludes(spark), ts="sec_time"), ["vehicle_id"])


def _replacement(spark, sf):
    """Rows that replace the metric in the first period, with their mask taken as all automatic."""
    window = periods(spark).filter("label = 'baseline'").select(PERIOD, "start_ts", "end_ts")
    rows = telemetry(spark, sf).select(
        VEHICLE, F.lit(1).alias(PERIOD), "ts", "event_id", "signal_b", floor_time("ts", "second").alias("sec_time")
    )
    inside = override_rows(rows, window, [PERIOD], excludes(spark))
    return resolve_drive_mode(inside, "auto")


@query(
    "override_apply",
    oracle(
        "worst periods excludes tel",
        """rep AS (SELECT *, signal_b * 10 + 1 AS v, date_trunc('second', ts) AS s FROM tel JOIN periods
            ON date_trunc('second', ts) >= start_ts AND date_trunc('second', ts) < end_ts
          WHERE label = 'baseline' AND NOT EXISTS (SELECT 1 FROM excludes x
            WHERE date_trunc('second', ts) >= x.start_ts AND date_trunc('second', ts) < x.end_ts))
        SELECT vehicle_id, period_id, win, sec_time, round(signal_a, 9) AS signal_a, round(abs_signal_a, 9) AS abs_signal_a,
          chunk_idx, FALSE AS overridden FROM worst w WHERE period_id <> 1
            OR NOT EXISTS (SELECT 1 FROM rep r WHERE r.vehicle_id = w.vehicle_id AND abs(r.v) >= 20)
        UNION ALL
        SELECT vehicle_id, period_id, date_trunc('day', s), s, round(v, 9), round(abs(v), 9), NULL, TRUE
        FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, date_trunc('day', s)
            ORDER BY abs(v) DESC, ts, event_id) AS n FROM rep WHERE abs(v) >= 20) WHERE n = 1""",
    ),
)
def override_apply(spark, sf):
    """The metric of the first period replaced by another signal, the other periods as fetched."""
    base = metric(run_of(spark, sf), SPEC)
    points = override_results(
        _replacement(spark, sf),
        "metric",
        F.col("signal_b") * 10.0 + 1.0,
        [VEHICLE, PERIOD],
        name=SPEC.name,
        threshold=SPEC.threshold,
        grain=GRAIN,
        tie=("ts", "event_id"),
    )["points"]
    out = apply_overrides(base, points, [VEHICLE, PERIOD])
    return out.select(VEHICLE, PERIOD, "win", "sec_time", SPEC.name, SPEC.abs_name, CHUNK, "overridden")


@query(
    "override_drive_mode",
    oracle(
        "tel excludes",
        _ROWS.rstrip()
        + """, m AS (SELECT 'auto' AS drive_mode, label, TRUE AS is_auto FROM rows_
          UNION ALL SELECT 'manual', label, FALSE FROM rows_ UNION ALL SELECT 'state', label, is_auto FROM rows_)
        SELECT drive_mode, label, count(*) AS n_rows, count_if(is_auto) AS n_auto FROM m GROUP BY 1, 2""",
    ),
)
def override_drive_mode(spark, sf):
    """How many rows each drive mode takes as automatic."""
    by_state = imported(spark, sf).select("label", "is_auto")
    rows = unmasked(spark, sf).select("label")
    sides = [resolve_drive_mode(rows, mode).withColumn("drive_mode", F.lit(mode)) for mode in ("auto", "manual")]
    sides.append(by_state.withColumn("drive_mode", F.lit("state")))
    all_rows = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return all_rows.groupBy("drive_mode", "label").agg(
        F.count("*").alias("n_rows"), F.count_if("is_auto").alias("n_auto")
    )


@query(
    "override_funnel",
    oracle(
        "tel excludes",
        _ROWS
        + """SELECT label, count(*) AS n_period, count_if(is_auto) AS n_auto,
          count_if(is_auto AND abs(signal_a) >= 20) AS n_threshold FROM rows_ GROUP BY 1""",
    ),
)
def override_funnel_(spark, sf):
    return override_funnel(imported(spark, sf), F.col("signal_a"), 20.0, ["label"])


@query(
    "override_recipes_latest",
    oracle(
        "",
        """SELECT period_label, target, o_orderkey AS recipe_id, round(o_totalprice, 9) AS scale FROM (
          SELECT *, 'customer ' || o_custkey AS period_label, o_orderpriority AS target, row_number() OVER (
            PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
        WHERE n = 1""",
    ),
)
def override_recipes_latest(spark, sf):
    """Saved recipes (here one per order), of which the last per period and target holds."""
    recipes = table(spark, sf, "orders").select(
        F.concat(F.lit("customer "), F.col("o_custkey")).alias("period_label"),
        F.col("o_orderpriority").alias("target"),
        F.col("o_orderdate").alias("saved_at"),
        F.col("o_orderkey").alias("recipe_id"),
        F.col("o_totalprice").alias("scale"),
    )
    return latest_recipes(recipes, ["period_label", "target"], ["saved_at", "recipe_id"]).drop("saved_at")


