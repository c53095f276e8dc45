"""Nearest-time joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.operators.asof import match_sweep
from drivetrace.operators.compare import backend_difference
from drivetrace.operators.overrides import mask_by_state
from drivetrace.operators.positions import attach_positions, remap_to_positions
from drivetrace.operators.quantiles import describe
from drivetrace.plans.run import metric
from drivetrace.plans.signals import merge_signals
from drivetrace.registry.base import (
    SLICE_S,
    TOLERANCE_S,
    nearest_sql,
    oracle,
    query,
    run_of,
    tagged,
    telemetry,
)
from drivetrace.registry.distance import _TRACK_SQL
from drivetrace.registry.metrics import SPEC

TOL_US = int(TOLERANCE_S * 1e6)
SWEEP_S = (60.0, 300.0, 600.0, 900.0, 1800.0)


def of_kind(spark, sf, kind, columns):
    """One signal: the telemetry rows of one kind."""
    return telemetry(spark, sf).filter(F.col("state_name") == kind).select("vehicle_id", "ts", "event_id", *columns)


@query(
    "asof_state",
    oracle(
        "tel",
        "lft AS (SELECT event_id AS rid, vehicle_id, ts FROM tel),\n"
        "rgt AS (SELECT vehicle_id, ts, system_state FROM tel WHERE state_name IN ('purchase', 'error')),"
        + nearest_sql("lft", "rgt", "system_state", str(TOL_US))
        + """SELECT rid AS event_id, vehicle_id, m_system_state AS system_state,
          coalesce(m_system_state = CASE WHEN vehicle_id % 2 = 0 THEN 16 ELSE 4 END, FALSE) AS is_auto FROM near""",
    ),
)
def asof_state(spark, sf):
    """Every sample with the nearest report of two kinds of state; samples without one are manual."""
    rows = telemetry(spark, sf).select("event_id", "vehicle_id", "ts")
    states = telemetry(spark, sf).filter("state_name IN ('purchase', 'error')").select(
        "vehicle_id", "ts", "event_id", "system_state"
    )
    value = F.when(F.col("vehicle_id") % 2 == 0, 16).otherwise(4)
    out = mask_by_state(
        rows, states, ["vehicle_id"], auto_value=value, tolerance_s=TOLERANCE_S, order=["event_id"], slice_s=SLICE_S
    )
    return out.select("event_id", "vehicle_id", "system_state", "is_auto")


@query(
    "asof_signals",
    oracle(
        "tel",
        "lft AS (SELECT event_id AS rid, vehicle_id, ts, signal_a FROM tel),\n"
        "rgt AS (SELECT vehicle_id, ts, signal_b FROM tel WHERE state_name = 'click'),"
        + nearest_sql("lft", "rgt", "signal_b", str(TOL_US))
        + ", lft2 AS (SELECT rid, vehicle_id, ts, signal_a, m_signal_b, mts AS ts_q3 FROM near),\n"
        + "rgt2 AS (SELECT vehicle_id, ts, speed_mps FROM tel WHERE state_name = 'signup'),"
        + nearest_sql("lft2", "rgt2", "speed_mps", str(TOL_US)).replace("back", "back2").replace("ahead", "ahead2").replace("near", "near2")
        + """SELECT rid AS event_id, vehicle_id, ts, round(signal_a, 9) AS signal_a, round(m_signal_b, 9) AS signal_b,
          ts_q3, round((epoch_us(ts) - epoch_us(ts_q3)) / 1e6, 9) AS time_diff_s_q3,
          round(m_speed_mps, 9) AS speed_mps, mts AS ts_q1,
          round((epoch_us(ts) - epoch_us(mts)) / 1e6, 9) AS time_diff_s_q1 FROM near2""",
    ),
)
def asof_signals(spark, sf):
    """Every sample with the nearest row of a second and of a third signal."""
    base = telemetry(spark, sf).select("event_id", "vehicle_id", "ts", "signal_a")
    return merge_signals(
        base,
        [
            (of_kind(spark, sf, "click", ["signal_b"]), ["signal_b"], "q3"),
            (of_kind(spark, sf, "signup", ["speed_mps"]), ["speed_mps"], "q1"),
        ],
        by=["vehicle_id"],
        tolerance_s=TOLERANCE_S,
        order=["event_id"],
        slice_s=SLICE_S,
    )


def _paired(spark, sf):
    return merge_signals(
        telemetry(spark, sf).select("event_id", "vehicle_id", "ts"),
        [(of_kind(spark, sf, "click", ["signal_b"]), ["signal_b"], "q3")],
        by=["vehicle_id"],
        tolerance_s=max(SWEEP_S),
        order=["event_id"],
        slice_s=SLICE_S,
    )


_PAIRED_SQL = (
    "lft AS (SELECT event_id AS rid, vehicle_id, ts FROM tel),\n"
    "rgt AS (SELECT vehicle_id, ts, signal_b FROM tel WHERE state_name = 'click'),"
    + nearest_sql("lft", "rgt", "signal_b", str(TOL_US))
    + ", gaps AS (SELECT vehicle_id, (epoch_us(ts) - epoch_us(mts)) / 1e6 AS gap FROM near)\n"
)


@query(
    "asof_match_sweep",
    oracle(
        "tel",
        _PAIRED_SQL
        + """SELECT vehicle_id, CAST(tol AS DOUBLE) AS tolerance_s, count(*) AS total,
          count(CASE WHEN abs(gap) <= tol THEN 1 END) AS matched,
          round(count(CASE WHEN abs(gap) <= tol THEN 1 END) / count(*), 9) AS pct,
          round(avg(CASE WHEN abs(gap) <= tol THEN gap END), 4) AS gap_mean,
          round(stddev_samp(CASE WHEN abs(gap) <= tol THEN gap END), 4) AS gap_std,
          round(min(CASE WHEN abs(gap) <= tol THEN gap END), 9) AS gap_min,
          round(max(CASE WHEN abs(gap) <= tol THEN gap END), 9) AS gap_max
        FROM gaps, (VALUES (60), (300), (600), (900), (1800)) t(tol) GROUP BY vehicle_id, tol""",
    ),
    {"gap_mean": 4, "gap_std": 4},
)
def asof_match_sweep(spark, sf):
    return match_sweep(_paired(spark, sf), "time_diff_s_q3", SWEEP_S, ["vehicle_id"])


@query(
    "asof_gap_describe",
    oracle(
        "tel",
        _PAIRED_SQL
        + """SELECT vehicle_id, count(gap) AS n, round(avg(gap), 4) AS mean, round(stddev_samp(gap), 4) AS std,
          round(min(gap), 9) AS "min", round(quantile_cont(gap, 0.25), 9) AS p25, round(quantile_cont(gap, 0.5), 9) AS p50,
          round(quantile_cont(gap, 0.75), 9) AS p75, round(max(gap), 9) AS "max"
        FROM gaps GROUP BY 1""",
    ),
    {"mean": 4, "std": 4},
)
def asof_gap_describe(spark, sf):
    """Count, mean, deviation, extremes and quartiles of the time differences."""
    return describe(_paired(spark, sf), "time_diff_s_q3", ["vehicle_id"])


@query(
    "asof_positions",
    oracle(
        "tel worst",
        _TRACK_SQL.replace("FROM tel\n", "FROM (SELECT * FROM tel WHERE state_name = 'signup')\n")
        + """, lft AS (SELECT row_number() OVER () AS rid, vehicle_id, period_id, chunk_idx, win, sec_time FROM worst),
        rgt AS (SELECT * FROM ptrack),"""
        + nearest_sql("lft", "rgt", "lat lon cum_dist_km", str(TOL_US), "sec_time")
        + """SELECT vehicle_id, period_id, chunk_idx, win, sec_time, round(m_lat, 9) AS latitude,
          round(m_lon, 9) AS longitude, round(m_cum_dist_km, 2) AS cum_dist_km FROM near""",
    ),
    {"cum_dist_km": 2},
)
def asof_positions(spark, sf):
    """Metric rows with position and distance of the nearest logged position."""
    rows = metric(run_of(spark, sf), SPEC).select(
        "vehicle_id", "period_id", "chunk_idx", "win", "sec_time", "latitude", "longitude", "cum_dist_km"
    )
    log = of_kind(spark, sf, "signup", ["latitude", "longitude"]).withColumnsRenamed(
        {"latitude": "lat", "longitude": "lon"}
    )
    return attach_positions(
        rows, log, ["vehicle_id"], order=["event_id"], tolerance_s=TOLERANCE_S, slice_s=SLICE_S
    )


@query(
    "asof_positions_auto",
    oracle(
        "tel worst",
        _TRACK_SQL.replace("FROM tel\n", "FROM (SELECT * FROM tel WHERE state_name <> 'error')\n")
        + """, lft AS (SELECT row_number() OVER () AS rid, vehicle_id, period_id, chunk_idx, win, sec_time FROM worst),
        rgt AS (SELECT * FROM ptrack),
        tol_ AS (SELECT vehicle_id AS v, CAST(1e6 * least(65, greatest(2, 1.5 * median(g))) AS BIGINT) AS tol FROM (
          SELECT vehicle_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY vehicle_id ORDER BY ts)) / 1e6 AS g
          FROM (SELECT DISTINCT vehicle_id, ts FROM ptrack)) GROUP BY 1),"""
        + nearest_sql("lft", "rgt", "lat lon cum_dist_km", "(SELECT t.tol FROM tol_ t WHERE t.v = vehicle_id)", "sec_time")
        + """SELECT vehicle_id, period_id, chunk_idx, win, sec_time, round(m_lat, 9) AS latitude,
          round(m_lon, 9) AS longitude, round(m_cum_dist_km, 2) AS cum_dist_km FROM near""",
    ),
    {"cum_dist_km": 2},
)
def asof_positions_auto(spark, sf):
    """As above from a denser log, with the tolerance that each vehicle's own gaps give."""
    rows = metric(run_of(spark, sf), SPEC).select(
        "vehicle_id", "period_id", "chunk_idx", "win", "sec_time", "latitude", "longitude", "cum_dist_km"
    )
    log = telemetry(spark, sf).filter("state_name <> 'error'").select(
        "vehicle_id", "ts", "event_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )
    return attach_positions(rows, log, ["vehicle_id"], order=["event_id"], slice_s=SLICE_S)


@query(
    "asof_remap_fallback",
    oracle(
        "tagged",
        """lft AS (SELECT event_id AS rid, vehicle_id, period_id, ts, latitude, longitude FROM tagged),
        rgt AS (SELECT vehicle_id, ts, latitude AS lat, longitude AS lon FROM tagged
          WHERE state_name = 'signup' AND period_id = 2),"""
        + nearest_sql("lft", "rgt", "lat lon", str(TOL_US))
        + """SELECT rid AS event_id, vehicle_id, period_id,
          round(CASE WHEN any_hit THEN m_lat ELSE latitude END, 9) AS latitude,
          round(CASE WHEN any_hit THEN m_lon ELSE longitude END, 9) AS longitude
        FROM (SELECT *, bool_or(mts IS NOT NULL) OVER (PARTITION BY vehicle_id, period_id) AS any_hit FROM near)
        WHERE mts IS NOT NULL OR NOT any_hit""",
    ),
)
def asof_remap_fallback(spark, sf):
    """Rows moved to the log's positions; the log covers one period, the others stay as they are."""
    rows = tagged(spark, sf).select("event_id", "vehicle_id", "period_id", "ts", "latitude", "longitude")
    log = (
        tagged(spark, sf)
        .filter("state_name = 'signup' AND period_id = 2")
        .select("vehicle_id", "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "event_id")
    )
    out = remap_to_positions(
        rows,
        log.withColumnRenamed("event_id", "log_id"),
        ["vehicle_id"],
        ["vehicle_id", "period_id"],
        ts="ts",
        order=["log_id"],
        tolerance_s=TOLERANCE_S,
        slice_s=SLICE_S,
    )
    return out.select("event_id", "vehicle_id", "period_id", "latitude", "longitude")


_SIDES = """sa AS (SELECT vehicle_id, ts, signal_a AS v FROM tel WHERE state_name <> 'view'),
sb AS (SELECT vehicle_id, ts, signal_a + CASE WHEN state_name = 'click' THEN 0.5 ELSE 0 END AS v FROM tel
  WHERE state_name <> 'error'),
d AS (SELECT vehicle_id, ts, sa.v AS value_a, sb.v AS value_b, abs(coalesce(sa.v, 0) - coalesce(sb.v, 0)) AS value_abs_diff
  FROM sa FULL JOIN sb USING (vehicle_id, ts))
"""


def _difference(spark, sf):
    tel = telemetry(spark, sf)
    a = tel.filter("state_name <> 'view'").select("vehicle_id", "ts", F.col("signal_a").alias("value"))
    shifted = F.col("signal_a") + F.when(F.col("state_name") == "click", 0.5).otherwise(0.0)
    b = tel.filter("state_name <> 'error'").select("vehicle_id", "ts", shifted.alias("value"))
    return backend_difference(a, b, ["vehicle_id", "ts"], ["value"])


@query(
    "backend_diff",
    oracle(
        "tel",
        _SIDES
        + """SELECT vehicle_id, ts, round(value_a, 9) AS value_a, round(value_b, 9) AS value_b,
          round(value_abs_diff, 9) AS value_abs_diff FROM d""",
    ),
)
def backend_diff(spark, sf):
    """Two result sets, one lacking some rows and one shifting some values, put side by side."""
    return _difference(spark, sf)


@query(
    "backend_diff_describe",
    oracle(
        "tel",
        _SIDES
        + """SELECT count(*) AS n, round(avg(value_abs_diff), 4) AS mean, round(stddev_samp(value_abs_diff), 4) AS std,
          round(min(value_abs_diff), 9) AS "min", round(quantile_cont(value_abs_diff, 0.25), 9) AS p25,
          round(quantile_cont(value_abs_diff, 0.5), 9) AS p50, round(quantile_cont(value_abs_diff, 0.75), 9) AS p75,
          round(max(value_abs_diff), 9) AS "max" FROM d""",
    ),
    {"mean": 4, "std": 4},
)
def backend_diff_describe(spark, sf):
    return describe(_difference(spark, sf), "value_abs_diff")


