"""Drive state."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.config import KEYS, RunSpec
from drivetrace.operators.positions import overlay_track, track_extent
from drivetrace.operators.states import auto_mask, label_states, prefer_states, state_track
from drivetrace.operators.periods import span_of
from drivetrace.plans.run import notes, plan_run
from drivetrace.registry.base import (
    GRAIN,
    PERIODS,
    SPLIT_MINUTES,
    TIE,
    excludes,
    oracle,
    periods,
    query,
    run_of,
    tagged,
    telemetry,
)
from drivetrace.sources.tables import Tables

_TRACK = """track AS (
  SELECT vehicle_id, period_id, chunk_idx, make_timestamp((epoch_us(ts) // 21600000000) * 21600000000) AS sec_time,
    system_state, arg_min(latitude, ts) AS latitude, arg_min(longitude, ts) AS longitude, arg_min(kp, ts) AS kp
  FROM tagged GROUP BY 1, 2, 3, 4, 5)"""
TRACK_SECONDS = 6 * 3600


def track(spark, sf):
    return state_track(tagged(spark, sf), bucket=TRACK_SECONDS, tie=("event_id",))


@query("state_per_second", oracle("state_s", "SELECT * FROM state_s"))
def state_per_second(spark, sf):
    return run_of(spark, sf).states()


@query("auto_value_detect", oracle("auto_v", "SELECT * FROM auto_v"))
def auto_value_detect(spark, sf):
    return run_of(spark, sf).auto()


@query(
    "state_seconds",
    oracle(
        "moded",
        """SELECT vehicle_id, period_id, chunk_idx, auto_value, basis, count_if(is_auto) AS auto_seconds,
          count_if(NOT is_auto) AS other_seconds
        FROM moded JOIN auto_v USING (vehicle_id, period_id, chunk_idx, auto_value) GROUP BY ALL""",
    ),
)
def state_seconds(spark, sf):
    return notes(run_of(spark, sf))


@query(
    "state_notes_gaps",
    oracle(
        "tagged",
        """s AS (SELECT vehicle_id, period_id, chunk_idx, sec_time, max(system_state) AS system_state FROM tagged
          WHERE vehicle_id <> 3 OR period_id = 2 GROUP BY 1, 2, 3, 4),
        k AS (SELECT DISTINCT vehicle_id, period_id, chunk_idx FROM tagged),
        a AS (SELECT k.*, CASE WHEN max(system_state) >= 5 THEN 16 ELSE 4 END AS auto_value,
            CASE WHEN max(system_state) >= 5 THEN 'state' ELSE 'date' END AS basis
          FROM k LEFT JOIN s USING (vehicle_id, period_id, chunk_idx) GROUP BY ALL)
        SELECT a.*, count_if(coalesce(system_state = auto_value, FALSE)) AS auto_seconds,
          count_if(coalesce(system_state <> auto_value, FALSE)) AS other_seconds
        FROM a LEFT JOIN s USING (vehicle_id, period_id, chunk_idx) GROUP BY ALL""",
    ),
)
def state_notes_gaps(spark, sf):
    """One vehicle has states in one period only; its other chunks are noted by date."""
    tel = telemetry(spark, sf)
    second = PERIODS[1]
    states = tel.filter(
        (F.col("vehicle_id") != 3) | ((F.col("ts") >= F.lit(second.start)) & (F.col("ts") < F.lit(second.end)))
    )
    tables = Tables(tel, states, tel, tel, {"telemetry": tel})
    spec = RunSpec(split_minutes=SPLIT_MINUTES, grain=GRAIN)
    return notes(plan_run(tables, periods(spark), spec, excludes=excludes(spark), span=span_of(PERIODS), tie=TIE))


@query(
    "auto_mask",
    oracle(
        "tel",
        """SELECT event_id, (state_name = 'purchase') AS is_auto FROM tel""",
    ),
)
def auto_mask_(spark, sf):
    """States as a mixed column: numbers as text for some vehicles, enum names or nothing for others."""
    rows = telemetry(spark, sf)
    value = F.when(F.col("vehicle_id") % 2 == 0, 16).otherwise(4)
    name = F.when(F.col("state_name") == "purchase", F.lit(" kAutonomousDriving ")).when(
        F.col("state_name") != "view", F.lit("kControlOk")
    )
    mixed = F.when(F.col("vehicle_id") > 2, name).otherwise(F.concat(F.col("system_state"), F.lit(".0")))
    return rows.select("event_id", auto_mask(mixed, value).alias("is_auto"))


@query(
    "state_track",
    oracle(
        "tagged",
        _TRACK + """
        SELECT vehicle_id, period_id, chunk_idx, sec_time, system_state, round(latitude, 9) AS latitude,
          round(longitude, 9) AS longitude, round(kp, 9) AS kp FROM track""",
    ),
)
def state_track_(spark, sf):
    return track(spark, sf)


@query(
    "state_track_labelled",
    oracle(
        "tagged auto_v",
        _TRACK + """
        SELECT vehicle_id, period_id, chunk_idx, sec_time, t.system_state, state_label, position FROM (
          SELECT t.*, CASE WHEN auto_value = 16 THEN
              CASE t.system_state WHEN 0 THEN 'kTerminated' WHEN 1 THEN 'kStandBy' WHEN 2 THEN 'kResetWait'
                WHEN 3 THEN 'kPerceptionOk' WHEN 4 THEN 'kControlOk' WHEN 16 THEN 'kAutonomousDriving' ELSE 'null' END
            ELSE CASE t.system_state WHEN 0 THEN 'kStandBy' WHEN 1 THEN 'kPerceptionOk' WHEN 2 THEN 'kControlOk'
                WHEN 3 THEN 'kReady' WHEN 4 THEN 'kAutonomousDriving' ELSE 'null' END END AS state_label,
            t.system_state AS position
          FROM track t JOIN auto_v USING (vehicle_id, period_id, chunk_idx)) t""",
    ),
)
def state_track_labelled(spark, sf):
    auto = run_of(spark, sf).auto().select(*KEYS, "auto_value")
    rows = label_states(track(spark, sf).join(auto, list(KEYS)))
    return rows.select(*KEYS, "sec_time", "system_state", "state_label", "position")


@query(
    "state_source_priority",
    oracle(
        "tagged state_s",
        """prim AS (SELECT vehicle_id, period_id, sec_time AS ts, system_state FROM state_s WHERE period_id < 3)
        SELECT vehicle_id, period_id, ts, CAST(system_state AS VARCHAR) AS system_state, 'primary' AS source FROM prim
        UNION ALL
        SELECT vehicle_id, period_id, ts, state_name, 'fallback' FROM tagged t
        WHERE NOT EXISTS (SELECT 1 FROM prim p WHERE p.vehicle_id = t.vehicle_id AND p.period_id = t.period_id)""",
    ),
)
def state_source_priority(spark, sf):
    """Fetched states where a period has them (here the first two), else the state CSV's."""
    fetched = run_of(spark, sf).states().filter("period_id < 3")
    primary = fetched.select("vehicle_id", "period_id", F.col("sec_time").alias("ts"), "system_state")
    fallback = tagged(spark, sf).select(
        "vehicle_id", "period_id", "ts", F.col("state_name").alias("system_state")
    )
    return prefer_states(primary, fallback, ["vehicle_id", "period_id"])


@query(
    "track_extent",
    oracle(
        "tagged",
        _TRACK + """
        SELECT vehicle_id, period_id, round(center_lat, 9) AS center_lat, round(center_lon, 9) AS center_lon,
          round(lat_span, 9) AS lat_span, round(lon_span, 9) AS lon_span, round(greatest(3, least(16,
            log2(360 / greatest(lat_span, lon_span * cos(radians(center_lat)), 1e-6)) - 0.5)), 9) AS zoom
        FROM (SELECT vehicle_id, period_id, avg(latitude) AS center_lat, avg(longitude) AS center_lon,
            max(latitude) - min(latitude) AS lat_span, max(longitude) - min(longitude) AS lon_span
          FROM track GROUP BY 1, 2)""",
    ),
)
def track_extent_(spark, sf):
    return track_extent(track(spark, sf), ["vehicle_id", "period_id"])


_OVERLAY = """lg AS (
  SELECT vehicle_id, period_id, ts AS sec_time, latitude, longitude FROM tagged
  WHERE state_name = 'signup' AND period_id = 2)"""


def _log_of_second_period(spark, sf):
    return (
        tagged(spark, sf)
        .filter("state_name = 'signup' AND period_id = 2")
        .select("vehicle_id", "period_id", "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    )


@query(
    "track_overlay_replace",
    oracle(
        "tagged",
        _TRACK + ",\n" + _OVERLAY + """
        SELECT vehicle_id, period_id, sec_time, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude,
          'track' AS source FROM track t
        WHERE NOT EXISTS (SELECT 1 FROM lg WHERE lg.vehicle_id = t.vehicle_id AND lg.period_id = t.period_id)
        UNION ALL SELECT vehicle_id, period_id, sec_time, round(latitude, 9), round(longitude, 9), 'log' FROM lg""",
    ),
)
def track_overlay_replace(spark, sf):
    """The log's positions instead of the track, in the period that has a log."""
    return overlay_track(
        track(spark, sf), _log_of_second_period(spark, sf), "replace", ["vehicle_id", "period_id"]
    )


@query(
    "track_overlay_both",
    oracle(
        "tagged",
        _TRACK + ",\n" + _OVERLAY + """
        SELECT vehicle_id, period_id, sec_time, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude,
          'track' AS source FROM track
        UNION ALL SELECT vehicle_id, period_id, sec_time, round(latitude, 9), round(longitude, 9), 'log' FROM lg""",
    ),
)
def track_overlay_both(spark, sf):
    return overlay_track(
        track(spark, sf), _log_of_second_period(spark, sf), "overlay", ["vehicle_id", "period_id"]
    )


