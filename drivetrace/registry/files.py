"""Parsers of text formats, over lines made from the given tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from drivetrace.functions.generators import computed_once
from drivetrace.functions.timegrain import floor_time, local_text, to_local
from drivetrace.operators.overrides import epoch_to_instant
from drivetrace.registry.base import oracle, query, telemetry
from drivetrace.sources.position_log import parse_position_lines, select_positions
from drivetrace.sources.topic_csv import csv_lines, state_rows, typed_topic, typed_values


def as_csv(rows, *keep):
    """Rows as CSV lines, parsed again as text columns."""
    columns = [c for c in rows.columns if c not in keep]
    return csv_lines(rows.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("value"), *keep), columns, keep)


def _topic(spark, sf):
    """Telemetry as an exported topic; the time of some rows is unreadable."""
    us = F.unix_micros("ts")
    return telemetry(spark, sf).select(
        local_text("ts").alias("time_jst"),
        (us / F.lit(1e6)).alias("t_sec"),
        F.when(F.col("state_name") == "error", F.lit("bad")).otherwise((us * 1000).cast("string")).alias("t_ns"),
        F.col("signal_b").alias("debug.lateral_error"),
        F.when(F.col("state_name") == "purchase", F.lit("kAutonomousDriving"))
        .when(F.col("state_name") == "click", F.lit("unknown"))
        .otherwise(F.col("system_state").cast("string"))
        .alias("state.system_state"),
        "event_id",
    )


@query(
    "csv_topic_scan",
    oracle(
        "tel",
        """SELECT event_id, epoch_us(ts) * 1000 AS t_ns, date_trunc('second', ts) AS sec_time,
          round(signal_b, 9) AS lateral_error FROM tel WHERE state_name <> 'error'""",
    ),
)
def csv_topic_scan(spark, sf):
    rows = typed_topic(as_csv(_topic(spark, sf)))
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"),
        "t_ns",
        "sec_time",
        F.col("`debug.lateral_error`").cast("double").alias("lateral_error"),
    )


@query(
    "csv_state_scan",
    oracle(
        "tel",
        """SELECT epoch_us(ts) * 1000 AS t_ns,
          CASE WHEN state_name = 'purchase' THEN 'kAutonomousDriving' ELSE CAST(system_state AS VARCHAR) END AS system_state
        FROM tel WHERE state_name NOT IN ('error', 'click')""",
    ),
)
def csv_state_scan(spark, sf):
    return state_rows(typed_topic(as_csv(_topic(spark, sf)))).select("t_ns", "system_state")


_UNITS = """CASE vehicle_id WHEN 0 THEN 's' WHEN 1 THEN 'ms' WHEN 2 THEN 'us' WHEN 3 THEN 'ns' ELSE 'text' END"""
_UNIT_TIME = """CASE vehicle_id WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts)
  WHEN 4 THEN date_trunc('second', ts) ELSE ts END"""


def _timed_text(column: str = "time"):
    us = F.unix_micros("ts")
    v = F.col("vehicle_id")
    return (
        F.when(v == 0, F.floor(us / 1_000_000).cast("string"))
        .when(v == 1, F.floor(us / 1_000).cast("string"))
        .when(v == 2, us.cast("string"))
        .when(v == 3, (us * 1000).cast("string"))
        .otherwise(local_text("ts"))
        .alias(column)
    )


@query(
    "epoch_unit_detect",
    oracle("tel", f"SELECT event_id, vehicle_id, {_UNITS} AS time_unit, {_UNIT_TIME} AS ts FROM tel"),
)
def epoch_unit_detect(spark, sf):
    """Each vehicle writes time in its own unit, one as local text; the unit is found per vehicle."""
    rows = telemetry(spark, sf).select("event_id", "vehicle_id", _timed_text())
    return epoch_to_instant(rows, "time", ["vehicle_id"]).select("event_id", "vehicle_id", "time_unit", "ts")


@query(
    "csv_value_scan",
    oracle(
        "tel",
        f"""SELECT event_id, vehicle_id, {_UNITS} AS time_unit, epoch_us({_UNIT_TIME}) * 1000 AS t_ns,
          date_trunc('second', ts) AS sec_time, round(signal_a, 9) AS signal_a,
          CASE WHEN state_name = 'view' THEN NULL ELSE round(signal_b, 9) END AS signal_b FROM tel""",
    ),
)
def csv_value_scan(spark, sf):
    """Generic files, one per vehicle: time first, then values of which some are no numbers."""
    no_value = F.when(F.col("state_name") == "view", F.lit("-")).otherwise(F.col("signal_b").cast("string"))
    files = telemetry(spark, sf).select(
        _timed_text(), "signal_a", no_value.alias("signal_b"), "event_id", F.col("vehicle_id").alias("vehicle"),
        F.concat(F.lit("v="), "vehicle_id").alias("_file"),
    )
    rows = typed_values(as_csv(files, "_file"))
    return rows.select(
        F.col("event_id").cast("long").alias("event_id"),
        F.col("vehicle").cast("long").alias("vehicle_id"),
        "time_unit",
        "t_ns",
        "sec_time",
        "signal_a",
        "signal_b",
    )


def _log_lines(spark, sf, grain=None):
    """Telemetry as position-log lines, mixed with lines that are no positions; times floored to a grain."""
    time = F.date_format(to_local("ts" if grain is None else floor_time("ts", grain)), "yyyy/MM/dd HH:mm:ss.SSSSSS")
    q = F.lit("'")

    def text(c):
        return F.concat(q, c, q)

    def field(name, value):
        return F.concat(F.lit(f"'{name}': "), value)

    truck = field("truck-id", text(F.concat(F.lit("car-giga-0"), F.col("vehicle_id"))))
    lat, lon = F.col("latitude").cast("string"), F.col("longitude").cast("string")
    at = field("datetime", text(time))
    kind = F.col("state_name")

    def message(*fields):
        return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))

    speed = F.col("speed_mps").cast("string")
    body = (
        F.when(kind == "view", message(truck, field("lat", lat), field("lon", lon), field("speed", speed), at))
        .when(
            kind == "click",
            message(field("ok", F.lit("True")), field("lat", text(lat)), field("lon", lon), field("speed", F.lit("None")), at, truck),
        )
        .when(kind == "signup", message(truck, field("lat", F.lit("None")), field("lon", lon), at))
        .when(kind == "error", message(truck, field("status", F.lit("'lost: lat'")), field("flag", F.lit("False")), at))
        .otherwise(message(field("lat", lat), field("lon", lon), field("speed", F.lit("'fast'")), at, field("note", F.lit('"it\'s on"'))))
    )
    broken = F.when(F.col("vehicle_id") == 4, F.lit("{'lat': 1,")).otherwise(body)
    return telemetry(spark, sf).select(computed_once(value=F.concat(time, F.lit(": "), broken)))


_LOG = """lg AS (SELECT ts, round(latitude, 9) AS lat, round(longitude, 9) AS lon,
  CASE WHEN state_name = 'view' THEN round(speed_mps, 9) END AS speed,
  CASE WHEN state_name <> 'purchase' THEN 'car-giga-0' || vehicle_id END AS truck_id,
  CASE WHEN state_name <> 'purchase' THEN CAST(vehicle_id AS INTEGER) END AS vehicle_num
  FROM tel WHERE vehicle_id <> 4 AND state_name IN ('view', 'click', 'purchase'))
"""


@query(
    "position_log_scan",
    oracle("tel", _LOG + "SELECT * FROM lg"),
)
def position_log_scan(spark, sf):
    return parse_position_lines(_log_lines(spark, sf), "Asia/Tokyo")


@query(
    "position_vehicle_filter",
    oracle("tel", _LOG + "SELECT ts, lat, lon, vehicle_num FROM lg WHERE vehicle_num = 3"),
)
def position_vehicle_filter(spark, sf):
    return select_positions(_log_lines(spark, sf), "Asia/Tokyo", vehicle="giga03").select("ts", "lat", "lon", "vehicle_num")


@query(
    "position_vehicle_unmatched",
    oracle("tel", _LOG + "SELECT ts, lat, lon, vehicle_num FROM lg"),
)
def position_vehicle_unmatched(spark, sf):
    """No position of that vehicle: all stay."""
    return select_positions(_log_lines(spark, sf), "Asia/Tokyo", vehicle="giga07").select("ts", "lat", "lon", "vehicle_num")


@query(
    "position_log_window",
    oracle(
        "tel",
        _LOG + """SELECT date_trunc('hour', ts) AS ts, lat, lon, vehicle_num FROM lg WHERE vehicle_num IN (1, 3)
          AND date_trunc('hour', ts) >= TIMESTAMP '2024-01-05 06:00:00' AND date_trunc('hour', ts) < TIMESTAMP '2024-01-19 18:00:00'
          AND NOT (vehicle_num = 1 AND date_trunc('hour', ts) >= TIMESTAMP '2024-01-12 00:00:00')""",
    ),
)
def position_log_window(spark, sf):
    """Positions of two vehicles, each in a window of its own; times are whole hours, so lines lie on the edges."""
    lines = _log_lines(spark, sf, "hour")
    start, middle, end = datetime(2024, 1, 5, 6), datetime(2024, 1, 12), datetime(2024, 1, 19, 18)
    rows = select_positions(lines, "Asia/Tokyo", vehicle="giga03", start=start, end=end)
    rows = rows.unionByName(select_positions(lines, "Asia/Tokyo", vehicle="1", start=start, end=middle))
    return rows.select("ts", "lat", "lon", "vehicle_num")
