"""Catalog tables, warehouse column names, files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from drivetrace.config import KEYS, VEHICLE
from drivetrace.functions.text import safe_name
from drivetrace.functions.timegrain import local_text
from drivetrace.operators.positions import position_track
from drivetrace.plans.run import custom, metric
from drivetrace.registry.asof import asof_signals
from drivetrace.registry.base import ORACLES, legs_raw, oracle, query, run_of, telemetry
from drivetrace.registry.metrics import SERIES, SPEC
from drivetrace.sources.legs import legs_table
from drivetrace.sources.shared import shared_folder
from drivetrace.sources.sinks import ordered, write_csv
from drivetrace.sources.tables import from_catalog, has_position, list_tables, normalized, select_columns
from drivetrace.sources.topic_csv import read_values


def _fresh(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "legs_newest",
    oracle("legs", "SELECT vehicle_id, display_name, start_ts, end_ts FROM legs ORDER BY start_ts DESC, vehicle_id, display_name LIMIT 100"),
)
def legs_newest(spark, sf):
    """The hundred newest legs of a catalog table."""
    legs_raw(spark, sf).createOrReplaceTempView("drivetrace_legs")
    return ordered(legs_table(spark, "drivetrace_legs"), "legs").limit(100).select("vehicle_id", "display_name", "start_ts", "end_ts")


_ROLES = {"control": "drivetrace_control", "state": "drivetrace_state", "pose": "drivetrace_pose"}


@query(
    "catalog_tables",
    oracle(
        "tel",
        """SELECT 'drivetrace_control' AS name, TRUE AS has_position, 5 AS n_columns, count(*) AS n FROM tel
        UNION ALL SELECT 'drivetrace_pose', FALSE, 3, count(*) FROM tel UNION ALL SELECT 'drivetrace_state', FALSE, 3, count(*) FROM tel WHERE state_name <> 'view'""",
    ),
)
def catalog_tables(spark, sf):
    """The tables of the catalog that hold a role, whether they have positions, and their rows."""
    tel = telemetry(spark, sf)
    tel.select(VEHICLE, "ts", "signal_a", "latitude", "longitude").createOrReplaceTempView(_ROLES["control"])
    tel.filter("state_name <> 'view'").select(VEHICLE, "ts", "system_state").createOrReplaceTempView(_ROLES["state"])
    tel.select(VEHICLE, "ts", "signal_b").createOrReplaceTempView(_ROLES["pose"])
    tables = from_catalog(spark, _ROLES)
    parts = []
    for role, name in _ROLES.items():
        if name in list_tables(spark):
            df = tables.role(role)
            one = df.agg(F.count("*").alias("n"))
            parts.append(one.select(F.lit(name).alias("name"), F.lit(has_position(df)).alias("has_position"), F.lit(len(df.columns)).alias("n_columns"), "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "series_without_position",
    oracle("tagged", "SELECT vehicle_id, period_id, chunk_idx, sec_time, round(avg(signal_a) * 0.5 + 3, 9) AS value FROM tagged GROUP BY 1, 2, 3, 4"),
)
def series_without_position(spark, sf):
    """A time series of a table that has no position: its result has none either."""
    run = run_of(spark, sf)
    bare = telemetry(spark, sf).select("event_id", VEHICLE, "ts", "signal_a")
    run = type(run)(run.spec, run.chunks, run.excludes, run.tables.with_role("telemetry", bare), run.span, run.tie)
    rows = custom(run, SERIES)
    assert not has_position(rows)
    return rows.select(*KEYS, "sec_time", "value")


@query(
    "warehouse_columns",
    oracle(
        "tel",
        """SELECT vehicle_id, ts, round(signal_b, 9) AS lateral_error, round(speed_mps, 9) AS speed,
          CASE WHEN state_name <> 'error' THEN CAST(system_state AS DOUBLE) END AS state FROM tel""",
    ),
)
def warehouse_columns(spark, sf):
    """Columns found by their dotted names, also where the warehouse spells them otherwise; text becomes numbers or null."""
    state = F.when(F.col("state_name") == "error", F.lit("unknown")).otherwise(F.col("system_state").cast("string"))
    table = telemetry(spark, sf).select(
        F.col(VEHICLE).alias(":vehicle"), F.col("ts").alias(":time"), F.col("signal_b").cast("string").alias(":debug:lateral_error_0_"),
        F.col("speed_mps").alias(".twist.x (m)"), state.alias(":state"),
    )
    wanted = {".vehicle": VEHICLE, ".time": "ts", ".debug.lateral_error[0]": "lateral_error", ".twist.x (m)": "speed", ".state": "state"}
    return normalized(select_columns(table, wanted))


@query(
    "safe_names",
    oracle("legs", r"""SELECT DISTINCT guid, substr(regexp_replace(display_name || ': ' || version || '?*' || guid || '/' || direction, '[\\/:*?"<>|]', '_', 'g'), 1, 31) AS sheet,
      regexp_replace(display_name || ': ' || version || '?*' || guid || '/' || direction, '[\\/:*?"<>|]', '_', 'g') AS file FROM legs"""),
)
def safe_names(spark, sf):
    """Names of legs as file names, and cut to the length of a sheet's."""
    legs_raw(spark, sf).createOrReplaceTempView("drivetrace_legs")
    legs = legs_table(spark, "drivetrace_legs")
    name = F.concat("display_name", F.lit(": "), "version", F.lit("?*"), "guid", F.lit("/"), "direction")
    return legs.select("guid", safe_name(name, 31).alias("sheet"), safe_name(name).alias("file")).distinct()


@query(
    "track_in_order",
    oracle("tel", """SELECT vehicle_id, ts, round(latitude, 9) AS lat, round(longitude, 9) AS lon FROM (
      SELECT vehicle_id, ts, arg_min(latitude, event_id) AS latitude, arg_min(longitude, event_id) AS longitude FROM tel GROUP BY 1, 2)
    ORDER BY vehicle_id, ts LIMIT 300"""),
)
def track_in_order(spark, sf):
    """The first three hundred points of the reference track, as a map draws them."""
    log = telemetry(spark, sf).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    track = position_track(log, [VEHICLE], order=["event_id"])
    return ordered(track, "track").limit(300).select(VEHICLE, "ts", "lat", "lon")


@query("csv_sink_signals", ORACLES["asof_signals"])
def csv_sink_signals(spark, sf):
    """Merged signals written as CSV and read back."""
    rows, path = asof_signals(spark, sf), _fresh(spark, "signals")
    write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).csv(path)


@query(
    "points_in_order",
    oracle(
        "worst",
        """SELECT vehicle_id, period_id, chunk_idx, win, sec_time, round(signal_a, 9) AS signal_a FROM worst
        ORDER BY sec_time, vehicle_id, period_id, chunk_idx LIMIT 50""",
    ),
)
def points_in_order(spark, sf):
    """The first fifty points of a metric, as tables and charts list them."""
    points = metric(run_of(spark, sf), SPEC).select(*KEYS, "win", "sec_time", SPEC.name)
    return ordered(points, "points").limit(50)


@query(
    "csv_files_values",
    oracle(
        "tel",
        """SELECT vehicle_id, epoch_us(t) * 1000 AS t_ns, name, value FROM (
          SELECT vehicle_id, CASE WHEN vehicle_id < 2 THEN ts ELSE date_trunc('second', ts) END AS t,
            unnest(CASE WHEN vehicle_id < 2 THEN ['debug.signal_b', 'event_id'] ELSE ['a,b', 'event_id'] END) AS name,
            unnest(CASE WHEN vehicle_id < 2 THEN [round(signal_b, 9), event_id] ELSE [round(signal_a, 9), event_id] END) AS value FROM tel)""",
    ),
)
def csv_files_values(spark, sf):
    """Files of two layouts, a topic and one with local time, read together by one glob for each vehicle."""
    tel, path = telemetry(spark, sf), _fresh(spark, "files")
    topic = tel.filter(F.col(VEHICLE) < 2).select(
        VEHICLE, local_text("ts").alias("time_jst"), (F.unix_micros("ts") * 1000).alias("t_ns"), F.col("signal_b").alias("debug.signal_b"), "event_id"
    )
    timed = tel.filter(F.col(VEHICLE) >= 2).select(VEHICLE, local_text("ts").alias("time"), F.col("signal_a").alias("a,b"), "event_id")
    for rows in (topic, timed):
        rows.write.mode("append").partitionBy(VEHICLE).option("header", True).csv(path)
    rows = read_values(spark, [f"{path}/{VEHICLE}={v}/*.csv" for v in range(5)])
    vehicle = F.regexp_extract("file", rf"{VEHICLE}=(\d+)/", 1).cast("long").alias(VEHICLE)
    return rows.select(vehicle, "t_ns", F.explode("values").alias("name", "value"))
