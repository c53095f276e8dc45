"""Cumulative distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.operators.distance import distance_by_position, distance_by_speed, stitch_distance
from drivetrace.operators.positions import gap_tolerance, position_track
from drivetrace.registry.base import GRAIN, METRIC_KM, oracle, query, run_of, tagged, telemetry
from drivetrace.plans.run import metric
from drivetrace.registry.metrics import SPEC

_TRACK_SQL = """ptrack AS (
  SELECT vehicle_id, ts, latitude AS lat, longitude AS lon,
    sum(step_m) OVER (PARTITION BY vehicle_id ORDER BY ts) / 1000 AS cum_dist_km
  FROM (SELECT *, coalesce(2 * 6371000 * asin(sqrt(pow(sin(radians(latitude - plat) / 2), 2)
      + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2))), 0) AS step_m
    FROM (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM tel
      WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts))))"""


@query(
    "cum_distance_latlon",
    oracle(
        "dist",
        "SELECT vehicle_id, period_id, chunk_idx, sec_time, round(cum_dist_km, 3) AS cum_dist_km FROM dist",
    ),
    METRIC_KM,
)
def cum_distance_latlon(spark, sf):
    return distance_by_position(tagged(spark, sf), fine=GRAIN.fine)


@query(
    "cum_distance_speed",
    oracle(
        "tagged",
        """SELECT vehicle_id, period_id, chunk_idx, sec_time, round(sum(v) OVER (
            PARTITION BY vehicle_id, period_id, chunk_idx ORDER BY sec_time) / 1000, 9) AS cum_dist_km
        FROM (SELECT vehicle_id, period_id, chunk_idx, sec_time, avg(speed_mps) AS v FROM tagged GROUP BY 1, 2, 3, 4)""",
    ),
)
def cum_distance_speed(spark, sf):
    return distance_by_speed(tagged(spark, sf), fine=GRAIN.fine)


@query(
    "distance_stitch",
    oracle(
        "worst",
        """reach AS (SELECT vehicle_id, period_id, chunk_idx, coalesce(sum(max(cum_dist_km)) OVER (
            PARTITION BY vehicle_id, period_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS base FROM worst GROUP BY 1, 2, 3)
        SELECT vehicle_id, period_id, chunk_idx, sec_time, round(cum_dist_km + base, 3) AS cum_dist_km
        FROM worst JOIN reach USING (vehicle_id, period_id, chunk_idx)""",
    ),
    METRIC_KM,
)
def distance_stitch(spark, sf):
    rows = stitch_distance(metric(run_of(spark, sf), SPEC))
    return rows.select("vehicle_id", "period_id", "chunk_idx", "sec_time", "cum_dist_km")


def positions(spark, sf):
    """All telemetry positions of a vehicle as its position source."""
    return telemetry(spark, sf).select(
        "vehicle_id", "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "event_id"
    )


@query(
    "position_cumdist",
    oracle(
        "tel",
        _TRACK_SQL + """
        SELECT vehicle_id, ts, round(lat, 9) AS lat, round(lon, 9) AS lon, round(cum_dist_km, 2) AS cum_dist_km
        FROM ptrack""",
    ),
    {"cum_dist_km": 2},
)
def position_cumdist(spark, sf):
    return position_track(positions(spark, sf), ["vehicle_id"], order=["event_id"])


@query(
    "position_gap_tolerance",
    oracle(
        "tel",
        """SELECT vehicle_id, round(median(gap), 9) AS median_gap_s,
          round(coalesce(least(65, greatest(2, 1.5 * median(gap))), 65), 9) AS tolerance_s
        FROM (SELECT vehicle_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY vehicle_id ORDER BY ts)) / 1e6
          AS gap FROM tel) GROUP BY 1""",
    ),
)
def position_gap_tolerance(spark, sf):
    return gap_tolerance(positions(spark, sf), ["vehicle_id"])
