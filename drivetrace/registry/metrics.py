"""Worst sample per window and custom fields."""

from __future__ import annotations

from drivetrace.config import CustomField, MetricSpec
from drivetrace.plans.run import custom, custom_hist, metric
from drivetrace.registry.base import METRIC_KM, THRESHOLD, oracle, query, run_of

SPEC = MetricSpec("q1", "signal_a", "signal_a", THRESHOLD)
FIELD = CustomField("cf1", "scaled", "telemetry", "signal_b", "metric", 1.5, 0.5, -2.0, 0.25)
SERIES = CustomField("cf2", "series", "telemetry", "signal_a", "timeseries", 0.0, 0.2, 0.5, 3.0)

_SCALED = """scaled AS (
  SELECT *, signal_b * CAST(-2 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS value FROM tagged)"""


@query(
    "metric_worst_per_window",
    oracle(
        "worst",
        """SELECT vehicle_id, period_id, chunk_idx, win, sec_time, round(latitude, 9) AS latitude,
          round(longitude, 9) AS longitude, round(signal_a, 9) AS signal_a, round(abs_signal_a, 9) AS abs_signal_a,
          round(cum_dist_km, 3) AS cum_dist_km FROM worst""",
    ),
    METRIC_KM,
)
def metric_worst_per_window(spark, sf):
    """Worst sample per day while driving automatically, for all vehicles, periods and chunks."""
    return metric(run_of(spark, sf), SPEC)


@query(
    "custom_metric",
    oracle(
        "tagged moded dist",
        _SCALED + """
        SELECT vehicle_id, period_id, chunk_idx, win, sec_time, round(latitude, 9) AS latitude,
          round(longitude, 9) AS longitude, round(value, 9) AS value, round(abs_value, 9) AS abs_value,
          round(cum_dist_km, 3) AS cum_dist_km
        FROM (
          SELECT p.*, date_trunc('day', p.sec_time) AS win, row_number() OVER (
            PARTITION BY p.vehicle_id, p.period_id, p.chunk_idx, date_trunc('day', p.sec_time)
            ORDER BY abs_value DESC, p.sec_time, p.ts, p.event_id) AS wrank
          FROM (SELECT *, abs(value) AS abs_value, row_number() OVER (
              PARTITION BY vehicle_id, period_id, chunk_idx, sec_time ORDER BY abs(value) DESC, ts, event_id) AS srank
            FROM scaled WHERE abs(value) >= 1.5) p
          JOIN moded m USING (vehicle_id, period_id, chunk_idx, sec_time) WHERE p.srank = 1 AND m.is_auto) q
        LEFT JOIN dist USING (vehicle_id, period_id, chunk_idx, sec_time) WHERE wrank = 1""",
    ),
    METRIC_KM,
)
def custom_metric(spark, sf):
    return custom(run_of(spark, sf), FIELD)


@query(
    "custom_timeseries",
    oracle(
        "tagged dist",
        """SELECT vehicle_id, period_id, chunk_idx, sec_time, round(value, 9) AS value, round(latitude, 9) AS latitude,
          round(longitude, 9) AS longitude, round(cum_dist_km, 3) AS cum_dist_km
        FROM (SELECT vehicle_id, period_id, chunk_idx, sec_time, avg(signal_a) * 0.5 + 3 AS value,
            avg(latitude) AS latitude, avg(longitude) AS longitude FROM tagged GROUP BY 1, 2, 3, 4)
        LEFT JOIN dist USING (vehicle_id, period_id, chunk_idx, sec_time)""",
    ),
    METRIC_KM,
)
def custom_timeseries(spark, sf):
    return custom(run_of(spark, sf), SERIES)


@query(
    "custom_hist",
    oracle(
        "tagged moded",
        _SCALED + """,
        c AS (SELECT vehicle_id, period_id, chunk_idx, floor(value / 0.5) * 0.5 AS bin_start,
            floor(value / 0.5) * 0.5 + 0.5 AS bin_end, count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
          FROM scaled JOIN moded USING (vehicle_id, period_id, chunk_idx, sec_time) GROUP BY 1, 2, 3, 4, 5)
        SELECT *, CASE WHEN sum(cnt_auto) OVER w > 0 THEN round(cnt_auto / sum(cnt_auto) OVER w, 9) ELSE 0 END AS ratio_auto,
          CASE WHEN sum(cnt_manual) OVER w > 0 THEN round(cnt_manual / sum(cnt_manual) OVER w, 9) ELSE 0 END AS ratio_manual
        FROM c WINDOW w AS (PARTITION BY vehicle_id, period_id, chunk_idx)""",
    ),
)
def custom_hist_(spark, sf):
    return custom_hist(run_of(spark, sf), FIELD)
