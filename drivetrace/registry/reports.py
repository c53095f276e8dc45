"""Comparison, axes, maps, range checks, export and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.config import HIST_DISPLAY_BIN, KEYS, PERIOD, SMOOTH_WINDOW_DEFAULT, VEHICLE
from drivetrace.operators.compare import (
    axis_mode,
    hist_range_check,
    new_warnings,
    range_warnings,
    scatter_range_check,
    union_periods,
    visible,
    with_labels,
    xy_rows,
)
from drivetrace.operators.histogram import rebin
from drivetrace.operators.positions import map_points, position_track, positions_of_results, prefer_source
from drivetrace.plans.export import sheets
from drivetrace.plans.run import custom, metric, report, whole_periods
from drivetrace.registry.base import METRIC_KM, oracle, periods, query, run_of, tagged
from drivetrace.registry.histograms import _RATIOS, of_periods
from drivetrace.registry.metrics import FIELD, SERIES, SPEC

_SERIES_SQL = """series AS (
  SELECT vehicle_id, period_id, chunk_idx, sec_time, avg(signal_a) * 0.5 + 3 AS value, avg(latitude) AS latitude,
    avg(longitude) AS longitude FROM tagged GROUP BY 1, 2, 3, 4)"""


@query(
    "period_union",
    oracle(
        "worst",
        _SERIES_SQL + """
        SELECT 'metric' AS item, vehicle_id, period_id, chunk_idx, sec_time, round(signal_a, 9) AS value,
          win FROM worst
        UNION ALL SELECT 'series', vehicle_id, period_id, chunk_idx, sec_time, round(value, 9), NULL FROM series""",
    ),
)
def period_union(spark, sf):
    """Chunks of all periods of two results under one schema."""
    run = run_of(spark, sf)
    points = metric(run, SPEC).select(F.lit("metric").alias("item"), *KEYS, "win", "sec_time", F.col("signal_a").alias("value"))
    series = custom(run, SERIES).select(F.lit("series").alias("item"), *KEYS, "sec_time", "value")
    return union_periods(points, series)


@query(
    "compare_periods",
    oracle(
        "worst periods",
        """SELECT label, vehicle_id, period_id, win, sec_time, round(signal_a, 9) AS signal_a FROM worst
        JOIN periods USING (period_id) WHERE label IN ('baseline', '期間2')""",
    ),
)
def compare_periods(spark, sf):
    """Periods side by side by label; a blank label got its default; one period is hidden."""
    rows = with_labels(metric(run_of(spark, sf), SPEC), periods(spark))
    return visible(rows, ["baseline", "期間2"]).select("label", VEHICLE, PERIOD, "win", "sec_time", "signal_a")


@query(
    "positions_from_metrics",
    oracle(
        "worst",
        _SERIES_SQL + """,
        lg AS (SELECT vehicle_id, period_id, ts, latitude AS lat, longitude AS lon FROM tagged
          WHERE state_name = 'signup' AND period_id = 2),
        u AS (SELECT vehicle_id, period_id, sec_time AS ts, latitude AS lat, longitude AS lon, 0 AS n FROM worst
          UNION ALL SELECT vehicle_id, period_id, sec_time, latitude, longitude, 1 FROM series),
        src AS (SELECT vehicle_id, period_id, ts, lat, lon FROM lg UNION ALL
          SELECT vehicle_id, period_id, ts, lat, lon FROM (SELECT *, row_number() OVER (
            PARTITION BY vehicle_id, period_id, ts ORDER BY n, lat, lon) AS k FROM u) q WHERE k = 1
          AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.vehicle_id = q.vehicle_id AND lg.period_id = q.period_id))
        SELECT vehicle_id, period_id, ts, round(lat, 9) AS lat, round(lon, 9) AS lon,
          round(sum(step_m) OVER (PARTITION BY vehicle_id, period_id ORDER BY ts) / 1000, 2) AS cum_dist_km
        FROM (SELECT *, coalesce(2 * 6371000 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2)
            + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))), 0) AS step_m
          FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM src
            WINDOW w AS (PARTITION BY vehicle_id, period_id ORDER BY ts)))""",
    ),
    {"cum_dist_km": 2},
)
def positions_from_metrics(spark, sf):
    """Position source of each period: its log, else the positions its results carry."""
    run = run_of(spark, sf)
    own = positions_of_results(metric(run, SPEC), custom(run, SERIES), keys=[VEHICLE, PERIOD])
    log = tagged(spark, sf).filter("state_name = 'signup' AND period_id = 2").select(
        VEHICLE, PERIOD, "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.lit(0).alias("source_no")
    )
    source = prefer_source(log, own, [VEHICLE, PERIOD])
    return position_track(source, [VEHICLE, PERIOD], order=["source_no"])


@query(
    "xy_mode_resolve",
    oracle(
        "worst",
        """SELECT vehicle_id, CASE WHEN count(CASE WHEN period_id <> 3 OR vehicle_id > 1 THEN cum_dist_km END) > 0
          THEN 'distance' ELSE 'time' END AS x_mode, 'elapsed' AS x_elapsed FROM worst GROUP BY 1""",
    ),
)
def xy_mode_resolve(spark, sf):
    """Axis of each vehicle's comparison, some of whose periods have no distance."""
    rows = metric(run_of(spark, sf), SPEC)
    lost = (F.col(PERIOD) == 3) & (F.col(VEHICLE) <= 1)
    rows = rows.withColumn("cum_dist_km", F.when(~lost, F.col("cum_dist_km")))
    by_distance = axis_mode(rows, "distance", [VEHICLE])
    elapsed = axis_mode(rows, "elapsed", [VEHICLE]).withColumnRenamed("x_mode", "x_elapsed")
    return by_distance.join(elapsed, VEHICLE)


@query(
    "map_points",
    oracle(
        "tel",
        """SELECT event_id, round(latitude, 9) AS latitude, round(longitude, 9) AS longitude,
          round(signal_a, 9) AS signal_a, round(least(greatest(abs(signal_a), 10), 60), 9) AS color_value
        FROM tel WHERE state_name <> 'error'""",
    ),
)
def map_points_(spark, sf):
    """Samples that can be drawn, with clamped colour value; some positions are unreadable text."""
    from drivetrace.registry.base import telemetry

    text = F.when(F.col("state_name") == "error", F.lit("?")).otherwise(F.col("latitude").cast("string"))
    rows = telemetry(spark, sf).withColumn("latitude", text)
    return map_points(rows, "signal_a", (10.0, 60.0)).select(
        "event_id", "latitude", "longitude", "signal_a", "color_value"
    )


@query(
    "range_check",
    oracle(
        "worst hist_r",
        f"""r AS (SELECT *, {_RATIOS} FROM hist_r WINDOW w AS (PARTITION BY vehicle_id, period_id)),
        s AS (SELECT greatest(avg(ratio_auto) OVER k, avg(ratio_manual) OVER k) AS top FROM (
            SELECT *, CASE WHEN sum(cnt_auto) OVER w > 0 THEN cnt_auto / sum(cnt_auto) OVER w ELSE 0 END AS ratio_auto,
              CASE WHEN sum(cnt_manual) OVER w > 0 THEN cnt_manual / sum(cnt_manual) OVER w ELSE 0 END AS ratio_manual
            FROM hist_r WINDOW w AS (PARTITION BY vehicle_id, period_id))
          WINDOW k AS (PARTITION BY vehicle_id, period_id ORDER BY bin_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
        c AS (
          SELECT 'q1' AS item, 'y' AS axis, -40.0 AS limit_lo, 1e6 AS limit_hi, min(signal_a) AS data_lo, max(signal_a) AS data_hi FROM worst
          UNION ALL SELECT 'q1', 'x', 0, 10, min(cum_dist_km), max(cum_dist_km) FROM worst
          UNION ALL SELECT 'q3', 'x', -5, 5, min(bin_start), max(bin_end) FROM hist_r
          UNION ALL SELECT 'q3', 'y', 0, 0.01, 0, max(top) FROM s)
        SELECT item, axis, CAST(limit_lo AS DOUBLE) AS limit_lo, CAST(limit_hi AS DOUBLE) AS limit_hi,
          round(CAST(data_lo AS DOUBLE), 2) AS data_lo, round(CAST(data_hi AS DOUBLE), 2) AS data_hi,
          data_lo < limit_lo OR data_hi > limit_hi AS out_of_range FROM c""",
    ),
    {"data_lo": 2, "data_hi": 2},
)
def range_check(spark, sf):
    """Axis limits against all data shown, smoothed shares included."""
    points = metric(run_of(spark, sf), SPEC)
    shown = rebin(of_periods(spark, sf), HIST_DISPLAY_BIN)
    return union_periods(
        scatter_range_check(points, "q1", "signal_a", ylim=(-40.0, 1e6), xlim=(0.0, 10.0)),
        hist_range_check(
            shown, "q3", [VEHICLE, PERIOD], xlim=(-5.0, 5.0), ylim=(0.0, 0.01), window=SMOOTH_WINDOW_DEFAULT
        ),
    )


@query(
    "xy_distance",
    oracle(
        "worst",
        """SELECT vehicle_id, period_id, chunk_idx, win, round(cum_dist_km, 3) AS x, round(signal_a, 9) AS signal_a
        FROM worst WHERE cum_dist_km IS NOT NULL""",
    ),
    {"x": 3},
)
def xy_distance(spark, sf):
    """Distance as axis."""
    rows = metric(run_of(spark, sf), SPEC)
    return xy_rows(rows, "signal_a", "distance").select(VEHICLE, PERIOD, "chunk_idx", "win", "x", "signal_a")


@query(
    "range_new_warnings",
    oracle(
        "worst",
        """c AS (SELECT 'q1' AS item, 'y' AS axis, -30.0 AS limit_lo, 40.0 AS limit_hi, min(signal_a) AS data_lo, max(signal_a) AS data_hi FROM worst
          UNION ALL SELECT 'q1', 'x', 0, 0.5, min(cum_dist_km), max(cum_dist_km) FROM worst)
        SELECT item, axis, CAST(limit_lo AS DOUBLE) AS limit_lo, CAST(limit_hi AS DOUBLE) AS limit_hi,
          round(CAST(data_lo AS DOUBLE), 2) AS data_lo, round(CAST(data_hi AS DOUBLE), 2) AS data_hi FROM c WHERE axis = 'x'""",
    ),
    {"data_lo": 2, "data_hi": 2},
)
def range_new_warnings(spark, sf):
    """The distance was not checked before; the value's warning is known."""
    points = metric(run_of(spark, sf), SPEC)
    before = range_warnings(scatter_range_check(points, "q1", "signal_a", ylim=(-30.0, 40.0)))
    now = range_warnings(scatter_range_check(points, "q1", "signal_a", ylim=(-30.0, 40.0), xlim=(0.0, 0.5)))
    return new_warnings(now, before)


@query(
    "export_sheet_rows",
    oracle(
        "worst",
        """SELECT 'T' || period_id || '_C' || (chunk_idx + 1) || '_Q1' AS sheet, vehicle_id,
          win + INTERVAL 9 HOUR AS win, sec_time + INTERVAL 9 HOUR AS sec_time, round(signal_a, 9) AS signal_a,
          round(abs_signal_a, 9) AS abs_signal_a, round(cum_dist_km, 3) AS cum_dist_km FROM worst""",
    ),
    METRIC_KM,
)
def export_sheet_rows(spark, sf):
    """Rows of the export, one sheet per period, chunk and result, in local time."""
    run = run_of(spark, sf, metrics=(SPEC,), hist_column="signal_b")
    return sheets(run)["Q1"].select(
        "sheet", VEHICLE, "win", "sec_time", "signal_a", "abs_signal_a", "cum_dist_km"
    )


@query(
    "export_sheet_hist",
    oracle(
        "hist",
        f"""r AS (SELECT vehicle_id, period_id, chunk_idx, bin_start, round(bin_start + 0.2, 9) AS bin_end,
            CAST(sum(cnt_auto) AS BIGINT) AS cnt_auto, CAST(sum(cnt_manual) AS BIGINT) AS cnt_manual
          FROM (SELECT * EXCLUDE (bin_start), round(floor(bin_start / CAST(0.2 AS DOUBLE) + 1e-9) * CAST(0.2 AS DOUBLE), 9)
            AS bin_start FROM hist) GROUP BY 1, 2, 3, 4)
        SELECT * EXCLUDE (period_id, chunk_idx), {_RATIOS}, 'T' || period_id || '_C' || (chunk_idx + 1) || '_Q2' AS sheet
        FROM r WINDOW w AS (PARTITION BY vehicle_id, period_id, chunk_idx)""",
    ),
)
def export_sheet_hist(spark, sf):
    """The export's histogram sheets, at display width."""
    run = run_of(spark, sf, metrics=(SPEC,), hist_column="signal_b")
    return sheets(run)["Q2"].drop(PERIOD, "chunk_idx", "query")


@query(
    "metric_whole_periods",
    oracle(
        "worst periods",
        """reach AS (SELECT vehicle_id, period_id, chunk_idx, coalesce(sum(max(cum_dist_km)) OVER (
            PARTITION BY vehicle_id, period_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS base FROM worst GROUP BY 1, 2, 3)
        SELECT label, vehicle_id, sec_time, round(signal_a, 9) AS signal_a, round(cum_dist_km + base, 3) AS cum_dist_km
        FROM worst JOIN reach USING (vehicle_id, period_id, chunk_idx) JOIN periods USING (period_id)""",
    ),
    METRIC_KM,
)
def metric_whole_periods(spark, sf):
    """A metric over whole periods on a continued distance axis, labelled."""
    rows = whole_periods(metric(run_of(spark, sf), SPEC))
    return with_labels(rows, periods(spark)).select("label", VEHICLE, "sec_time", "signal_a", "cum_dist_km")


@query(
    "run_report",
    oracle(
        "worst hist periods",
        _SERIES_SQL + """,
        scaled AS (SELECT *, signal_b * CAST(-2 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS value FROM tagged),
        cm AS (SELECT * FROM (
          SELECT p.*, row_number() OVER (PARTITION BY p.vehicle_id, p.period_id, p.chunk_idx, date_trunc('day', p.sec_time)
            ORDER BY abs(value) DESC, p.sec_time, p.ts, p.event_id) AS wrank
          FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, period_id, chunk_idx, sec_time
              ORDER BY abs(value) DESC, ts, event_id) AS srank FROM scaled WHERE abs(value) >= 1.5) p
          JOIN moded m USING (vehicle_id, period_id, chunk_idx, sec_time) WHERE p.srank = 1 AND m.is_auto) q
          LEFT JOIN dist USING (vehicle_id, period_id, chunk_idx, sec_time) WHERE wrank = 1),
        ch AS (SELECT vehicle_id, period_id, chunk_idx, floor(value / 0.5) * 0.5 AS bin_start,
            count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
          FROM scaled JOIN moded USING (vehicle_id, period_id, chunk_idx, sec_time) GROUP BY 1, 2, 3, 4),
        sh AS (SELECT vehicle_id, period_id, chunk_idx, round(i * CAST(0.2 AS DOUBLE), 9) AS bin_start,
            count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
          FROM (SELECT *, CAST(floor((signal_a * 0.5 + 3) / CAST(0.2 AS DOUBLE)) AS BIGINT) AS i FROM tagged
            JOIN moded USING (vehicle_id, period_id, chunk_idx, sec_time)) GROUP BY 1, 2, 3, i),
        nt AS (SELECT vehicle_id, period_id, chunk_idx, count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
          FROM moded GROUP BY 1, 2, 3),
        al AS (
          SELECT 'metric:q1' AS item, vehicle_id, period_id, chunk_idx, sec_time, signal_a AS value, cum_dist_km,
            CAST(NULL AS DOUBLE) AS bin_start, CAST(NULL AS BIGINT) AS cnt_auto, CAST(NULL AS BIGINT) AS cnt_manual FROM worst
          UNION ALL SELECT 'custom:cf1', vehicle_id, period_id, chunk_idx, sec_time, value, cum_dist_km, NULL, NULL, NULL FROM cm
          UNION ALL SELECT 'custom:cf2', vehicle_id, period_id, chunk_idx, sec_time, value, cum_dist_km, NULL, NULL, NULL
            FROM series LEFT JOIN dist USING (vehicle_id, period_id, chunk_idx, sec_time)
          UNION ALL SELECT 'hist', vehicle_id, period_id, chunk_idx, NULL, NULL, NULL, bin_start, cnt_auto, cnt_manual FROM hist
          UNION ALL SELECT 'customhist:cf1', vehicle_id, period_id, chunk_idx, NULL, NULL, NULL, bin_start, cnt_auto, cnt_manual FROM ch
          UNION ALL SELECT 'customhist:cf2', vehicle_id, period_id, chunk_idx, NULL, NULL, NULL, bin_start, cnt_auto, cnt_manual FROM sh
          UNION ALL SELECT 'notes', vehicle_id, period_id, chunk_idx, NULL, NULL, NULL, NULL, cnt_auto, cnt_manual FROM nt)
        SELECT item, vehicle_id, period_id, label, chunk_idx, sec_time, round(value, 9) AS value,
          round(cum_dist_km, 3) AS cum_dist_km, round(bin_start, 9) AS bin_start, cnt_auto, cnt_manual
        FROM al JOIN periods USING (period_id)""",
    ),
    METRIC_KM,
)
def run_report(spark, sf):
    """A whole run over stored seconds: a metric, the histogram, two custom fields with theirs, and the state notes."""
    run = run_of(spark, sf, store=True, metrics=(SPEC,), hist_column="signal_b", fields=(FIELD, SERIES))
    return report(run, periods(spark))
