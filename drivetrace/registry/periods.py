"""Periods, chunks, exclusions and time text."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.functions.timegrain import (
    floor_time,
    local_day_start,
    local_text,
    next_local_day,
    plus_seconds,
)
from drivetrace.operators import periods as ops
from drivetrace.registry.base import (
    GRAIN,
    chunks,
    excludes,
    leg_periods,
    oracle,
    query,
    periods,
    table,
    telemetry,
)
from drivetrace.sources.range_text import parse_excludes, parse_periods
from drivetrace.sources.tables import first_rows_between, normalized


@query(
    "period_filter",
    oracle(
        "tel chunks",
        """SELECT event_id, vehicle_id, ts, period_id, chunk_idx
        FROM tel JOIN chunks ON ts >= chunk_start AND ts < chunk_end""",
    ),
)
def period_filter(spark, sf):
    return ops.tag_chunks(telemetry(spark, sf), chunks(spark)).select(
        "event_id", "vehicle_id", "ts", "period_id", "chunk_idx"
    )


@query(
    "exclude_anti",
    oracle(
        "tel excludes",
        """SELECT event_id, vehicle_id, ts FROM tel
        WHERE NOT EXISTS (SELECT 1 FROM excludes x WHERE ts >= x.start_ts AND ts < x.end_ts)""",
    ),
)
def exclude_anti(spark, sf):
    return ops.drop_excluded(telemetry(spark, sf), excludes(spark)).select("event_id", "vehicle_id", "ts")


@query(
    "exclude_preview_flag",
    oracle(
        "tel excludes",
        """SELECT event_id, ts, EXISTS (SELECT 1 FROM excludes x WHERE tel.ts >= x.start_ts AND tel.ts < x.end_ts)
        AS excluded FROM tel""",
    ),
)
def exclude_preview_flag(spark, sf):
    return ops.flag_excluded(telemetry(spark, sf), excludes(spark)).select("event_id", "ts", "excluded")


@query(
    "chunk_periods",
    oracle(
        "leg_periods",
        """SELECT period_id, vehicle_id, CAST(i AS INTEGER) AS chunk_idx, start_ts + to_minutes(90 * i) AS chunk_start,
          least(start_ts + to_minutes(90 * (i + 1)), end_ts) AS chunk_end
        FROM leg_periods, range(0, 4) r(i) WHERE start_ts + to_minutes(90 * i) < end_ts""",
    ),
)
def chunk_periods(spark, sf):
    return ops.chunk_periods(leg_periods(spark, sf), 90).select(
        "period_id", "vehicle_id", "chunk_idx", "chunk_start", "chunk_end"
    )


@query(
    "ranges_from_text",
    oracle(
        "leg_periods",
        """SELECT period_id AS line_no,
          CASE WHEN error = 'fields' THEN NULL ELSE start_ts END AS start_ts,
          CASE WHEN error IN ('fields', 'time') THEN NULL
            WHEN error = 'order' THEN start_ts - INTERVAL 1 HOUR ELSE end_ts END AS end_ts,
          CASE WHEN error IS NOT NULL OR status = 'F' THEN '' ELSE label || ' 6/7' END AS label, error
        FROM (SELECT *,
            CASE WHEN priority LIKE '5%' AND status = 'F' THEN 'fields'
              WHEN priority LIKE '5%' AND status = 'O' THEN 'time'
              WHEN priority LIKE '5%' THEN 'order' END AS error FROM leg_periods)""",
    ),
)
def ranges_from_text(spark, sf):
    """Every order written as a line of period input, in one of the accepted notations."""
    start = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss")
    end = F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss")
    local_start, local_end = local_text("start_ts"), local_text("end_ts", pattern="yyyy-MM-dd HH:mm:ss.SSS")
    before = F.date_format(plus_seconds("start_ts", -3600), "yyyy-MM-dd'T'HH:mm:ss")
    z = F.lit("Z")
    style, status = F.col("priority"), F.col("status")
    times = (
        F.when(style.startswith("1"), F.concat(start, z, F.lit(","), end, z))
        .when(style.startswith("2"), F.concat(local_start, F.lit(" / "), local_end))
        .when(style.startswith("3"), F.concat(local_start, F.lit("+09:00，"), local_end, F.lit("+0900")))
        .when(style.startswith("4"), F.concat(F.lit("  "), start, F.lit("Z / "), end, z))
        .when(status == "F", F.concat(start, z))
        .when(status == "O", F.concat(start, F.lit("Z,soon")))
        .otherwise(F.concat(start, F.lit("Z,"), before, z))
    )
    named = (status != "F") & ~style.startswith("5")
    line = F.when(named, F.concat(times, F.lit(", "), F.col("label"), F.lit(" 6/7"))).otherwise(times)
    lines = leg_periods(spark, sf).select(F.col("period_id").alias("line_no"), line.alias("value"))
    return parse_periods(lines, keep=["line_no"])


@query(
    "excludes_from_text",
    oracle(
        "leg_periods",
        """SELECT period_id AS line_no, start_ts, CASE WHEN status = 'O' THEN end_ts ELSE start_ts END AS end_ts,
          CASE WHEN status = 'O' THEN NULL ELSE 'order' END AS error
        FROM leg_periods WHERE status <> 'P'""",
    ),
)
def excludes_from_text(spark, sf):
    """Every order written as a line of exclusion input; pending ones are commented out."""
    start = F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    end = F.when(F.col("status") == "O", F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(start)
    style = F.col("priority")
    between = (
        F.when(style.startswith("1"), F.lit(","))
        .when(style.startswith("2"), F.lit("/"))
        .when(style.startswith("3"), F.lit(" - "))
        .otherwise(F.lit("  "))
    )
    mark = F.when(F.col("status") == "P", F.lit("# ")).otherwise(F.lit(""))
    lines = leg_periods(spark, sf).select(
        F.col("period_id").alias("line_no"), F.concat(mark, start, between, end).alias("value")
    )
    return parse_excludes(lines, keep=["line_no"])


@query(
    "exclude_from_points",
    oracle(
        "tel",
        """SELECT vehicle_id, date_trunc('day', ts) AS selection, min(date_trunc('second', ts)) AS start_ts,
          max(date_trunc('second', ts)) + INTERVAL 1 SECOND AS end_ts FROM tel GROUP BY 1, 2""",
    ),
)
def exclude_from_points(spark, sf):
    points = telemetry(spark, sf).select(
        "vehicle_id",
        floor_time("ts", GRAIN.coarse).alias("selection"),
        floor_time("ts", "second").alias("sec_time"),
    )
    return ops.exclude_from_points(points, ["vehicle_id", "selection"])


@query(
    "exclude_union",
    oracle(
        "leg_periods",
        """SELECT start_ts, end_ts FROM leg_periods WHERE status <> 'F'
        UNION SELECT start_ts, end_ts FROM leg_periods WHERE status <> 'O'""",
    ),
)
def exclude_union(spark, sf):
    ranges = leg_periods(spark, sf)
    return ops.union_excludes(ranges.filter("status <> 'F'"), ranges.filter("status <> 'O'"))


@query(
    "exclude_pending",
    oracle(
        "leg_periods",
        """SELECT DISTINCT start_ts, end_ts FROM leg_periods l WHERE NOT EXISTS (
          SELECT 1 FROM leg_periods a WHERE a.status = 'F' AND a.start_ts = l.start_ts AND a.end_ts = l.end_ts)""",
    ),
)
def exclude_pending(spark, sf):
    ranges = leg_periods(spark, sf)
    return ops.pending_excludes(ops.union_excludes(ranges), ranges.filter("status = 'F'"))


@query(
    "compare_window",
    oracle(
        "leg_periods",
        "SELECT vehicle_id, min(start_ts) AS win_start, max(end_ts) AS win_end FROM leg_periods GROUP BY 1",
    ),
)
def compare_window(spark, sf):
    return ops.compare_window(leg_periods(spark, sf), ["vehicle_id"])


@query(
    "suggested_split",
    oracle(
        "leg_periods",
        """SELECT vehicle_id, CAST(greatest(1, max(ceil(epoch(end_ts - start_ts) / 60))) AS INTEGER) AS split_minutes
        FROM leg_periods GROUP BY 1""",
    ),
)
def suggested_split(spark, sf):
    return ops.suggested_split(leg_periods(spark, sf), ["vehicle_id"])


@query(
    "period_overlap_choice",
    oracle(
        "tel periods",
        """files AS (SELECT vehicle_id, date_trunc('week', ts) AS file, min(date_trunc('second', ts)) AS a,
            max(date_trunc('second', ts)) AS z FROM tel GROUP BY 1, 2),
        o AS (SELECT vehicle_id, file, period_id, label,
            epoch_us(least(z, end_ts)) / 1e6 - epoch_us(greatest(a, start_ts)) / 1e6 AS overlap_s FROM files, periods)
        SELECT vehicle_id, file, period_id, label, round(overlap_s, 9) AS overlap_s FROM (
          SELECT *, row_number() OVER (PARTITION BY vehicle_id, file ORDER BY overlap_s DESC, period_id) AS n
          FROM o WHERE overlap_s > 0) WHERE n = 1""",
    ),
)
def period_overlap_choice(spark, sf):
    """Each vehicle's week of telemetry as one file, placed into the periods."""
    second = floor_time("ts", "second")
    files = (
        telemetry(spark, sf)
        .groupBy("vehicle_id", F.date_trunc("week", "ts").alias("file"))
        .agg(F.min(second).alias("first_ts"), F.max(second).alias("last_ts"))
    )
    chosen = ops.choose_period(files.withColumnRenamed("file", "week"), periods(spark), file_key="week", extra=["vehicle_id"])
    return chosen.withColumnRenamed("week", "file")


@query(
    "grain_floor",
    oracle(
        "tel",
        """SELECT event_id, date_trunc('second', ts) AS sec, date_trunc('minute', ts) AS win,
          make_timestamp((epoch_us(ts) // 5000000) * 5000000) AS bucket5 FROM tel""",
    ),
)
def grain_floor(spark, sf):
    return telemetry(spark, sf).select(
        "event_id",
        floor_time("ts", "second").alias("sec"),
        floor_time("ts", "minute").alias("win"),
        floor_time("ts", 5).alias("bucket5"),
    )


@query(
    "local_time_text",
    oracle(
        "tel",
        """SELECT event_id, CASE WHEN state_name = 'error' THEN 'bad ' || event_id
          ELSE strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS shown FROM tel""",
    ),
)
def local_time_text(spark, sf):
    """Time texts for display; text that is no time stays as it is."""
    from drivetrace.functions.text import parse_instant

    text = F.when(F.col("state_name") == "error", F.concat(F.lit("bad "), F.col("event_id"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    )
    rows = telemetry(spark, sf).select("event_id", text.alias("raw"))
    return rows.select("event_id", F.coalesce(local_text(parse_instant("raw")), "raw").alias("shown"))


@query(
    "local_day_bounds",
    oracle(
        "tel",
        """SELECT vehicle_id, date_trunc('day', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR AS day_start,
          date_trunc('day', ts + INTERVAL 9 HOUR) + INTERVAL 15 HOUR AS day_end, count(*) AS n_rows
        FROM tel GROUP BY ALL""",
    ),
)
def local_day_bounds(spark, sf):
    return (
        telemetry(spark, sf)
        .groupBy("vehicle_id", local_day_start("ts").alias("day_start"), next_local_day("ts").alias("day_end"))
        .agg(F.count("*").alias("n_rows"))
    )


@query(
    "raw_between_limit",
    oracle(
        "",
        """SELECT ts, vehicle_id, round(lateral_error, 9) AS lateral_error FROM (
          SELECT ts, user_id % 5 AS vehicle_id, value AS lateral_error, event_id FROM events
          WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 00:00:00'
          ORDER BY ts, event_id LIMIT 1000)""",
    ),
)
def raw_between_limit(spark, sf):
    """The bounded look at a signal: closed range, earliest rows first, row limit."""
    raw = table(spark, sf, "events").select(
        "ts", (F.col("user_id") % 5).alias("vehicle_id"), F.col("value").alias("lateral_error"), "event_id"
    )
    rows = first_rows_between(normalized(raw), "2024-01-05 00:00:00", "2024-01-25 00:00:00", 1000, tie="event_id")
    return rows.drop("event_id")


@query(
    "xy_elapsed",
    oracle(
        "tel periods",
        """SELECT event_id, period_id, round((epoch_us(ts) - epoch_us(start_ts)) / 6e7, 9) AS x,
          round(signal_a, 9) AS signal_a FROM tel JOIN periods ON ts >= start_ts AND ts < end_ts""",
    ),
)
def xy_elapsed(spark, sf):
    from drivetrace.operators.compare import xy_rows
    from drivetrace.operators.intervals import join_intervals

    rows = join_intervals(telemetry(spark, sf), periods(spark)).withColumnRenamed("ts", "sec_time")
    return xy_rows(rows, "signal_a", "elapsed", "start_ts").select("event_id", "period_id", "x", "signal_a")


@query(
    "xy_time",
    oracle(
        "tel periods",
        """SELECT event_id, period_id, ts + INTERVAL 9 HOUR AS x, round(signal_a, 9) AS signal_a
        FROM tel JOIN periods ON ts >= start_ts AND ts < end_ts""",
    ),
)
def xy_time(spark, sf):
    """Local wall-clock time as axis."""
    from drivetrace.operators.compare import xy_rows
    from drivetrace.operators.intervals import join_intervals

    rows = join_intervals(telemetry(spark, sf), periods(spark)).withColumnRenamed("ts", "sec_time")
    return xy_rows(rows, "signal_a", "time").select("event_id", "period_id", "x", "signal_a")


