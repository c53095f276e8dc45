"""Whole pipelines over many files at once: overrides applied again, imported periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.config import PERIOD, VEHICLE, RunSpec
from drivetrace.functions.timegrain import floor_time
from drivetrace.operators.compare import union_periods, with_labels
from drivetrace.operators.intervals import join_intervals
from drivetrace.plans.csv_import import csv_hist, csv_metric, csv_periods
from drivetrace.plans.override import replay
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
    telemetry,
)
from drivetrace.registry.metrics import FIELD, SERIES, SPEC

TOL_US = str(int(TOLERANCE_S * 1e6))
RUN = RunSpec(grain=GRAIN, metrics=(SPEC,), fields=(FIELD, SERIES))


def files(spark, sf):
    """One file per vehicle: each row's time and its numbers by column, one of them never a number."""
    values = F.create_map(
        F.lit("debug.signal_b"), F.col("signal_b"), F.lit("signal_a"), F.col("signal_a"), F.lit("text"), F.lit(None).cast("double")
    )
    return telemetry(spark, sf).select(
        F.concat(F.lit("file "), VEHICLE).alias("file"), "ts", floor_time("ts", "second").alias("sec_time"),
        F.col("event_id").alias("t_ns"), values.alias("values"),
    )


# Each vehicle has one period of its own; label and vehicle together name it.
_OWN = """own AS (SELECT * FROM (VALUES
  (0, 1, 'baseline', TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-09 12:00:00'),
  (1, 2, 'baseline', TIMESTAMP '2024-01-05 00:00:00', TIMESTAMP '2024-01-12 00:00:00'),
  (2, 3, 'late', TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-28 00:00:00'),
  (3, 4, 'late', TIMESTAMP '2024-01-15 00:00:00', TIMESTAMP '2024-01-21 00:00:00')
) o(vehicle_id, period_id, label, start_ts, end_ts))"""
_RECIPES = (
    # seq, file, vehicle, target, column, scale, offset, period_label, drive_mode
    (1, "file 0", 0, "q1", "debug.signal_b", 10.0, 1.0, "", "auto"),
    (2, "file 0", 0, "q1", "debug.signal_b", 20.0, 1.0, "", "auto"),
    (3, "file 1", 1, "q1", "", 2.0, 0.0, "baseline", "state"),
    (4, "file 2", 2, "q1", "debug.signal_b", 10.0, 0.0, "late", "manual"),
    (5, "file 3", 3, "q1", "signal_a", 3.0, 0.0, "", "state"),
    (6, "file 0", 3, "q1", "missing", 1.0, 0.0, "late", "auto"),
    (7, "file 1", 4, "q1", "signal_a", 1.0, 0.0, "", "auto"),
)


def _own(spark):
    rows = ", ".join(
        f"named_struct('{VEHICLE}', {v}L, '{PERIOD}', {p}, 'label', '{label}', 'start_ts', timestamp'{a}', 'end_ts', timestamp'{b}')"
        for v, p, label, a, b in (
            (0, 1, "baseline", "2024-01-02 00:00:00", "2024-01-09 12:00:00"),
            (1, 2, "baseline", "2024-01-05 00:00:00", "2024-01-12 00:00:00"),
            (2, 3, "late", "2024-01-18 00:00:00", "2024-01-28 00:00:00"),
            (3, 4, "late", "2024-01-15 00:00:00", "2024-01-21 00:00:00"),
        )
    )
    return spark.range(0, 1, 1, 1).select(F.expr(f"inline(array({rows}))"))


def _inside(spark, sf):
    """Telemetry in the periods of its vehicle."""
    tel = telemetry(spark, sf).withColumn(VEHICLE, F.col(VEHICLE).cast("long"))
    tel = tel.withColumn("sec_time", floor_time("ts", "second"))
    own = _own(spark).select(VEHICLE, PERIOD, "start_ts", "end_ts")
    return join_intervals(tel, own, ts="sec_time", on=[VEHICLE]).drop("start_ts", "end_ts")


def _base_metric(inside):
    return csv_metric(
        inside.withColumn("is_auto", F.lit(True)).drop("latitude", "longitude"), F.col(SPEC.name), SPEC.name, SPEC.threshold,
        [VEHICLE, PERIOD], GRAIN, ("ts", "event_id"),
    )


def _recipes(spark, rows):
    return spark.createDataFrame(
        rows, f"seq int, file string, {VEHICLE} long, target string, column string, scale double, offset double, "
        "period_label string, drive_mode string",
    )


def replayed(spark, sf):
    own = _own(spark)
    inside = _inside(spark, sf)
    base = _base_metric(inside)
    states = inside.filter("state_name IN ('purchase', 'error') AND vehicle_id <> 3").select(
        VEHICLE, PERIOD, "ts", "event_id", "system_state"
    )
    recipes = _recipes(spark, _RECIPES)
    return replay(
        {"metric:q1": base}, recipes, files(spark, sf), RUN, own, order=["seq"], states=states, excludes=excludes(spark),
        state_order=["event_id"], tolerance_s=TOLERANCE_S, slice_s=SLICE_S,
    )


_WORST = """SELECT {keys}, date_trunc('day', s) AS win, s AS sec_time, v, row_number() OVER (
  PARTITION BY {keys}, date_trunc('day', s) ORDER BY abs(v) DESC, {tie}) AS n FROM {rows} WHERE abs(v) >= {least}"""


@query(
    "override_replay",
    oracle(
        "tel excludes",
        _OWN + f""", inr AS (SELECT t.*, o.period_id, date_trunc('second', ts) AS s FROM tel t JOIN own o
            ON t.vehicle_id = o.vehicle_id AND date_trunc('second', ts) >= start_ts AND date_trunc('second', ts) < end_ts),
        base AS (SELECT * FROM ({_WORST.format(keys='vehicle_id, period_id', tie='ts, event_id', rows='(SELECT *, signal_a AS v FROM inr)', least=20)}) WHERE n = 1),
        kept AS (SELECT * FROM inr WHERE NOT EXISTS (SELECT 1 FROM excludes x WHERE s >= x.start_ts AND s < x.end_ts)),
        lft AS (SELECT event_id AS rid, vehicle_id, ts FROM kept WHERE vehicle_id = 1),
        rgt AS (SELECT vehicle_id, ts, max(system_state) AS system_state FROM inr
          WHERE vehicle_id = 1 AND state_name IN ('purchase', 'error') GROUP BY 1, 2),
        """ + nearest_sql("lft", "rgt", "system_state", TOL_US) + f""",
        rep AS (
          SELECT vehicle_id, period_id, s, ts, event_id, signal_b * 20 + 1 AS v FROM kept WHERE vehicle_id = 0
          UNION ALL SELECT k.vehicle_id, k.period_id, k.s, k.ts, k.event_id, signal_a * 2 FROM kept k JOIN near ON rid = event_id
            WHERE m_system_state = (SELECT CASE WHEN max(system_state) >= 5 THEN 16 ELSE 4 END FROM rgt)),
        new AS (SELECT * FROM ({_WORST.format(keys='vehicle_id, period_id', tie='event_id', rows='rep', least=20)}) WHERE n = 1)
        SELECT vehicle_id, period_id, win, sec_time, round(v, 9) AS signal_a, FALSE AS overridden FROM base b
          WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.vehicle_id = b.vehicle_id)
        UNION ALL SELECT vehicle_id, period_id, win, sec_time, round(v, 9), TRUE FROM new""",
    ),
)
def override_replay(spark, sf):
    """Seven recipes for five vehicles with periods of their own; some cannot be applied."""
    out, _ = replayed(spark, sf)
    return out["metric:q1"].select(VEHICLE, PERIOD, "win", "sec_time", SPEC.name, "overridden")


@query(
    "override_replay_notes",
    """SELECT * FROM (VALUES (0, 'file 0', 2, 'debug.signal_b', ''), (1, 'file 1', 3, 'signal_a', ''),
      (2, 'file 2', 4, 'debug.signal_b', ''), (3, 'file 3', 5, 'signal_a', 'no states'), (3, 'file 0', 6, NULL, 'no column'),
      (4, 'file 1', 7, 'signal_a', 'no period')) n(vehicle_id, file, seq, "column", note)
    WHERE (SELECT count(*) FROM events) > 0""",
)
def override_replay_notes(spark, sf):
    """What became of each recipe; of two for one place the later is left."""
    return replayed(spark, sf)[1].select(F.col(VEHICLE).cast("int").alias(VEHICLE), "file", "seq", "column", "note")


_INSIDE = """inr AS (SELECT t.*, o.period_id, date_trunc('second', ts) AS s FROM tel t JOIN own o
            ON t.vehicle_id = o.vehicle_id AND date_trunc('second', ts) >= start_ts AND date_trunc('second', ts) < end_ts),
        kept AS (SELECT * FROM inr WHERE NOT EXISTS (SELECT 1 FROM excludes x WHERE s >= x.start_ts AND s < x.end_ts))"""
_TWO = (
    # Two targets from one file and each of another vehicle's; the histogram of the second stays.
    (1, "file 0", 0, "q1", "debug.signal_b", 10.0, 1.0, "", "auto"),
    (2, "file 0", 0, "q3", "signal_a", 1.0, 0.25, "", "manual"),
    (3, "file 3", 3, "q1", "signal_a", 3.0, 0.0, "late", "auto"),
    (4, "file 3", 3, "q3", "missing", 3.0, 0.0, "late", "auto"),
)


@query(
    "override_two_targets",
    oracle(
        "tel excludes",
        _OWN + f""", {_INSIDE},
        base AS (SELECT * FROM ({_WORST.format(keys='vehicle_id, period_id', tie='ts, event_id', rows='(SELECT *, signal_a AS v FROM inr)', least=20)}) WHERE n = 1),
        rep AS (SELECT *, CASE vehicle_id WHEN 0 THEN signal_b * 10 + 1 ELSE signal_a * 3 END AS v FROM kept WHERE vehicle_id IN (0, 3)),
        new AS (SELECT * FROM ({_WORST.format(keys='vehicle_id, period_id', tie='event_id', rows='rep', least=20)}) WHERE n = 1),
        bins AS (SELECT vehicle_id, period_id, floor(signal_b / 0.5) AS i, count(*) AS a, 0 AS b, FALSE AS o FROM inr WHERE vehicle_id <> 0 GROUP BY 1, 2, 3
          UNION ALL SELECT vehicle_id, period_id, floor((signal_a + 0.25) / 0.5), 0, count(*), TRUE FROM kept WHERE vehicle_id = 0 GROUP BY 1, 2, 3)
        SELECT vehicle_id, period_id, sec_time, round(v, 9) AS value, CAST(NULL AS BIGINT) AS cnt_auto, CAST(NULL AS BIGINT) AS cnt_manual, FALSE AS overridden
          FROM base b WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.vehicle_id = b.vehicle_id)
        UNION ALL SELECT vehicle_id, period_id, sec_time, round(v, 9), NULL, NULL, TRUE FROM new
        UNION ALL SELECT vehicle_id, period_id, NULL, round(i * 0.5, 9), a, b, o FROM bins""",
    ),
)
def override_two_targets(spark, sf):
    """One file replaces the metric and the histogram of its vehicle, each by a column of its own."""
    inside = _inside(spark, sf)
    run = RunSpec(grain=GRAIN, metrics=(SPEC,), hist_column="signal_b", hist_bin=0.5)
    hist = csv_hist(inside.withColumn("is_auto", F.lit(True)), F.col("signal_b"), run.hist_bin, [VEHICLE, PERIOD])
    out, _ = replay(
        {"metric:q1": _base_metric(inside), "hist": hist}, _recipes(spark, _TWO), files(spark, sf), run, _own(spark), order=["seq"],
        excludes=excludes(spark),
    )
    none, no_time = F.lit(None).cast("long"), F.lit(None).cast("timestamp")
    points = out["metric:q1"].select(
        VEHICLE, PERIOD, "sec_time", F.col(SPEC.name).alias("value"), none.alias("cnt_auto"), none.alias("cnt_manual"), "overridden"
    )
    bins = out["hist"].select(
        VEHICLE, PERIOD, no_time.alias("sec_time"), F.col("bin_start").alias("value"), F.col("cnt_auto").cast("long").alias("cnt_auto"),
        F.col("cnt_manual").cast("long").alias("cnt_manual"), "overridden",
    )
    return points.unionByName(bins)


_ENTRIES = (
    # label, file, target, column, scale, offset
    ("import a", "file 0", "q1", "", 2.0, 1.0),
    ("import a", "file 0", "cf1", "debug.signal_b", 9.0, 9.0),
    ("import b", "file 3", "cf2", "", 9.0, 9.0),
    ("import b", "file 3", "cf1", "", 9.0, 9.0),
    ("import c", "file 9", "q1", "", 1.0, 0.0),
    ("import d", "file 1", "zzz", "", 1.0, 0.0),
    ("import d", "file 1", "q1", "text", 1.0, 0.0),
    ("import e", "file 1", "q1", "nowhere", 1.0, 0.0),
)


def imported(spark, sf):
    entries = spark.createDataFrame(_ENTRIES, "label string, file string, target string, column string, scale double, offset double")
    states = telemetry(spark, sf).filter("state_name IN ('purchase', 'error')").select("ts", F.col("event_id").alias("t_ns"), "system_state")
    return csv_periods(
        files(spark, sf), entries, RUN, states=states, excludes=excludes(spark), tolerance_s=TOLERANCE_S, slice_s=SLICE_S
    )


# Rows of the files with their nearest state, whichever vehicle it is of; at one instant the last
# counts looking back, the first looking ahead.
_FILES = (
    """src AS (SELECT *, date_trunc('second', ts) AS s, 1 AS k FROM tel WHERE NOT EXISTS (SELECT 1 FROM excludes x
  WHERE date_trunc('second', ts) >= x.start_ts AND date_trunc('second', ts) < x.end_ts)),
lft AS (SELECT event_id AS rid, k, ts, vehicle_id, signal_a, signal_b, s, event_id FROM src WHERE vehicle_id IN (0, 3)),
rgt AS (SELECT 1 AS k, ts, arg_max(system_state, event_id) AS system_state FROM tel
  WHERE state_name IN ('purchase', 'error') GROUP BY ts),"""
    + nearest_sql("lft", "rgt", "system_state", TOL_US, by="k")
    + """,
rows_ AS (SELECT *, CASE vehicle_id WHEN 0 THEN 'import a' ELSE 'import b' END AS label,
  coalesce(m_system_state = (SELECT CASE WHEN max(system_state) >= 5 THEN 16 ELSE 4 END FROM rgt), FALSE) AS is_auto FROM near),
m AS (SELECT * FROM (""" + _WORST.format(keys="label", tie="event_id", rows="(SELECT *, signal_a * 2 + 1 AS v FROM rows_ WHERE is_auto AND vehicle_id = 0)", least=20) + """) WHERE n = 1)
"""
)


@query(
    "csv_periods_report",
    oracle(
        "tel excludes",
        _FILES + """,
        c AS (SELECT * FROM (""" + _WORST.format(keys="label", tie="event_id", rows="(SELECT *, signal_b * -2 + 0.25 AS v FROM rows_ WHERE is_auto)", least=1.5) + """) WHERE n = 1),
        h AS (SELECT label, floor((signal_b * -2 + 0.25) / 0.5) AS i, count_if(is_auto) AS a, count_if(NOT is_auto) AS b FROM rows_ GROUP BY 1, 2)
        SELECT 'bounds' AS item, label, min(s) AS at, CAST(NULL AS DOUBLE) AS value,
          date_diff('second', min(s), max(s)) + 1 AS n_auto, CAST(NULL AS BIGINT) AS n_manual FROM (
            SELECT s, CASE vehicle_id WHEN 0 THEN 'import a' WHEN 3 THEN 'import b' ELSE 'import d' END AS label
            FROM src WHERE vehicle_id IN (0, 1, 3)) GROUP BY 2
        UNION ALL SELECT 'metric:q1', label, sec_time, round(v, 9), NULL, NULL FROM m
        UNION ALL SELECT 'custom:cf1', label, sec_time, round(v, 9), NULL, NULL FROM c
        UNION ALL SELECT 'custom:cf2', label, s, round(avg(signal_a * 0.5 + 3), 9), NULL, NULL FROM rows_ WHERE vehicle_id = 3 GROUP BY 2, 3
        UNION ALL SELECT 'customhist:cf1', label, NULL, round(i * 0.5, 9), a, b FROM h""",
    ),
)
def csv_periods_report(spark, sf):
    """Eight entries over the files of five vehicles: all results of the new periods in one table."""
    out, _ = imported(spark, sf)
    number = lambda c: F.col(c).cast("long")
    none, no_value, no_time = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    parts = []
    for name, df in out.items():
        if name == "bounds":
            length = (F.unix_seconds("end_ts") - F.unix_seconds("start_ts")).cast("long")
            shown = (F.col("start_ts"), no_value, length, none)
        elif name.startswith("customhist"):
            shown = (no_time, F.col("bin_start"), number("cnt_auto"), number("cnt_manual"))
        else:
            shown = (F.col("sec_time"), F.col(SPEC.name if name.startswith("metric") else "value"), none, none)
        columns = [c.alias(n) for c, n in zip(shown, ("at", "value", "n_auto", "n_manual"))]
        parts.append(df.select(F.lit(name).alias("item"), "label", *columns))
    return union_periods(*parts)


@query(
    "csv_periods_notes",
    """SELECT * FROM (VALUES ('import a', 'q1', 'signal_a', ''), ('import a', 'cf1', 'debug.signal_b', ''),
      ('import b', 'cf2', 'signal_a', ''), ('import b', 'cf1', 'debug.signal_b', ''), ('import c', 'q1', NULL, 'no rows'),
      ('import d', 'zzz', NULL, 'unknown target'), ('import d', 'q1', 'text', ''), ('import e', 'q1', NULL, 'no value column')
    ) n(label, target, "column", note) WHERE (SELECT count(*) FROM events) > 0""",
)
def csv_periods_notes(spark, sf):
    return imported(spark, sf)[1].select("label", "target", F.when(F.col("note") != "unknown target", F.col("column")).alias("column"), "note")


@query(
    "compare_with_csv",
    oracle(
        "worst periods tel excludes",
        _FILES + """
        SELECT label, win, sec_time, round(signal_a, 9) AS signal_a FROM worst JOIN periods USING (period_id)
        UNION ALL SELECT label, win, sec_time, round(v, 9) FROM m""",
    ),
)
def compare_with_csv(spark, sf):
    """Fetched periods and imported ones side by side."""
    fetched = with_labels(metric(run_of(spark, sf), SPEC), periods(spark))
    both = union_periods(fetched, imported(spark, sf)[0]["metric:q1"])
    return both.select("label", "win", "sec_time", SPEC.name)
