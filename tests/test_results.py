import pytest
from helpers import at, frame, utc, values
from pyspark.sql import functions as F

from drivetrace.config import CustomField, Grain, MetricSpec, Range, RunSpec, custom_fields
from drivetrace.functions.numeric import step_decimals
from drivetrace.operators import compare, periods
from drivetrace.operators.distance import cumulative_distance, distance_by_position, distance_by_speed, stitch_distance
from drivetrace.operators.histogram import merge_modes, rebin, smooth, sum_bins, with_ratios
from drivetrace.operators.overrides import apply_overrides, latest_recipes, override_funnel
from drivetrace.operators.positions import map_points, track_extent
from drivetrace.operators.quantiles import describe, exact_quantiles, ordinal
from drivetrace.operators.states import (
    auto_mask, detect_auto_value, label_states, prefer_states, state_per_second, state_track)
from drivetrace.plans.csv_import import CsvEntry, override_results, read_csv_periods
from drivetrace.plans.export import sheets
from drivetrace.plans.override import OverrideEntry, override, recipes_frame, replay
from drivetrace.sources.topic_csv import read_values
from drivetrace.plans.run import hist, metric, notes, plan_run, results
from drivetrace.sources.tables import Tables, first_rows_between, normalized, select_columns

DAY = "2025-12-09"


# --- periods -------------------------------------------------------------------------------------

def test_chunks(spark):
    p = periods.periods_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 02:30"), "a"), Range(utc(f"{DAY} 05:00"), utc(f"{DAY} 06:00"))])
    got = values(periods.chunk_periods(p, 60), "label", "chunk_idx", "chunk_start", "chunk_end", order=["period_id", "chunk_idx"])
    assert [(g[0], g[1], g[2].hour, (g[3].hour, g[3].minute)) for g in got] == [
        ("a", 0, 1, (2, 0)), ("a", 1, 2, (2, 30)), ("期間2", 0, 5, (6, 0))]
    assert periods.chunk_periods(p, 0).count() == 2


def test_half_open_periods_and_excludes(spark):
    p = periods.periods_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 02:00")), Range(utc(f"{DAY} 01:30"), utc(f"{DAY} 03:00"))])
    rows = frame(spark, "vehicle_id int, ts timestamp", [(1, f"{DAY} {t}") for t in ("00:59:59", "01:00:00", "01:05:00", "01:30:00", "02:00:00")])
    tagged = periods.tag_chunks(rows, periods.chunk_periods(p, 0))
    assert values(tagged.groupBy("period_id").count(), "period_id", "count") == [(1, 3), (2, 2)]
    ex = periods.excludes_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 01:05")), Range(utc(f"{DAY} 01:02"), utc(f"{DAY} 01:04"))])
    assert periods.drop_excluded(rows, ex).count() == 4
    flags = values(periods.flag_excluded(rows, ex), "ts", "excluded")
    assert [f[1] for f in flags] == [False, True, False, False, False]


def test_periods_of_one_vehicle(spark):
    chunks = frame(spark, "vehicle_id int, period_id int, chunk_idx int, chunk_start timestamp, chunk_end timestamp",
                   [(1, 1, 0, f"{DAY} 00:00:00", "2025-12-12 00:00:00")])
    rows = frame(spark, "vehicle_id int, ts timestamp", [(1, f"{DAY} 10:00:00"), (2, f"{DAY} 10:00:00"), (1, "2025-12-11 23:59:59")])
    assert periods.tag_chunks(rows, chunks).count() == 2


def test_many_intervals_without_broadcast(spark):
    """The same rows when the intervals are too large to broadcast."""
    rows = frame(spark, "vehicle_id int, ts timestamp", [(n % 3, at(f"{DAY} 00:00:00", 600 * n)) for n in range(400)])
    ex = periods.excludes_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 09:00")), Range(utc(f"{DAY} 20:00"), utc("2025-12-11 02:00"))])
    small = values(periods.drop_excluded(rows, ex), "vehicle_id", "ts")
    flags = values(periods.flag_excluded(rows, ex).filter("excluded"), "vehicle_id", "ts")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        assert values(periods.drop_excluded(rows, ex), "vehicle_id", "ts") == small
        assert values(periods.flag_excluded(rows, ex).filter("excluded"), "vehicle_id", "ts") == flags
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert len(small) + len(flags) == 400


def test_choose_period(spark):
    p = periods.periods_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 02:00"), "a"), Range(utc(f"{DAY} 01:30"), utc(f"{DAY} 03:00"), "b"),
                                      Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 02:00"), "c")])
    files = frame(spark, "file string, first_ts timestamp, last_ts timestamp, wanted_label string", [
        ("x", f"{DAY} 01:10:00", f"{DAY} 01:40:00", "b"), ("y", f"{DAY} 01:40:00", f"{DAY} 02:40:00", "zzz"),
        ("z", f"{DAY} 05:00:00", f"{DAY} 06:00:00", "c"), ("one", f"{DAY} 01:10:00", f"{DAY} 01:10:00", "a")])
    assert values(periods.choose_period(files, p), "file", "label", "overlap_s") == [("x", "a", 1800.0), ("y", "b", 3600.0)]
    assert values(periods.choose_by_label(files, p), "file", "label") == [("one", "a"), ("x", "b"), ("z", "c")]


def test_exclude_sets(spark):
    ex = lambda *h: periods.excludes_frame(spark, [Range(utc(f"{DAY} {a}"), utc(f"{DAY} {b}")) for a, b in h])
    a, b = ex(("01:00", "02:00"), ("01:30", "03:00")), ex(("01:00", "02:00"), ("05:00", "06:00"))
    assert periods.union_excludes(a, b).count() == 3
    assert values(periods.pending_excludes(b, a), "start_ts")[0][0].hour == 5
    points = frame(spark, "sel int, sec_time timestamp", [(1, f"{DAY} 01:00:05"), (1, f"{DAY} 01:00:01")])
    got = periods.exclude_from_points(points, ["sel"]).collect()[0]
    assert (got.start_ts.second, got.end_ts.second) == (1, 6)
    assert periods.suggested_split(periods.periods_frame(spark, [])).collect()[0][0] == 60
    assert periods.suggested_split(a.withColumn("k", F.lit(1))).collect()[0][0] == 90


# --- distance ------------------------------------------------------------------------------------

KEYED = "vehicle_id int, period_id int, chunk_idx int"


def test_stitch(spark):
    rows = frame(spark, f"{KEYED}, n int, cum_dist_km double", [
        (1, 1, 0, 0, 0.5), (1, 1, 0, 1, 1.0), (1, 1, 1, 2, None), (1, 1, 1, 3, 0.4), (1, 1, 2, 4, None), (1, 1, 3, 5, 1.0),
        (2, 1, 0, 6, 0.0), (2, 1, 0, 7, 1.0), (2, 1, 0, 8, 2.0), (2, 1, 1, 9, 0.0), (2, 1, 1, 10, 0.5)])
    assert [r[1] for r in values(stitch_distance(rows), "n", "cum_dist_km")] == [0.5, 1.0, None, 1.4, None, 2.4, 0.0, 1.0, 2.0, 2.0, 2.5]


def test_distance_over_many_slices(spark):
    """One row per second over several slices equals a plain running sum; null positions step zero."""
    rows = [(1, 1, 0, at(f"{DAY} 00:00:00", n * 7), 35.0 + 0.0001 * (n % 5), 139.0, None if n == 0 else float(n % 4)) for n in range(2000)]
    rows[700] = (*rows[700][:4], None, None, 1.0)
    df = frame(spark, f"{KEYED}, ts timestamp, latitude double, longitude double, speed_mps double", rows)
    got = values(distance_by_position(df), "sec_time", "cum_dist_km")
    import math
    total, prev, want = 0.0, None, []
    for r in rows:
        if prev is not None and prev[4] is not None and r[4] is not None:
            total += 6371.0 * math.radians(abs(r[4] - prev[4]))
        prev = r
        want.append(total)
    assert [g[1] for g in got] == pytest.approx(want, rel=1e-6)
    speeds = values(distance_by_speed(df), "sec_time", "cum_dist_km")
    total, want = 0.0, [None]
    for r in rows[1:]:
        total += r[6]
        want.append(total / 1000)
    assert speeds[0][1] is None
    assert [s[1] for s in speeds[1:]] == pytest.approx(want[1:])
    with pytest.raises(ValueError):
        cumulative_distance("other", df, df)


# --- histograms ----------------------------------------------------------------------------------

def hist_frame(spark, rows):
    return frame(spark, "vehicle_id int, period_id int, bin_start double, bin_end double, cnt_auto long, cnt_manual long", rows)


def test_sum_and_ratio(spark):
    got = values(sum_bins(hist_frame(spark, [(1, 1, 0.0, 0.2, 1, 0), (1, 1, 0.2, 0.4, 2, 0), (1, 1, 0.2, 0.4, 3, 0), (1, 1, 0.4, 0.6, 4, 0)])),
                 "bin_start", "cnt_auto", "ratio_auto", "ratio_manual")
    assert [g[1] for g in got] == [1, 5, 4]
    assert [g[2] for g in got] == pytest.approx([0.1, 0.5, 0.4])
    assert [g[3] for g in got] == [0.0, 0.0, 0.0]


def test_rebin(spark):
    fine = [(1, 1, round(0.05 * n, 9), round(0.05 * n + 0.05, 9), n + 1, 0) for n in range(8)]
    got = values(rebin(hist_frame(spark, fine), 0.2), "bin_start", "bin_end", "cnt_auto", "ratio_auto")
    assert [g[:3] for g in got] == [(0.0, 0.2, 10), (0.2, 0.4, 26)]
    assert got[0][3] == pytest.approx(10 / 36)
    assert rebin(hist_frame(spark, fine), 0.03).count() == 8
    negative = [(1, 1, -0.05, 0.0, 1, 2), (1, 1, 0.0, 0.05, 1, 2)]
    assert [g[0] for g in values(rebin(hist_frame(spark, negative), 0.2), "bin_start")] == [-0.2, 0.0]
    # halves round to even: 0.125 / 0.05 = 2.5 gives 2
    assert values(rebin(hist_frame(spark, fine), 0.125), "bin_end")[0][0] == 0.1


def test_merge_and_smooth(spark):
    side = lambda m, rows: frame(spark, f"{KEYED}, bin_start double, bin_end double, cnt_{m} long, ratio_{m} double", rows)
    got = values(merge_modes(side("auto", [(1, 1, 0, 0.0, 0.2, 2, 1.0)]), side("manual", [(1, 1, 0, 0.2, 0.4, 3, 1.0)])),
                 "bin_start", "cnt_auto", "cnt_manual", "ratio_auto", "ratio_manual")
    assert got == [(0.0, 2, 0, 1.0, 0.0), (0.2, 0, 3, 0.0, 1.0)]
    h = frame(spark, "vehicle_id int, period_id int, bin_start double, r double", [(1, 1, 0.0, 0.0), (1, 1, 1.0, 1.0), (1, 1, 5.0, 0.0)])
    assert [g[0] for g in values(smooth(h, ["r"], 3), "r_smooth", order=["bin_start"])] == pytest.approx([0.5, 1 / 3, 0.5])
    assert max(g[0] for g in values(smooth(h, ["r"], 1), "r_smooth")) == 1.0


@pytest.mark.parametrize("window", [1, 2, 3, 4, 5])
def test_smooth_as_pandas(spark, window):
    import pandas as pd
    y = [float((n * 7) % 11) for n in range(12)]
    h = frame(spark, "k int, bin_start double, r double", [(1, float(n), v) for n, v in enumerate(y)])
    want = pd.Series(y).rolling(window, center=True, min_periods=1).mean().tolist()
    assert [g[0] for g in values(smooth(h, ["r"], window, ["k"]), "r_smooth", order=["bin_start"])] == pytest.approx(want)


@pytest.mark.parametrize("step,digits", [(0.01, 2), (0.2, 1), (0.025, 3), (1.0, 0), (0.0, 1), (None, 1), (0.123456789, 7)])
def test_step_decimals(spark, step, digits):
    assert values(frame(spark, "s double", [(step,)]).select(step_decimals(F.col("s")).alias("d")), "d") == [(digits,)]


def test_quantiles(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(10, 3000), 1)
    df = spark.createDataFrame([(int(n % 2), float(x)) for n, x in enumerate(v)], "k int, v double").unionByName(
        spark.createDataFrame([(1, None), (7, 3.5)], "k int, v double"))
    more = spark.createDataFrame([(8, None), (9, float("nan")), (9, None)], "k int, v double")
    got = {r.k: r for r in exact_quantiles(df.unionByName(more), "v", {"a": 0.25, "b": 0.5, "c": 0.99}, ["k"]).collect()}
    for k in (0, 1):
        want = np.quantile(v[k::2], [0.25, 0.5, 0.99])
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(want))
    assert got[7].n == 1 and got[7].a == got[7].c == 3.5
    assert (got[8].n, got[8].a, got[9].n, got[9].c) == (0, None, 0, None)
    d = describe(df.filter("k < 2"), "v").collect()[0]
    assert (d.n, d["min"], d["max"]) == (3000, v.min(), v.max())
    assert d.std == pytest.approx(v.std(ddof=1)) and d.p50 == pytest.approx(np.median(v))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_with_an_outlier_and_ties(spark, keys):
    """Brackets follow ranks: one outlier does not put everything into one group."""
    import numpy as np
    rng = np.random.default_rng(7)
    v = np.concatenate([np.round(rng.normal(0, 1, 30000), 5), np.full(9000, 0.25), [1e18, -1e18]])
    rng.shuffle(v)
    df = spark.createDataFrame([(1, float(x)) for x in v], "k int, v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.75, "e": 0.999, "f": 1.0}
    got = exact_quantiles(df, "v", probs, keys).collect()[0]
    assert got.n == len(v)
    assert [got[n] for n in probs] == pytest.approx(list(np.quantile(v, list(probs.values()))), rel=1e-12)
    plan = exact_quantiles(df, "v", probs, keys)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_quantiles_order_nothing_but_digits(spark):
    """Millions of different values without keys: windows see one row for each digit, and the result is exact."""
    n = 5_000_000
    x = ((F.col("id") * 2654435761) % n).cast("double")
    df = spark.range(n).select((x * x / 7.0 - 1e6).alias("v"))
    probs = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.9999}
    got = exact_quantiles(df, "v", probs).collect()[0]
    assert got.n == n
    for name, p in probs.items():
        low = int((n - 1) * p)
        a, b = (k * k / 7.0 - 1e6 for k in (float(low), float(low + 1)))
        assert got[name] == a + (b - a) * ((n - 1) * p - low)
    # The ordered rows are counts by digit.
    plan = exact_quantiles(df, "v", probs)._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and "ObjectHashAggregate" not in plan
    assert df.select((F.shiftright(ordinal(F.col("v")), 42)).alias("d")).distinct().count() < 100_000


@pytest.mark.parametrize("v", [
    0.0, -0.0, 1.0, -1.0, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, float("inf"), -float("inf"),
    0.1, 0.30000000000000004, 0.3, 8.0, 7.999999999999999, 1e-310, -1e-310, 1023.9999999999999, 2.0**1023,
])
def test_ordinal_orders_like_the_double(spark, v):
    import struct

    bits = struct.unpack("<q", struct.pack("<d", abs(v)))[0]
    assert values(frame(spark, "v double", [(v,)]).select(ordinal(F.col("v")).alias("k")), "k") == [(-bits if v < 0 else bits,)]


def test_describe_keeps_keys_without_values(spark):
    df = frame(spark, "k int, v double", [(1, 2.0), (1, float("nan")), (1, None), (2, None), (2, float("nan"))])
    got = {r.k: r for r in describe(df, "v", ["k"]).collect()}
    assert (got[1].n, got[1]["mean"], got[1]["max"], got[1].p50) == (1, 2.0, 2.0, 2.0)
    assert (got[2].n, got[2]["mean"], got[2].p50) == (0, None, None)


# --- states --------------------------------------------------------------------------------------

def test_auto_mask(spark):
    df = frame(spark, "s string, v int", [(s, 16) for s in ("16", "4", "kAutonomousDriving", "kControlOk", None, " 16.0 ")])
    assert [r[0] for r in df.select(auto_mask(F.col("s"), F.col("v"))).collect()] == [True, False, True, False, False, True]


@pytest.mark.parametrize("states,start,generation,value,basis", [
    (["16", "1"], "2025-12-09 00:00:00", "auto", 16, "state"), (["4", "0"], "2025-12-09 00:00:00", "auto", 4, "date"),
    (["4", "0"], "2026-04-30 15:00:00", "auto", 16, "date"), (["4"], "2026-04-30 14:59:59", "auto", 4, "date"),
    (["kAutonomousDriving"], "2026-07-01 00:00:00", "auto", 16, "date"), (["16"], "2026-07-01 00:00:00", "legacy", 4, "explicit"),
    (["1"], "2020-01-01 00:00:00", "202605a", 16, "explicit"), (["5"], "2020-01-01 00:00:00", "auto", 16, "state"),
    ([], None, "auto", 16, "date"),
])
def test_detect(spark, states, start, generation, value, basis):
    s = frame(spark, "k int, system_state string", [(1, x) for x in states])
    t = frame(spark, "k int, start_ts timestamp", [(1, start)])
    assert values(detect_auto_value(s, t, ["k"], generation), "auto_value", "basis") == [(value, basis)]


def test_labels_and_track(spark):
    df = frame(spark, "auto_value int, system_state int", [(16, 4), (4, 4), (16, 99), (4, None)])
    assert sorted(values(label_states(df), "auto_value", "state_label", "position")) == [
        (4, "kAutonomousDriving", 4), (4, "null", 5), (16, "kControlOk", 4), (16, "null", 18)]
    rows = frame(spark, f"{KEYED}, ts timestamp, system_state int, latitude double, longitude double, kp double", [
        (1, 1, 0, f"{DAY} 00:00:04", 4, 2.0, 2.0, None), (1, 1, 0, f"{DAY} 00:00:01", 4, 1.0, 1.0, 0.5),
        (1, 1, 0, f"{DAY} 00:00:02", 3, 3.0, 3.0, 0.7), (1, 1, 0, f"{DAY} 00:00:05", 4, 5.0, 5.0, 0.9)])
    got = values(state_track(rows), "sec_time", "system_state", "latitude", "kp")
    assert [(g[0].second, *g[1:]) for g in got] == [(0, 3, 3.0, 0.7), (0, 4, 1.0, 0.5), (5, 4, 5.0, 0.9)]


def test_largest_state_of_a_second(spark):
    rows = frame(spark, f"{KEYED}, ts timestamp, system_state int", [(1, 1, 0, f"{DAY} 00:00:00.{n}", s) for n, s in enumerate((16, 17, 1))])
    assert values(state_per_second(rows), "system_state") == [(17,)]


def test_state_source(spark):
    a = frame(spark, "p int, ts timestamp, system_state string", [(1, f"{DAY} 00:00:00", "4"), (2, f"{DAY} 00:00:00", "x")])
    b = frame(spark, "p int, ts timestamp, system_state string", [(1, f"{DAY} 00:00:01", "5"), (2, f"{DAY} 00:00:01", "kReady")])
    assert values(prefer_states(a, b, ["p"]), "p", "system_state", "source") == [(1, "4", "primary"), (2, "kReady", "fallback")]


# --- a whole run ---------------------------------------------------------------------------------

def drive(spark):
    """Two vehicles, two minutes each of 2 Hz samples; the state is automatic in the first minute."""
    rows = []
    for v in (1, 2):
        for n in range(240):
            t = at(f"{DAY} 01:00:00", n / 2)
            sec = n // 2
            error = (-0.9 if sec == 30 and n % 2 else 0.5) if sec < 60 else 1.5
            rows.append((v, n, t, error * v, 35.0 + 1e-5 * sec, 139.0, 10.0, 16 if sec < 60 else 3))
    df = frame(spark, "vehicle_id int, rid int, ts timestamp, lateral_error double, latitude double, longitude double, speed_mps double, system_state int", rows)
    return df.withColumn("lateral_accel", F.col("lateral_error")).withColumn("acceleration", F.col("lateral_error") * 2)


def run(spark, minutes=1, store=False, **settings):
    df = drive(spark)
    no_position = df.select("vehicle_id", "rid", "ts", "lateral_accel")
    return plan_run(
        Tables(df, df, no_position, df, {"pose2": no_position}),
        periods.periods_frame(spark, [Range(utc(f"{DAY} 01:00"), utc(f"{DAY} 01:10"), "p")]),
        RunSpec(split_minutes=minutes, **settings), tie=("ts", "rid"), store=store)


@pytest.mark.parametrize("distance", ["latlon", "speed"])
def test_stored_seconds_change_nothing(spark, distance):
    """All results of a run over stored seconds are those of the lazy one; nothing below the table is planned again."""
    fields = (CustomField("cf1", "a", "pose2", "lateral_accel", "metric", 0.1, 0.5, 2.0, 0.5), CustomField("cf2", "b", "control", "lateral_error", "timeseries"))
    lazy, kept = (results(run(spark, store=s, distance=distance, fields=fields)) for s in (False, True))
    assert lazy.keys() == kept.keys()
    for name in lazy:
        columns = sorted(lazy[name].columns)
        assert columns == sorted(kept[name].columns)
        rounded = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in ((c, dict(lazy[name].dtypes)[c]) for c in columns)]
        a, b = (sorted(map(str, df.select(*rounded).collect())) for df in (lazy[name], kept[name]))
        assert a == b and (a or name.startswith("metric:q2")), name
    plan = kept["metric:q1"]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Window" not in plan


def test_stored_tables_can_be_cleared(spark):
    import os

    from drivetrace.sources import shared

    table = shared.stored_by(frame(spark, "k int, v int", [(n, n * n) for n in range(50)]), "squares", ["k"])
    assert table.count() == 50 and shared.stored(table, "again").count() == 50
    folder = shared.shared_folder(spark).removeprefix("file:")
    assert len(os.listdir(folder)) >= 2
    shared.clear_shared(spark)
    assert not os.path.exists(folder) and not [t for t in spark.catalog.listTables() if t.name.startswith("squares_")]


def test_metric(spark):
    got = values(metric(run(spark), MetricSpec("q1", "lateral_error", "lateral_error", 0.2)), "vehicle_id", "chunk_idx", "sec_time", "lateral_error", "abs_lateral_error")
    assert [(g[0], g[1], g[2].second, g[3], g[4]) for g in got] == [(1, 0, 30, -0.9, 0.9), (2, 0, 30, -1.8, 1.8)]
    row = metric(run(spark, distance="speed"), MetricSpec("q1", "lateral_error", "lateral_error", 0.2)).filter("vehicle_id = 1").collect()[0]
    assert row.cum_dist_km == pytest.approx(0.31)
    assert row.win.second == 0 and row.latitude == pytest.approx(35.0003)
    assert metric(run(spark), MetricSpec("q1", "lateral_error", "lateral_error", 5.0)).count() == 0


def test_ties_take_the_earliest(spark):
    got = metric(run(spark), MetricSpec("q", "latitude", "north", 0.0)).filter("vehicle_id = 1").collect()
    assert [r.sec_time.second for r in got] == [59]
    got = metric(run(spark), MetricSpec("q", "speed_mps", "speed", 0.0)).filter("vehicle_id = 1").collect()
    assert [r.sec_time.second for r in got] == [0]


def test_hist_of_run(spark):
    r = run(spark, 0)
    got = values(hist(r, "lateral_accel", 0.5).filter("vehicle_id = 1"), "bin_start", "cnt_auto", "cnt_manual", "ratio_auto")
    assert got == [(-1.0, 1, 0, 1 / 120), (0.5, 119, 0, 119 / 120), (1.5, 0, 120, 0.0)]
    n = notes(run(spark, 0)).filter("vehicle_id = 2").collect()[0]
    assert (n.auto_value, n.basis, n.auto_seconds, n.other_seconds) == (16, "state", 60, 60)


def test_results_and_fields(spark):
    fields = custom_fields([
        {"label": "scaled", "table": "pose2", "column": "lateral_accel", "threshold": "0.5", "hist_bin": 0, "scale": "x", "offset": None},
        {"label": "", "table": "pose2", "column": "x"},
        {"label": "mean", "table": "control", "column": "lateral_error", "agg_mode": "timeseries", "scale": -1, "offset": 2},
    ])
    assert [(f.key, f.mode, f.hist_bin, f.scale) for f in fields] == [("cf1", "metric", 0.2, 1.0), ("cf2", "timeseries", 0.2, -1.0)]
    out = results(run(spark, 0, fields=fields))
    assert set(out) == {"metric:q1", "metric:q2", "hist", "custom:cf1", "customhist:cf1", "custom:cf2", "customhist:cf2", "notes"}
    assert "latitude" not in out["custom:cf1"].columns and "latitude" in out["custom:cf2"].columns
    series = out["custom:cf2"].filter("vehicle_id = 1").orderBy("sec_time").collect()
    assert len(series) == 120
    assert series[30].value == pytest.approx(2.2) and series[100].value == pytest.approx(0.5)
    assert series[119].cum_dist_km == pytest.approx(119 * 1.11194927e-3, rel=1e-5)


# --- comparison ----------------------------------------------------------------------------------

def test_axis(spark):
    rows = frame(spark, "k int, sec_time timestamp, v string, cum_dist_km double", [
        (1, f"{DAY} 16:01:00", "1.5", None), (1, f"{DAY} 16:02:00", "x", 2.0), (2, f"{DAY} 16:02:00", "2", None)])
    assert values(compare.axis_mode(rows, "distance", ["k"]), "k", "x_mode") == [(1, "distance"), (2, "time")]
    assert values(compare.axis_mode(rows, "elapsed", ["k"]), "x_mode")[0] == ("elapsed",)
    assert values(compare.axis_mode(rows.drop("cum_dist_km"), "distance", ["k"]), "x_mode")[0] == ("time",)
    start = F.lit(f"{DAY} 16:00:00").cast("timestamp")
    assert values(compare.xy_rows(rows, "v", "elapsed", start), "x", "v") == [(1.0, 1.5), (2.0, 2.0)]
    assert compare.xy_rows(rows, "v", "distance").count() == 0
    assert values(compare.xy_rows(rows, "v", "time"), "x")[0][0].hour == 1
    with pytest.raises(ValueError):
        compare.xy_rows(rows, "v", "elapsed")


def test_range_checks(spark):
    rows = frame(spark, "v double, cum_dist_km double", [(-1.0, 0.5), (2.0, None), (None, 3.0)])
    got = values(compare.scatter_range_check(rows, "q", "v", ylim=(-1, 1.9), xlim=(0, 3)), "axis", "data_lo", "data_hi", "out_of_range")
    assert got == [("x", 0.5, 3.0, False), ("y", -1.0, 2.0, True)]
    h = frame(spark, "k int, bin_start double, bin_end double, ratio_auto double, ratio_manual double", [
        (1, 0.0, 1.0, 0.0, 0.0), (1, 1.0, 2.0, 1.0, 0.0), (1, 2.0, 3.0, 0.0, 0.0)])
    check = lambda w: values(compare.hist_range_check(h, "h", ["k"], ylim=(0, 0.6), window=w), "data_hi", "out_of_range")
    assert check(1) == [(1.0, True)]
    assert check(3) == [(0.5, False)]
    w = compare.range_warnings(compare.scatter_range_check(rows, "q", "v", ylim=(-1, 1.9)), compare.scatter_range_check(rows, "q", "v", ylim=(-1, 1.9)))
    assert w.count() == 1 and compare.new_warnings(w, w).count() == 0


def test_visible_and_difference(spark):
    rows = frame(spark, "label string", [("a",), ("b",)])
    assert compare.visible(rows, ["b"]).count() == 1 and compare.visible(rows, []).count() == 0
    a = frame(spark, "k int, v double", [(1, 1.0), (2, None)])
    b = frame(spark, "k int, v double", [(1, 1.5), (3, 2.0)])
    assert values(compare.backend_difference(a, b, ["k"], ["v"]), "k", "v_abs_diff") == [(1, 0.5), (2, 0.0), (3, 2.0)]


def test_maps(spark):
    rows = frame(spark, "k int, latitude string, longitude double, v double", [(1, "35.0", 139.0, -5.0), (1, "36.0", 139.5, 1.0), (1, "?", 1.0, 1.0), (1, "1", 1.0, None)])
    pts = map_points(rows, "v", (2, 4))
    assert [g[0] for g in values(pts, "color_value")] == [2.0, 4.0]
    got = track_extent(pts, ["k"]).collect()[0]
    assert (got.center_lat, got.lat_span) == (35.5, 1.0)
    assert got.zoom == pytest.approx(7.99185, rel=1e-4)
    assert track_extent(pts.limit(1), ["k"]).collect()[0].zoom == 16.0


# --- imports -------------------------------------------------------------------------------------

T0 = 1782864000  # 2026-07-01 00:00:00 UTC


def write_topic(path, rows, column):
    path.write_text("﻿time_jst,t_sec,t_ns," + column + "\n" + "".join(f"x,{t},{int((T0 + t) * 1e9)},{v}\n" for t, v in rows))


@pytest.fixture()
def topics(tmp_path):
    error = [(n / 2, 0.5 if n < 60 else -0.9 if n < 120 else 1.5) for n in range(180)]
    write_topic(tmp_path / "debug.csv", error, "debug.lateral_error")
    write_topic(tmp_path / "state.csv", [(n / 2, 16 if n < 120 else 4) for n in range(180)], "system_state")
    return tmp_path


def test_csv_periods(spark, topics):
    field = CustomField("cf1", "f", "t", ".debug.lateral_error", "metric", 0.0, 0.5, 2.0, 0.0)
    series = CustomField("cf2", "f", "t", "lateral_error", "timeseries")
    spec = RunSpec(fields=(field, series), grain=Grain("second", "minute"))
    debug = str(topics / "debug.csv")
    entries = [CsvEntry("a", debug, "q1"), CsvEntry("a", debug, "cf1"), CsvEntry("a", debug, "cf2")]
    bad = [CsvEntry("a", debug, "zzz"), CsvEntry("a", str(topics / "state.csv"), "q1"), CsvEntry("a", debug, "q1", "nope"),
           CsvEntry("a", str(topics / "missing.csv"), "q1")]
    out, told = read_csv_periods(spark, entries + bad, spec, state_path=str(topics / "state.csv"))
    assert sorted(r.note for r in told.collect()) == ["", "", "", "no rows", "no rows", "no value column", "unknown target"]
    assert set(out) == {"metric:q1", "metric:q2", "custom:cf1", "customhist:cf1", "custom:cf2", "bounds"}
    assert out["metric:q2"].count() == 0
    got = values(out["metric:q1"], "win", "lateral_error", "abs_lateral_error", "cum_dist_km")
    assert [g[1:] for g in got] == [(-0.9, 0.9, None)]
    h = values(out["customhist:cf1"], "bin_start", "cnt_auto", "cnt_manual")
    assert h == [(-2.0, 60, 0), (1.0, 60, 0), (3.0, 0, 60)]
    assert out["custom:cf2"].count() == 90
    b = out["bounds"].collect()[0]
    assert (b.end_ts - b.start_ts).total_seconds() == 90
    everything, told = read_csv_periods(spark, [CsvEntry("a", debug, "q1")], spec)
    assert sorted(g[0] for g in values(everything["metric:q1"], "lateral_error")) == [-0.9, 1.5]
    (topics / "empty.csv").write_text("t_ns,system_state\n")
    nothing, _ = read_csv_periods(spark, [CsvEntry("a", debug, "q1")], spec, state_path=str(topics / "empty.csv"))
    assert sorted(g[0] for g in values(nothing["metric:q1"], "lateral_error")) == [-0.9, 1.5]


def test_override(spark, topics):
    raw = read_values(spark, [str(topics / "debug.csv")])
    value = F.col("values")["debug.lateral_error"] * 2.0 + 0.1
    rows = raw.withColumn("p", F.lit(1)).withColumn("is_auto", F.lit(True))
    out = override_results(rows, "custom_timeseries", value, ["p"], width=0.5)
    assert set(out) == {"points", "hist"}
    assert out["points"].count() == 90
    points = override_results(rows, "metric", value, ["p"], name="lateral_error", threshold=1.0)["points"]
    assert [g[0] for g in values(points, "lateral_error")] == pytest.approx([-1.7, 3.1])
    base = frame(spark, "p int, lateral_error double", [(1, 9.0), (2, 8.0)])
    merged = apply_overrides(base, points.select("p", "lateral_error"), ["p"])
    assert sorted(values(merged, "p", "overridden")) == [(1, True), (1, True), (2, False)]
    nothing = apply_overrides(base, points.select("p", "lateral_error").filter("false"), ["p"])
    assert values(nothing, "p", "lateral_error") == [(1, 9.0), (2, 8.0)]
    low = F.col("values")["debug.lateral_error"] < 1
    funnel = override_funnel(rows.withColumn("is_auto", low), value, 1.5, ["p"]).collect()[0]
    assert (funnel.n_period, funnel.n_auto, funnel.n_threshold) == (180, 120, 60)


def test_override_of_a_run(spark, topics):
    """A file replaces a metric and the histogram of one vehicle and the period it overlaps most."""
    rows = frame(spark, "vehicle_id int, ts timestamp, lateral_error double, acceleration double, lateral_accel double, "
                 "latitude double, longitude double, speed_mps double, system_state int",
                 [(v, at("2026-07-01 00:00:00", n), 9.0, 9.0, 9.0, 35.0 + 1e-5 * n, 139.0, 1.0, 16 if n < 60 else 4) for v in (1, 2) for n in range(120)])
    ranges = [Range(utc("2026-06-30 23:00"), utc("2026-07-01 00:00:10"), "early"), Range(utc("2026-07-01 00:00"), utc("2026-07-01 00:02"), "late")]
    p = periods.periods_frame(spark, ranges)
    spec = RunSpec(split_minutes=0)
    r = plan_run(Tables(rows, rows, rows, rows), p, spec)
    solid = lambda df: spark.createDataFrame(df.collect(), df.schema)
    base = {name: solid(df) for name, df in results(r).items() if name in ("metric:q1", "hist")}
    states = solid(r.rows("state").select("vehicle_id", "period_id", "ts", "system_state"))
    track = rows.select("vehicle_id", F.lit(2).alias("period_id"), "ts", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    entry = OverrideEntry(str(topics / "debug.csv"), 1, "q1", "debug.lateral_error")
    out = override(spark, base, entry, spec, p, states=states, positions=track)
    out = {"metric:q1": solid(out["metric:q1"]), "hist": base["hist"]}
    got = values(out["metric:q1"], "vehicle_id", "period_id", "lateral_error", "overridden")
    assert got == [(1, 1, 9.0, False), (1, 2, -0.9, True), (2, 1, 9.0, False), (2, 2, 9.0, False)]
    row = out["metric:q1"].filter("overridden").collect()[0]
    assert row.latitude == pytest.approx(35.0003) and row.cum_dist_km == pytest.approx(0.0333585, rel=1e-4)
    hist_entry = OverrideEntry(entry.path, 1, "q3", entry.column, period_label="late", drive_mode="manual")
    again = override(spark, {"hist": base["hist"]}, hist_entry, spec, p)
    counts = values(again["hist"].filter("overridden"), "vehicle_id", "bin_start", "cnt_auto", "cnt_manual")
    assert counts == [(1, -0.9, 0, 60), (1, 0.5, 0, 60), (1, 1.5, 0, 60)]
    # A blank column is found by its name; applied to a result that was overridden before.
    more = [OverrideEntry(entry.path, 1, "q1", drive_mode="auto", scale=2.0), OverrideEntry(entry.path, 1, "q1", drive_mode="auto")]
    blank = override(spark, {"metric:q1": out["metric:q1"]}, more, spec, p)
    assert values(blank["metric:q1"].filter("overridden"), "vehicle_id", "period_id", "lateral_error") == [(1, 2, -0.9), (1, 2, 1.5)]
    with pytest.raises(ValueError):
        override(spark, base, entry, spec, p)
    with pytest.raises(Exception, match="no states"):
        override(spark, base, entry, spec, p, states=states.filter("vehicle_id = 2"))["metric:q1"].collect()
    with pytest.raises(ValueError):
        override(spark, base, OverrideEntry(entry.path, 1, "zzz", entry.column), spec, p)


def test_replay_plan_does_not_grow(spark):
    """Two or many recipes, periods of two vehicles: as many scans."""
    base = frame(spark, "vehicle_id int, period_id int, lateral_error double", [(1, 1, 9.0), (2, 2, 9.0)])
    own = frame(spark, "vehicle_id int, period_id int, label string, start_ts timestamp, end_ts timestamp",
                [(1, 1, "a", "2026-07-01 00:00:00", "2026-07-01 01:00:00"), (2, 2, "b", "2026-07-01 00:30:00", "2026-07-01 02:00:00")])
    rows = frame(spark, "file string, ts timestamp, sec_time timestamp, t_ns long, v double",
                 [(f"f{v}", t, t, n, 1.0 + n) for v in (1, 2) for n, t in enumerate(("2026-07-01 00:40:00", "2026-07-01 00:50:00", "2026-07-01 01:10:00"))])
    rows = rows.select("file", "ts", "sec_time", "t_ns", F.create_map(F.lit("x.lateral_error"), "v").alias("values"))

    def run(n):
        entries = [OverrideEntry(f"f{1 + k % 2}", 1 + k % 2, "q1", "", 1.0, float(k), "", "auto") for k in range(n)]
        return replay({"metric:q1": base}, recipes_frame(spark, entries, "int"), rows, RunSpec(), own, order=["seq"])[0]["metric:q1"]

    got = values(run(4), "vehicle_id", "period_id", "lateral_error", "overridden")
    assert got == [(1, 1, 3.0, True), (1, 1, 4.0, True), (2, 2, 4.0, True), (2, 2, 5.0, True), (2, 2, 6.0, True)]
    plans = [run(n)._jdf.queryExecution().executedPlan().toString() for n in (2, 200)]
    assert plans[0].count("FileScan") == plans[1].count("FileScan") < 15
    assert plans[0].count("Exchange") == plans[1].count("Exchange")


def test_sheets(spark):
    out = sheets(run(spark))
    assert set(out) == {"Q1", "Q2", "Q3"}
    assert values(out["Q1"].filter("vehicle_id = 1"), "sheet", "win")[0][0] == "T1_C1_Q1"
    assert values(out["Q1"], "win")[0][0].hour == 10
    assert values(out["Q3"].filter("vehicle_id = 1"), "sheet", "bin_start") == [("T1_C1_Q3", -1.0), ("T1_C1_Q3", 0.4), ("T1_C2_Q3", 1.4)]


def test_recipes(spark):
    r = frame(spark, "label string, target string, seq int, scale double", [("a", "q1", 1, 1.0), ("a", "q1", 2, 3.0), ("a", "q2", 1, 5.0)])
    assert values(latest_recipes(r, ["label", "target"], ["seq"]), "label", "target", "scale") == [("a", "q1", 3.0), ("a", "q2", 5.0)]


# --- tables --------------------------------------------------------------------------------------

def test_tables(spark):
    raw = spark.createDataFrame([("1", "2025-12-09 00:00:00", "x"), ("1", "2025-12-09 00:00:01", "2.5")], "`:veh:id` string, `t` string, `:a:b` string")
    df = select_columns(raw, {".veh.id": "vehicle_id", "t": "ts", ".a.b": "v"})
    norm = normalized(df)
    assert values(norm, "v") == [(None,), (2.5,)]
    assert first_rows_between(norm, "2025-12-09 00:00:00", "2025-12-09 00:00:01", 5).count() == 2
    assert first_rows_between(norm, "2025-12-09 00:00:00", "2025-12-09 00:00:01", 1).count() == 1
    t = Tables(df, df, norm)
    assert t.role("speed") is norm and t.with_role("extra", raw).role("extra") is raw
    with pytest.raises(KeyError):
        t.role("nope")
    with pytest.raises(KeyError):
        select_columns(raw, {"nope": "x"})
