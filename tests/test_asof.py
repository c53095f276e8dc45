import math
import random
from fractions import Fraction

import pandas as pd
import pytest
from helpers import frame, values
from pyspark.sql import functions as F

from drivetrace.functions.geo import haversine_m
from drivetrace.operators import asof
from drivetrace.operators.asof import asof_nearest, match_sweep
from drivetrace.operators.overrides import mask_by_state, resolve_drive_mode
from drivetrace.operators.positions import (
    attach_positions,
    gap_tolerance,
    match_vehicle,
    overlay_track,
    position_track,
    remap_to_positions,
)


def micro_frame(spark, rows, name):
    return spark.createDataFrame(rows, f"k int, us long, {name} long").withColumn("ts", F.timestamp_micros("us"))


def pandas_nearest(left, right, tol_us):
    l = pd.DataFrame(left, columns=["k", "us", "lid"]).sort_values(["us", "lid"], kind="stable")
    r = pd.DataFrame(right, columns=["k", "us", "rid"]).sort_values(["us", "rid"], kind="stable")
    r["rus"] = r["us"]
    m = pd.merge_asof(l, r, on="us", by="k", direction="nearest", tolerance=int(tol_us))
    return sorted((int(a), None if pd.isna(b) else int(b)) for a, b in zip(m["lid"], m["rid"]))


@pytest.mark.parametrize("slice_s,tol_us,span", [(60.0, 3, 60), (0.000007, 20, 400), (0.00001, 1000, 300), (0.0001, 0, 50)])
def test_same_as_pandas(spark, slice_s, tol_us, span):
    """Random times with many duplicates, slices much narrower and wider than the tolerance."""
    rng = random.Random(span)
    left = [(rng.randrange(3), rng.randrange(span), n) for n in range(400)]
    right = [(rng.randrange(3), rng.randrange(span) if span < 300 else rng.randrange(span // 7) * 7, n) for n in range(150)]
    got = asof_nearest(
        micro_frame(spark, left, "lid"),
        micro_frame(spark, right, "rid"),
        by=["k"], tolerance_s=tol_us / 1e6, columns=["rid"], order=[], slice_s=slice_s,
    )
    assert sorted(values(got, "lid", "rid"), key=str) == sorted(pandas_nearest(left, right, tol_us), key=str)


@pytest.mark.parametrize("stretch,tol_us", [(1, 5), (2, 40), (3, 100_000), (4096, 30)])
def test_stretches_of_the_summary(spark, monkeypatch, stretch, tol_us):
    """However short the stretches are, the nearest row is found across their edges and across empty ones; no keys."""
    monkeypatch.setattr(asof, "STRETCH", stretch)
    rng = random.Random(stretch)
    left = [(0, rng.randrange(2000), n) for n in range(150)]
    right = [(0, rng.choice([rng.randrange(60), 700 + rng.randrange(30), 1999]), n) for n in range(80)]
    got = asof_nearest(
        micro_frame(spark, left, "lid"), micro_frame(spark, right, "rid"), by=[], tolerance_s=tol_us / 1e6, columns=["rid"], order=[], slice_s=0.000009
    )
    assert sorted(values(got, "lid", "rid"), key=str) == sorted(pandas_nearest(left, right, tol_us), key=str)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_hot_instant_keeps_every_left_row(spark):
    left = [(1, 1000, n) for n in range(3000)] + [(1, 5000, 9999)]
    right = [(1, 1000, n) for n in range(2000)]
    got = asof_nearest(
        micro_frame(spark, left, "lid"), micro_frame(spark, right, "rid"),
        by=["k"], tolerance_s=0.001, columns=["rid"], order=["rid"],
    )
    assert got.count() == 3001
    assert got.filter("rid = 1999").count() == 3000
    assert values(got.filter("lid = 9999"), "rid") == [(None,)]


def test_null_time_and_missing_key_stay_unmatched(spark):
    left = spark.createDataFrame([(1, None, 1), (2, 5, 2), (None, 5, 3)], "k int, us long, lid long")
    left = left.withColumn("ts", F.timestamp_micros("us"))
    got = asof_nearest(
        left, micro_frame(spark, [(1, 5, 7)], "rid"), by=["k"], tolerance_s=1, columns=["rid"]
    )
    assert values(got, "lid", "rid") == [(1, None), (2, None), (3, None)]


def test_state_within_one_second(spark):
    rows = frame(spark, "v int, n int, ts timestamp", [
        (1, 1, "2026-07-01 00:00:00"), (1, 2, "2026-07-01 00:00:01"), (1, 3, "2026-07-01 00:00:05")])
    states = frame(spark, "v int, ts timestamp, system_state string", [
        (1, "2026-07-01 00:00:00.900", "16"), (1, "2026-07-01 00:00:06.001", "kAutonomousDriving")])
    got = mask_by_state(rows, states, ["v"], auto_value=F.lit(16))
    assert values(got, "n", "is_auto") == [(1, True), (2, True), (3, False)]


def test_drive_modes(spark):
    rows = frame(spark, "n int", [(1,), (2,)])
    assert values(resolve_drive_mode(rows, "auto"), "is_auto") == [(True,), (True,)]
    assert values(resolve_drive_mode(rows, "manual"), "is_auto") == [(False,), (False,)]
    with pytest.raises(ValueError):
        resolve_drive_mode(rows, "state")
    with pytest.raises(ValueError):
        resolve_drive_mode(rows, "other")


def test_match_sweep(spark):
    rows = spark.createDataFrame([(0.01,), (-0.03,), (None,), (0.4,)], "gap double")
    got = values(match_sweep(rows, "gap", [0.02, 0.05, 0.5]), "tolerance_s", "matched", "total", "pct")
    assert got == [(0.02, 1, 4, 0.25), (0.05, 2, 4, 0.5), (0.5, 3, 4, 0.75)]


POSITIONS = [
    (1, "2026-07-01 00:00:00", 35.0, 139.0, 1),
    (1, "2026-07-01 00:00:00", 36.0, 139.0, 2),
    (1, "2026-07-01 00:00:03", 35.001, 139.0, 3),
    (1, "2026-07-01 02:00:06", 35.002, 139.0, 4),
    (1, "2026-07-01 02:00:09", None, 139.0, 5),
]


def positions(spark, rows=POSITIONS):
    return frame(spark, "p int, ts timestamp, lat double, lon double, rid int", rows)


def test_track_takes_first_of_equal_times_and_continues_over_slices(spark):
    got = values(position_track(positions(spark), ["p"], order=["rid"]), "lat", "cum_dist_km")
    assert [g[0] for g in got] == [35.0, 35.001, 35.002]
    assert got[0][1] == 0.0
    assert got[1][1] == pytest.approx(0.1111949, rel=1e-5)
    assert got[2][1] == pytest.approx(0.2223899, rel=1e-5)


def test_long_track_has_the_error_of_one_rounding(spark):
    """Distances of 20,000 steps in 560 slices are the exact sums of the steps, to the last place or next to it."""
    n = F.col("id")
    points = spark.range(20_000).select(
        F.lit(1).alias("p"), F.timestamp_micros(n * 100_700_003).alias("ts"), n.alias("rid"),
        (F.lit(35.0) + (n * 37 % 997) / 9973.0).alias("lat"), (F.lit(139.0) + (n * 53 % 991) / 9973.0).alias("lon"))
    track = values(position_track(points, ["p"], order=["rid"]), "lat", "lon", "cum_dist_km", order=["ts"])
    steps = spark.createDataFrame([(i, *a[:2], *b[:2]) for i, (a, b) in enumerate(zip(track, track[1:]))], "i int, a double, b double, c double, d double")
    total, off = Fraction(0), [0.0]
    for (m,), (_, _, km) in zip(values(steps.select("i", haversine_m(*map(F.col, "abcd")).alias("m")), "m", order=["i"]), track[1:]):
        total += Fraction(m) / 1000
        off.append(abs(Fraction(km) - total) / Fraction(math.ulp(km)))
    assert len(track) == len(off) == 20_000
    assert max(off) <= 2


@pytest.mark.parametrize("gaps,expected", [([3, 3, 3], 4.5), ([1, 1], 2.0), ([100], 65.0), ([10, 1000], 65.0), ([2, 4], 4.5)])
def test_gap_tolerance(spark, gaps, expected):
    t, rows = 0, [(1, "2026-07-01 00:00:00", 35.0, 139.0, 0)]
    from helpers import at
    for n, g in enumerate(gaps, 1):
        t += g
        rows.append((1, at("2026-07-01 00:00:00", t), 35.0, 139.0, n))
    assert values(gap_tolerance(positions(spark, rows), ["p"]), "tolerance_s") == [(expected,)]


def test_attach_positions(spark):
    out = frame(spark, "p int, sec_time timestamp, latitude double, longitude double, cum_dist_km double", [
        (1, "2026-07-01 00:00:02", 1.0, 1.0, None), (1, "2026-07-01 01:00:00", 1.0, 1.0, 5.0),
        (2, "2026-07-01 00:00:02", 2.0, 2.0, 7.0)])
    got = values(attach_positions(out, positions(spark), ["p"], order=["rid"]), "p", "sec_time", "latitude", "cum_dist_km")
    assert got[0][2] == 35.001 and got[0][3] == pytest.approx(0.1111949, rel=1e-5)
    assert got[1][2:] == (None, None)
    assert got[2][2:] == (2.0, 7.0)


def test_single_position_has_widest_tolerance(spark):
    out = frame(spark, "p int, sec_time timestamp", [(1, "2026-07-01 00:01:05"), (1, "2026-07-01 00:01:06")])
    got = attach_positions(out, positions(spark, POSITIONS[:1]), ["p"], order=["rid"])
    assert values(got, "sec_time", "latitude")[0][1] == 35.0
    assert values(got, "sec_time", "latitude")[1][1] is None


def test_remap_falls_back_per_series(spark):
    rows = frame(spark, "label string, p int, sec_time timestamp, latitude double, longitude double", [
        ("a", 1, "2026-07-01 00:00:01", 1.0, 1.0), ("a", 1, "2026-07-01 00:30:00", 1.0, 1.0),
        ("b", 1, "2030-07-01 00:00:01", 2.0, 2.0)])
    got = values(remap_to_positions(rows, positions(spark), ["p"], ["label"], order=["rid"]), "label", "latitude", "longitude")
    assert got == [("a", 36.0, 139.0), ("b", 2.0, 2.0)]


def test_overlay_and_replace(spark):
    track = frame(spark, "p int, sec_time timestamp, latitude double, longitude double", [
        (1, "2026-07-01 00:00:00", 1.0, 1.0), (2, "2026-07-01 00:00:00", 2.0, 2.0)])
    log = positions(spark)
    assert sorted(r[0] for r in values(overlay_track(track, log, "replace", ["p"]), "source")) == ["log"] * 4 + ["track"]
    assert overlay_track(track, log, "overlay", ["p"]).count() == 6
    with pytest.raises(ValueError):
        overlay_track(track, log, "none", ["p"])


def test_match_vehicle(spark):
    log = frame(spark, "vehicle_num int, n int", [(9, 1), (9, 2), (3, 3), (None, 4)])
    assert values(match_vehicle(log, "giga09"), "n") == [(1,), (2,)]
    assert match_vehicle(log, "giga07").count() == 4
    assert match_vehicle(log, "none").count() == 4
