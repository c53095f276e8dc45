from datetime import datetime, timedelta, timezone

import pytest
from helpers import at, frame, values
from pyspark.sql import functions as F

from drivetrace.functions.text import clean_column, parse_instant, safe_name, vehicle_number
from drivetrace.operators.overrides import epoch_to_instant
from drivetrace.sources.legs import as_periods, clean_legs, legs_of_day, legs_table, local_dates, read_legs_jsonl, vehicles
from drivetrace.sources.position_log import parse_position_lines, read_position_log, select_positions
from drivetrace.sources.range_text import parse_excludes, parse_periods, require_valid
from drivetrace.sources.sinks import ordered, write_csv, write_sheets
from drivetrace.sources.tables import from_catalog, list_tables
from drivetrace.sources.topic_csv import (
    chosen_columns,
    csv_fields,
    header_names,
    read_topic_csv,
    read_value_csv,
    read_values,
    state_rows,
    typed_values,
    value_column,
)


def naive(rows):
    return [tuple(x.isoformat(sep=" ") if hasattr(x, "isoformat") else x for x in r) for r in rows]


def shown(df, *columns, order=None):
    ntz = [F.col(f"`{c}`").cast("timestamp_ntz").alias(c) if dict(df.dtypes)[c] == "timestamp" else F.col(f"`{c}`") for c in df.columns]
    return naive(values(df.select(*ntz), *columns, order=order))


@pytest.mark.parametrize("text,tz,expected", [
    ("2026-06-01T19:30:42.000+09:00", "UTC", "2026-06-01 10:30:42"),
    ("2026-06-01 19:30:42", "Asia/Tokyo", "2026-06-01 10:30:42"),
    ("2026-06-01 19:30:42", "UTC", "2026-06-01 19:30:42"),
    (" 2026-06-01T19:30:42Z ", "Asia/Tokyo", "2026-06-01 19:30:42"),
    ("2026-06-01", "Asia/Tokyo", "2026-05-31 15:00:00"),
    ("20260601T193042", "UTC", "2026-06-01 19:30:42"),
    ("2026-06-01T10:30:42-0130", "UTC", "2026-06-01 12:00:42"),
    ("12:30", "UTC", None), ("soon", "UTC", None), ("", "UTC", None), (None, "UTC", None),
])
def test_parse_instant(spark, text, tz, expected):
    df = frame(spark, "t string", [(text,)]).select(parse_instant("t", tz).alias("x"))
    assert shown(df, "x") == [(expected,)]


@pytest.mark.parametrize("text,number", [
    ("giga07", 7), ("car-giga-9", 9), ("GIGA_12", 12), ("truck_car-giga-9_2026-02-04.log", 9),
    ("car 5 of 6", 5), ("none", None), (None, None),
])
def test_vehicle_number(spark, text, number):
    assert values(frame(spark, "t string", [(text,)]).select(vehicle_number("t").alias("n")), "n") == [(number,)]


def test_names(spark):
    assert clean_column(".can_message[0].angle (deg)") == ":can_message_0_:angle__deg_"
    df = frame(spark, "t string", [('a/b:c*"d"<e>|\\' + "x" * 40,)]).select(safe_name("t", 31).alias("s"))
    assert values(df, "s") == [(("a_b_c__d__e___" + "x" * 40)[:31],)]


def test_periods(spark):
    lines = [
        (1, "2025-12-09T10:00:00+09:00,2025-12-09T11:00:00+09:00,run 6/7"),
        (2, "2025-12-09T10:00:00+09:00，2025-12-09T11:00:00+09:00"),
        (3, "2025-12-09 10:00:00.000+09:00/2025-12-09 11:00:00.000+09:00"),
        (4, "2025-12-09 10:00:00 / 2025-12-09 11:00:00, slash"),
        (5, "   "),
        (6, "2025-12-09T11:00:00,2025-12-09T10:00:00"),
        (7, "2025-12-09T11:00:00"),
        (8, "2025-12-09T11:00:00,whenever"),
        (9, "a,b,c,d"),
        (10, "2025-12-09T11:00:00/2025-12-09T12:00:00/x"),
    ]
    out = parse_periods(frame(spark, "n int, value string", lines), keep=["n"])
    got = shown(out, "n", "start_ts", "end_ts", "label", "error", order=["n"])
    good = ("2025-12-09 01:00:00", "2025-12-09 02:00:00")
    assert got[:4] == [(1, *good, "run 6/7", None), (2, *good, "", None), (3, *good, "", None), (4, *good, "slash", None)]
    assert [(g[0], g[4]) for g in got[4:]] == [(6, "order"), (7, "fields"), (8, "time"), (9, "fields"), (10, "fields")]
    with pytest.raises(ValueError):
        require_valid(out)
    assert require_valid(out.filter("n < 5")).count() == 4


def test_excludes(spark):
    lines = [
        (1, "2025-12-09T10:00:00Z,2025-12-09T10:05:00Z"), (2, "2025-12-09T10:00:00Z/2025-12-09T10:05:00Z"),
        (3, "2025-12-09T10:00:00Z - 2025-12-09T10:05:00Z"), (4, "2025-12-09T10:00:00Z 2025-12-09T10:05:00Z"),
        (5, "# comment"), (6, ""), (7, "2025-12-09T10:00:00Z"), (8, "2025-12-09T10:00:00Z,2025-12-09T10:00:00Z"),
        (9, "2025-12-09T10:00:00Z  2025-12-09T10:05:00Z  x"),
    ]
    got = shown(parse_excludes(frame(spark, "n int, value string", lines), keep=["n"]), "n", "start_ts", "end_ts", "error", order=["n"])
    assert got[:4] == [(n, "2025-12-09 10:00:00", "2025-12-09 10:05:00", None) for n in (1, 2, 3, 4)]
    assert [(g[0], g[3]) for g in got[4:]] == [(7, "fields"), (8, "order"), (9, "fields")]


LOG = """2026/02/04 12:34:56.005000: {'truck-id': 'car-giga-9', 'lat': 35.6811, 'lon': 139.7, 'speed': 12.3, 'datetime': '2026/02/04 12:34:56.005000'}
2026/02/04 12:34:57.005000: {'truck-id': 'car-giga-9', 'status': 'ok', 'flag': True}
2026/02/04 12:34:58.005000: {'cpu': 0.5, 'datetime': '2026/02/04 12:34:58.005000'}
2026/02/04 12:34:59: {'truck-id': 'car-giga-9', 'lat': 35.6822, 'lon': 139.8, 'speed': None, 'ok': True, 'datetime': '2026/02/04 12:34:59'}
no separator here with lat and lon
2026/02/04 12:35:00.005000: {'lat': 1, 'lon': broken
2026/02/04 12:35:01.005000: {'lat': None, 'lon': 139.8, 'datetime': '2026/02/04 12:35:01'}
2026/02/04 12:35:02.005000: {'lat': 35.0, 'lon': 139.8, 'datetime': 'never'}
2026/02/04 12:35:03.005000: {'lat': '35.5', 'lon': 139.8, 'speed': 'fast', 'datetime': '2026/02/04 12:35:03', 'note': "it's: None"}
"""


def test_position_log(spark, tmp_path):
    (tmp_path / "truck_a.log").write_text(LOG)
    (tmp_path / "other.log").write_text(LOG)
    got = shown(read_position_log(spark, str(tmp_path), "Asia/Tokyo"), "ts", "lat", "lon", "speed", "truck_id", "vehicle_num")
    assert got == [
        ("2026-02-04 03:34:56.005000", 35.6811, 139.7, 12.3, "car-giga-9", 9),
        ("2026-02-04 03:34:59", 35.6822, 139.8, None, "car-giga-9", 9),
        ("2026-02-04 03:35:03", 35.5, 139.8, None, None, None),
    ]
    both = read_position_log(spark, [str(tmp_path / "truck_a.log"), str(tmp_path / "other.log")], glob=None)
    assert both.count() == 6
    assert read_position_log(spark, str(tmp_path / "*.log"), glob=None).count() == 6


def test_position_log_window(spark, tmp_path):
    """The window is half-open and comes after the choice of vehicle; the vehicle is told from every position."""
    (tmp_path / "truck_a.log").write_text(LOG + """2026/02/04 12:40:00: {'truck-id': 'car-giga-7', 'lat': 1.0, 'lon': 2.0, 'datetime': '2026/02/04 12:40:00'}
2026/02/04 12:41:00: {'truck-id': 'car-giga-07x', 'lat': 1.5, 'lon': 2.0, 'datetime': "2026/02/04 12:41:00"}
2026/02/04 12:41:30: {'truck-id': 'car-giga-\\u0037', 'lat': 1.7, 'lon': 2.0, 'datetime': '2026/02/04 12:41:30', 'n': 'datetime'}
2026/02/04 12:42:00: {'truck-id': 'car-giga-17', 'lat': 1.9, 'lon': 2.0, 'speed': 7, 'datetime': '2026/02/04 12:42:00'}
2026/02/04 09:00:00: {'note': "'datetime': '2020/01/01 00:00:00'", 'truck-id': 'car-giga-9', 'lat': 3.5, 'lon': 2.0, 'datetime': '2026/02/04 12:34:58'}
""")

    def lats(**options):
        return [x for (x,) in values(read_position_log(spark, str(tmp_path), "Asia/Tokyo", **options), "lat", order=["ts"])]

    tokyo = timezone(timedelta(hours=9))
    start, end = datetime(2026, 2, 4, 12, 34, 59, tzinfo=tokyo), datetime(2026, 2, 4, 12, 41, tzinfo=tokyo)
    assert lats(start=start, end=end) == [35.6822, 35.5, 1.0]
    assert lats(start=start.astimezone(timezone.utc).replace(tzinfo=None)) == [35.6822, 35.5, 1.0, 1.5, 1.7, 1.9]
    assert lats(end=start) == [35.6811, 3.5]
    assert lats(vehicle="giga09") == [35.6811, 3.5, 35.6822]
    assert lats(vehicle="giga09", start=start, end=end) == [35.6822]
    assert lats(vehicle="giga07") == [1.0, 1.5, 1.7]
    # All of that vehicle's positions are outside: none, and not those of the others.
    assert lats(vehicle="giga07", start=start, end=datetime(2026, 2, 4, 12, 40, tzinfo=tokyo)) == []
    # No position of that vehicle at any time, or no number at all: the others stay.
    assert lats(vehicle="giga05", start=start, end=end) == [35.6822, 35.5, 1.0]
    assert lats(vehicle="someone", start=start, end=end) == [35.6822, 35.5, 1.0]


def test_lines_are_parsed_once(spark):
    """Of a log's lines only those that may belong to the vehicle and the window reach the parser."""
    lines = frame(spark, "value string", [(x,) for x in LOG.splitlines()])
    plan = select_positions(lines, vehicle="giga09", start=datetime(2026, 1, 1))._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("scalar-subquery")[0]
    assert main.count("from_json") <= 1 and "RLIKE" in plan
    alone = parse_position_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert alone.count("from_json") == 1


def test_long_line_is_parsed_whole(spark):
    filler = ", ".join(f"'k{n}': {n}" for n in range(20_000))
    line = "2026/02/04 12:34:56: {" + filler + ", 'lat': 1.5, 'lon': 2.5, 'datetime': '2026/02/04 12:34:56'}"
    assert values(parse_position_lines(frame(spark, "value string", [(line,)])), "lat", "lon") == [(1.5, 2.5)]


TOPIC = "﻿time_jst,t_sec,t_ns,debug.lateral_error,other\n"


def test_topic_csv(spark, tmp_path):
    path = tmp_path / "topic.csv"
    path.write_text(TOPIC + "x,1,1765244221500000999,0.5,a\nx,1,bad,0.7,b\nx,1,1765244220000000000,,c\n", encoding="utf-8")
    df = read_topic_csv(spark, str(path))
    assert shown(df, "t_ns", "ts", "sec_time", "debug.lateral_error"[:0] or "other") == [
        (1765244220000000000, "2025-12-09 01:37:00", "2025-12-09 01:37:00", "c"),
        (1765244221500000999, "2025-12-09 01:37:01.500000", "2025-12-09 01:37:01", "a"),
    ]
    assert df.columns[0] == "time_jst"
    assert value_column(df, "lateral_error") == "debug.lateral_error"
    assert value_column(df, "other") == "other"
    assert value_column(df, "unknown") == "debug.lateral_error"
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_topic_csv(spark, str(tmp_path / "no.csv"))


def test_state_csv(spark, tmp_path):
    path = tmp_path / "state.csv"
    path.write_text("t_ns,my.system_state\n1,16\n2, kAutonomousDriving \n3,unknown\n4,\n5,4.0\n")
    assert values(state_rows(read_topic_csv(spark, str(path))), "t_ns", "system_state") == [
        (1, "16"), (2, "kAutonomousDriving"), (5, "4.0")]


@pytest.mark.parametrize("times,unit,first", [
    (["1765244220", "1765244221"], "s", "2025-12-09 01:37:00"),
    (["1765244220000", "1765244221000"], "ms", "2025-12-09 01:37:00"),
    (["1765244220000000", "1765244220500000"], "us", "2025-12-09 01:37:00"),
    (["1765244220000000123", "1765244220500000123"], "ns", "2025-12-09 01:37:00"),
    (["2025-12-09 10:37:00", "2025-12-09 10:37:01"], "text", "2025-12-09 01:37:00"),
    (["2025-12-09T01:37:00Z", "bad"], "text", "2025-12-09 01:37:00"),
    (["1765244220.25", "1765244221"], "s", "2025-12-09 01:37:00.250000"),
])
def test_generic_csv(spark, tmp_path, times, unit, first):
    path = tmp_path / "v.csv"
    path.write_text("time,a,b\n" + "".join(f"{t},{n},x\n" for n, t in enumerate(times)))
    df = read_value_csv(spark, str(path))
    got = shown(df, "ts", "time_unit", "a", "b")
    assert got[0] == (first, unit, 0.0, None)
    assert len(got) == sum(t != "bad" for t in times)


def test_generic_csv_units_are_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,a\n1765244220,1\n")
    (tmp_path / "b.csv").write_text("time,a\n1765244220000,2\n")
    assert shown(read_value_csv(spark, str(tmp_path)), "ts", "time_unit", "a") == [
        ("2025-12-09 01:37:00", "ms", 2.0), ("2025-12-09 01:37:00", "s", 1.0)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.csv").write_text("time\n1\n")
    with pytest.raises(ValueError):
        read_value_csv(spark, str(tmp_path / "c"))


@pytest.mark.parametrize("sizes,unit", [
    ([1.0, 2e11], "ms"), ([1.0, 1e11], "s"), ([1e11, 1e14, 1e17], "us"), ([2e14, 3e17], "ns"), ([1e9, 1e9, 1e18], "s"),
])
def test_unit_from_median(spark, sizes, unit):
    """A median between two classes is the mean of their neighbouring extremes."""
    df = spark.createDataFrame([(1, s) for s in sizes], "f int, t double")
    assert {r[0] for r in values(epoch_to_instant(df, "t", ["f"]), "time_unit")} == {unit}


def test_legs(spark, tmp_path):
    path = tmp_path / "legs.jsonl"
    path.write_text("\n".join([
        '{"vehicle_id": "giga07", "display_name": "a", "data_start_time": 1765244220, "data_end_time": 1765247820, "version": "1"}',
        "", "{broken",
        '{"vehicle_id": "giga07", "display_name": "b", "data_start_time": "1765344220000", "data_end_time": 1765347820000.0}',
        '{"vehicle_id": "giga09", "display_name": "c", "data_start_time": "2025-12-09T01:37:00Z", "data_end_time": "2025-12-09 02:37:00"}',
        '{"vehicle_id": "giga09", "display_name": "back", "data_start_time": 20, "data_end_time": 10}',
        '{"vehicle_id": "giga09", "display_name": "none", "data_start_time": "x", "data_end_time": 10}',
        '{"vehicle_id": null, "display_name": "d", "data_start_time": 10, "data_end_time": 20}',
    ]))
    legs = read_legs_jsonl(spark, str(path))
    assert [r[0] for r in shown(legs, "display_name")] == ["a", "b", "c", "d"]
    assert [r.display_name for r in ordered(legs, "legs").collect()][0] == "b"
    got = shown(legs.filter("display_name in ('a', 'c')"), "display_name", "start_ts", "end_ts", "version", "range_line")
    line = "2025-12-09T10:37:00+09:00, 2025-12-09T11:37:00+09:00, "
    assert got == [("a", "2025-12-09 01:37:00", "2025-12-09 02:37:00", "1", line + "a"),
                   ("c", "2025-12-09 01:37:00", "2025-12-09 02:37:00", "", line + "c")]
    assert values(vehicles(legs), "vehicle_id") == [("giga07",), ("giga09",)]
    assert local_dates(legs).filter("vehicle_id = 'giga07'").count() == 2
    assert values(legs_of_day(legs, "giga07", "2025-12-09"), "display_name") == [("a",)]
    assert clean_legs(spark.createDataFrame([("1", "2", "v", "n", None, None, None, None)],
        "data_start_time string, data_end_time string, vehicle_id string, display_name string, version string, "
        "vehicle_generation string, direction string, guid string")).count() == 1


def test_sinks(spark, tmp_path):
    df = frame(spark, "period_id int, chunk_idx int, query string, v double", [(1, 0, "Q1", 0.5), (2, 1, "Q3", 1.5)])
    write_sheets(df, str(tmp_path / "sheets"))
    assert (tmp_path / "sheets" / "period_id=2" / "chunk_idx=1" / "query=Q3").is_dir()
    assert spark.read.parquet(str(tmp_path / "sheets")).count() == 2
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_unreadable_times_are_told(spark):
    raw = frame(spark, "time string, v string, _file string", [("never", "1", "a"), ("-", "2", "a"), ("2026-01-01 00:00:00", "3", "b")])
    assert typed_values(raw.filter("_file = 'b'")).count() == 1
    with pytest.raises(Exception, match="no readable time in a"):
        typed_values(raw).collect()


def test_written_rows_are_ordered(spark, tmp_path):
    rows = frame(spark, "vehicle_id int, start_ts timestamp, display_name string",
                 [(1, "2026-01-01 00:00:00", "a"), (2, "2026-01-03 00:00:00", "b"), (1, "2026-01-02 00:00:00", "c")])
    write_csv(rows, str(tmp_path / "legs"), "legs")
    text = "".join(sorted(p.read_text() for p in (tmp_path / "legs").glob("part-*") if p.stat().st_size))
    assert [line.split(",")[2] for line in text.splitlines() if "display_name" not in line] == ["b", "c", "a"]
    assert [r[0] for r in ordered(rows, "legs of a day").select("display_name").collect()] == ["a", "c", "b"]
    points = frame(spark, "period_id int, chunk_idx int, query string, vehicle_id int, sec_time timestamp",
                   [(1, 0, "Q1", 1, at("2026-01-01 00:00:00", 59 - n)) for n in range(60)])
    write_sheets(points.repartition(4), str(tmp_path / "points"))
    for part in (tmp_path / "points").rglob("*.parquet"):
        times = [r[0] for r in spark.read.parquet(str(part)).select("sec_time").collect()]
        assert times == sorted(times)


def test_legs_and_tables_of_the_catalog(spark):
    frame(spark, "data_start_time string, data_end_time string, vehicle_id string, display_name string, version string, "
          "vehicle_generation string, direction string, guid string", [("1", "2", "v", "n", None, None, None, None)]).createOrReplaceTempView("leg_rows")
    legs = legs_table(spark, "leg_rows")
    assert values(as_periods(legs), "vehicle_id", "label") == [("v", "n")]
    tables = from_catalog(spark, {"control": "leg_rows", "state": "leg_rows", "pose": "leg_rows", "more": "leg_rows"})
    assert tables.role("speed").columns == tables.role("more").columns
    assert "leg_rows" in list_tables(spark)
    with pytest.raises(KeyError):
        tables.role("none")


def test_many_files_in_one_plan(spark, tmp_path):
    """Files of two layouts, with and without byte-order mark, one with a quoted comma."""
    for n in range(3):
        (tmp_path / f"a{n}.csv").write_text("\ufefft_ns,x.signal,note\n" + "".join(f'{k}000000000,{n + k},"a,b"\n' for k in range(3)))
    (tmp_path / "b.csv").write_text("time,signal\n2026-01-01 00:00:00,5\n2026-01-01 00:00:01,-\n")
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    rows = read_values(spark, paths)
    got = {(r.file.rsplit("/")[-1], tuple(sorted(r["values"].items(), key=str))) for r in rows.collect()}
    assert ("a2.csv", (("note", None), ("x.signal", 4.0))) in got
    assert ("b.csv", (("signal", 5.0),)) in got and ("b.csv", (("signal", None),)) in got
    assert rows.count() == 11
    wishes = spark.createDataFrame([(p, c, "signal") for p in paths[:1] + paths[3:] for c in ("", "signal", "nope")], "file string, column string, token string")
    assert sorted((r.file.rsplit("/")[-1], r.column) for r in chosen_columns(wishes, rows, "column", "token").collect() if r.column) == [
        ("a0.csv", "x.signal"), ("b.csv", "signal"), ("b.csv", "signal")]


@pytest.mark.parametrize("line,fields", [
    ("a,b", ["a", "b"]), ("", [""]), (",", ["", ""]), (",a,,", ["", "a", "", ""]), ('"x,y",1', ["x,y", "1"]),
    ('"say ""hi""",2', ['say "hi"', "2"]), ('a"b,c', ['a"b', "c"]), ('"open,c', ['"open', "c"]), ('" a ",""', [" a ", ""]), ("é,😀", ["é", "😀"]),
])
def test_csv_fields(spark, line, fields):
    assert values(frame(spark, "v string", [(line,)]).select(csv_fields(F.col("v")).alias("f")), "f") == [(fields,)]


def test_header_names(spark):
    df = frame(spark, "v string", [("t, a ,a,b,a,t",)]).select(header_names(csv_fields(F.col("v"))).alias("f"))
    assert values(df, "f") == [(["t", "a", "a.1", "b", "a.2", "t.1"],)]


def _some_files(folder):
    (folder / "deep dir").mkdir()
    (folder / "one.csv").write_text('t_ns,"v,w",v\n1000000000,1,2\n2000000000,3,"4"\n')
    (folder / "deep dir" / "two+%.csv").write_text("t_ns,v\n3000000000,5\n")
    (folder / "deep dir" / "three.csv").write_text("time,v,v\n2026-01-01 00:00:00,6,7\n\n2026-01-01 00:00:01,8\n")


def test_values_by_relative_path_folder_and_glob(spark, tmp_path, monkeypatch):
    import os

    _some_files(tmp_path)
    relative = os.path.relpath(tmp_path / "one.csv")
    shown_ = lambda *paths: sorted(((r.file, tuple(sorted(r["values"].items()))) for r in read_values(spark, list(paths)).collect()), key=str)
    assert shown_(relative) == [(relative, (("v", 2.0), ("v,w", 1.0))), (relative, (("v", 4.0), ("v,w", 3.0)))]
    folder = str(tmp_path / "deep dir")
    in_folder = [(("v", 5.0),), (("v", 6.0), ("v.1", 7.0)), (("v", 8.0), ("v.1", None))]
    assert shown_(folder) == [(folder, x) for x in in_folder]
    glob = str(tmp_path / "*.csv")
    assert [x[0] for x in shown_(glob, folder)] == [glob] * 2 + [folder] * 3 if glob < folder else [folder] * 3 + [glob] * 2
    # A file given twice belongs to both paths.
    twice = shown_(folder, f"{folder}/two+%.csv")
    assert twice == sorted([(folder, x) for x in in_folder] + [(f"{folder}/two+%.csv", in_folder[0])], key=str)
    with pytest.raises(Exception, match="(?i)path"):
        read_values(spark, [str(tmp_path / "missing.csv")])


def test_plan_does_not_grow_with_layouts(spark, tmp_path):
    for n in range(40):
        (tmp_path / f"{n}.csv").write_text(f"t_ns,c{n}\n{n}000000000,{n}\n")
    many = read_values(spark, [str(tmp_path)])
    one = read_values(spark, [str(tmp_path / "0.csv")])
    size = lambda df: df._jdf.queryExecution().executedPlan().toString().count("\n")
    assert size(many) == size(one)
    assert sorted((k, v) for r in many.collect() for k, v in r["values"].items()) == sorted((f"c{n}", float(n)) for n in range(40))


def test_one_column_is_no_value_file(spark, tmp_path):
    (tmp_path / "one.csv").write_text("time\n1\n")
    with pytest.raises(Exception, match="at least one value column"):
        read_values(spark, [str(tmp_path / "one.csv")]).collect()
