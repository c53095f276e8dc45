"""Legs."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.operators.compare import union_periods
from drivetrace.operators.periods import attach_meta
from drivetrace.registry.base import leg_periods, legs_raw, oracle, query
from drivetrace.sources.legs import META, clean_legs, leg_lines, legs_of_day, local_dates, vehicles

_LINE = """strftime(start_ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00, '
  || strftime(end_ts + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%S') || '+09:00, ' || display_name"""
_LEGS_SQL = oracle(
    "legs",
    f"""SELECT vehicle_id, display_name, start_ts, end_ts, version, '' AS vehicle_generation, direction, guid,
      CAST(start_ts + INTERVAL 9 HOUR AS DATE) AS local_date, {_LINE} AS range_line FROM legs""",
)
_COLUMNS = (
    "vehicle_id", "display_name", "start_ts", "end_ts", "version", "vehicle_generation", "direction",
    "guid", "local_date", "range_line",
)


@query("legs_clean", _LEGS_SQL)
def legs_clean(spark, sf):
    return clean_legs(legs_raw(spark, sf)).select(*_COLUMNS)


@query("legs_jsonl_scan", _LEGS_SQL)
def legs_jsonl_scan(spark, sf):
    """Legs as JSON lines, with a malformed and a blank line after some, and parsed again."""
    raw = legs_raw(spark, sf)
    line = F.to_json(F.struct(*raw.columns))
    lines = F.when(F.col("direction") == "P", F.array(line, F.lit("{broken"), F.lit(""))).otherwise(F.array(line))
    return leg_lines(raw.select(F.explode(lines).alias("value"))).select(*_COLUMNS)


@query(
    "legs_dates",
    oracle("legs", "SELECT DISTINCT vehicle_id, CAST(start_ts + INTERVAL 9 HOUR AS DATE) AS local_date FROM legs"),
)
def legs_dates(spark, sf):
    return local_dates(clean_legs(legs_raw(spark, sf)))


@query("legs_vehicles", oracle("legs", "SELECT DISTINCT vehicle_id FROM legs WHERE vehicle_id <> ''"))
def legs_vehicles(spark, sf):
    return vehicles(clean_legs(legs_raw(spark, sf)))


DAYS = ("2025-07-02", "2025-07-04", "2025-11-18", "2025-12-02")


@query(
    "legs_one_day",
    oracle(
        "legs",
        f"""SELECT vehicle_id, display_name, start_ts, end_ts FROM legs
        WHERE vehicle_id = 'v3' AND strftime(start_ts + INTERVAL 9 HOUR, '%Y-%m-%d') IN {DAYS}""",
    ),
)
def legs_one_day(spark, sf):
    """Legs of one vehicle on some days."""
    legs = clean_legs(legs_raw(spark, sf))
    days = [legs_of_day(legs, "v3", day) for day in DAYS]
    return union_periods(*days).select("vehicle_id", "display_name", "start_ts", "end_ts")


@query(
    "period_meta_join",
    oracle(
        "legs leg_periods",
        """SELECT period_id, label, l.version, l.direction, l.guid,
          CASE WHEN l.guid IS NOT NULL THEN '' END AS vehicle_generation
        FROM leg_periods p LEFT JOIN legs l ON p.label = l.display_name""",
    ),
)
def period_meta_join(spark, sf):
    periods = leg_periods(spark, sf).select("period_id", "label")
    out = attach_meta(periods, clean_legs(legs_raw(spark, sf)), META)
    return out.select("period_id", "label", *[F.col("meta")[c].alias(c) for c in META])
