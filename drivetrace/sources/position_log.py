"""Position logs: one ``<time>: {python dict}`` per line, positions among other messages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.functions.generators import computed_once
from drivetrace.functions.numeric import number
from drivetrace.functions.text import parse_log_time, vehicle_number
from drivetrace.functions.timegrain import within

_MESSAGES = "array<struct<lat string, lon string, speed string, `truck-id` string, datetime string>>"
_OPTIONS = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}


def read_position_log(
    spark: SparkSession,
    path: str | Sequence[str],
    naive_tz: str = "UTC",
    glob: str | None = "truck_*.log",
    *,
    vehicle: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Positions of files, folders or globs; in a folder only names matching ``glob`` are read.

    ``vehicle``, ``start`` and ``end`` select as in ``select_positions``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    return select_positions(reader.text(paths), naive_tz, vehicle=vehicle, start=start, end=end)


def parse_position_lines(lines: DataFrame, naive_tz: str = "UTC", keep: Sequence[str] = ()) -> DataFrame:
    """``ts, lat, lon, speed, truck_id, vehicle_num`` of the lines that are positions.

    Lines without both coordinate names are left out before parsing.  Python's ``None``, ``True``
    and ``False`` are rewritten to JSON.  A line that cannot be parsed gives no row.
    """
    line = F.col("value")
    body = F.regexp_extract(line, r"^.*?: (.*)$", 1)
    before, after = r"(?<=[:,\[]\s?)", r"(?=\s*[,}\]])"
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        body = F.when(line.contains(word), F.regexp_replace(body, before + word + after, json)).otherwise(body)
    return (
        lines.filter(line.contains("lat") & line.contains("lon"))
        .select(*keep, F.inline(F.from_json(body, _MESSAGES, _OPTIONS)))
        .select(
            *keep,
            computed_once(
                ts=parse_log_time("datetime", naive_tz),
                lat=number("lat"),
                lon=number("lon"),
                speed=number("speed"),
                truck_id=F.col("truck-id"),
            ),
        )
        .dropna(subset=["ts", "lat", "lon"])
        .withColumn("vehicle_num", vehicle_number("truck_id"))
    )


def select_positions(
    lines: DataFrame,
    naive_tz: str = "UTC",
    keep: Sequence[str] = (),
    *,
    vehicle: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """Positions of the lines that belong to a vehicle and lie in ``start <= ts < end``.

    The vehicle is told by its number; if no position of the lines has it, at whatever time, all vehicles
    stay.  A bound without zone is in UTC, a bound left out is open.

    Lines are tested as text before they are parsed: for the vehicle's digits, and for the instant in the
    one ``datetime`` field they name.  Lines that could hide either (escapes, several such fields) are
    parsed and then tested, so the rows are those of testing every parsed line.
    """
    kept = lines
    if start is not None or end is not None:
        kept = lines.filter(_may_be_inside(F.col("value"), naive_tz, start, end))
    if vehicle is not None:
        n = vehicle_number(F.lit(vehicle))
        may_be, same = _may_be_vehicle(F.col("value"), n), F.coalesce(F.col("vehicle_num") == n, F.lit(False))
        some = parse_position_lines(lines.filter(may_be), naive_tz).filter(same).select(F.lit(True).alias("_found"))
        found = some.limit(1).scalar()
        kept = kept.filter(found.isNull() | may_be)
        return parse_position_lines(kept, naive_tz, keep).filter((found.isNull() | same) & within("ts", start, end))
    return parse_position_lines(kept, naive_tz, keep).filter(within("ts", start, end))


def _may_be_vehicle(line: Column, n: Column) -> Column:
    """False for lines whose text cannot hold a truck of that number; a null number has none."""
    digits = F.concat(F.lit("(?<![0-9])0*"), n.cast("string"), F.lit("(?![0-9])"))
    return F.coalesce(F.rlike(line, digits) | line.contains("\\") & n.isNotNull(), F.lit(False))


def _may_be_inside(line: Column, naive_tz: str, start: datetime | None, end: datetime | None) -> Column:
    """False for lines whose one ``datetime`` field is outside the bounds."""
    said = F.regexp_extract(line, r"""datetime['"]\s*+:\s*+['"]([^'"]*+)['"]""", 1)
    one = (F.regexp_count(line, F.lit("datetime")) == 1) & ~line.contains("\\") & (said != "")
    return F.coalesce(~one, F.lit(True)) | F.coalesce(within(parse_log_time(said, naive_tz), start, end), F.lit(True))
