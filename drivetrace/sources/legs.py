"""Legs (driven trips) from a table or from JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.functions.generators import computed_once
from drivetrace.functions.numeric import number
from drivetrace.functions.text import parse_instant
from drivetrace.functions.timegrain import local_text, to_local

TEXTS = ("vehicle_id", "display_name", "version", "vehicle_generation", "direction", "guid")
META = ("version", "vehicle_generation", "direction", "guid")
SCHEMA = ", ".join(f"{c} string" for c in ("data_start_time", "data_end_time", *TEXTS))


def leg_instant(c: str | Column) -> Column:
    """Epoch seconds or milliseconds (from 1e12), as number or text, else ISO text; else null."""
    c = F.col(c) if isinstance(c, str) else c
    n = number(c)
    seconds = F.when(n >= 1e12, n / 1000.0).otherwise(n)
    # First and last second that a calendar date can express.
    dated = (seconds >= -62_135_596_800) & (seconds < 253_402_300_800)
    as_number = F.when(dated, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))
    return F.when(n.isNotNull(), as_number).otherwise(parse_instant(c.cast("string"), "UTC"))


def clean_legs(raw: DataFrame) -> DataFrame:
    """Legs with a readable start before a readable end; missing text is empty."""
    return (
        raw.select(
            *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TEXTS],
            computed_once(start_ts=leg_instant("data_start_time"), end_ts=leg_instant("data_end_time")),
        )
        .filter(F.col("end_ts") > F.col("start_ts"))
        .withColumn("local_date", F.to_date(to_local("start_ts")))
        .withColumn("range_line", range_line("start_ts", "end_ts", "display_name"))
    )


def range_line(start: str, end: str, label: str) -> Column:
    """Line for the period input: local start, local end, name."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss"
    offset = F.lit("+09:00")
    return F.concat_ws(
        ", ",
        F.concat(local_text(start, pattern=pattern), offset),
        F.concat(local_text(end, pattern=pattern), offset),
        F.col(label),
    )


def legs_table(spark: SparkSession, name: str) -> DataFrame:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return clean_legs(spark.table(name).select(*columns))


def read_legs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped."""
    raw = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return clean_legs(raw)


def leg_lines(lines: DataFrame) -> DataFrame:
    """Legs of JSON lines in ``value``; blank and malformed lines are skipped."""
    return clean_legs(lines.select(F.inline(F.array(F.from_json("value", SCHEMA)))))


def vehicles(legs: DataFrame) -> DataFrame:
    return legs.filter(F.col("vehicle_id") != "").select("vehicle_id").distinct()


def local_dates(legs: DataFrame) -> DataFrame:
    """Days on which each vehicle has legs."""
    return legs.select("vehicle_id", "local_date").distinct()


def legs_of_day(legs: DataFrame, vehicle: str, day: str) -> DataFrame:
    return legs.filter((F.col("vehicle_id") == vehicle) & (F.col("local_date") == F.lit(day).cast("date")))


def as_periods(legs: DataFrame) -> DataFrame:
    """Legs as labelled ranges of their vehicle."""
    return legs.select("vehicle_id", F.col("display_name").alias("label"), "start_ts", "end_ts")
