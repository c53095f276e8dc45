"""Typed-in text: labelled periods and exclusion ranges, one per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivetrace.functions.generators import computed_once
from drivetrace.functions.text import parse_instant, trimmed


def _parts(text: Column, separator: str, limit: int = -1) -> Column:
    pieces = F.transform(F.split(text, separator, limit), trimmed)
    return F.filter(pieces, lambda p: p != "") if limit < 0 else pieces


def _checked(lines: DataFrame, start: Column, end: Column, naive_tz: str) -> DataFrame:
    """Adds ``start_ts``, ``end_ts`` and ``error``: fields, time, order, or null."""
    timed = lines.select("*", computed_once(_a=start, _b=end)).select(
        "*", computed_once(start_ts=parse_instant("_a", naive_tz), end_ts=parse_instant("_b", naive_tz))
    )
    error = (
        F.when(F.col("_a").isNull() | F.col("_b").isNull(), "fields")
        .when(F.col("start_ts").isNull() | F.col("end_ts").isNull(), "time")
        .when(F.col("start_ts") >= F.col("end_ts"), "order")
    )
    return timed.withColumn("error", error).drop("_a", "_b")


def parse_periods(
    lines: DataFrame, naive_tz: str = "Asia/Tokyo", keep: Sequence[str] = (), column: str = "value"
) -> DataFrame:
    """``start,end[,label]`` or ``start/end[,label]``; commas may be full width.

    A label follows a comma and may hold a slash.  Blank lines are skipped.
    """
    rows = lines.select(*keep, trimmed(F.col(column)).alias("_line")).filter("_line <> ''")
    rows = rows.withColumn("_c", _parts(F.col("_line"), "[,，]"))
    rows = rows.withColumn("_s", _parts(F.get("_c", 0), "/"))
    count, slash = F.size("_c"), F.size("_s") == 2
    by_slash = (count == 1) | ((count == 2) & F.get("_c", 0).contains("/"))
    by_comma = (count == 3) | ((count == 2) & ~by_slash)
    start = F.when(by_slash & slash, F.get("_s", 0)).when(by_comma, F.get("_c", 0))
    end = F.when(by_slash & slash, F.get("_s", 1)).when(by_comma, F.get("_c", 1))
    label = F.when(count == 3, F.get("_c", 2)).when(by_slash & (count == 2), F.get("_c", 1))
    return (
        _checked(rows, start, end, naive_tz)
        .withColumn("label", F.coalesce(label, F.lit("")))
        .select(*keep, "start_ts", "end_ts", "label", "error")
    )


def parse_excludes(
    lines: DataFrame, naive_tz: str = "Asia/Tokyo", keep: Sequence[str] = (), column: str = "value"
) -> DataFrame:
    """Two times apart by comma, slash, `` - `` or blank; ``#`` starts a comment line."""
    rows = lines.select(*keep, trimmed(F.col(column)).alias("_line")).filter(
        "_line <> '' and not startswith(_line, '#')"
    )
    line = F.col("_line")
    words = _parts(line, r"\s+")
    pieces = (
        F.when(line.contains(","), _parts(line, ",", 2))
        .when(line.contains("/"), _parts(line, "/", 2))
        .when(line.contains(" - "), _parts(line, " - ", 2))
        .when(F.size(words) == 2, words)
    )
    rows = rows.withColumn("_p", pieces)
    return _checked(rows, F.get("_p", 0), F.get("_p", 1), naive_tz).select(
        *keep, "start_ts", "end_ts", "error"
    )


def require_valid(parsed: DataFrame) -> DataFrame:
    """The valid rows; raises on the first line that is not."""
    bad = parsed.filter(F.col("error").isNotNull()).limit(1).collect()
    if bad:
        raise ValueError(f"cannot read range: {bad[0].asDict()}")
    return parsed.drop("error")
