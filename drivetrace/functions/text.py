"""Text helpers: instants, vehicle numbers, safe names, column names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"[T ].*(Z|[+-]\d\d(:?\d\d)?)$"
_COMPACT = r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)"
_BLANKS = " \t\r\n\f\u000b 　"


def trimmed(c: str | Column) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(_BLANKS))


def parse_instant(text: str | Column, naive_tz: str = "UTC") -> Column:
    """ISO 8601 text to an instant; one blank may stand for the T; bad text gives null.

    Text without an offset is wall-clock time in ``naive_tz``.
    """
    t = trimmed(text)
    dashed = F.substring(t, 5, 1) == "-"
    compact = F.regexp_replace(t, _COMPACT, "$1-$2-$3T$4:$5:$6")
    instant = F.when(dashed, t.try_cast("timestamp")).when(
        t.rlike(_COMPACT), compact.try_cast("timestamp")
    )
    if naive_tz == "UTC":
        return instant
    return F.when(t.rlike(_ZONED), instant).otherwise(F.to_utc_timestamp(instant, naive_tz))


def parse_log_time(text: str | Column, naive_tz: str = "UTC") -> Column:
    """``yyyy/MM/dd HH:mm:ss`` with optional fraction, wall-clock in ``naive_tz``."""
    c = F.col(text) if isinstance(text, str) else text
    return F.to_utc_timestamp(F.try_to_timestamp(c, F.lit("yyyy/M/d H:m:s[.SSSSSS]")), naive_tz)


def vehicle_number(c: str | Column) -> Column:
    """Digits after ``giga``, else the first digits, else null."""
    c = F.col(c) if isinstance(c, str) else c
    preferred = F.regexp_extract(c, r"(?i)giga[-_]?(\d+)", 1)
    first = F.regexp_extract(c, r"(\d+)", 1)
    return F.coalesce(preferred.try_cast("int"), first.try_cast("int"))


def safe_name(c: str | Column, length: int | None = None) -> Column:
    """Replace characters that paths and sheet names cannot hold."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(c, r'[\\/:*?"<>|]', "_")
    return F.substring(out, 1, length) if length else out


def clean_column(name: str) -> str:
    """Warehouse form of a dotted column name: dots to colons, brackets and blanks to underscores."""
    return re.sub(r"[\[\]() ]", "_", name.replace(".", ":"))
