"""Tabular results as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drivetrace.config import CHUNK, PERIOD, VEHICLE
from drivetrace.functions.text import safe_name
from drivetrace.functions.timegrain import to_local


def sheet_key(query: str):
    """Sheet name of a result: period and chunk counted from 1, and the query's number."""
    name = F.concat(F.lit("T"), F.col(PERIOD), F.lit("_C"), F.col(CHUNK) + 1, F.lit(f"_{query}"))
    return safe_name(name, 31)


def local_times(df: DataFrame) -> DataFrame:
    """Every instant as local wall-clock time without zone."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({c: to_local(c) for c in columns})


#: Order of rows where results leave, by what they hold; columns a frame lacks are passed over.
ORDERS = {
    "points": ("sec_time", VEHICLE, PERIOD, CHUNK, "event_id"),
    "bins": (PERIOD, CHUNK, VEHICLE, "bin_start"),
    "track": (VEHICLE, "sec_time", "ts"),
    "legs": ("-start_ts", VEHICLE, "display_name"),
    "legs of a day": ("start_ts", VEHICLE, "display_name"),
}


def _order(df: DataFrame, kind: str) -> list:
    names = [n for n in ORDERS[kind] if n.lstrip("-") in df.columns]
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """Rows in the order in which results of this kind are shown; only the outer edge sorts."""
    return df.orderBy(*_order(df, kind))


def write_sheets(df: DataFrame, path: str, partition_by: Sequence[str] = (PERIOD, CHUNK, "query")) -> None:
    """One folder per partition.  Rows are rebalanced by folder first: small folders get one file,
    a folder holding most rows is split over several tasks, and every file is ordered."""
    kind = "bins" if "bin_start" in df.columns else "points"
    dealt = df.hint("rebalance", *partition_by).sortWithinPartitions(*partition_by, *_order(df, kind))
    dealt.write.mode("error").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, kind: str | None = None) -> None:
    """CSV with a header, ordered as results of ``kind`` are; instants keep their microseconds."""
    rows = df if kind is None else ordered(df, kind)
    rows.write.mode("error").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
