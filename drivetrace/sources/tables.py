"""Telemetry tables by role."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivetrace.functions.numeric import number
from drivetrace.functions.text import clean_column


@dataclass(frozen=True)
class Tables:
    """Role to table; ``speed`` is read from the pose table unless given."""

    control: DataFrame
    state: DataFrame
    pose: DataFrame
    speed: DataFrame | None = None
    others: Mapping[str, DataFrame] | None = None

    def role(self, name: str) -> DataFrame:
        if name == "speed":
            return self.speed if self.speed is not None else self.pose
        if name in ("control", "state", "pose"):
            return getattr(self, name)
        if self.others and name in self.others:
            return self.others[name]
        raise KeyError(f"no table for role {name}")

    def with_role(self, name: str, df: DataFrame) -> Tables:
        if name in ("control", "state", "pose", "speed"):
            return replace(self, **{name: df})
        return replace(self, others={**(self.others or {}), name: df})


def from_catalog(spark: SparkSession, names: Mapping[str, str]) -> Tables:
    """Tables of the session catalog by role name."""
    base = {r: spark.table(names[r]) for r in ("control", "state", "pose")}
    speed = spark.table(names["speed"]) if "speed" in names else None
    rest = {r: spark.table(t) for r, t in names.items() if r not in base and r != "speed"}
    return Tables(**base, speed=speed, others=rest)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def has_position(df: DataFrame) -> bool:
    return {"latitude", "longitude"} <= set(df.columns)


def select_columns(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns renamed to engine names; a dotted name finds its cleaned warehouse form too."""
    picked = []
    for source, name in columns.items():
        found = next((c for c in (source, clean_column(source)) if c in df.columns), None)
        if found is None:
            raise KeyError(f"no column {source}")
        picked.append(F.col(f"`{found}`").alias(name))
    return df.select(*picked)


def normalized(df: DataFrame, *, ts: str = "ts", vehicle: str = "vehicle_id", rename: Mapping[str, str] | None = None) -> DataFrame:
    """Renamed, with an instant in ``ts`` and every column but the vehicle as a number or null."""
    out = df.withColumnsRenamed(dict(rename or {}))
    numbers = {c: number(F.col(f"`{c}`")) for c in out.columns if c not in (ts, vehicle)}
    return out.withColumns({ts: F.col(ts).try_cast("timestamp"), **numbers})


def first_rows_between(
    df: DataFrame, first: datetime | str, last: datetime | str, limit: int, *, ts: str = "ts", tie: str | None = None
) -> DataFrame:
    """The earliest ``limit`` rows of a closed time range (both ends belong to it)."""
    low, high = F.lit(str(first)).cast("timestamp"), F.lit(str(last)).cast("timestamp")
    order = [ts] + ([tie] if tie else [])
    return df.filter((F.col(ts) >= low) & (F.col(ts) <= high)).orderBy(*order).limit(limit)

