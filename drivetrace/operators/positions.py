"""Position sources: cumulative distance, joins by time, maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.config import (
    POSITION_GAP_FACTOR,
    POSITION_TOLERANCE_MAX_SECONDS,
    POSITION_TOLERANCE_MIN_SECONDS,
    REMAP_TOLERANCE_SECONDS,
)
from drivetrace.functions.geo import map_zoom
from drivetrace.functions.numeric import number
from drivetrace.functions.text import vehicle_number
from drivetrace.functions.timegrain import GRAIN_US, floor_micros, micros
from drivetrace.operators.asof import asof_nearest
from drivetrace.operators.distance import running_distance
from drivetrace.operators.quantiles import exact_quantiles


def unique_positions(positions: DataFrame, keys: Sequence[str], *, order: Sequence[str]) -> DataFrame:
    """``keys, ts, lat, lon``: of several positions at one instant the first in ``order``."""
    known = positions.select(
        *keys, "ts", number("lat").alias("lat"), number("lon").alias("lon"), *order
    ).dropna(subset=["ts", "lat", "lon"])
    return (
        known.groupBy(*keys, "ts")
        .agg(F.min(F.struct(*order, "lat", "lon")).alias("_p"))
        .select(*keys, "ts", "_p.lat", "_p.lon")
    )


def position_track(
    positions: DataFrame, keys: Sequence[str], *, order: Sequence[str], width_us: int = GRAIN_US["hour"]
) -> DataFrame:
    """``keys, ts, lat, lon, cum_dist_km`` along time."""
    unique = unique_positions(positions, keys, order=order)
    return running_distance(unique, keys, ts="ts", lat="lat", lon="lon", width_us=width_us)


def gaps(positions: DataFrame, keys: Sequence[str], *, width_us: int = GRAIN_US["hour"]) -> DataFrame:
    """``gap_s`` between neighbouring instants, inside time slices and across their edges."""
    known = positions.filter(number("lat").isNotNull() & number("lon").isNotNull())
    sliced = (
        known.select(*keys, micros("ts").alias("_t"))
        .filter(F.col("_t").isNotNull())
        .distinct()
        .withColumn("_slice", floor_micros(F.col("_t"), width_us))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy("_t")
    within = sliced.select(*keys, (F.col("_t") - F.lag("_t").over(inside)).alias("_g"))
    ends = sliced.groupBy(*keys, "_slice").agg(F.min("_t").alias("_a"), F.max("_t").alias("_z"))
    over = W.partitionBy(*keys).orderBy("_slice")
    across = ends.select(*keys, (F.col("_a") - F.lag("_z").over(over)).alias("_g"))
    return within.unionByName(across).filter(F.col("_g").isNotNull()).select(
        *keys, (F.col("_g") / F.lit(1e6)).alias("gap_s")
    )


def gap_tolerance(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join tolerance of a position source: 1.5 times its median gap, between 2 and 65 seconds.

    Keys with a single instant have no gap; they take the upper limit.
    """
    median = exact_quantiles(gaps(positions, keys), "gap_s", {"median_gap_s": 0.5}, keys)
    known = positions.filter(number("lat").isNotNull() & number("lon").isNotNull() & F.col("ts").isNotNull())
    top = F.lit(POSITION_TOLERANCE_MAX_SECONDS)
    wanted = F.greatest(F.lit(POSITION_TOLERANCE_MIN_SECONDS), F.col("median_gap_s") * POSITION_GAP_FACTOR)
    tolerance = F.when(F.col("median_gap_s").isNull(), top).otherwise(F.least(top, wanted))
    return known.select(*keys).distinct().join(median, list(keys), "left").select(
        *keys, "median_gap_s", tolerance.alias("tolerance_s")
    )


def attach_positions(
    rows: DataFrame,
    positions: DataFrame,
    keys: Sequence[str],
    *,
    order: Sequence[str],
    ts: str = "sec_time",
    tolerance_s: float | None = None,
    slice_s: float = 60.0,
) -> DataFrame:
    """Fill latitude, longitude and distance of result rows from the nearest position.

    Without a given tolerance each key uses that of its own source; rows out of tolerance, and rows
    that had a position before, get nulls.  Keys without any position stay as they are.
    """
    unique = unique_positions(positions, keys, order=order)
    track = running_distance(unique, keys, ts="ts", lat="lat", lon="lon", width_us=GRAIN_US["hour"]).withColumnsRenamed(
        {"cum_dist_km": "_km", "lat": "_lat", "lon": "_lon"}
    )
    limit = POSITION_TOLERANCE_MAX_SECONDS if tolerance_s is None else tolerance_s
    out = asof_nearest(
        rows,
        track,
        by=keys,
        left_ts=ts,
        tolerance_s=limit,
        columns=["_lat", "_lon", "_km"],
        right_ts_as="_at",
        slice_s=slice_s,
    )
    near = F.col("_at").isNotNull()
    if tolerance_s is None:
        own = gap_tolerance(unique, keys).select(*keys, "tolerance_s")
        allowed = F.coalesce("tolerance_s", F.lit(POSITION_TOLERANCE_MAX_SECONDS))
        out = out.join(own, list(keys), "left")
        near = near & (F.abs(micros(ts) - micros("_at")) <= allowed * 1e6)
    has = unique.select(*keys).distinct().withColumn("_has", F.lit(True))
    out = out.join(has, list(keys), "left")
    for old, new in zip(("latitude", "longitude", "cum_dist_km"), ("_lat", "_lon", "_km")):
        kept = F.col(old) if old in rows.columns else F.lit(None).cast("double")
        out = out.withColumn(old, F.when(F.col("_has").isNull(), kept).when(near, F.col(new)))
    return out.drop("_lat", "_lon", "_km", "_at", "_has", "tolerance_s")


def remap_to_positions(
    rows: DataFrame,
    positions: DataFrame,
    by: Sequence[str],
    series: Sequence[str],
    *,
    ts: str = "sec_time",
    order: Sequence[str] = (),
    tolerance_s: float = REMAP_TOLERANCE_SECONDS,
    slice_s: float = 60.0,
) -> DataFrame:
    """Move rows to the nearest position and drop those without one.

    A series in which no row finds a position stays unchanged.
    """
    joined = asof_nearest(
        rows,
        positions.select(*by, "ts", number("lat").alias("_lat"), number("lon").alias("_lon"), *order).dropna(
            subset=["_lat", "_lon"]
        ),
        by=by,
        left_ts=ts,
        tolerance_s=tolerance_s,
        columns=["_lat", "_lon"],
        order=order,
        right_ts_as="_at",
        slice_s=slice_s,
    )
    hit = F.col("_at").isNotNull()
    any_hit = joined.groupBy(*series).agg(F.bool_or(hit).alias("_any"))
    return (
        joined.join(any_hit, list(series))
        .filter(hit | ~F.col("_any"))
        .withColumn("latitude", F.when(F.col("_any"), F.col("_lat")).otherwise(F.col("latitude")))
        .withColumn("longitude", F.when(F.col("_any"), F.col("_lon")).otherwise(F.col("longitude")))
        .drop("_lat", "_lon", "_at", "_any")
    )


def match_vehicle(positions: DataFrame, vehicle: str) -> DataFrame:
    """Positions of the vehicle with the same number; all of them if none match."""
    same = F.coalesce(F.col("vehicle_num") == vehicle_number(F.lit(vehicle)), F.lit(False))
    found = positions.filter(same).select(F.lit(True).alias("_found")).limit(1).scalar()
    return positions.filter(found.isNull() | same)


def positions_of_results(*results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All positions that results already carry, as one source; ``_from`` numbers the results."""
    parts = [
        r.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
            *keys,
            F.col("sec_time").alias("ts"),
            F.col("latitude").alias("lat"),
            F.col("longitude").alias("lon"),
            F.lit(n).alias("source_no"),
        )
        for n, r in enumerate(results)
        if {"sec_time", "latitude", "longitude"} <= set(r.columns)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefer_source(primary: DataFrame, fallback: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``primary`` wherever a key has any of it, ``fallback`` for the other keys."""
    have = primary.select(*keys).distinct()
    return primary.unionByName(fallback.join(have, list(keys), "left_anti"), allowMissingColumns=True)


def overlay_track(track: DataFrame, log: DataFrame, mode: str, keys: Sequence[str]) -> DataFrame:
    """Track and position log on one map, with ``source``.

    ``replace`` shows only the log for keys that have one; ``overlay`` shows both.
    """
    t = track.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    g = log.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    if mode == "replace":
        t = t.join(g.select(*keys).distinct(), list(keys), "left_anti")
    elif mode != "overlay":
        raise ValueError(f"unknown track mode: {mode}")
    return t.select(
        *keys, "sec_time", "latitude", "longitude", F.lit("track").alias("source")
    ).unionByName(
        g.select(
            *keys,
            F.col("ts").alias("sec_time"),
            F.col("lat").alias("latitude"),
            F.col("lon").alias("longitude"),
            F.lit("log").alias("source"),
        )
    )


def map_points(rows: DataFrame, value: str, clamp: tuple[float, float] | None = None) -> DataFrame:
    """Rows that can be drawn on a map, with the value's size as colour value."""
    numeric = rows.withColumns({c: number(c) for c in ("latitude", "longitude", value)})
    size: Column = F.abs(F.col(value))
    if clamp is not None:
        size = F.least(F.greatest(size, F.lit(float(clamp[0]))), F.lit(float(clamp[1])))
    return numeric.dropna(subset=["latitude", "longitude", value]).withColumn("color_value", size)


def track_extent(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Centre, spans and zoom of the points of each key."""
    box = points.groupBy(*keys).agg(
        F.avg("latitude").alias("center_lat"),
        F.avg("longitude").alias("center_lon"),
        (F.max("latitude") - F.min("latitude")).alias("lat_span"),
        (F.max("longitude") - F.min("longitude")).alias("lon_span"),
    )
    return box.withColumn("zoom", map_zoom(F.col("lat_span"), F.col("lon_span"), F.col("center_lat")))
