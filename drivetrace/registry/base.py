"""Registry, adapter views over the given tables, and the shared parts of the oracle SQL.

``events`` stands in for telemetry and ``orders`` for legs.  Events are sparse, so the fine grain is
the hour and the coarse grain the day.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drivetrace.config import Grain, Range, RunSpec
from drivetrace.operators.periods import chunk_periods, excludes_frame, periods_frame, select_rows, span_of
from drivetrace.plans.run import Run, plan_run
from drivetrace.session import prepare
from drivetrace.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

GRAIN = Grain(fine="hour", coarse="day")
SPLIT_MINUTES = 2 * 24 * 60
THRESHOLD = 20.0
TIE = ("ts", "event_id")
SLICE_S = 600.0
TOLERANCE_S = 1800.0
DIGITS = 9
METRIC_KM = {"cum_dist_km": 3}


def query(name: str, sql: str | None = None, digits: dict[str, int] | None = None):
    """Register a query; its result leaves with rounded doubles and zone-less times."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return edge(build(prepare(spark), sf_dir), digits or {})

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def edge(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Doubles to 9 places (or as told), instants as UTC wall-clock times."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits.get(f.name, DIGITS)) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry table holding every role's columns."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    vehicle = F.col("user_id") % 5
    auto = F.when(vehicle % 2 == 0, 16).otherwise(4)
    kind = F.col("event_type")
    state = (
        F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "signup", 2)
        .when(kind == "error", 3).otherwise(auto)
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        vehicle.alias("vehicle_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("state_name"),
        (F.col("value") - 50.0).alias("signal_a"),
        (((F.col("event_id") * 37) % 401 - 200) / F.lit(50.0)).alias("signal_b"),
        (F.lit(35.0) + (F.col("event_id") % 997) / F.lit(9973.0)).alias("latitude"),
        (F.lit(139.0) + k / F.lit(9973.0)).alias("longitude"),
        (k / F.lit(3.7)).alias("speed_mps"),
        (k / F.lit(10.0)).alias("kp"),
        state.alias("system_state"),
    )


PERIODS = (
    Range(datetime(2024, 1, 2), datetime(2024, 1, 9, 12), "baseline"),
    Range(datetime(2024, 1, 10, 6), datetime(2024, 1, 17), ""),
    Range(datetime(2024, 1, 18), datetime(2024, 1, 28), "late"),
)
EXCLUDES = (
    Range(datetime(2024, 1, 4), datetime(2024, 1, 4, 6)),
    Range(datetime(2024, 1, 4, 3), datetime(2024, 1, 4, 12)),
    Range(datetime(2024, 1, 12, 10), datetime(2024, 1, 12, 16, 30)),
)


def periods(spark: SparkSession) -> DataFrame:
    return periods_frame(spark, PERIODS)


def chunks(spark: SparkSession) -> DataFrame:
    return chunk_periods(periods(spark), SPLIT_MINUTES)


def excludes(spark: SparkSession) -> DataFrame:
    return excludes_frame(spark, EXCLUDES)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_rows(telemetry(spark, sf_dir), chunks(spark), excludes(spark), span=span_of(PERIODS))


def run_of(spark: SparkSession, sf_dir: str, store: bool = False, **settings) -> Run:
    tel = telemetry(spark, sf_dir)
    spec = RunSpec(split_minutes=SPLIT_MINUTES, grain=GRAIN, **settings)
    return plan_run(
        Tables(tel, tel, tel, tel, {"telemetry": tel}),
        periods(spark),
        spec,
        excludes=excludes(spark),
        span=span_of(PERIODS),
        tie=TIE,
        store=store,
    )


def legs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as legs, 30 years later: start and end as text in several notations, or unreadable."""
    later = 10_957 * 86_400_000_000
    start = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + later + (F.col("o_custkey") % 24) * 3_600_000_000
    )
    hours = F.when(F.col("o_orderstatus") == "P", 0).otherwise(1 + F.col("o_orderkey") % 5)
    end = F.timestamp_micros(F.unix_micros(start) + hours * 3_600_000_000)

    def noted(t):
        s = F.unix_seconds(t)
        style = F.col("o_orderpriority")
        return (
            F.when(style.startswith("1"), s.cast("string"))
            .when(style.startswith("2"), (s * 1000).cast("string"))
            .when(style.startswith("3"), F.concat(s.cast("string"), F.lit(".5")))
            .when(style.startswith("4"), F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
            .otherwise(F.lit("n/a"))
        )

    return table(spark, sf_dir, "orders").select(
        noted(start).alias("data_start_time"),
        noted(end).alias("data_end_time"),
        F.concat(F.lit("v"), F.col("o_custkey") % 5).alias("vehicle_id"),
        F.concat(F.lit("leg-"), F.col("o_orderkey")).alias("display_name"),
        F.col("o_orderpriority").alias("version"),
        F.lit(None).cast("string").alias("vehicle_generation"),
        F.col("o_orderstatus").alias("direction"),
        F.col("o_orderkey").cast("string").alias("guid"),
    )


def leg_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a labelled period of one vehicle."""
    start = F.timestamp_micros(
        F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (F.col("o_custkey") % 24) * 3_600_000_000
    )
    length = (1 + F.col("o_orderkey") % 5) * 3_600_000_000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("period_id"),
        (F.col("o_custkey") % 5).alias("vehicle_id"),
        F.concat(F.lit("leg-"), F.col("o_orderkey")).alias("label"),
        start.alias("start_ts"),
        F.timestamp_micros(F.unix_micros(start) + length).alias("end_ts"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


# Shared parts of the oracle SQL, by name.
CTE = {
    "tel": """
tel AS (
  SELECT event_id, user_id % 5 AS vehicle_id, ts, event_type AS state_name,
    value - CAST(50 AS DOUBLE) AS signal_a,
    CAST((event_id * 37) % 401 - 200 AS DOUBLE) / CAST(50 AS DOUBLE) AS signal_b,
    CAST(35 AS DOUBLE) + (event_id % 997) / CAST(9973 AS DOUBLE) AS latitude,
    CAST(139 AS DOUBLE) + k / CAST(9973 AS DOUBLE) AS longitude,
    k / CAST(3.7 AS DOUBLE) AS speed_mps, k / CAST(10 AS DOUBLE) AS kp,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3
      ELSE CASE WHEN (user_id % 5) % 2 = 0 THEN 16 ELSE 4 END END AS system_state
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events))""",
    "periods": """
periods AS (
  SELECT * FROM (VALUES
    (1, 'baseline', TIMESTAMP '2024-01-02 00:00:00', TIMESTAMP '2024-01-09 12:00:00'),
    (2, '期間2', TIMESTAMP '2024-01-10 06:00:00', TIMESTAMP '2024-01-17 00:00:00'),
    (3, 'late', TIMESTAMP '2024-01-18 00:00:00', TIMESTAMP '2024-01-28 00:00:00')
  ) p(period_id, label, start_ts, end_ts))""",
    "excludes": """
excludes AS (
  SELECT * FROM (VALUES
    (TIMESTAMP '2024-01-04 00:00:00', TIMESTAMP '2024-01-04 06:00:00'),
    (TIMESTAMP '2024-01-04 03:00:00', TIMESTAMP '2024-01-04 12:00:00'),
    (TIMESTAMP '2024-01-12 10:00:00', TIMESTAMP '2024-01-12 16:30:00')
  ) x(start_ts, end_ts))""",
    "chunks": """
chunks AS (
  SELECT period_id, label, CAST(i AS INTEGER) AS chunk_idx,
    start_ts + to_days(CAST(2 * i AS INTEGER)) AS chunk_start,
    least(start_ts + to_days(CAST(2 * i + 2 AS INTEGER)), end_ts) AS chunk_end
  FROM periods, range(0, 20) r(i) WHERE start_ts + to_days(CAST(2 * i AS INTEGER)) < end_ts)""",
    "tagged": """
tagged AS (
  SELECT t.*, c.period_id, c.chunk_idx, date_trunc('hour', t.ts) AS sec_time
  FROM tel t JOIN chunks c ON t.ts >= c.chunk_start AND t.ts < c.chunk_end
  WHERE NOT EXISTS (SELECT 1 FROM excludes x WHERE t.ts >= x.start_ts AND t.ts < x.end_ts))""",
    "state_s": """
state_s AS (
  SELECT vehicle_id, period_id, chunk_idx, sec_time, max(system_state) AS system_state
  FROM tagged GROUP BY 1, 2, 3, 4)""",
    "auto_v": """
auto_v AS (
  SELECT s.vehicle_id, s.period_id, s.chunk_idx,
    CASE WHEN max(s.system_state) >= 5 THEN 16
      WHEN min(c.chunk_start) < TIMESTAMP '2026-04-30 15:00:00' THEN 4 ELSE 16 END AS auto_value,
    CASE WHEN max(s.system_state) >= 5 THEN 'state' ELSE 'date' END AS basis
  FROM state_s s JOIN chunks c USING (period_id, chunk_idx) GROUP BY 1, 2, 3)""",
    "moded": """
moded AS (
  SELECT s.*, a.auto_value, s.system_state = a.auto_value AS is_auto
  FROM state_s s JOIN auto_v a USING (vehicle_id, period_id, chunk_idx))""",
    "dist": """
dist AS (
  SELECT vehicle_id, period_id, chunk_idx, sec_time,
    sum(step_m) OVER (PARTITION BY vehicle_id, period_id, chunk_idx ORDER BY sec_time) / 1000 AS cum_dist_km
  FROM (
    SELECT *, CASE WHEN plat IS NULL OR plon IS NULL THEN 0 ELSE
      2 * 6371000 * asin(sqrt(pow(sin(radians(lat - plat) / 2), 2)
        + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))) END AS step_m
    FROM (
      SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM (
        SELECT vehicle_id, period_id, chunk_idx, sec_time, avg(latitude) AS lat, avg(longitude) AS lon
        FROM tagged GROUP BY 1, 2, 3, 4)
      WINDOW w AS (PARTITION BY vehicle_id, period_id, chunk_idx ORDER BY sec_time))))""",
    "worst": """
worst AS (
  SELECT vehicle_id, period_id, chunk_idx, win, sec_time, latitude, longitude, signal_a, abs_signal_a, cum_dist_km
  FROM (
    SELECT p.*, date_trunc('day', p.sec_time) AS win, row_number() OVER (
      PARTITION BY p.vehicle_id, p.period_id, p.chunk_idx, date_trunc('day', p.sec_time)
      ORDER BY abs_signal_a DESC, p.sec_time, p.ts, p.event_id) AS wrank
    FROM (
      SELECT *, abs(signal_a) AS abs_signal_a, row_number() OVER (
        PARTITION BY vehicle_id, period_id, chunk_idx, sec_time
        ORDER BY abs(signal_a) DESC, ts, event_id) AS srank
      FROM tagged WHERE abs(signal_a) >= 20) p
    JOIN moded m USING (vehicle_id, period_id, chunk_idx, sec_time)
    WHERE p.srank = 1 AND m.is_auto) q
  LEFT JOIN dist USING (vehicle_id, period_id, chunk_idx, sec_time) WHERE wrank = 1)""",
    "hist": """
hist AS (
  SELECT vehicle_id, period_id, chunk_idx, round(bin_idx * CAST(0.05 AS DOUBLE), 9) AS bin_start,
    round(round(bin_idx * CAST(0.05 AS DOUBLE), 9) + CAST(0.05 AS DOUBLE), 9) AS bin_end,
    count_if(is_auto) AS cnt_auto, count_if(NOT is_auto) AS cnt_manual
  FROM (SELECT t.vehicle_id, t.period_id, t.chunk_idx, m.is_auto,
          CAST(floor(t.signal_b / CAST(0.05 AS DOUBLE)) AS BIGINT) AS bin_idx
        FROM tagged t JOIN moded m USING (vehicle_id, period_id, chunk_idx, sec_time))
  GROUP BY 1, 2, 3, bin_idx)""",
    "hist_p": """
hist_p AS (
  SELECT vehicle_id, period_id, bin_start, bin_end,
    CAST(sum(cnt_auto) AS BIGINT) AS cnt_auto, CAST(sum(cnt_manual) AS BIGINT) AS cnt_manual
  FROM hist GROUP BY 1, 2, 3, 4)""",
    "hist_r": """
hist_r AS (
  SELECT vehicle_id, period_id, bin_start, round(bin_start + w, 9) AS bin_end,
    CAST(sum(cnt_auto) AS BIGINT) AS cnt_auto, CAST(sum(cnt_manual) AS BIGINT) AS cnt_manual
  FROM (
    SELECT vehicle_id, period_id, w, cnt_auto, cnt_manual,
      round(floor(h.bin_start / w + 1e-9) * w, 9) AS bin_start
    FROM hist_p h JOIN (
      SELECT vehicle_id, period_id, round(round_even(CAST(0.2 AS DOUBLE) / median(round(bin_end - bin_start, 9)), 0)
        * median(round(bin_end - bin_start, 9)), 9) AS w
      FROM hist_p GROUP BY 1, 2) b USING (vehicle_id, period_id))
  GROUP BY 1, 2, 3, w)""",
    "legs": """
legs AS (
  SELECT 'v' || (o_custkey % 5) AS vehicle_id, 'leg-' || o_orderkey AS display_name,
    start_ts + INTERVAL 1 MILLISECOND * (CASE WHEN o_orderpriority LIKE '3%' THEN 500 ELSE 0 END) AS start_ts,
    end_ts + INTERVAL 1 MILLISECOND * (CASE WHEN o_orderpriority LIKE '3%' THEN 500 ELSE 0 END) AS end_ts,
    o_orderpriority AS version, o_orderstatus AS direction, CAST(o_orderkey AS VARCHAR) AS guid
  FROM (SELECT *, o_orderdate + to_days(10957) + to_hours(o_custkey % 24) AS start_ts,
          o_orderdate + to_days(10957) + to_hours(o_custkey % 24 + CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 + o_orderkey % 5 END) AS end_ts
        FROM orders)
  WHERE end_ts > start_ts AND o_orderpriority NOT LIKE '5%')""",
    "leg_periods": """
leg_periods AS (
  SELECT o_orderkey AS period_id, o_custkey % 5 AS vehicle_id, 'leg-' || o_orderkey AS label,
    o_orderdate + to_hours(o_custkey % 24) AS start_ts,
    o_orderdate + to_hours(o_custkey % 24 + 1 + o_orderkey % 5) AS end_ts,
    o_orderstatus AS status, o_orderpriority AS priority, o_totalprice AS price
  FROM orders)""",
}
NEEDS = {
    "tel": (),
    "periods": (),
    "excludes": (),
    "chunks": ("periods",),
    "tagged": ("tel", "chunks", "excludes"),
    "state_s": ("tagged",),
    "auto_v": ("state_s", "chunks"),
    "moded": ("state_s", "auto_v"),
    "dist": ("tagged",),
    "worst": ("tagged", "moded", "dist"),
    "hist": ("tagged", "moded"),
    "hist_p": ("hist",),
    "hist_r": ("hist_p",),
    "legs": (),
    "leg_periods": (),
}


def oracle(uses: str, body: str) -> str:
    """SQL with the shared parts it uses; ``body`` starts with further parts or with SELECT."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for name in uses.split():
        add(name)
    parts = ",".join(CTE[n] for n in order)
    body = body.strip()
    if not parts:
        return body
    joint = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {parts}{joint}{body}"


def nearest_sql(left: str, right: str, columns: str, tolerance: str, left_ts: str = "ts", by: str = "vehicle_id") -> str:
    """Two parts, ``pairs`` then ``near``: each left row (by ``rid``) with the nearest right row."""
    return f"""
back AS (
  SELECT l.rid, r.ts AS bts, {', '.join(f'r.{c} AS b_{c}' for c in columns.split())}
  FROM {left} l ASOF LEFT JOIN {right} r ON l.{by} = r.{by} AND l.{left_ts} >= r.ts),
ahead AS (
  SELECT l.rid, r.ts AS ats, {', '.join(f'r.{c} AS a_{c}' for c in columns.split())}
  FROM {left} l ASOF LEFT JOIN {right} r ON l.{by} = r.{by} AND l.{left_ts} <= r.ts),
near AS (
  SELECT * EXCLUDE (mts, {', '.join('m_' + c for c in columns.split())}),
    CASE WHEN ok THEN mts END AS mts, {', '.join(f'CASE WHEN ok THEN m_{c} END AS m_{c}' for c in columns.split())}
  FROM (SELECT *, abs(epoch_us({left_ts}) - epoch_us(mts)) <= {tolerance} AS ok
    FROM (SELECT l.*, CASE WHEN pick THEN bts ELSE ats END AS mts,
            {', '.join(f'CASE WHEN pick THEN b_{c} ELSE a_{c} END AS m_{c}' for c in columns.split())}
      FROM (SELECT l.*, back.* EXCLUDE (rid), ahead.* EXCLUDE (rid),
              bts IS NOT NULL AND (ats IS NULL
                OR epoch_us(l.{left_ts}) - epoch_us(bts) <= epoch_us(ats) - epoch_us(l.{left_ts})) AS pick
            FROM {left} l JOIN back USING (rid) JOIN ahead USING (rid)) l)))"""
