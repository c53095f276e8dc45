"""Histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivetrace.config import HIST_BASE_BIN, HIST_DISPLAY_BIN, SMOOTH_WINDOW_DEFAULT
from drivetrace.functions.numeric import step_decimals
from drivetrace.operators.histogram import merge_modes, rebin, smooth, sum_bins, with_ratios
from drivetrace.plans.run import hist, hist_of_mode
from drivetrace.registry.base import oracle, query, run_of, telemetry

_RATIOS = """CASE WHEN sum(cnt_auto) OVER w > 0 THEN round(cnt_auto / sum(cnt_auto) OVER w, 9) ELSE 0 END AS ratio_auto,
  CASE WHEN sum(cnt_manual) OVER w > 0 THEN round(cnt_manual / sum(cnt_manual) OVER w, 9) ELSE 0 END AS ratio_manual"""


def of_chunks(spark, sf):
    return hist(run_of(spark, sf), "signal_b", HIST_BASE_BIN)


def of_periods(spark, sf):
    return sum_bins(of_chunks(spark, sf))


_CHUNK_SQL = oracle(
    "hist", f"SELECT *, {_RATIOS} FROM hist WINDOW w AS (PARTITION BY vehicle_id, period_id, chunk_idx)"
)


@query("hist_auto_manual", _CHUNK_SQL)
def hist_auto_manual(spark, sf):
    return of_chunks(spark, sf)


@query("hist_merge_full_outer", _CHUNK_SQL)
def hist_merge_full_outer(spark, sf):
    """The two modes counted apart, each over the seconds of its own, and put together by bin."""
    run = run_of(spark, sf)
    return merge_modes(*(hist_of_mode(run, "signal_b", HIST_BASE_BIN, mode) for mode in ("auto", "manual")))


@query(
    "hist_period_rollup",
    oracle("hist_p", f"SELECT *, {_RATIOS} FROM hist_p WINDOW w AS (PARTITION BY vehicle_id, period_id)"),
)
def hist_period_rollup(spark, sf):
    return of_periods(spark, sf)


@query(
    "hist_rebin",
    oracle(
        "hist_r",
        f"""SELECT *, {_RATIOS}, CAST(1 AS INTEGER) AS x_decimals
        FROM hist_r WINDOW w AS (PARTITION BY vehicle_id, period_id)""",
    ),
)
def hist_rebin(spark, sf):
    """The fine histogram at display width, with the decimals its axis needs."""
    rows = rebin(of_periods(spark, sf), HIST_DISPLAY_BIN)
    return rows.withColumn("x_decimals", step_decimals(F.round(F.col("bin_end") - F.col("bin_start"), 9)))


@query(
    "hist_step_decimals",
    oracle(
        "tel",
        """SELECT DISTINCT event_id % 97 AS k, 10.0 ** -(event_id % 5) * (1 + event_id % 97) AS step,
          CAST(CASE WHEN strpos(t, '.') = 0 THEN 0 ELSE length(t) - strpos(t, '.') END AS INTEGER) AS decimals
        FROM (SELECT event_id, rtrim(rtrim(printf('%.9f', (1 + event_id % 97) / CAST(10 ** (event_id % 5) AS DOUBLE)), '0'), '.') AS t FROM tel)""",
    ),
)
def hist_step_decimals(spark, sf):
    """Decimals of many widths, from whole numbers to ten-thousandths."""
    rows = telemetry(spark, sf).select(
        (F.col("event_id") % 97).alias("k"), ((1 + F.col("event_id") % 97) / F.pow(F.lit(10.0), F.col("event_id") % 5)).alias("step")
    )
    return rows.distinct().withColumn("decimals", step_decimals(F.col("step")))


@query(
    "hist_smooth",
    oracle(
        "hist_r",
        f"""SELECT vehicle_id, period_id, bin_start, round(avg(ra) OVER s, 9) AS ratio_auto_smooth,
          round(avg(rm) OVER s, 9) AS ratio_manual_smooth
        FROM (SELECT *, CASE WHEN sum(cnt_auto) OVER w > 0 THEN cnt_auto / sum(cnt_auto) OVER w ELSE 0 END AS ra,
            CASE WHEN sum(cnt_manual) OVER w > 0 THEN cnt_manual / sum(cnt_manual) OVER w ELSE 0 END AS rm
          FROM hist_r WINDOW w AS (PARTITION BY vehicle_id, period_id))
        WINDOW s AS (PARTITION BY vehicle_id, period_id ORDER BY bin_start ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""",
    ),
)
def hist_smooth(spark, sf):
    rows = rebin(of_periods(spark, sf), HIST_DISPLAY_BIN)
    return smooth(rows, ("ratio_auto", "ratio_manual"), SMOOTH_WINDOW_DEFAULT).select(
        "vehicle_id", "period_id", "bin_start", "ratio_auto_smooth", "ratio_manual_smooth"
    )
