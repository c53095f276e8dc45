"""Signals of one vehicle merged by nearest time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from drivetrace.operators.asof import asof_nearest, signed_gap_seconds


def merge_signals(
    base: DataFrame,
    others: Sequence[tuple[DataFrame, Sequence[str], str]],
    *,
    by: Sequence[str],
    tolerance_s: float,
    order: Sequence[str] = (),
    slice_s: float = 60.0,
) -> DataFrame:
    """Base rows with the nearest row of each other signal.

    Each of ``others`` is (rows, value columns, suffix); its matched instant appears as
    ``ts_<suffix>`` and the signed distance as ``time_diff_s_<suffix>``.
    """
    out = base
    for rows, columns, suffix in others:
        out = asof_nearest(
            out,
            rows,
            by=by,
            tolerance_s=tolerance_s,
            columns=columns,
            order=order,
            right_ts_as=f"ts_{suffix}",
            slice_s=slice_s,
        ).withColumn(f"time_diff_s_{suffix}", signed_gap_seconds("ts", f"ts_{suffix}"))
    return out
