"""Results as export sheets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.config import HIST_DISPLAY_BIN, KEYS
from drivetrace.operators.histogram import rebin
from drivetrace.plans.run import Run, hist, metric
from drivetrace.sources.sinks import local_times, sheet_key


def sheets(run: Run, display_bin: float = HIST_DISPLAY_BIN) -> dict[str, DataFrame]:
    """Fetched results by query (``Q1``, ``Q2``, …, the histogram last), in local time.

    Rows carry their ``sheet`` name and ``query``.  The histogram of each chunk has the display
    width; overrides are not part of the export.
    """
    out = {}
    for n, spec in enumerate(run.spec.metrics, start=1):
        out[f"Q{n}"] = metric(run, spec)
    fine = hist(run, run.spec.hist_column, run.spec.hist_bin)
    out[f"Q{len(out) + 1}"] = rebin(fine, display_bin, KEYS)
    return {
        q: local_times(df).withColumn("sheet", sheet_key(q)).withColumn("query", F.lit(q))
        for q, df in out.items()
    }
