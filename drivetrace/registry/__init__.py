"""Named queries over the given tables, each with the SQL that must give the same rows."""

from drivetrace.registry import (  # noqa: F401
    asof,
    distance,
    files,
    histograms,
    imports,
    legs,
    metrics,
    periods,
    replays,
    reports,
    states,
    tables,
)
from drivetrace.registry.base import ORACLES, QUERIES  # noqa: F401
