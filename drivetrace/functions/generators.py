"""Columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(**columns: Column) -> Column:
    """Several columns at once, for ``select``.

    Filters on plain computed columns are moved below them and compute them again.  Coming from a
    generator, costly columns such as parsed text are computed once and then filtered.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
