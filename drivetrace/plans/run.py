"""A run: all metrics, histograms and custom fields of all vehicles, periods and chunks.

Each result is one plan over the whole fleet; vehicle, period and chunk are columns.  What all of them need of
each second, its state, whether it was driven automatically and the distance so far, can be stored once
(``plan_run(..., store=True)``): in buckets by vehicle, period, chunk and second, in which samples
reduced to seconds meet it without another exchange of it, in whichever action and however often.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivetrace.config import KEYS, PERIOD, VEHICLE, CustomField, MetricSpec, RunSpec
from drivetrace.functions.numeric import linear, number
from drivetrace.operators.compare import union_periods, with_labels
from drivetrace.operators.distance import cumulative_distance, stitch_distance
from drivetrace.operators.histogram import histogram, histogram_of_mode, sum_bins, with_ratios
from drivetrace.operators.periods import chunk_periods, select_rows
from drivetrace.operators.states import auto_of_chunks, second_modes, state_per_second, state_seconds
from drivetrace.operators.worst import auto_seconds, mean_per_second, worst_per_window
from drivetrace.sources.shared import stored_by
from drivetrace.sources.tables import Tables, has_position


@dataclass(frozen=True)
class Run:
    """What all results of a run share, still lazy."""

    spec: RunSpec
    chunks: DataFrame
    excludes: DataFrame | None
    tables: Tables
    span: tuple[datetime, datetime] | None
    tie: tuple[str, ...]
    store: bool = False
    _built: dict = field(default_factory=dict, repr=False, compare=False)

    def _once(self, name, build: Callable[[], DataFrame]) -> DataFrame:
        """Each shared plan is built once, so that Spark sees equal parts as equal and reuses them."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def rows(self, role: str) -> DataFrame:
        """A table's rows inside the chunks and outside the exclusions."""
        table = self.tables.role(role)
        return self._once(
            ("rows", id(table)), lambda: select_rows(table, self.chunks, self.excludes, span=self.span)
        )

    def states(self) -> DataFrame:
        fine = self.spec.grain.fine
        return self._once("states", lambda: state_per_second(self.rows("state"), fine=fine))

    def auto(self) -> DataFrame:
        generation = self.spec.generation
        return self._once("auto", lambda: auto_of_chunks(self.states(), self.chunks, generation=generation))

    def driven(self) -> DataFrame:
        """The automatic seconds; of stored ones with their distance."""
        if self.store:
            return self._once("driven", lambda: self.seconds().filter("is_auto").select(*KEYS, "sec_time", "cum_dist_km"))
        return self._once("driven", lambda: auto_seconds(self.states(), self.auto()))

    def modes(self) -> DataFrame:
        """Seconds with a state, and whether it is the automatic one."""
        if self.store:
            return self._once("modes", lambda: self.seconds().filter("is_auto IS NOT NULL").select(*KEYS, "sec_time", "is_auto"))
        return self._once("modes", lambda: second_modes(self.states(), self.auto()))

    def seconds(self) -> DataFrame:
        """``keys, sec_time, system_state, is_auto, cum_dist_km`` of seconds with a state or a distance, stored."""

        def build() -> DataFrame:
            both = self.states().join(self._distance(), [*KEYS, "sec_time"], "full")
            both = both.join(self.auto().select(*KEYS, "auto_value"), list(KEYS), "left")
            is_auto = (F.col("system_state") == F.col("auto_value")).alias("is_auto")
            columns = [*KEYS, "sec_time", "system_state", is_auto, "cum_dist_km"]
            return stored_by(both.select(*columns), "seconds", [*KEYS, "sec_time"])

        return self._once("seconds", build)

    def distance(self) -> DataFrame:
        if self.store:
            return self._once("stored distance", lambda: self.seconds().filter("cum_dist_km IS NOT NULL").select(*KEYS, "sec_time", "cum_dist_km"))
        return self._distance()

    def _distance(self) -> DataFrame:
        spec = self.spec
        return self._once(
            "distance",
            lambda: cumulative_distance(
                spec.distance, self.rows("control"), self.rows("speed"), fine=spec.grain.fine
            ),
        )


def plan_run(
    tables: Tables,
    periods: DataFrame,
    spec: RunSpec,
    *,
    excludes: DataFrame | None = None,
    span: tuple[datetime, datetime] | None = None,
    tie: Sequence[str] = ("ts",),
    store: bool = False,
) -> Run:
    return Run(spec, chunk_periods(periods, spec.split_minutes), excludes, tables, span, tuple(tie), store)


def metric(run: Run, spec: MetricSpec, role: str = "control") -> DataFrame:
    """Worst automatic sample per window of a built-in metric."""
    return worst_per_window(
        run.rows(role),
        run.driven(),
        number(spec.column),
        spec.name,
        run.spec.threshold(spec),
        grain=run.spec.grain,
        tie=run.tie,
        **_far(run),
    )


def _far(run: Run) -> dict:
    """Where the distance of the worst seconds comes from."""
    return {"along": ("cum_dist_km",)} if run.store else {"distance": run.distance()}


def hist(run: Run, column: str, width: float, *, scale: float = 1.0, offset: float = 0.0, role: str = "pose") -> DataFrame:
    """Histogram of each chunk with shares."""
    counted = histogram(
        run.rows(role),
        run.modes(),
        linear(number(column), scale, offset),
        width,
        fine=run.spec.grain.fine,
    )
    return with_ratios(counted)


def hist_of_mode(run: Run, column: str, width: float, mode: str, *, role: str = "pose") -> DataFrame:
    """Histogram of each chunk with shares, of the seconds of one mode only."""
    counted = histogram_of_mode(
        run.rows(role), run.modes(), number(column), width, mode, fine=run.spec.grain.fine
    )
    return with_ratios(counted, modes=(mode,))


def custom(run: Run, cf: CustomField) -> DataFrame:
    """Worst sample per window, or mean time series, of any table and column."""
    rows = run.rows(cf.table)
    position = has_position(rows)
    if cf.mode == "timeseries":
        return mean_per_second(
            rows,
            number(cf.column),
            scale=cf.scale,
            offset=cf.offset,
            fine=run.spec.grain.fine,
            with_position=position,
            distance=run.distance(),
        )
    return worst_per_window(
        rows,
        run.driven(),
        linear(number(cf.column), cf.scale, cf.offset),
        "value",
        cf.threshold,
        grain=run.spec.grain,
        carry=("latitude", "longitude") if position else (),
        tie=run.tie,
        **_far(run),
    )


def custom_hist(run: Run, cf: CustomField) -> DataFrame:
    return hist(
        run, cf.column, cf.hist_bin, scale=cf.scale, offset=cf.offset, role=cf.table
    )


def notes(run: Run) -> DataFrame:
    """Automatic value, its basis, and automatic and other seconds of each chunk with rows.

    A chunk with control rows but without states has its value by explicit generation or date.
    """
    if run.store and run.spec.distance == "latlon":  # whose seconds are all of the control rows
        seconds = run.seconds()
        auto = auto_of_chunks(seconds, run.chunks, generation=run.spec.generation, known=seconds.select(*KEYS).distinct())
        return state_seconds(seconds, auto)
    driven = run.rows("control").select(*KEYS).union(run.states().select(*KEYS)).distinct()
    auto = auto_of_chunks(run.states(), run.chunks, generation=run.spec.generation, known=driven)
    return state_seconds(run.states(), auto)


def results(run: Run) -> dict[str, DataFrame]:
    """All results by name: ``metric:…``, ``hist``, ``custom:…``, ``customhist:…``, ``notes``."""
    out = {f"metric:{m.key}": metric(run, m) for m in run.spec.metrics}
    out["hist"] = hist(run, run.spec.hist_column, run.spec.hist_bin)
    for f in run.spec.fields:
        out[f"custom:{f.key}"] = custom(run, f)
        out[f"customhist:{f.key}"] = custom_hist(run, f)
    out["notes"] = notes(run)
    return out


def whole_periods(rows: DataFrame) -> DataFrame:
    """Chunks of a period as one: distances continued, histograms summed."""
    if {"bin_start", "bin_end"} <= set(rows.columns):
        return sum_bins(rows, (VEHICLE, PERIOD))
    return stitch_distance(rows)


def report(run: Run, periods: DataFrame) -> DataFrame:
    """All results of a run in one long table, one row per point or bin, with period labels."""
    parts = []
    for name, df in results(run).items():
        value = next((m.name for m in run.spec.metrics if name == f"metric:{m.key}"), "value")
        columns = {"item": F.lit(name), **{c: F.col(c) for c in KEYS}}
        if name.startswith(("metric", "custom:")):
            columns |= {"sec_time": F.col("sec_time"), "value": F.col(value), "cum_dist_km": F.col("cum_dist_km")}
        elif name == "notes":
            columns |= {"cnt_auto": F.col("auto_seconds"), "cnt_manual": F.col("other_seconds")}
        else:
            columns |= {c: F.col(c) for c in ("bin_start", "cnt_auto", "cnt_manual")}
        parts.append(df.select(*[c.alias(n) for n, c in columns.items()]))
    return with_labels(union_periods(*parts), periods)


