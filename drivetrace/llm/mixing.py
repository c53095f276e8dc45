"""Mixing sources to target weights with a temperature.

The share of a source in all tokens, raised to an exponent and normalised, is its weight: 1 keeps the
shares, 0 makes all sources equal. The exponent is the largest that reaches a target entropy, or the
smallest that repeats no source more often than a limit, found by bisection. A budget of tokens is then
spent: a source passes over its documents in one permutation after another until its part of the
budget is used up. A permutation deals documents to blocks by a hash and orders each block by it, so
that no source is ever ordered as a whole; only the block in which the budget ends is looked into.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivetrace.llm.common import written

#: A round cuts the range of the exponent into so many parts; after the rounds it is exact to 1e-9.
CUTS, ROUNDS = 64, 5


def counted(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, source and tokens (runs without white space) of every document."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(r"\S++")).cast("long").alias("tokens"),
    )


def _last_true(holds: Callable[[list[float]], list[bool]]) -> float:
    """The largest point of [0, 1] up to which ``holds``; it is tested for a row of points at once."""
    low, high = 0.0, 1.0
    if holds([1.0])[0]:
        return 1.0
    for _ in range(ROUNDS):
        points = [low + (high - low) * k / CUTS for k in range(1, CUTS)]
        n = sum(holds(points))
        low, high = ([low, *points])[n], ([*points, high])[n]
    return low


def exponent(totals: DataFrame, entropy: float | None, repeats: float | None, budget_share: float) -> float:
    """The exponent that meets the goals, to six places.

    ``entropy`` is a share of the largest possible one, the logarithm of the number of sources;
    ``repeats`` limits the passes over any source when ``budget_share`` times all tokens are spent. Where
    both cannot be had the limit wins; a limit that even exponent 1 breaks gives 1. Each round is one
    aggregate over the sources, which are never collected.
    """
    some = totals.where("share > 0").select("share", F.ln("share").alias("log"))
    n = some.count()

    def sums(points: list[float]) -> list[tuple]:
        grid = some.select("*", F.posexplode(F.array(*map(F.lit, points))).alias("n", "t"))
        power = F.exp(F.col("t") * F.col("log"))
        by = grid.groupBy("n").agg(
            F.sum(power).alias("z"), F.sum(power * F.col("t") * F.col("log")).alias("e"), F.max(F.exp((F.col("t") - 1) * F.col("log"))).alias("most")
        )
        return [(r["z"], r["e"], r["most"]) for r in by.orderBy("n").collect()]

    def even_enough(points: list[float]) -> list[bool]:
        return [math.log(z) - e / z >= entropy * math.log(n) - 1e-12 for z, e, _ in sums(points)]

    def few_passes(points: list[float]) -> list[bool]:  # counted from 1 down
        return [most / z * budget_share <= repeats + 1e-12 for z, _, most in sums([1 - p for p in points])]

    if n == 0:
        return 1.0
    found = 1.0 if entropy is None else math.floor(_last_true(even_enough) * 1e6) / 1e6
    if repeats is not None:
        limit = 1.0 if not few_passes([0.0])[0] else 1 - math.floor(_last_true(few_passes) * 1e6) / 1e6
        found = max(found, limit) if entropy is not None else limit
    return round(found, 6)


def weights(rows: DataFrame, entropy: float | None = 0.9, repeats: float | None = 4.0, budget: int | None = None) -> DataFrame:
    """source, total (tokens), documents, share, weight, target (tokens of the budget) of each source."""
    totals = written(rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("documents")), "totals")
    whole = totals.agg(F.sum("total")).first()[0] or 0
    share = F.when(F.lit(whole) > 0, F.col("total") / F.lit(max(whole, 1))).otherwise(0.0)
    totals = totals.withColumn("share", share)
    budget = whole if budget is None else budget
    power = exponent(totals, entropy, repeats, budget / whole if whole else 0.0)
    raised = F.when(F.col("share") > 0, F.pow("share", F.lit(power))).otherwise(0.0)
    z = totals.agg(F.sum(raised)).first()[0] or 1.0
    weight = F.round(raised / F.lit(z), 12)
    return totals.withColumn("weight", weight).withColumn("target", F.round(F.col("weight") * F.lit(budget)).cast("long"))


def mixture(
    documents: DataFrame, entropy: float | None = 0.9, repeats: float | None = 4.0, budget: int | None = None,
    block_tokens: int = 1 << 20, seed: int = 11,
) -> DataFrame:
    """The order in which documents are read, one row per reading.

    doc_id, text_hash, source, tokens, epoch (pass over the source, from 0), block, place (within the
    block, from 1), progress (share of the source's part of the budget spent before the block; sorting by
    it interleaves all sources at their weights). ``budget`` defaults to all tokens there are. A source
    never exceeds its part and stays below it by less than one document. Null sources are one source;
    null texts have no tokens; repeated rows are read as often as they occur; a source without tokens
    has no part. Columns other than doc_id, text and source are ignored.
    """
    rows = written(counted(documents), "counted")
    parts = weights(rows, entropy, repeats, budget).withColumns(
        {
            "passes": F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("int"),
            "blocks": F.ceil((F.col("total") + F.col("documents")) / block_tokens).cast("long"),
        }
    )
    parts = parts.where("target > 0").withColumn("rest", F.col("target") - F.col("passes") * F.col("total"))
    parts = parts.select(F.col("source").alias("_s"), "total", "target", "passes", "blocks", "rest")
    read = rows.join(parts, F.expr("source <=> _s")).drop("_s")
    last = F.col("passes") - F.when(F.col("rest") > 0, 0).otherwise(1)
    read = read.select("*", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
    read = read.withColumn("order", F.xxhash64("doc_id", "text_hash", "epoch", F.lit(seed)))
    read = read.withColumn("block", F.pmod("order", "blocks")).withColumn("_n", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull())
    key = ["_n", "_null", "epoch", "block"]
    sums = read.groupBy(*key).agg(F.sum("tokens").alias("in_block"))
    upto = Window.partitionBy("_n", "_null", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("in_block").over(upto), F.lit(0).cast("long")))
    room = F.col("rest") - F.col("before")
    kept = read.join(sums, key).where((F.col("epoch") < F.col("passes")) | (room > 0))
    inside = Window.partitionBy(*key).orderBy("order", "doc_id", "text_hash")
    kept = kept.withColumns({"place": F.row_number().over(inside), "spent": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    kept = kept.where((F.col("epoch") < F.col("passes")) | (F.col("spent") <= room))
    progress = (F.col("epoch") * F.col("total") + F.col("before")) / F.col("target")
    return kept.select("doc_id", "text_hash", "source", "tokens", "epoch", "block", "place", progress.alias("progress"))


def mixed(documents: DataFrame, **options) -> DataFrame:
    """``documents`` as often and in the order in which the mixture reads them, with all their columns.

    Rows are dealt to ranges of ``progress`` and sorted inside them, so that a table written from the result
    holds them in order, by progress, block and place. Rows equal in doc_id, text and source are told apart by their
    other columns; the plan reads each of them in every whole pass, and in the last one as many as fit.
    Null texts stay null; a row that is not read is not in the result.
    """
    key = ["id", "text_hash", "name", "absent"]
    same = lambda other: F.expr(" AND ".join(f"r.{c} <=> {other}.{c}" for c in key))
    named = {"id": F.col("doc_id"), "name": F.coalesce("source", F.lit("")), "absent": F.col("source").isNull()}
    reading = mixture(documents, **options).withColumns(named).select(*key, "epoch", "block", "place", "progress")
    reading = reading.withColumn("copy", F.row_number().over(Window.partitionBy(*key, "epoch").orderBy("block", "place")))
    # The row as one struct: no name of a column of its own meets those used here.
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    source = F.col("row.source").cast("string")
    rows = rows.select(
        "row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("row.text", F.lit(""))).alias("text_hash"),
        F.coalesce(source, F.lit("")).alias("name"), source.isNull().alias("absent"),
    ).alias("r")
    # Only rows that have equals are numbered.
    equal = written(rows.groupBy(*key).count().where("count > 1").select(*key), "equal-rows").alias("e")
    number = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(F.to_json("row"))))
    alone = rows.join(equal, same("e"), "left_anti").select("*", F.lit(1).alias("copy"))
    several = rows.join(equal, same("e"), "left_semi").select("*", number.alias("copy"))
    met = same("p") & F.expr("r.copy = p.copy")
    read = alone.unionByName(several).alias("r").join(reading.alias("p"), met).select("r.row", "p.progress", "p.block", "p.place", "p.id")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("progress") * n), F.lit(n - 1)).cast("int")
    return read.repartitionById(n, part).sortWithinPartitions("progress", "block", "place", "id").select("row.*")
