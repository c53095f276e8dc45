"""Exact quantiles by searching ranks digit by digit, without ordering a column anywhere.

Every double has a whole number that orders like it.  Its upper digits are counted first, and the digit
that holds a wanted rank is where the search goes on: only rows with that digit are counted by the next
one.  After three digits a single value is left.  Counting is a hash aggregate that combines before the
shuffle; what is put in order is at most one row per digit, however many rows or keys there are and
however the values lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from drivetrace.functions.generators import computed_once
from drivetrace.functions.numeric import number

#: Bits of the second and the third digit; the first has the rest of 64: sign, exponent and ten more.
BITS = 21
_DIGITS = ("_d1", "_d2", "_d3")


def ordinal(v: Column) -> Column:
    """A long that orders like the double ``v`` and is equal only for equal values; null for null."""
    size = F.abs(v)
    low = F.pow(F.lit(2.0), F.lit(-1022.0))
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    exponent = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    part = ((size / power(exponent) - 1) * F.lit(2.0**52)).cast("long")
    normal = F.shiftleft((exponent + 1023).cast("long"), 52) + part
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    above = F.when(size < low, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(v < 0, -above).when(v.isNotNull(), above)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), *, also: dict[str, Callable[[Column], Column]] | None = None
) -> DataFrame:
    """``keys``, ``n`` and one column per entry of ``probs`` (name to probability).

    Linear interpolation between the two nearest ranks; nulls and NaN do not count.  A key without any
    value has ``n`` 0 and null quantiles.  ``also`` names further aggregates of the value.
    """
    keys, more, v = list(keys), also or {}, F.col("_v")
    rows = df.select(*keys, number(value).alias("_v"))
    digits = F.col("_k")
    last = F.lit((1 << BITS) - 1)
    cut = (F.shiftright(digits, 2 * BITS), F.shiftright(digits, BITS).bitwiseAND(last), digits.bitwiseAND(last))
    placed = rows.filter(v.isNotNull()).select(*keys, computed_once(_v=v, _k=ordinal(v)))
    placed = placed.select(*keys, "_v", *[c.alias(d) for c, d in zip(cut, _DIGITS)])
    known = rows.groupBy(*keys).agg(F.count(v).alias("n"), *[f(v).alias(name) for name, f in more.items()])

    first = placed.groupBy(*keys, "_d1").agg(F.count("*").alias("_c"))
    n = F.sum("_c").over(W.partitionBy(*keys))
    at = [(n - 1) * F.lit(float(p)) for p in probs.values()]
    wanted = [
        F.struct(F.lit(no).alias("no"), F.lit(up).alias("up"), round_(a).alias("rank"), (a - F.floor(a)).alias("part"))
        for no, a in enumerate(at)
        for up, round_ in ((False, F.floor), (True, F.ceil))
    ]
    found = _holding(first.withColumn("_t", F.array(*wanted)), keys, "_d1")
    for depth in (1, 2):
        path, digit = [*keys, *_DIGITS[:depth]], _DIGITS[depth]
        counted = placed.join(found, path).groupBy(*path, digit).agg(F.count("*").alias("_c"), F.first("_t").alias("_t"), F.max("_v").alias("_v"))
        found = _holding(counted, path, digit, *(["_v"] if depth == 2 else []))
    hits = found.select(*keys, "_v", F.explode("_t").alias("_t"))
    aggs = []
    for no, name in enumerate(probs):
        here = F.col("_t.no") == no
        lower, upper = (F.max(F.when(here & (F.col("_t.up") == up), v)) for up in (False, True))
        aggs.append((lower + F.when(upper > lower, (upper - lower) * F.max(F.when(here, F.col("_t.part")))).otherwise(0.0)).alias(name))
    found = hits.groupBy(*keys).agg(*aggs)
    if keys:
        return known.join(found, keys, "left").select(*keys, "n", *more, *probs)
    one = found.select(F.struct(*probs).alias("_q")).scalar()
    return known.withColumn("_q", one).select("n", *more, *[F.col(f"_q.{p}").alias(p) for p in probs])


def _holding(counted: DataFrame, path: Sequence[str], digit: str, *keep: str) -> DataFrame:
    """The digits under ``path`` that hold a wanted rank, with the ranks inside them."""
    upto = W.partitionBy(*path).orderBy(digit).rowsBetween(W.unboundedPreceding, 0)
    below = counted.withColumn("_z", F.sum("_c").over(upto)).withColumn("_a", F.col("_z") - F.col("_c"))
    mine = F.filter("_t", lambda t: (t["rank"] >= F.col("_a")) & (t["rank"] < F.col("_z")))
    inside = F.transform(mine, lambda t: t.withField("rank", t["rank"] - F.col("_a")))
    return below.select(*path, digit, *keep, inside.alias("_t")).filter(F.size("_t") > 0)


def describe(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column; NaN counts as null.

    Keys without any value stay, with count 0.
    """
    moments = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = exact_quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, keys, also=moments)
    return found.select(*keys, "n", "mean", "std", "min", "p25", "p50", "p75", "max")
