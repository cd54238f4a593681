"""Exact quantiles per key without holding a key's values in one buffer.

A double's 64 bits, turned so that they follow the order of values, are resolved sixteen at a time: a pass counts, for
each key, the values below each of the at most 65,536 continuations of the prefix that is known to hold a wanted rank.
After four passes a prefix is a value.  Every pass is a plain count, so it combines before the shuffle and splits a busy
key over many tasks; no window or buffer ever holds more than the 65,536 counts of one prefix.

The same at every size: nulls are ignored, NaN is greater than every number, infinities lie at the ends, a null key
is a key of its own, and the result is a double.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut
from .series import null_safe_join, rows_per_chunk, spread_by_key

BITS = 16
_ONE = 1 << 52
_HALF = float(2**537)


def ordered_bits(v: Column) -> Column:
    """The bits of a double as a whole number in the order of values; both zeros are one, NaN comes last."""
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    scaled = a / F.pow(F.lit(2.0), guess)
    # The logarithm may be off by one next to a power of two.
    exponent = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    fraction = ((a / F.pow(F.lit(2.0), exponent) - 1) * _ONE).cast("long")
    normal = (exponent + 1023) * _ONE + fraction
    tiny = (a * _HALF * _HALF).cast("long")
    infinite = F.lit(2047 * _ONE).cast("long")
    size = F.when(F.isnan(v), infinite + 1).when(a == float("inf"), infinite).when(a < 2.0**-1022, tiny).otherwise(normal)
    return F.when(v < 0, -size).otherwise(size)


def from_ordered_bits(bits: Column) -> Column:
    """The double whose ordered bits these are."""
    a = F.abs(bits)
    exponent = F.shiftright(a, 52)
    fraction = (a - exponent * _ONE).cast("double") / float(_ONE)
    normal = (fraction + 1) * F.pow(F.lit(2.0), exponent - 1023)
    tiny = a.cast("double") / _HALF / _HALF
    infinite = 2047 * _ONE
    size = F.when(a > infinite, float("nan")).when(a == infinite, float("inf")).when(exponent == 0, tiny).otherwise(normal)
    return F.when(bits < 0, -size).otherwise(size)


def fits_one_buffer(rows: DataFrame, keys: list[str]) -> bool:
    """Whether no key has more rows than one task may hold."""
    return (rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= rows_per_chunk(rows.sparkSession)


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float], small: bool | None = None) -> DataFrame:
    """One row per key with linearly interpolated quantiles, nulls ignored.

    ``small`` says whether the values of a key fit one aggregation buffer; unset, a count per key decides.
    """
    rows = df.select(*keys, value.cast("double").alias("_q_v")).where(F.col("_q_v").isNotNull())
    if fits_one_buffer(rows, keys) if small is None else small:
        return rows.groupBy(*keys).agg(*[F.percentile("_q_v", q).alias(n) for n, q in quantiles.items()])

    base = cut(rows.select(*keys, ordered_bits(F.col("_q_v")).alias("_q_s")))
    names = list(quantiles)
    place = {n: F.lit(q) * (F.col("_q_all") - 1) for n, q in quantiles.items()}
    asks = [F.struct(F.lit(2 * i + up).alias("id"), end(place[n]).alias("r")) for i, n in enumerate(names) for up, end in enumerate((F.floor, F.ceil))]
    wanted = None
    for shift in range(64 - BITS, -1, -BITS):
        here = F.shiftright("_q_s", shift).alias("_q_p")
        if wanted is None:
            of = keys
            counts = base.groupBy(*keys, here).agg(F.count("*").alias("_q_n"))
            counts = counts.withColumn("_q_all", F.sum("_q_n").over(Window.partitionBy(*keys))).withColumn("_q_asks", F.array(*asks))
        else:
            of = [*keys, "_q_parent"]
            inside = base.withColumn("_q_parent", F.shiftright("_q_s", shift + BITS))
            inside = spread_by_key(inside, wanted.select(*of), of, "inner", null_safe=True)
            counts = inside.groupBy(*of, here).agg(F.count("*").alias("_q_n"))
            counts = null_safe_join(counts, wanted, of)
        start = F.sum("_q_n").over(Window.partitionBy(*of).orderBy("_q_p")) - F.col("_q_n")
        counts = counts.withColumn("_q_start", start)
        inside_here = F.filter("_q_asks", lambda a: (a["r"] >= F.col("_q_start")) & (a["r"] < F.col("_q_start") + F.col("_q_n")))
        held = F.transform(inside_here, lambda a: F.struct(a["id"].alias("id"), (a["r"] - F.col("_q_start")).alias("r")))
        wanted = cut(counts.select(*keys, F.col("_q_p").alias("_q_parent"), "_q_all", held.alias("_q_asks")).where(F.size("_q_asks") > 0))
    found = wanted.select(*keys, "_q_all", from_ordered_bits(F.col("_q_parent")).alias("_q_v"), F.explode("_q_asks").alias("_q_a"))
    at = lambda i: F.max(F.when(F.col("_q_a.id") == i, F.col("_q_v")))
    out = []
    for i, n in enumerate(names):
        part = F.max(place[n] - F.floor(place[n]))
        low, high = at(2 * i), at(2 * i + 1)
        # Equal ends stay as they are: between two infinities nothing is to be interpolated.
        out.append(F.when(low == high, low).otherwise(low * (1 - part) + high * part).alias(n))
    return found.groupBy(*keys).agg(*out)


def exact_median(df: DataFrame, keys: list[str], value: Column, name: str, small: bool | None = None) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5}, small)
