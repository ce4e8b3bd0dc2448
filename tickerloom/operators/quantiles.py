"""Exact order statistics by distributed selection.

Equal values collapse to one row with a count before anything else, so ties take
no part in the search. A wanted rank then has a range of values that holds it.
Splitters cut a range of too many values into parts of about equal size, exact
counts say which part holds the rank, and the search goes on there, until the
range is small enough to be sorted. No range, key or value gathers in one task
above that size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..session import broadcast_if_small, cut_lineage

#: Distinct values that may be sorted together.
SMALL = 500_000
#: Parts that a larger range is cut into, and the accuracy of the splitters.
PARTS, ACCURACY = 64, 1000


def _inside(counted: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Values with the targets of their key whose range holds them."""
    return counted.join(broadcast_if_small(targets), keys).where(
        (F.col("_low").isNull() | (F.col("_v") >= F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high"))))


def _narrowed(counted: DataFrame, targets: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Each target with the part of its range that holds its rank, and the rank counted from that part's first row."""
    rows = _inside(counted, targets, keys)
    cuts = rows.groupBy(*keys, "_want").agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)], ACCURACY).alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    counts = rows.join(broadcast_if_small(cuts), [*keys, "_want"]).groupBy(*keys, "_want", "_rank", part.alias("_part")).agg(
        F.sum("_c").alias("_rows"), F.count("*").alias("_values"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    end = F.sum("_rows").over(Window.partitionBy(*keys, "_want").orderBy("_part"))
    found = counts.withColumn("_end", end).where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_rows")))
    return found.select(*keys, "_want", (F.col("_rank") - F.col("_end") + F.col("_rows")).alias("_rank"), "_low", "_high", "_values")


def ranked_values(df: DataFrame, keys: list[str], value: str, wanted: list[Column], small: int = SMALL, parts: int = PARTS) -> DataFrame:
    """(keys, _want, _v): the values at wanted ranks (from 1, computed from the row count ``_n``) per key; nulls do not count."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, dbl(value).alias("_v"))
    counted = cut_lineage(rows.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count("*").alias("_values"))
    none = F.lit(None).cast("double")
    targets = totals.withColumn("_want", F.explode(F.array_distinct(F.array(*wanted)))).select(
        *keys, "_want", F.col("_want").alias("_rank"), none.alias("_low"), none.alias("_high"), "_values")
    while (targets.agg(F.max("_values")).first()[0] or 0) > small:
        large = targets.where(F.col("_values") > small)
        targets = cut_lineage(targets.where(F.col("_values") <= small).unionByName(_narrowed(counted, large, keys, parts)))
    end = F.sum("_c").over(Window.partitionBy(*keys, "_want").orderBy("_v"))
    found = _inside(counted, targets, keys).withColumn("_end", end)
    return found.where((F.col("_rank") <= F.col("_end")) & (F.col("_rank") > F.col("_end") - F.col("_c"))).select(*keys, "_want", "_v")


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median", **sizes) -> DataFrame:
    """Median per key."""
    middle = [F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)]
    return ranked_values(df, keys, value, middle, **sizes).groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, share: float, name: str = "quantile", **sizes) -> DataFrame:
    """Nearest-rank quantile per key: the value at position ceil(n * share)."""
    at = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_n") * F.lit(share)))
    return ranked_values(df, keys, value, [at], **sizes).groupBy(*keys).agg(F.min("_v").alias(name))
