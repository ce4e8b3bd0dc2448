"""Movement facts as a bounded correction of the market score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp, dbl, fixed
from .latest import topn

# Score per unit of confidence, cap of the sum, and facts used per stock.
UNIT, CAP, TOP = 0.8, 2.0, 3


def any_term(text: str, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(text).contains(t) for t in terms if t], F.lit(False))


def movement_adjust(facts: DataFrame, positive: list[str], negative: list[str], scores: DataFrame) -> DataFrame:
    """Negative wording wins over positive; the three strongest facts of a stock count."""
    direction = F.when(any_term("text", negative), -1).when(any_term("text", positive), 1).otherwise(0)
    rated = facts.withColumn("adjustment", fixed(direction * F.col("confidence") * F.lit(UNIT), 4))
    strongest = topn(rated, ["stock_key"],
                     [F.desc(F.abs("adjustment")), F.desc("confidence"), F.asc("fact_id")], TOP)
    total = strongest.groupBy("stock_key").agg(
        fixed(clamp(dbl(F.sum(F.col("adjustment").cast("decimal(10,4)"))), -CAP, CAP), 4).alias("movement"))
    return (
        scores.join(total, "stock_key", "left")
        .withColumn("movement", F.coalesce("movement", F.lit(0.0)))
        .withColumn("adjusted", fixed(clamp(F.col("market_score") + F.col("movement"), 0, 20), 4))
    )
