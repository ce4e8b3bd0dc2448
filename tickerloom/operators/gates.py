"""Ordered selection gates; one pass labels each candidate with the first gate it fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

GATES = ("stock", "gain", "loss", "price", "day_drop", "quality")

# Quality gate.
LONG_DOWNTREND, OVERHEAT_5D, OVERHEAT_20D, WEAK_20D, WEAK_RATIO = -0.30, 0.15, 0.25, -0.12, 0.8


def quality_ok() -> Column:
    """Fresh, not in a long downtrend, not carried by graph alone, specific enough, neither overheated nor drained."""
    ratio = F.coalesce("volume_ratio", F.lit(0.0))
    confirmed = (ratio >= 1) & (F.col("breakout") == 1.0)
    evidence, graph = F.coalesce("evidence_score", F.lit(0.0)), F.coalesce("graph_score", F.lit(0.0))
    exposure, market = F.coalesce("exposure_score", F.lit(0.0)), F.coalesce("market_score", F.lit(0.0))
    hot = (F.coalesce("momentum5", F.lit(0.0)) >= OVERHEAT_5D) | (F.coalesce("momentum20", F.lit(0.0)) >= OVERHEAT_20D)
    bad = (
        (F.coalesce("stale_days", F.lit(0)) > 0)
        | F.coalesce(F.col("momentum120") <= LONG_DOWNTREND, F.lit(False))
        | ((evidence < 10) & (graph >= 12))
        | ((exposure < 4) & ~((evidence >= 18) & (market >= 8)))
        | (hot & ~confirmed)
        | F.coalesce((F.col("momentum20") <= WEAK_20D) & (ratio < WEAK_RATIO), F.lit(False))
    )
    return ~bad


def apply_gates(candidates: DataFrame) -> DataFrame:
    """Add ``failed_gate`` (null when all pass); surge rows skip the gain, loss and quality gates."""
    surge = F.coalesce(F.col("channel") == "surge", F.lit(False))

    def fails(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    name = F.upper(F.trim("name"))
    checks = {
        "stock": F.col("symbol").startswith("688") | name.contains("ST") | name.contains("ＳＴ"),
        "gain": ~surge & fails(F.col("momentum5") > K.MAX_GAIN_5D),
        "loss": ~surge & (fails(F.col("momentum5") < K.MAX_LOSS_5D) | fails(F.col("momentum20") < K.MAX_LOSS_20D)),
        "price": fails(F.col("close") > K.MAX_PRICE),
        "day_drop": fails(F.col("day_change") < K.MAX_DAY_DROP),
        "quality": ~surge & ~quality_ok(),
    }
    failed = None
    for gate in GATES:
        failed = F.when(checks[gate], gate) if failed is None else failed.when(checks[gate], gate)
    return candidates.withColumn("failed_gate", failed)
