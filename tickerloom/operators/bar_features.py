"""Window features over daily bars.

Every feature uses one window: bars of a stock ordered by day. A stock has at
most one bar per day, so a partition is bounded by the length of history and
all features share a single shuffle and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import clamp, col, dbl, fixed

def by_day():
    return Window.partitionBy("stock_key").orderBy("trading_day")


def previous20():
    return by_day().rowsBetween(-20, -1)


def last(n: int):
    return by_day().rowsBetween(-(n - 1), 0)


def change_over(n: int) -> Column:
    """Return over n bars; null without enough bars or with a non-positive base."""
    base = F.lag(dbl("close"), n).over(by_day())
    return F.when(base > 0, (dbl("close") - base) / base)


def momentum(bars: DataFrame, n: int, name: str = "momentum") -> DataFrame:
    return bars.withColumn(name, change_over(n))


def _mean_previous_volume() -> Column:
    volume = F.when(F.col("volume") > 0, F.col("volume"))
    return F.sum(volume).over(previous20()) / F.count(volume).over(previous20())


def volume_ratio(bars: DataFrame) -> DataFrame:
    return bars.withColumn("volume_ratio", dbl("volume") / _mean_previous_volume())


def breakout(bars: DataFrame) -> DataFrame:
    """1 at or above the previous 20-bar high, 0.5 within 3% below it."""
    high = dbl(F.max("high").over(previous20()))
    return bars.withColumn("previous_high", high).withColumn("breakout", _breakout_share())


def _breakout_share() -> Column:
    return F.when(F.col("previous_high") > 0, F.when(dbl("close") >= F.col("previous_high"), 1.0)
                  .when(dbl("close") >= F.col("previous_high") * 0.97, 0.5).otherwise(0.0)).otherwise(0.0)


def _range_share() -> Column:
    share = F.when(F.col("close") > 0, (dbl("high") - dbl("low")) / dbl("close"))
    return F.when(share > 0, share)


def _mean_previous_close() -> Column:
    close = F.when(F.col("close") > 0, F.col("close"))
    return dbl(F.sum(close).over(previous20())) / F.count(close).over(previous20())


def compression(bars: DataFrame) -> DataFrame:
    """Narrowing range (six bars against the twenty before) while at or above the mean close."""
    return (
        bars.withColumn("_share", _range_share())
        .withColumn("recent_range", F.avg("_share").over(last(6)))
        .withColumn("previous_range", F.avg("_share").over(previous20()))
        .withColumn("mean_close", _mean_previous_close())
        .withColumn("compressed", _compressed())
        .drop("_share")
    )


def _compressed() -> Column:
    return F.coalesce((F.col("previous_range") > 0) & (F.col("recent_range") / F.col("previous_range") <= 0.75)
                      & (dbl("close") >= F.col("mean_close")), F.lit(False))


def zone_flags(bars: DataFrame) -> DataFrame:
    """Below 95% of the mean close; with high volume, or with low volume."""
    return volume_ratio(bars).withColumn("mean_close", _mean_previous_close()).withColumns(_zones())


def _zones() -> dict[str, Column]:
    low = F.coalesce(dbl("close") < F.col("mean_close") * 0.95, F.lit(False))
    return {"low_zone": low, "accumulation": F.coalesce(low & (F.col("volume_ratio") > 1.2), F.lit(False)),
            "weak_rebound": low & (F.coalesce(F.col("volume_ratio"), F.lit(0.0)) < 0.8)}


def fib_hit(bars: DataFrame, n: int = 60, tol: float = 0.015) -> DataFrame:
    """First retracement level of the last n bars lying within tol of the close."""
    return _fib(_with_range(bars, n), tol).drop("_high", "_low", "_seen")


def _with_range(bars: DataFrame, n: int) -> DataFrame:
    frame = last(n)
    return bars.select("*", dbl(F.max("high").over(frame)).alias("_high"), dbl(F.min("low").over(frame)).alias("_low"),
                       F.count("*").over(frame).alias("_seen"))


def _fib(ranged: DataFrame, tol: float) -> DataFrame:
    high, low, close = F.col("_high"), F.col("_low"), dbl("close")
    enough = (F.col("_seen") >= 10) & (high > low)
    level = F
    for share in K.FIB_LEVELS:
        level = level.when(enough & (F.abs(close - (high - F.lit(share) * (high - low))) / close <= tol), F.lit(share))
    return ranged.withColumn("fib_level", level)


def sr_touch(bars: DataFrame, n: int = 60, tol: float = 0.015) -> DataFrame:
    """Close within tol of the n-bar low (support) or high (resistance)."""
    return _touch(_with_range(bars, n), tol).drop("_high", "_low", "_seen")


def _touch(ranged: DataFrame, tol: float) -> DataFrame:
    close, enough = dbl("close"), F.col("_seen") >= 10
    return ranged.withColumn(
        "touch", F.when(enough & (F.abs(close - F.col("_low")) / close <= tol), "support")
        .when(enough & (F.abs(close - F.col("_high")) / close <= tol), "resistance"))


def _frames(bars: DataFrame, n: int) -> DataFrame:
    """All window values of the market features in one select, hence one window operator."""
    volume, close = F.when(F.col("volume") > 0, F.col("volume")), F.when(F.col("close") > 0, F.col("close"))
    shared = bars.withColumn("_share", _range_share())
    frame = last(n)
    return shared.select(
        "*", F.row_number().over(by_day()).alias("bars_seen"),
        *[F.lag(dbl("close"), k).over(by_day()).alias(f"_c{k}") for k in (1, 5, 20, 120)],
        dbl(F.max("high").over(previous20())).alias("previous_high"),
        F.sum(volume).over(previous20()).alias("_vs"), F.count(volume).over(previous20()).alias("_vn"),
        F.sum(close).over(previous20()).alias("_cs"), F.count(close).over(previous20()).alias("_cn"),
        F.avg("_share").over(previous20()).alias("previous_range"), F.avg("_share").over(last(6)).alias("recent_range"),
        dbl(F.max("high").over(frame)).alias("_high"), dbl(F.min("low").over(frame)).alias("_low"),
        F.count("*").over(frame).alias("_seen"))


def market_features(bars: DataFrame, n: int = 60, tol: float = 0.015) -> DataFrame:
    """Every market feature of every bar."""
    f = _frames(bars, n)
    close = dbl("close")
    changes = {name: F.when(F.col(f"_c{k}") > 0, (close - F.col(f"_c{k}")) / F.col(f"_c{k}"))
               for name, k in (("day_change", 1), ("momentum5", 5), ("momentum20", 20), ("momentum120", 120))}
    f = f.withColumns({
        **changes,
        "volume_ratio": dbl("volume") / (F.col("_vs") / F.col("_vn")),
        "mean_close": dbl("_cs") / F.col("_cn"),
        "breakout": _breakout_share(),
    })
    f = f.withColumns({"compressed": _compressed(), **_zones()})
    return _touch(_fib(f, tol), tol).drop("_share", "_c1", "_c5", "_c20", "_c120", "_vs", "_vn", "_cs", "_cn", "_high", "_low", "_seen")


def market_score(bars: DataFrame, weights: dict[str, float] = K.MARKET_WEIGHTS) -> DataFrame:
    """0-20 confirmation score of every bar; fewer than six bars score 0."""
    f = market_features(bars)
    m5, m20, ratio = F.col("momentum5"), F.col("momentum20"), F.col("volume_ratio")
    parts = {
        "momentum5": F.when(m5.isNull(), 0.0).when(m5 > 0.1, 0.2).when(F.col("accumulation"), 1.0)
        .when(F.col("weak_rebound"), 0.1).when(F.col("low_zone"), 0.6)
        .otherwise(clamp((F.lit(0.05) - F.abs(m5)) / 0.05, 0, 0.5)),
        "momentum20": F.when(m20.isNull(), 0.0).when(m20 > 0.15, 0.3)
        .when((m20 < -0.05) & F.col("low_zone"), F.when(F.col("weak_rebound"), 0.2).otherwise(0.9))
        .otherwise(clamp((F.lit(0.1) - F.abs(m20)) / 0.1, 0, 0.6)),
        "volume": F.coalesce(clamp((ratio - 1) / 1.5, 0, 1), F.lit(0.0)),
        "breakout": F.col("breakout"),
        "compression": F.col("compressed").cast("double"),
        "fibonacci": F.col("fib_level").isNotNull().cast("double"),
        "support": F.col("touch").isNotNull().cast("double"),
    }
    total = sum(weights.values())
    weighted = None
    for name, value in parts.items():
        term = F.lit(weights[name]) * value
        weighted = term if weighted is None else weighted + term
    score = F.when(F.col("bars_seen") >= 6, fixed(clamp(weighted / total * 20, 0, 20), 4)).otherwise(0.0) \
        if total > 0 else F.lit(0.0)
    return f.withColumn("market_score", score)


def latest_quote(bars: DataFrame) -> DataFrame:
    """Newest bar per stock with previous close and change."""
    newest = Window.partitionBy("stock_key").orderBy(F.desc("trading_day"))
    previous = F.lead(dbl("close")).over(newest)
    return (
        bars.select("stock_key", "trading_day", dbl("close").alias("close"), previous.alias("previous_close"),
                    F.row_number().over(newest).alias("_rn"))
        .where("_rn = 1").drop("_rn")
        .withColumn("change", F.when(F.col("previous_close") > 0,
                                     (F.col("close") - F.col("previous_close")) / F.col("previous_close")))
    )


def limit_rule(symbol: Column | str, name: Column | str) -> Column:
    """Struct of board and daily price limit."""
    symbol, upper = col(symbol), F.upper(col(name))

    def rule(board: str, pct: float) -> Column:
        return F.struct(F.lit(board).alias("board"), F.lit(pct).alias("limit_pct"))

    # Boards and limits.
    return (
        F.when(upper.startswith("*ST") | upper.startswith("ST"), rule("ST", 0.05))
        .when(symbol.startswith("300") | symbol.startswith("301"), rule("CHINEXT", 0.20))
        .when(symbol.startswith("68"), rule("STAR", 0.20))
        .when(symbol.startswith("8") | symbol.startswith("4") | symbol.startswith("9"), rule("BEIJING", 0.30))
        .otherwise(rule("MAIN", 0.10))
    )


def limit_up_cases(bars: DataFrame, stocks: DataFrame, days: int = 120, sealed_only: bool = False) -> DataFrame:
    """Bars of the last N market days that touched (or closed at) the daily limit."""
    market_days = bars.select("trading_day").distinct().orderBy(F.desc("trading_day")).limit(days)
    first_day = market_days.agg(F.min("trading_day")).scalar()
    rule = limit_rule("symbol", "name")
    cases = (
        bars.withColumn("previous_close", F.lag(dbl("close")).over(by_day()))
        .where((F.col("trading_day") >= first_day) & (F.col("previous_close") > 0))
        .join(stocks.select("stock_key", "symbol", "name"), "stock_key")
        .withColumn("board", rule["board"])
        .withColumn("limit_price", fixed(F.col("previous_close") * (F.lit(1.0) + rule["limit_pct"]), 2))
        .withColumn("touched", dbl("high") >= F.col("limit_price") - 0.0001)
        .withColumn("sealed", dbl("close") >= F.col("limit_price") - 0.0001)
    )
    return cases.where("sealed" if sealed_only else "touched or sealed")
