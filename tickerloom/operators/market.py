"""Market-wide and thematic aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, dbl, fixed
from ..session import broadcast_if_small, written
from . import asof
from .bar_features import change_over
from .graph import GENERIC_WORDS
from .latest import topn
from .lookups import market_day_pairs, theme_members
from .temporal import bars_as_of

# Weak-signal bounds, strength divisor, direction shares, blend, flat band, breadth and industry bounds.
GAP_MIN, FLAT_PRICE, SIGNAL_SCALE, BULL_SHARE, BEAR_SHARE = 0.40, 0.03, 25.0, 0.60, 0.40
STRENGTH_WEIGHT, GAP_WEIGHT, FLAT_MOVE = 0.6, 0.4, 0.01
BEAR_BREADTH, BULL_BREADTH, MIN_STOCKS, MIN_CANDIDATES = 0.25, 0.40, 100, 10
INDUSTRY_BOUND, INDUSTRY_FLOOR = -0.05, 0.3


def momentum_as_of(bars: DataFrame, as_of: Column, lookback_days: int, n: int = 5) -> DataFrame:
    """Latest n-bar momentum of each stock over its visible bars inside the lookback."""
    seen = bars_as_of(bars, as_of, F.date_sub(F.to_date(as_of), lookback_days))
    newest = Window.partitionBy("stock_key").orderBy(F.desc("trading_day"))
    return seen.select("stock_key", change_over(n).alias("momentum"), F.row_number().over(newest).alias("_rn")).where(
        "_rn = 1 and momentum is not null").select("stock_key", "momentum")


def expectation_gap(strength: DataFrame, facts: DataFrame, bars: DataFrame, as_of: Column, lookback_days: int = 20) -> DataFrame:
    """Graph strength less mean member momentum; keywords without price data get 0 and sort last."""
    members = theme_members(strength, facts, as_of)
    reaction = members.join(momentum_as_of(bars, as_of, lookback_days), "stock_key").groupBy("keyword").agg(
        F.avg("momentum").alias("reaction"))
    out = strength.join(reaction, "keyword", "left").withColumn("has_price", F.col("reaction").isNotNull())
    gap = F.when(F.col("has_price"), fixed(F.col("strength") - F.col("reaction"), 4)).otherwise(0.0)
    return out.withColumn("gap", gap).withColumn(
        "weak_signal", F.col("has_price") & (F.col("gap") > GAP_MIN) & (F.abs(F.coalesce("reaction", F.lit(0.0))) < FLAT_PRICE)
    ).select("keyword", fixed("strength", 4).alias("strength"), fixed(F.coalesce("reaction", F.lit(0.0)), 4).alias("reaction"),
             "gap", "has_price", "weak_signal")


def theme_forecast(signals: DataFrame, gaps: DataFrame, members: DataFrame | None = None, most: int = 10) -> DataFrame:
    """Direction, strength and probability per keyword with its five commonest variables.

    With ``members`` (keyword, stock_key) the first ``most`` member stocks of each keyword are listed too.
    """
    usable = signals.where((F.trim("keyword") != "") & ~F.col("keyword").isin(*GENERIC_WORDS))
    sums = usable.groupBy("keyword").agg(
        F.count_if(F.col("direction") == "positive").alias("positive"), F.count_if(F.col("direction") == "negative").alias("negative"),
        F.count("*").alias("total"), dbl(F.sum(F.col("confidence").cast("decimal(10,4)"))).alias("conf"),
        F.countDistinct("news_id").alias("news"))
    counts = usable.groupBy("keyword", "business_variable").agg(F.count("*").alias("c"))
    top = topn(counts, ["keyword"], [F.desc("c"), F.asc("business_variable")], 5).groupBy("keyword").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "business_variable"))), lambda x: x["business_variable"]), ",").alias("variables"))
    share = F.col("positive") / F.col("total")
    out = sums.join(top, "keyword").join(gaps.select("keyword", "gap", "weak_signal"), "keyword", "left")
    gap = F.coalesce("gap", F.lit(0.0))
    told = (
        out.withColumn("direction", F.when(share >= BULL_SHARE, "bullish").when(share < BEAR_SHARE, "bearish").otherwise("neutral"))
        .withColumn("strength", fixed(clamp(F.col("total") * (F.col("conf") / F.col("total")) / SIGNAL_SCALE, 0, 1), 4))
        .withColumn("probability", fixed(clamp(
            F.col("strength") * STRENGTH_WEIGHT
            + F.when(F.col("direction") == "bearish", F.greatest(F.lit(0.0), -gap)).otherwise(F.greatest(F.lit(0.0), gap)) * GAP_WEIGHT, 0, 1), 4))
        .select("keyword", "positive", "negative", "total", "news", "direction", "strength", "probability", "variables")
    )
    if members is None:
        return told
    first = topn(members.select("keyword", "stock_key").distinct(), ["keyword"], [F.asc("stock_key")], most).groupBy("keyword").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("stock_key")), lambda x: x.cast("string")), ",").alias("members"))
    return told.join(first, "keyword", "left").withColumn("members", F.coalesce("members", F.lit("")))


def settle_forecasts(forecasts: DataFrame, members: DataFrame, bars: DataFrame) -> DataFrame:
    """Realised move of each forecast: mean return of its members from the bar visible then to the fifth (or last) one after.

    ``forecasts`` has keyword, direction and as_of; ``members`` keyword and stock_key. ``ready_at`` is when the last bar behind
    the move could be read; null without a move.
    """
    instants = written(forecasts.select("keyword", "as_of").join(members, "keyword").select("stock_key", "as_of").distinct(), "instants")
    theirs = bars.join(broadcast_if_small(instants.select("stock_key").distinct()), "stock_key", "left_semi")  # members are few among the stocks
    ahead = asof.nth_after(instants, theirs, F.col("as_of"), [1, 2, 3, 4, 5])
    last = F.coalesce(*[F.col(f"base.close_{n}") for n in (5, 4, 3, 2, 1)])
    until = F.coalesce(*[F.when(F.col(f"base.close_{n}").isNotNull(), F.col(f"base.trading_day_{n}")) for n in (5, 4, 3, 2, 1)])
    moves = ahead.select("stock_key", "as_of", asof.returns(F.col("base.close"), last).alias("move"), until.alias("until")).where("move is not null")
    mean = forecasts.join(members, "keyword").join(moves, ["stock_key", "as_of"]).groupBy("keyword", "as_of").agg(
        F.avg("move").alias("move"), (F.max("until").cast("timestamp") + F.expr("INTERVAL '7' HOUR")).alias("ready_at"))
    out = forecasts.join(mean, ["keyword", "as_of"], "left")
    realised = F.when(F.col("move") > FLAT_MOVE, "up").when(F.col("move") < -FLAT_MOVE, "down").when(F.col("move").isNotNull(), "flat")
    expected = F.when(F.col("direction") == "bullish", "up").when(F.col("direction") == "bearish", "down").otherwise("flat")
    return out.withColumn("realised", F.coalesce(realised, F.lit("no_data"))).withColumn("hit", F.col("realised") == expected)


def hit_rate(settled: DataFrame, keys: list[str]) -> DataFrame:
    known = settled.where("realised <> 'no_data'")
    return known.groupBy(*keys).agg(F.count("*").alias("evaluated"), fixed(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"))


def industry_penalty(candidates: DataFrame, keys: list[str], momentum: str, score: str) -> DataFrame:
    """Scale scores of industries whose mean momentum is poor."""
    mean = candidates.groupBy(*keys).agg(F.avg(momentum).alias("mean_momentum"))
    factor = F.when(F.col("mean_momentum") < INDUSTRY_BOUND, fixed(F.greatest(F.lit(INDUSTRY_FLOOR), F.lit(1.0) + F.col("mean_momentum")), 4)).otherwise(1.0)
    return candidates.join(mean.select(*keys, factor.alias("factor")), keys).withColumn("adjusted", fixed(F.col(score) * F.col("factor"), 4))


def market_breadth(bars: DataFrame, momentum20: DataFrame, hour: int, min_stocks: int = MIN_STOCKS, min_candidates: int = MIN_CANDIDATES) -> DataFrame:
    """Share of rising stocks per market day with its regime; thin days fall back to 20-bar momentum.

    A day is judged at the given hour, from the bars visible by then.
    """
    pairs = market_day_pairs(bars, hour).groupBy(F.col("latest_day").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(F.col("close") > F.col("previous_close")).alias("up"))
    backup = momentum20.where("momentum20 is not null").groupBy(F.col("trading_day").alias("day")).agg(
        F.count("*").alias("m"), F.count_if(F.col("momentum20") > 0).alias("m_up"))
    out = bars.select(F.col("trading_day").alias("day")).distinct().join(pairs, "day", "left").join(backup, "day", "left")
    breadth = F.when(F.col("n") >= min_stocks, F.col("up") / F.col("n")).when(F.col("m") >= min_candidates, F.col("m_up") / F.col("m"))
    source = F.when(F.col("n") >= min_stocks, "bars").when(F.col("m") >= min_candidates, "momentum")
    return out.select("day", source.alias("source"), breadth.alias("breadth")).withColumn(
        "regime", F.when(F.col("breadth") < BEAR_BREADTH, "bear").when(F.col("breadth") < BULL_BREADTH, "neutral")
        .when(F.col("breadth").isNotNull(), "bull").otherwise("neutral"))
