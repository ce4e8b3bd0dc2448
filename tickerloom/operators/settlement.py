"""Returns of recommendations: horizons, states, reports and the penalties learnt from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, dbl, fixed
from ..functions.timekeys import local_day
from ..session import written
from . import asof
from .lookups import keywords_of
from .quantiles import exact_median
from .sessions import session_age, trailing_streak

HORIZONS = (1, 3, 5)
# States that block an exit.
RESTRICTED = ("LIMIT_UP", "LIMIT_DOWN", "SUSPEND", "HALT", "ST", "RESUMED_LIMIT_UP", "RESUMED_LIMIT_DOWN")
# Loss threshold, penalty factor and validity, lookbacks, half life, prior count, minimum weight.
LOSS, FACTOR, VALID_DAYS, LOOKBACK_DAYS, LOOKBACK_SESSIONS, HALF_LIFE, PRIOR, MIN_N = -0.03, 0.6, 7, 30, 60, 20, 20, 5


def exits(recs: DataFrame, bars: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Base price (last visible bar at as_of) and the n-th bars dated after as_of."""
    out = asof.base_and_following(recs, bars, F.col("as_of"), list(horizons), ["trading_day", "close", "trading_status"])
    return out.select(
        *recs.columns, F.col("base.trading_day").alias("base_day"), dbl("base.close").alias("p0"),
        *[F.col(f"next_{n}.trading_day").alias(f"day_{n}") for n in horizons],
        *[dbl(f"next_{n}.close").alias(f"close_{n}") for n in horizons],
        *[F.col(f"next_{n}.trading_status").alias(f"state_{n}") for n in horizons])


def horizon_status(p0: Column, day: Column, state: Column, reference: Column) -> Column:
    """immature without the bar, coverage_gap without base or state, pending while blocked or unseen, else mature."""
    seen = day.cast("timestamp") + F.expr("INTERVAL '7' HOUR")
    return (
        F.when(day.isNull(), "immature").when(p0.isNull() | (p0 <= 0) | state.isNull(), "coverage_gap")
        .when(state.isin(*RESTRICTED) | (seen > reference), "pending").otherwise("mature")
    )


def yield_records(recs: DataFrame, bars: DataFrame, reference: Column) -> DataFrame:
    """One row per recommendation and horizon."""
    wide = exits(recs, bars)
    rows = F.array(*[F.struct(
        F.lit(n).alias("horizon"), asof.returns(F.col("p0"), F.col(f"close_{n}")).alias("value"),
        horizon_status(F.col("p0"), F.col(f"day_{n}"), F.col(f"state_{n}"), reference).alias("status"),
        F.col(f"day_{n}").alias("planned_day")) for n in HORIZONS])
    out = wide.where("p0 > 0").select("run_id", "stock_key", F.explode(rows).alias("y")).select("run_id", "stock_key", "y.*")
    return out.withColumns({
        "actual_day": F.when(F.col("status").isin("mature") | (
            (F.col("status") == "pending") & (F.col("planned_day").cast("timestamp") + F.expr("INTERVAL '7' HOUR") > reference)),
            F.col("planned_day")),
        "maturity_at": F.col("planned_day").cast("timestamp") + F.expr("INTERVAL '7' HOUR")})


def yield_summary(recs: DataFrame, bars: DataFrame, reference: Column) -> DataFrame:
    """One row per tenant: recommendations scanned, those without a base price, and the return records by state."""
    base = exits(recs, bars).select("tenant", (F.coalesce(F.col("p0"), F.lit(0.0)) > 0).alias("based"), F.array(*[
        horizon_status(F.col("p0"), F.col(f"day_{n}"), F.col(f"state_{n}"), reference) for n in HORIZONS]).alias("states"))
    count = lambda s: F.sum(F.when(F.col("based"), F.size(F.filter("states", lambda x: x == s))).otherwise(0)).alias(s)
    out = base.groupBy("tenant").agg(F.count("*").alias("scanned"), F.count_if(~F.col("based")).alias("without_base"),
                                     *[count(s) for s in ("immature", "pending", "mature", "coverage_gap")])
    return out.withColumns({"coverage_gap": F.col("coverage_gap") + F.col("without_base"),
                            "records": (F.col("scanned") - F.col("without_base")) * len(HORIZONS)})


def settle(recs: DataFrame, bars: DataFrame, reference: Column) -> DataFrame:
    """Wide return columns, exit price of the longest horizon reached and the reconciled flag."""
    wide = exits(recs, bars).where("p0 > 0 and day_1 is not null")
    out = wide
    for n in HORIZONS:
        out = out.withColumn(f"yield_{n}", asof.returns(F.col("p0"), F.col(f"close_{n}"))).withColumn(
            f"visible_{n}", F.col(f"day_{n}").cast("timestamp") + F.expr("INTERVAL '7' HOUR"))
    done = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"yield_{n}").isNotNull() & (F.col(f"visible_{n}") <= reference), F.lit(False)) for n in HORIZONS])
    return out.withColumn("exit_price", F.coalesce("close_5", "close_3", "close_1")).withColumn("reconciled", done)


def daily_returns(settled: DataFrame, publishes: DataFrame, as_of: Column) -> DataFrame:
    """Mean matured five-day return and sample size per day of published recommendations."""
    ripe = settled.join(publishes.select("run_id"), "run_id", "left_semi").where(
        (F.col("visible_5") <= as_of) & F.col("yield_5").isNotNull())
    return ripe.groupBy(F.to_date("as_of").alias("day")).agg(F.avg("yield_5").alias("ret"), F.count("*").alias("samples"))


def strategy_profits(events: DataFrame, bars: DataFrame, latest: DataFrame) -> DataFrame:
    """Events with latest and T+1/3/5 prices, returns and states.

    ``latest`` is one quote per stock.
    """
    out = exits(events, bars).join(latest.select("stock_key", F.col("close").alias("close_live")), "stock_key", "left")

    def state(price: Column, missing: str, found: str) -> Column:
        return F.when(F.col("p0").isNull() | (F.col("p0") <= 0), "NO_BASE_PRICE").when(price.isNull(), missing).otherwise(found)

    out = out.withColumn("return_live", asof.returns(F.col("p0"), F.col("close_live"))).withColumn(
        "status_live", state(F.col("close_live"), "NO_CURRENT_PRICE", "LIVE"))
    for n in HORIZONS:
        out = out.withColumn(f"return_{n}", asof.returns(F.col("p0"), F.col(f"close_{n}"))).withColumn(
            f"status_{n}", state(F.col(f"close_{n}"), "PENDING", "FINAL"))
    return out


def profit_summary(rows: DataFrame, key: str = "tenant") -> DataFrame:
    """Per strategy: runs, recommendations, return statistics and counts per horizon.

    The profit rows are joined once; their few columns are written for the aggregates that read them.
    """
    rows = written(rows.select(key, "run_id", "return_live", *[f"{c}_{n}" for n in HORIZONS for c in ("status", "return")]), "profits")
    r = F.col("return_live")
    per_horizon = [a for n in HORIZONS for a in (
        F.count_if(F.col(f"status_{n}") == "PENDING").alias(f"pending_{n}"),
        F.count(f"return_{n}").alias(f"final_{n}"), F.avg(f"return_{n}").alias(f"avg_{n}"),
        (F.count_if(F.col(f"return_{n}") > 0) / F.count(f"return_{n}")).alias(f"win_rate_{n}"),
        F.min(f"return_{n}").alias(f"worst_{n}"))]
    runs = rows.select(key, "run_id").distinct().groupBy(key).agg(F.count("*").alias("runs"))
    summary = rows.groupBy(key).agg(
        F.count("*").alias("recs"), F.avg(r).alias("avg_return"), F.max(r).alias("best_return"), F.min(r).alias("worst_return"),
        (F.count_if(r > 0) / F.count(r)).alias("win_rate"), *per_horizon)
    return summary.join(runs, key).join(exact_median(rows, [key], "return_live", name="median_return"), key, "left")


def performance_report(recs: DataFrame, bars: DataFrame, key: str = "run_id") -> DataFrame:
    """Win rate, mean, profit ratio and worst drop of the five-day equal-weight path per strategy run."""
    wide = exits(recs, bars, (1, 2, 3, 4, 5)).where("p0 > 0 and close_1 is not null")
    y = asof.returns(F.col("p0"), F.coalesce("close_5", "close_3", "close_1"))
    sums = wide.withColumn("y", y).groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") > 0).alias("wins"), F.avg("y").alias("mean"),
        F.coalesce(F.avg(F.when(F.col("y") > 0, F.col("y"))), F.lit(0.0)).alias("gain"),
        F.coalesce(F.avg(F.when(F.col("y") < 0, F.col("y"))), F.lit(0.0)).alias("loss"),
        *[F.avg(F.col(f"close_{t}") / F.col("p0")).alias(f"v{t}") for t in range(1, 6)])
    path = F.array_compact(F.array(F.lit(1.0), *[F.col(f"v{t}") for t in range(1, 6)]))
    walk = F.aggregate(
        path, F.struct(F.lit(1.0).alias("peak"), F.lit(0.0).alias("worst")),
        lambda acc, x: F.struct(
            F.greatest(acc["peak"], x).alias("peak"),
            F.greatest(acc["worst"], (F.greatest(acc["peak"], x) - x) / F.greatest(acc["peak"], x)).alias("worst")))
    return sums.select(
        key, F.col("n").alias("recs"), fixed(F.col("wins") / F.col("n"), 4).alias("win_rate"), fixed("mean", 6).alias("mean_return"),
        F.when(F.col("loss") != 0, fixed(F.col("gain") / F.abs("loss"), 4)).alias("profit_ratio"),
        fixed(walk["worst"], 6).alias("max_drawdown"))


def recent_win_rate(settled: DataFrame, publishes: DataFrame, day: Column, n: int = 30) -> DataFrame:
    """Share of gains at T+1 and T+3 over each stock's last n published recommendations before a local day.

    Only returns that were visible before that day count.
    """
    told = settled.join(publishes.select("run_id"), "run_id", "left_semi").where(local_day("as_of") < day)
    order = Window.partitionBy("stock_key").orderBy(F.desc("as_of"), F.desc("run_id"))
    last = told.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    known = {h: F.when(local_day(f"visible_{h}") < day, F.col(f"yield_{h}")) for h in (1, 3)}
    return last.groupBy("stock_key").agg(*[
        a for h, value in known.items() for a in (
            F.count(value).alias(f"total_{h}"),
            (F.count_if(value > 0) / F.nullif(F.count(value), F.lit(0))).alias(f"win_rate_{h}"))])


def guard_triggers(daily: DataFrame, key: str, value: str, threshold: float, days_required: int) -> DataFrame:
    """Mean of daily values, trailing days below the threshold and whether the guard trips."""
    mean = daily.groupBy(key).agg(F.avg(value).alias("mean"), F.count("*").alias("days"))
    low = trailing_streak(daily, [key], "day", F.col(value) < threshold)
    return mean.join(low, key).withColumn("triggered", (F.col("mean") < threshold) & (F.col("streak") >= days_required))


def guard_reviews(outcomes: DataFrame, key: str, window_days: int, threshold: float, days_required: int, pooled: bool = False) -> DataFrame:
    """Weekly reviews (Mondays, 00:00) of daily outcomes inside the guard window: level, trailing low days, and whether the guard trips.

    ``outcomes`` has the key, as_of, ready_at and value. A review at instant R reads the outcomes told in [R - window_days, R] that were
    known by R, so an outcome is offered to at most window_days / 7 + 1 reviews and no review reads ahead. The level is the mean of
    the days' means, or with ``pooled`` the mean of all outcomes. Outcomes without a value count as reconciled, and in nothing else;
    a review with none but such has no level and does not trip. Rows without key, as_of or ready_at take no part. A day is low when its
    mean is below the threshold; the streak counts the latest days of the window up to the last one that isn't.
    """
    week = F.expr("INTERVAL '7' DAY")
    last = F.date_trunc("week", F.col("as_of") + F.expr(f"INTERVAL '{window_days}' DAY"))
    known = F.greatest("as_of", "ready_at")
    first = F.date_trunc("week", known)
    asked = outcomes.where(F.col(key).isNotNull() & F.col("as_of").isNotNull() & F.col("ready_at").isNotNull()).select(
        key, F.to_date("as_of").alias("day"), "value", F.when(first < known, first + week).otherwise(first).alias("first"), last.alias("last"))
    # Few (day, first, last) triples per key: sums meet the calendar, not outcomes.
    sums = asked.where("first <= last").groupBy(key, "day", "first", "last").agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.count("*").alias("reconciled"))
    daily = sums.withColumn("review", F.explode(F.sequence("first", "last", week))).groupBy(key, "review", "day").agg(
        *[F.sum(c).alias(c) for c in ("total", "n", "reconciled")])
    mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
    level = F.try_divide(F.sum("total"), F.sum("n")) if pooled else F.avg(mean)
    told = F.collect_list(F.when(mean.isNotNull(), F.struct("day", (mean < threshold).alias("low"))))  # at most window_days + 1 days
    out = daily.groupBy(key, "review").agg(level.alias("level"), F.sum("reconciled").alias("reconciled"), told.alias("told"))
    sound = F.array_max(F.transform(F.filter("told", lambda d: ~d["low"]), lambda d: d["day"]))
    streak = F.size(F.filter("told", lambda d: sound.isNull() | (d["day"] > sound)))
    trips = F.coalesce(F.col("level") < threshold, F.lit(False)) & (streak >= days_required)
    return out.select(key, "review", "level", "reconciled", F.size("told").alias("days"), streak.alias("streak"), trips.alias("triggered"))


def worst_visible(as_of: Column) -> Column:
    """Lowest return already visible."""
    values = F.array(*[F.when(F.col(f"visible_{n}") <= as_of, F.col(f"yield_{n}")) for n in HORIZONS])
    return F.array_min(F.array_compact(values))


def threshold_penalties(settled: DataFrame, publishes: DataFrame, evidence: DataFrame, as_of: Column) -> DataFrame:
    """A fixed factor for every evidence keyword of recently published losers."""
    losers = (
        settled.join(publishes.select("run_id"), "run_id", "left_semi")
        .where((F.col("as_of") >= as_of - F.expr(f"INTERVAL '{LOOKBACK_DAYS}' DAY")) & (F.col("as_of") < as_of) & F.col("reconciled"))
        .withColumn("loss", worst_visible(as_of)).where(F.col("loss") <= LOSS).select("run_id", "stock_key", "loss")
    )
    return losers.join(keywords_of(evidence, ["run_id", "stock_key"]), ["run_id", "stock_key"]).select(
        "run_id", "stock_key", "word", F.lit(FACTOR).alias("factor"), "loss", as_of.alias("valid_from"),
        (as_of + F.expr(f"INTERVAL '{VALID_DAYS}' DAY")).alias("valid_to"))


def smooth_penalties(settled: DataFrame, publishes: DataFrame, evidence: DataFrame, calendar: DataFrame, as_of: Column) -> DataFrame:
    """Factor per keyword from time- and responsibility-weighted loss rates, shrunk to the global rate."""
    ripe = settled.join(publishes.select("run_id"), "run_id", "left_semi").where(
        (F.col("as_of") < as_of) & (F.col("visible_5") <= as_of) & F.col("reconciled")).select(
        "run_id", "stock_key", "yield_5", F.to_date("as_of").alias("day"))
    aged = session_age(ripe, calendar, "day", F.to_date(as_of)).where(F.col("age_sessions") <= LOOKBACK_SESSIONS)
    words = F.array_distinct(F.array_compact(F.array("keyword", "matched_keyword")))
    mass = evidence.where("contribution > 0").select("run_id", "stock_key", F.explode(words).alias("word"), "contribution") \
        .groupBy("run_id", "stock_key", "word").agg(F.max("contribution").alias("mass"))
    total = mass.groupBy("run_id", "stock_key").agg(F.sum("mass").alias("total"))
    seen = aged.join(mass, ["run_id", "stock_key"]).join(total, ["run_id", "stock_key"])
    weight = F.pow(F.lit(0.5), F.col("age_sessions") / F.lit(float(HALF_LIFE))) * (F.col("mass") / F.col("total"))
    rated = seen.withColumn("w", weight).groupBy("word").agg(
        F.sum("w").alias("n"), F.coalesce(F.sum(F.when(F.col("yield_5") <= LOSS, F.col("w"))), F.lit(0.0)).alias("lost"))
    overall = rated.agg((F.sum("lost") / F.sum("n")).alias("p0")).scalar()
    out = rated.withColumn("p0", overall)
    p = (F.col("lost") + F.col("p0") * PRIOR) / (F.col("n") + PRIOR)
    return out.withColumn("p", p).withColumn(
        "factor", F.when(F.col("n") < MIN_N, 1.0).otherwise(clamp(F.lit(1.0) - F.lit(FACTOR) * F.greatest(F.lit(0.0), F.col("p") - F.col("p0")), 0, 1)))
