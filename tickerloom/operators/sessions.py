"""Trading calendar, session ordinals, walk-forward windows and path statistics.

Windows without a partition key run here only over distinct days, whose number
is bounded by the length of history, never over facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl, fixed


def derive_calendar(bars: DataFrame) -> DataFrame:
    """Every date in the covered range; open iff any stock traded."""
    open_days = bars.select(F.col("trading_day").alias("day")).distinct()
    span = open_days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dates = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    return dates.join(open_days.withColumn("is_open", F.lit(True)), "day", "left").select(
        "day", F.coalesce("is_open", F.lit(False)).alias("is_open"))


def session_table(calendar: DataFrame) -> DataFrame:
    """Calendar days with their neighbouring sessions and running session ordinal."""
    by_day = Window.orderBy("day")
    opened = F.when(F.col("is_open"), F.col("day"))
    return calendar.select(
        "day", "is_open",
        F.sum(F.col("is_open").cast("int")).over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("ordinal"),
        F.max(opened).over(by_day.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_session"),
        F.min(opened).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("next_session"),
    )


def next_session(df: DataFrame, calendar: DataFrame, day: str, direction: str = "forward") -> DataFrame:
    """Next (or previous) open day of each row; null outside the covered years."""
    column = "next_session" if direction == "forward" else "previous_session"
    table = session_table(calendar).select(F.col("day").alias("_d"), F.col(column).alias("session"))
    return df.join(table, F.col(day) == F.col("_d"), "left").drop("_d")


def session_age(df: DataFrame, calendar: DataFrame, day: str, as_of_day: Column) -> DataFrame:
    """Sessions strictly after the row's day up to the reference day; weekdays where the calendar has none."""
    table = session_table(calendar)
    upto = table.where(F.col("day") <= as_of_day).agg(F.max("ordinal")).scalar()
    own = table.select(F.col("day").alias("_d"), "ordinal")
    weekdays = F.size(F.filter(
        F.sequence(F.date_add(F.col(day), 1), as_of_day), lambda d: F.weekday(d) < 5))
    fallback = F.when(F.col(day) < as_of_day, weekdays).otherwise(0)
    return (
        df.join(own, F.col(day) == F.col("_d"), "left").drop("_d")
        .withColumn("age_sessions", F.when(F.col("ordinal").isNotNull(), F.greatest(upto - F.col("ordinal"), F.lit(0))).otherwise(fallback).cast("bigint"))
        .drop("ordinal")
    )


def walk_forward(days: DataFrame, train: int = 120, validation: int = 20, test: int = 20, gap: int = 5) -> DataFrame:
    """(window, role, day) rows of every full train/validation/test window, stepping by the test length."""
    numbered = days.select("day").distinct().withColumn("n", F.row_number().over(Window.orderBy("day")) - 1)
    total = numbered.agg(F.count("*")).scalar()
    span = train + validation + test + 2 * gap
    starts = F.sequence(F.lit(0), F.floor((F.col("total") - span) / F.lit(test)).cast("int"))
    roles = F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(a).alias("offset"), F.lit(n).alias("length"))
        for r, a, n in (("train", 0, train), ("validation", train + gap, validation),
                        ("test", train + gap + validation + gap, test))])
    one = numbered.where("n = 0").withColumn("total", total).where(F.col("total") >= span)
    windows = (
        one.select(F.explode(starts).alias("window"), F.lit(roles).alias("roles"))
        .select("window", F.explode("roles").alias("r"))
        .select("window", "r.role", (F.col("window") * test + F.col("r.offset")).alias("first"), "r.length")
        .select("window", "role", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)).alias("n"))
    )
    return windows.join(numbered, "n").select("window", "role", "day")


def trailing_streak(df: DataFrame, keys: list[str], order: str, predicate: Column) -> DataFrame:
    """Most recent consecutive rows satisfying the predicate, per key."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    broken = F.sum(F.when(predicate, 0).otherwise(1)).over(newest)
    return df.select(*keys, broken.alias("_b")).groupBy(*keys).agg(F.count_if(F.col("_b") == 0).alias("streak"))


def equity_path(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    """Compounded value, running peak (at least 1) and drawdown along an ordered return series."""
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("equity", F.product(F.lit(1.0) + dbl(ret)).over(frame))
        .withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(frame)))
        .withColumn("drawdown", F.col("equity") / F.col("peak") - 1)
    )


def max_drawdown(df: DataFrame, keys: list[str], order: str, ret: str) -> DataFrame:
    return equity_path(df, keys, order, ret).groupBy(*keys).agg(
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"))


def net_return(gross: Column, bps_per_side: float = 10.0) -> Column:
    """Return after paying both sides."""
    return gross - F.lit(bps_per_side * 2 / 10000)


def stage(position: Column, total: Column) -> Column:
    """A for the first 30%, B up to 70%, else C; position counts from 1."""
    first = F.greatest(F.lit(1), F.ceil(total * F.lit(0.3)))
    second = F.greatest(first + 1, F.ceil(total * F.lit(0.7)))
    return F.when(position <= first, "A").when(position <= second, "B").otherwise("C")


def grade(df: DataFrame, run: str, position: str, n: int) -> DataFrame:
    """S is the leading 30% of stage A among the first n of each run."""
    whole = Window.partitionBy(run)
    out = df.withColumn("stage", stage(F.col(position), F.count("*").over(whole))).where(F.col(position) <= n)
    top = F.greatest(F.lit(1), F.ceil(F.count_if(F.col("stage") == "A").over(whole) * F.lit(0.3)))
    return out.withColumn("grade", F.when((F.col("stage") == "A") & (F.col(position) <= top), "S")
                          .otherwise(F.col("stage")))


def trade_plan(rows: DataFrame) -> DataFrame:
    """Buy, stop and target prices from close, five-bar momentum, breakout and stage.

    Fixed values: the price multiples.
    """
    close = dbl("close")
    hot = F.coalesce(F.col("momentum5") >= 0.12, F.lit(False))
    broke = F.col("breakout") == 1.0
    return rows.where(close > 0).withColumns({
        "price": fixed(close, 2),
        "buy_low": fixed(close * F.when(hot, 0.94).otherwise(0.97), 2),
        "buy_high": fixed(close * F.when(hot, 0.985).otherwise(1.01), 2),
        "stop_loss": fixed(close * F.when(F.col("stage") == "A", 0.91).otherwise(0.9), 2),
        "target_low": fixed(close * F.when(broke, 1.08).otherwise(1.06), 2),
        "target_high": fixed(close * F.when(broke, 1.16).otherwise(1.12), 2),
    })
