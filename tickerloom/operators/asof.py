"""As-of joins without a window over the left side.

The right side (bars, status rows) is bounded per key, the left side is not.
Right rows are packed into one array per key and calendar block together with
the best row carried in from earlier blocks; the left side then needs only an
equi-join on (key, block), which AQE can split when a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..functions.timekeys import visible_at


def asof_join(left: DataFrame, right: DataFrame, key: str, t: Column, order: str, payload: list[str],
              usable_from: Column, into: str, block: str = "month") -> DataFrame:
    """Attach to each left row the right row with the greatest ``order`` among those usable at ``t``.

    ``into`` becomes a struct column of ``order`` and ``payload``; it is null where nothing was usable.
    """
    item = F.struct(F.col(order), *[F.col(p) for p in payload if p != order])
    packed = (
        right.select(F.col(key), usable_from.alias("_from"), item.alias("_row"))
        .groupBy(F.col(key), F.date_trunc(block, "_from").alias("_block"))
        .agg(F.collect_list(F.struct("_from", "_row")).alias("_items"), F.max("_row").alias("_best"))
    )
    rows = left.withColumn("_t", t.cast("timestamp")).withColumn("_block", F.date_trunc(block, "_t"))
    asked = rows.select(key, "_block").distinct()
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        asked.join(packed, [key, "_block"], "full")
        .withColumn("_carry", F.max("_best").over(before))
        .select(key, "_block", "_items", "_carry")
    )
    inside = F.array_max(F.transform(F.filter("_items", lambda x: x["_from"] <= F.col("_t")), lambda x: x["_row"]))
    return (
        rows.join(blocks, [key, "_block"], "left")
        .withColumn(into, F.greatest(F.coalesce(inside, F.col("_carry")), F.coalesce(F.col("_carry"), inside)))
        .drop("_t", "_block", "_items", "_carry")
    )


def bar_usable_from() -> Column:
    """A bar counts from the later of its day and its visible instant."""
    return F.greatest(F.col("trading_day").cast("timestamp"), visible_at("trading_day", "visible_at"))


def latest_bar(left: DataFrame, bars: DataFrame, t: Column, payload: list[str], into: str = "bar") -> DataFrame:
    """Last visible bar of the row's stock at t."""
    if "visible_at" not in bars.columns:
        bars = bars.withColumn("visible_at", F.lit(None).cast("timestamp"))
    return asof_join(left, bars, "stock_key", t, "trading_day", payload, bar_usable_from(), into)


def with_following(bars: DataFrame, horizons: list[int], columns: list[str]) -> DataFrame:
    """Bars carrying the named columns of the n-th following bar, so no later join is needed."""
    by_day = Window.partitionBy("stock_key").orderBy("trading_day")
    return bars.select("*", *[F.lead(c, n).over(by_day).alias(f"{c}_{n}") for n in horizons for c in columns])


def base_and_following(left: DataFrame, bars: DataFrame, t: Column, horizons: list[int], columns: list[str]) -> DataFrame:
    """Last visible bar at t as struct ``base`` (trading_day, close) and the n-th bars dated after t as structs ``next_n``.

    Bars move to their stock once. There each month gets its bars, the last ones before it and the first ones after it, so a bar
    is no more than itself however many horizons are asked for, and left rows meet their month in one join. Without a
    bar dated up to t nothing follows.
    """
    if "visible_at" not in bars.columns:
        bars = bars.withColumn("visible_at", F.lit(None).cast("timestamp"))
    day = F.col("trading_day").cast("timestamp")
    own = F.struct("trading_day", *[c for c in columns if c != "trading_day"])
    told = F.struct(bar_usable_from().alias("from"), F.struct("trading_day", "close").alias("row"))
    placed = bars.select("stock_key", own.alias("own"), told.alias("told"), day.alias("day")).withColumn(
        "after", F.collect_list("own").over(Window.partitionBy("stock_key").orderBy("own.trading_day").rowsBetween(1, max(horizons))))
    entry = lambda at, told, own, after: F.struct(
        F.date_trunc("month", at).alias("block"), told.alias("told"), own.alias("own"), after.alias("after"))
    null = F.lit(None)
    types = {f.name: f.dataType for f in placed.schema.fields}
    packed = placed.select("stock_key", F.explode(F.array(
        entry(F.col("told.from"), F.col("told"), null.cast(types["own"]), null.cast(types["after"])),
        entry(F.col("day"), null.cast(types["told"]), F.col("own"), F.col("after")))).alias("e")).groupBy("stock_key", "e.block").agg(
        F.collect_list("e.told").alias("told"), F.max("e.told.row").alias("best"),
        F.array_sort(F.collect_list("e.own")).alias("own"), F.max_by("e.after", "e.own").alias("after"))
    rows = left.withColumn("_t", t.cast("timestamp")).withColumn("_block", F.date_trunc("month", "_t"))
    history = packed.groupBy("stock_key").agg(F.collect_list(F.struct("block", "told", "best", "own", "after", F.lit(False).alias("asked"))).alias("packs"))
    asked = rows.groupBy("stock_key").agg(F.collect_set("_block").alias("blocks"))
    kind = history.schema["packs"].dataType.elementType
    unasked = [null.cast(kind[c].dataType).alias(c) for c in ("told", "best", "own", "after")]
    every = F.concat("packs", F.transform("blocks", lambda b: F.struct(b.alias("block"), *unasked, F.lit(True).alias("asked"))))
    before = Window.partitionBy("stock_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = asked.join(history, "stock_key").select("stock_key", F.inline(every)).groupBy("stock_key", "block").agg(
        F.first("told", True).alias("told"), F.max("best").alias("best"), F.first("own", True).alias("own"), F.first("after", True).alias("after"),
        F.bool_or("asked").alias("asked")).withColumns({
            "best": F.max("best").over(before), "earlier": F.last("after", True).over(before)}).where("asked").select(
        "stock_key", F.col("block").alias("_block"), F.col("told").alias("_told"), F.col("best").alias("_best"),
        F.coalesce("own", F.array().cast(kind["own"].dataType)).alias("_own"), "earlier", F.col("after")).select(
        "stock_key", "_block", "_told", "_best", "_own", F.coalesce("after", "earlier").alias("_after"), F.col("earlier").isNotNull().alias("_earlier"))
    met = rows.join(blocks, ["stock_key", "_block"], "left")
    inside = F.array_max(F.transform(F.filter("_told", lambda x: x["from"] <= F.col("_t")), lambda x: x["row"]))
    upto = F.size(F.filter("_own", lambda x: x["trading_day"].cast("timestamp") <= F.col("_t")))
    nth = lambda n: F.when((F.col("_upto") > 0) | F.col("_earlier"), F.get(F.concat("_own", "_after"), F.col("_upto") + (n - 1)))
    return met.withColumns({"base": F.greatest(F.coalesce(inside, "_best"), F.coalesce(F.col("_best"), inside)), "_upto": upto}).select(
        *left.columns, "base", *[nth(n).alias(f"next_{n}") for n in horizons])


def nth_after(left: DataFrame, bars: DataFrame, t: Column, horizons: list[int], valuation_day: Column | None = None,
              columns: tuple[str, ...] = ("trading_day", "close"), into: str = "base") -> DataFrame:
    """Base bar at t and the n-th bars after it, up to a valuation day."""
    ahead = with_following(bars, horizons, list(columns))
    if valuation_day is not None:
        for n in horizons:
            reached = F.col(f"trading_day_{n}") <= valuation_day
            for c in columns:
                if c != "trading_day":
                    ahead = ahead.withColumn(f"{c}_{n}", F.when(reached, F.col(f"{c}_{n}")))
            ahead = ahead.withColumn(f"trading_day_{n}", F.when(reached, F.col(f"trading_day_{n}")))
    payload = [*[c for c in columns if c != "trading_day"], *[f"{c}_{n}" for n in horizons for c in columns]]
    return latest_bar(left, ahead, t, payload, into)


def status_as_of(left: DataFrame, history: DataFrame, t: Column) -> DataFrame:
    """Effective-dated status of each row; a coverage gap where none applied yet."""
    out = asof_join(left, history, "stock_key", t, "effective_from", ["is_st", "industry"],
                    F.col("effective_from"), "state", block="year")
    return out.select(*left.columns, "state.effective_from", "state.is_st", "state.industry",
                      F.col("state").isNull().alias("coverage_gap"))


def returns(base: Column, target: Column) -> Column:
    base, target = dbl(base), dbl(target)
    return F.when(base > 0, (target - base) / base)
