"""Block bootstrap and the evaluation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..operators import sessions
from ..session import cut_lineage

# Increment and masks of the counter-based generator, defaults of the bootstrap.
STEP, MASK, SCALE = 0x6D2B79F5, 0xFFFFFFFF, 4294967296.0
ITERATIONS, BLOCK, SEED = 2000, 10, 20260910


def _times(x: Column, y: Column) -> Column:
    """32-bit product of two unsigned values held in bigint, in 16-bit halves so nothing overflows."""
    low = x * y.bitwiseAND(F.lit(0xFFFF))
    high = (x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (low + high).bitwiseAND(F.lit(MASK))


def draw(k: Column, seed: int) -> Column:
    """k-th uniform draw (k from 1): it depends on the counter alone, so draws are computed in parallel."""
    a = (F.lit(seed) + k * F.lit(STEP)).bitwiseAND(F.lit(MASK))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(SCALE)


def bootstrap_means(returns: DataFrame, iterations: int = ITERATIONS, block: int = BLOCK, seed: int = SEED, series: tuple[str, ...] = ()) -> DataFrame:
    """Mean of every circular block resample of ordered daily series (series columns, day, ret).

    Draws are addressed by series, iteration and block, so a series among many gives what it gives alone. Block sums are
    differences of running sums over a series that is continued past its end; a resample is one row per block, so work is
    iterations x days / block.
    """
    by_day = Window.partitionBy(*series).orderBy("day")
    rows = cut_lineage(returns.select(*series, "ret", (F.row_number().over(by_day) - 1).cast("bigint").alias("i")))
    sizes = rows.groupBy(*series).agg(F.count("*").alias("n")).where("n > 0") if series else rows.agg(F.count("*").alias("n")).where("n > 0")
    one = F.lit(1).alias("_all")  # lets a single series join like many
    keys = ["_all", *series]
    rows, sizes = rows.select("*", one), sizes.select("*", one)
    run = Window.partitionBy(*keys).orderBy("i")
    turns = F.sequence(F.lit(0).cast("bigint"), F.ceil(F.lit(block) / F.col("n")))
    ext = rows.join(sizes, keys).withColumn("turn", F.explode(turns)).select(*keys, "n", (F.col("i") + F.col("turn") * F.col("n")).alias("i"), "ret").where(
        F.col("i") < F.col("n") + block).withColumn("upto", F.sum("ret").over(run))
    ends = ext.select(*keys, F.col("i").alias("end"), F.col("upto").alias("end_sum"))
    starts = ext.where(F.col("i") < F.col("n")).select(
        *keys, F.col("i").alias("start"), (F.col("upto") - F.col("ret")).alias("before"),
        F.explode(F.array(F.lit(block).cast("bigint"), F.col("n") % block)).alias("length")).where("length > 0").distinct()
    sums = starts.withColumn("end", F.col("start") + F.col("length") - 1).join(ends, [*keys, "end"]).select(
        *keys, "start", "length", (F.col("end_sum") - F.col("before")).alias("value"))
    blocks = F.ceil(F.col("n") / block)
    tasks = int(returns.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number keeps the draws spread
    grid = sizes.withColumn("iteration", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(iterations - 1).cast("bigint")))).repartition(
        tasks, *series, "iteration").withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    k = F.col("iteration") * (1 + F.floor(F.col("n") / block)) + F.col("b") + 1
    length = F.when((F.col("b") == blocks - 1) & (F.col("n") % block > 0), F.col("n") % block).otherwise(F.lit(block).cast("bigint"))
    drawn = grid.select(*keys, "n", "iteration", F.floor(draw(k, seed) * F.col("n")).alias("start"), length.alias("length"))
    return drawn.join(sums, [*keys, "start", "length"]).groupBy(*keys, "iteration", "n").agg(F.sum("value").alias("total")).select(
        *series, "iteration", (F.col("total") / F.col("n")).alias("mean"))


def bootstrap_ci(returns: DataFrame, iterations: int = ITERATIONS, block: int = BLOCK, seed: int = SEED, series: tuple[str, ...] = ()) -> DataFrame:
    """5% and 95% order statistics and mean of the resampled means, per series."""
    means = bootstrap_means(returns, iterations, block, seed, series)
    ranked = means.withColumn("r", F.row_number().over(Window.partitionBy(*series).orderBy("mean")) - 1)
    low, high = int(0.05 * (iterations - 1)), -int(-(0.95 * (iterations - 1)) // 1)
    return ranked.groupBy(*series).agg(F.max(F.when(F.col("r") == low, F.col("mean"))).alias("lower"),
                                       F.max(F.when(F.col("r") == high, F.col("mean"))).alias("upper"), F.avg("mean").alias("mean"))


def eval_report(returns: DataFrame, baseline: DataFrame, bps: float = 10.0, **bootstrap) -> DataFrame:
    """Windows, confidence interval, drawdown, 5th percentile and baseline drawdown of net returns."""
    # A daily series is short but costly to derive and is read several times.
    net = cut_lineage(returns.select("day", sessions.net_return(dbl("ret"), bps).alias("ret")))
    base = cut_lineage(baseline.select("day", sessions.net_return(dbl("ret"), bps).alias("ret")))
    windows = sessions.walk_forward(net.select("day")).agg(F.countDistinct("window").alias("w")).scalar()

    def worst(df: DataFrame) -> Column:
        return sessions.max_drawdown(df.withColumn("series", F.lit(1)), ["series"], "day", "ret").select("max_drawdown").scalar()

    ranked = net.withColumn("r", F.row_number().over(Window.orderBy("ret")) - 1).withColumn("n", F.count("*").over(
        Window.orderBy("ret").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    tail = ranked.where(F.col("r") == F.floor((F.col("n") - 1) * F.lit(0.05))).agg(F.max("ret")).scalar()
    return bootstrap_ci(net, **bootstrap).select(
        windows.alias("windows"), "lower", "upper", "mean", worst(net).alias("max_drawdown"), tail.alias("worst_5pct"),
        worst(base).alias("baseline_drawdown"))
