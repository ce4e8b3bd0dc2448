"""Newest, best and live row per key.

``row_number`` filtered to a constant is planned as a partial group limit before
the shuffle, so a hot key sends only its best rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timekeys import visible_at


def topn(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key with their rank."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).where(F.col(rank) <= n)


def best_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return topn(df, keys, order, 1, "_rn").drop("_rn")


def reusable_snapshots(requests: DataFrame, snaps: DataFrame) -> DataFrame:
    """Own-run snapshot of a stock, else the newest one of the same tenant and instant.

    Both candidates come from aggregates, so no request is paired with every
    snapshot of its instant.
    """
    own = snaps.select("run_id", "stock_key", F.col("score").alias("own_score"))
    newest = snaps.groupBy("tenant", "as_of", "stock_key").agg(
        F.max_by(F.struct("run_id", "score"), F.struct("created_at", "run_id")).alias("newest"))
    return (
        requests.join(own, ["run_id", "stock_key"], "left")
        .join(newest, ["tenant", "as_of", "stock_key"], "left")
        .withColumn("source_run", F.when(F.col("own_score").isNotNull(), F.col("run_id"))
                    .otherwise(F.col("newest.run_id")))
        .withColumn("score", F.coalesce("own_score", "newest.score"))
        .where(F.col("source_run").isNotNull()).drop("own_score", "newest")
    )


def freshness(snaps: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Latest visible day per stock, visible bars newer than its snapshot, and calendar staleness against the market."""
    seen = bars.where((F.col("trading_day") <= F.to_date(as_of)) & (visible_at("trading_day", "visible_at") <= as_of))
    market_day = seen.agg(F.max("trading_day")).scalar()
    per_stock = (
        seen.select("stock_key", "trading_day").join(snaps.select("stock_key", "snap_day"), "stock_key")
        .groupBy("stock_key").agg(F.max("trading_day").alias("latest_day"),
                                  F.count_if(F.col("trading_day") > F.col("snap_day")).alias("newer_bars"))
    )
    return snaps.join(per_stock, "stock_key", "left").select(
        *snaps.columns, "latest_day", F.coalesce("newer_bars", F.lit(0)).alias("newer_bars"),
        F.when(F.col("latest_day") < market_day, F.greatest(F.lit(1), F.datediff(market_day, F.col("latest_day"))))
        .otherwise(0).alias("stale_days"))


def pick_run(recs: DataFrame, runs: DataFrame) -> DataFrame:
    """Run to show per day: newest instant, successful first, then most rows, then run id."""
    sizes = recs.groupBy("run_id").agg(F.count("*").alias("rows_in_run"))
    joined = runs.join(sizes, "run_id").withColumn("day", F.to_date("as_of"))
    return best_per_key(joined, ["day"], [
        F.desc("as_of"), F.desc(F.col("status") == "SUCCESS"), F.desc("rows_in_run"), F.desc("run_id")])


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Parents with their most relevant child, if any."""
    return parents.join(best_per_key(children, [key], order), key, "left")


def publish(live: DataFrame, requests: DataFrame) -> DataFrame:
    """Publish records after new requests: a live run is reused, a new one gets its next version.

    Within a tenant and instant each record is superseded by the one published after it.
    """
    versions = live.groupBy("run_id").agg(F.max("publish_version").alias("last_version"))
    fresh = (
        requests.join(live.select("run_id"), "run_id", "left_anti")
        .join(versions, "run_id", "left")
        .select("run_id", "tenant", "as_of",
                (F.coalesce("last_version", F.lit(0)) + 1).cast("bigint").alias("publish_version"),
                "published_at")
    )
    every = live.select("run_id", "tenant", "as_of", "publish_version", "published_at").unionByName(fresh)
    order = Window.partitionBy("tenant", "as_of").orderBy("published_at", "run_id", "publish_version")
    return every.withColumn("superseded_by", F.lead("run_id").over(order))
