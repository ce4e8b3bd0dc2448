"""Equi-joins that attach, count, filter and carry rows across tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..functions.timekeys import REPORT_ZONE, local_day, visible_at
from .temporal import published_only, valid_at


def theme_members(keys: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """Distinct member stocks of each keyword through facts valid at as_of."""
    members = valid_at(facts, as_of).select("keyword", "stock_key").distinct()
    return keys.select("keyword").distinct().join(members, "keyword")


def evidence_detail(evidence: DataFrame, news: DataFrame, facts: DataFrame, recs: DataFrame, publishes: DataFrame) -> DataFrame:
    """Published evidence with its news title, fact and recommendation rank."""
    return (
        published_only(evidence, publishes)
        .join(news.select("news_id", "source", F.length("title").alias("title_length")), "news_id", "left")
        .join(facts.select("fact_id", "exposure_type", "taxonomy_level"), "fact_id", "left")
        .join(recs.select("run_id", "stock_key", "rnk"), ["run_id", "stock_key"], "left")
    )


def evidence_stats(recs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence per recommendation: rows, confident rows, mean confidence and total contribution."""
    stats = evidence.groupBy("run_id", "stock_key").agg(
        F.count("*").alias("evidence_count"),
        F.count_if(F.col("match_confidence") >= 0.8).alias("confident_count"),
        (dbl(F.sum(F.col("match_confidence").cast("decimal(10,4)"))) / F.count("match_confidence")).alias("mean_confidence"),
        dbl(F.sum(F.col("contribution").cast("decimal(12,4)"))).alias("total_contribution"))
    return recs.join(stats, ["run_id", "stock_key"], "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("evidence_count", "confident_count")})


def keywords_of(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-empty keywords of evidence rows, from all keyword columns."""
    words = F.array_distinct(F.array_compact(F.array(
        F.nullif(F.trim("keyword"), F.lit("")), F.nullif(F.trim("matched_keyword"), F.lit("")))))
    return evidence.select(*keys, F.explode(words).alias("word")).distinct()


def cooldown_gate(candidates: DataFrame, published: DataFrame, evidence: DataFrame) -> DataFrame:
    """Add ``cooled``: previous_stock where the stock was published for the tenant on the local day before, else previous_keyword where a
    keyword was, else null."""
    day = local_day("as_of")
    asked = candidates.withColumn("_day", day)
    told = published.select("tenant", F.date_add(day, 1).alias("_day"), "run_id", "stock_key")
    words = keywords_of(evidence, ["run_id", "stock_key"])
    stocks = told.select("tenant", "_day", "stock_key").distinct().withColumn("_stock", F.lit(True))
    used = told.join(words, ["run_id", "stock_key"]).select("tenant", "_day", "word").distinct()
    shared = asked.select("run_id", "tenant", "_day", "stock_key").join(words, ["run_id", "stock_key"]).join(
        used, ["tenant", "_day", "word"], "left_semi").select("run_id", "stock_key").distinct().withColumn("_word", F.lit(True))
    return asked.join(stocks, ["tenant", "_day", "stock_key"], "left").join(shared, ["run_id", "stock_key"], "left").withColumn(
        "cooled", F.when(F.col("_stock"), "previous_stock").when(F.col("_word"), "previous_keyword")).drop("_day", "_stock", "_word")


def apply_cooldown(candidates: DataFrame, published: DataFrame, evidence: DataFrame) -> DataFrame:
    """Drop candidates whose stock, or any keyword, was published for the tenant on the local day before."""
    day = local_day("as_of")
    asked = candidates.withColumn("day", day)
    told = published.select("tenant", F.date_add(day, 1).alias("day"), "run_id", "stock_key")
    stocks = told.select("tenant", "day", "stock_key").distinct()
    words = keywords_of(evidence, ["run_id", "stock_key"])
    cooled = told.join(words, ["run_id", "stock_key"]).select("tenant", "day", "word").distinct()
    hit = (
        asked.select("run_id", "tenant", "day", "stock_key").join(words, ["run_id", "stock_key"])
        .join(cooled, ["tenant", "day", "word"], "left_semi").select("run_id", "stock_key").distinct()
    )
    return asked.join(stocks, ["tenant", "day", "stock_key"], "left_anti").join(hit, ["run_id", "stock_key"], "left_anti")


def news_window(cases: DataFrame, news: DataFrame, days: int = 3) -> DataFrame:
    """News count in [day - n 00:00, day 15:00] local time per case, from daily counts.

    News are counted per local day first (before 15:00 and in all), so a busy
    day never multiplies with its cases.
    """
    local = F.from_utc_timestamp("published_at", REPORT_ZONE)
    early = F.date_format(local, "HH:mm:ss") <= "15:00:00"
    daily = news.groupBy(F.to_date(local).alias("day")).agg(
        F.count("*").alias("n"), F.count_if(early).alias("n_early"), F.min("published_at").alias("first_at"))
    case_days = cases.select("trading_day").distinct()
    spread = case_days.select("trading_day", F.explode(F.sequence(F.date_sub("trading_day", days), F.col("trading_day"))).alias("day"))
    window = spread.join(daily, "day").groupBy("trading_day").agg(
        F.sum(F.when(F.col("day") == F.col("trading_day"), F.col("n_early")).otherwise(F.col("n"))).alias("news_count"))
    return (
        cases.join(window, "trading_day", "left")
        .withColumn("news_count", F.coalesce("news_count", F.lit(0)))
        .withColumn("news_missing", F.col("news_count") == 0)
    )



def market_day_pairs(bars: DataFrame, hour: int | None = None) -> DataFrame:
    """The same pairing for every market day at once; with an hour, only of bars visible by then on the later day.

    Market days are numbered, and a bar finds those of the number before among its stock's, so bars move to their stock once.
    """
    order = Window.orderBy("latest_day")
    days = bars.select(F.col("trading_day").alias("latest_day")).distinct().select(
        "latest_day", F.lag("latest_day").over(order).alias("previous_day"), F.row_number().over(order).alias("_n"))  # one row per market day
    seen = [] if hour is None else [visible_at("trading_day", "visible_at").alias("_seen")]
    rows = bars.where(F.col("stock_key").isNotNull()).select(
        "stock_key", F.col("trading_day").alias("latest_day"), dbl("close").alias("close"), "volume", *seen).join(F.broadcast(days), "latest_day")
    before = Window.partitionBy("stock_key").orderBy("_n").rangeBetween(-1, -1)
    own = F.struct("close", "volume", *(["_seen"] if seen else []))
    pairs = rows.withColumn("_before", F.collect_list(own).over(before)).withColumn("_b", F.explode("_before"))
    if seen:
        now = by_hour("latest_day", hour)
        pairs = pairs.where((F.col("_seen") <= now) & (F.col("_b._seen") <= now))
    return pairs.select("stock_key", "previous_day", "latest_day", "close", "volume",
                        F.col("_b.close").alias("previous_close"), F.col("_b.volume").alias("previous_volume"))


def by_hour(day: str, hour: int) -> Column:
    """Instant of an hour of a day."""
    return F.col(day).cast("timestamp") + F.expr(f"INTERVAL '{hour}' HOUR")


def resolve_names(symbols: DataFrame, tiers: list[DataFrame], acceptable: str = "[一-龥]") -> DataFrame:
    """First acceptable name over ordered tiers of (stock_key, name, rank); higher rank wins inside a tier."""
    stacked = reduce(lambda a, b: a.unionByName(b), [
        t.select("stock_key", F.trim("name").alias("name"), F.col("rank").cast("double").alias("rank"), F.lit(i).alias("tier"))
        for i, t in enumerate(tiers)])
    best = stacked.where(F.col("name").rlike(acceptable)).groupBy("stock_key").agg(
        F.min_by(F.struct("name", "tier"), F.struct(F.col("tier"), -F.col("rank"), F.col("name"))).alias("b"))
    return symbols.join(best, "stock_key", "left").select(*symbols.columns, "b.name", "b.tier")


def carry_forward(rows: DataFrame, runs: DataFrame, new_id: Column, as_of: Column) -> DataFrame:
    """Rows of each tenant's newest earlier successful run, under a new run id."""
    source = runs.where((F.col("status") == "SUCCESS") & (F.col("as_of") < as_of)).groupBy("tenant").agg(
        F.max_by("run_id", F.struct("as_of", "run_id")).alias("run_id"))
    return rows.join(source.select("run_id"), "run_id", "left_semi").withColumn("source_run", F.col("run_id")) \
        .withColumn("run_id", new_id)


def members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a whose key occurs in b."""
    return a.join(b.select(key), key, "left_semi")
