"""Readers that turn bar, quote and news feeds into typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..schemas import BAR, NEWS_PAYLOAD


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(BAR).json(path).where(F.col("stock_key").isNotNull())


def parse_bar_lines(lines: DataFrame) -> DataFrame:
    """The same parsing for lines already in a ``value`` column (a Kafka topic, a text table)."""
    return lines.where(F.trim("value") != "").select(F.from_json("value", BAR).alias("b")).select("b.*")


def normalise_bars(bars: DataFrame) -> DataFrame:
    """Empty optional fields become null; an adjustment other than hfq or none is unknown."""
    return bars.withColumns({
        "trading_status": F.nullif(F.trim("trading_status"), F.lit("")),
        "adj_type": F.when(F.trim("adj_type").isin("hfq", "none"), F.trim("adj_type")),
    })


def unknown_counts(bars: DataFrame, fields: list[str]) -> DataFrame:
    return bars.agg(F.count("*").alias("rows"),
                    *[F.count_if(F.col(f).isNull()).alias(f"unknown_{f}") for f in fields])


def describe_dataset(bars: DataFrame, source: str, as_of: Column) -> DataFrame:
    """Size, coverage and an order-free checksum of an imported batch, with a revision id derived from them.

    The checksum holds the number of rows and the xor and sum of their hashes, so a row that occurs twice shows. Prices, volume
    and, where they are known, status, adjustment and price limits take part.
    """
    names = ["stock_key", "trading_day", "open", "high", "low", "close", "volume"]
    names += [c for c in ("trading_status", "adj_type", "limit_up_price", "limit_down_price") if c in bars.columns]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    row = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return bars.agg(
        F.count("*").alias("rows"), F.countDistinct("stock_key").alias("stocks"),
        F.min("trading_day").alias("first_day"), F.max("trading_day").alias("last_day"),
        F.concat_ws("-", F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0))).alias("checksum"),
    ).withColumn("revision", F.concat_ws(
        "-", F.lit(source), F.date_format(as_of, "yyyyMMdd"), F.substring(F.sha2(F.col("checksum").cast("string"), 256), 1, 12)))


def valid_bars(raw: DataFrame, order: list[str]) -> DataFrame:
    """Positive consistent prices, non-negative volume, first row per stock and day."""
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    sane = reduce(lambda a, b: a & b, [(p > 0) & ~F.isnan(dbl(p)) & (dbl(p) < float("inf")) for p in prices])
    good = raw.where(sane & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") <= F.least("open", "close")))
    first = F.row_number().over(Window.partitionBy("stock_key", "trading_day").orderBy(*order))
    return good.withColumn("volume", F.greatest("volume", F.lit(0))).withColumn("_rn", first).where("_rn = 1").drop("_rn")


def missing_rows(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("stock_key", "trading_day"), ["stock_key", "trading_day"], "left_anti")


def symbols_needing_sync(stocks: DataFrame, bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """One-day range: stocks lacking that day; longer ranges: every stock."""
    have = bars.where((F.col("trading_day") == first) & (first == last)).select("stock_key")
    return stocks.join(have, "stock_key", "left_anti")


def read_quote_lines(lines: DataFrame) -> DataFrame:
    """``var hq_xx="f0,f1,..."`` lines to bars: at least 32 fields, positive prices, lots to shares.

    Fixed values: field positions open 1, close 3, high 4, low 5, lots 8, day 30; 100 shares per lot.
    """
    code = F.regexp_extract("value", r'^var hq_([a-z]*\d+)="', 1)
    fields = F.split(F.regexp_extract("value", r'="([^"]*)"', 1), ",")
    num = [fields[i].try_cast("double") for i in range(9)]
    return (
        lines.where((code != "") & (F.size(fields) >= 32))
        .select(code.alias("code"), F.get(fields, F.lit(30)).try_cast("date").alias("trading_day"),
                num[1].alias("open"), num[4].alias("high"), num[5].alias("low"), num[3].alias("close"),
                (num[8] * 100).cast("bigint").alias("volume"))
        .where("open > 0 and high > 0 and low > 0 and close > 0")
    )


def snapshot_to_bars(snapshot: DataFrame, stocks: DataFrame, day: Column, order: list[Column]) -> DataFrame:
    """Full-market snapshot to one bar per listed stock; the first row of a stock wins."""
    first = F.row_number().over(Window.partitionBy("stock_key").orderBy(*order))
    return (
        snapshot.withColumn("_rn", first).where("_rn = 1").drop("_rn")
        .join(stocks.select("stock_key"), "stock_key", "left_semi")
        .where("close > 0 and volume > 0").withColumn("trading_day", day)
    )


def symbol_universe(raw: DataFrame) -> DataFrame:
    """Six-digit codes without exchange marks; the last name seen wins."""
    # Exchange prefixes and suffixes.
    code = F.regexp_replace(F.lower(F.trim("code")), r"^(sh|sz|bj)\.?|\.(sh|sz|bj|ss)$", "")
    return raw.withColumn("symbol", code).where(F.col("symbol").rlike(r"^\d{6}$")).groupBy("symbol").agg(
        F.max_by("name", "seq").alias("name"))


def sync_summary(requested: DataFrame, returned: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """Requested, succeeded and failed counts with the first failed keys."""
    failed = requested.join(returned.select(key), key, "left_anti")
    first = failed.select(key).orderBy(key).limit(sample).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x.cast("string")), ",").alias("s")).scalar()
    n_failed = failed.agg(F.count("*")).scalar()
    return requested.agg(F.count("*").alias("requested")).select(
        "requested", (F.col("requested") - n_failed).alias("succeeded"), n_failed.alias("failed"), first.alias("failed_sample"))


def parse_news(payloads: DataFrame, as_of: Column) -> DataFrame:
    """Nested payload to article rows: body falls back to summary then title, times are clamped, empties dropped."""
    article = payloads.select(F.from_json("value", NEWS_PAYLOAD).alias("p")).select(
        "p.source", F.explode("p.articles").alias("a"))
    title = F.trim("a.title")
    body = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("a.content", "a.summary", "a.title")])
    return article.select(
        "source", F.coalesce(title, F.lit("")).alias("title"), body.alias("content"), F.col("a.url").alias("url"),
        F.least(F.coalesce(F.col("a.publishedAt").try_cast("timestamp"), as_of), as_of).alias("published_at"),
    ).where(F.col("content").isNotNull())



def union_sources(feeds: list[DataFrame], as_of: Column, limit: int) -> DataFrame:
    """Union of feeds up to as_of, at most ``limit`` newest rows per source, deduplicated by url else title and time."""
    every = reduce(lambda a, b: a.unionByName(b), feeds).where(F.col("published_at") <= as_of)
    newest = Window.partitionBy("source").orderBy(F.desc("published_at"), "item_id")
    kept = every.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= limit)
    key = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(
        F.concat_ws("|", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")))
    first = Window.partitionBy("_key").orderBy(F.desc("published_at"), "source", "item_id")
    return kept.withColumn("_key", key).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", "_key")


def stable_id(prefix: str, *columns: str | Column) -> Column:
    """Content-derived id: prefix and 24 hex digits of the joined fields."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 24))
