"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..session import shared_folder
from ..sources import feeds, merge
from ..sources.tables import WrittenTable, hashed
from .registry import query, view

def day_():
    return F.lit("2000-01-14").cast("date")



@query("src_bars_jsonl", "SELECT stock_key, trading_day, CAST(close AS DOUBLE) AS close, volume, trading_status, adj_type FROM bars_full")
def src_bars_jsonl(v):
    """Bars rendered as JSON lines and parsed back."""
    lines = v.bars_full.select(F.to_json(F.struct(
        "stock_key", "trading_day", "open", "high", "low", "close", "volume", "trading_status", "adj_type")).alias("value"))
    return feeds.parse_bar_lines(lines).select("stock_key", "trading_day", "close", "volume", "trading_status", "adj_type")


@query("src_bars_normalise", """SELECT stock_key, trading_day, trading_status, CASE WHEN adj_type IN ('hfq', 'none') THEN adj_type END AS adj_type FROM bars_full""")
def src_bars_normalise(v):
    return feeds.normalise_bars(v.bars_full).select("stock_key", "trading_day", "trading_status", "adj_type")


@query("src_unknown_counts", """SELECT count(*) AS "rows", count(*) FILTER (trading_status IS NULL) AS unknown_trading_status,
 count(*) FILTER (adj_type NOT IN ('hfq', 'none')) AS unknown_adj_type, count(*) FILTER (visible_at IS NULL) AS unknown_visible_at FROM bars_full""")
def src_unknown_counts(v):
    return feeds.unknown_counts(feeds.normalise_bars(v.bars_full), ["trading_status", "adj_type", "visible_at"])


@query("src_dataset_version", """SELECT *, concat('import-20011231-', substr(sha256(checksum), 1, 12)) AS revision FROM (
SELECT count(*) AS "rows", count(DISTINCT stock_key) AS stocks, min(trading_day) AS first_day, max(trading_day) AS last_day,
 concat_ws('-', count(*), bit_xor(h), sum(h)) AS checksum FROM (SELECT *, CAST(concat('0x', substr(md5(concat_ws('|', stock_key, trading_day, open, high, low, close, volume,
  coalesce(trading_status, ''), coalesce(adj_type, ''))), 1, 15)) AS BIGINT) AS h FROM bars_full))""")
def src_dataset_version(v):
    return feeds.describe_dataset(v.bars_full, "import", tk.instant("2001-12-31"))


@query("sink_bars_upsert", """
WITH t AS (SELECT * FROM bars_full WHERE trading_day < DATE '2000-01-01'),
b AS (SELECT stock_key, trading_day, close * 2 AS close, 'resumed' AS trading_status FROM bars_full WHERE trading_day >= DATE '1999-01-01')
SELECT coalesce(t.stock_key, b.stock_key) AS stock_key, coalesce(t.trading_day, b.trading_day) AS trading_day, CAST(coalesce(t.close, b.close) AS DOUBLE) AS close,
 CASE WHEN b.close IS NOT NULL THEN b.trading_status ELSE t.trading_status END AS trading_status,
 CASE WHEN t.close IS NOT NULL AND b.close IS NOT NULL THEN 'updated' WHEN b.close IS NOT NULL THEN 'inserted' ELSE 'kept' END AS change
FROM t FULL JOIN b ON t.stock_key = b.stock_key AND t.trading_day = b.trading_day""")
def sink_bars_upsert(v):
    target = v.bars_full.where("trading_day < DATE '2000-01-01'")
    batch = v.bars_full.where("trading_day >= DATE '1999-01-01'").withColumn(
        "close", (F.col("close") * 2).cast("decimal(18,4)")).withColumn("trading_status", F.lit("resumed"))
    return merge.upsert_bars(target, batch).select("stock_key", "trading_day", "close", "trading_status", "change")


@query("sink_bars_written", """
WITH t AS (SELECT * FROM bars_full WHERE trading_day < DATE '2000-01-01'),
b AS (SELECT stock_key, trading_day, close * 2 AS close, 'resumed' AS trading_status FROM bars_full WHERE trading_day >= DATE '1999-01-01')
SELECT coalesce(t.stock_key, b.stock_key) AS stock_key, coalesce(t.trading_day, b.trading_day) AS trading_day, CAST(coalesce(t.close, b.close) AS DOUBLE) AS close,
 CASE WHEN b.close IS NOT NULL THEN b.trading_status ELSE t.trading_status END AS trading_status
FROM t FULL JOIN b ON t.stock_key = b.stock_key AND t.trading_day = b.trading_day""")
def sink_bars_written(v):
    """Bars kept by year: a first load, then a batch that touches some years only, and the same batch again, which changes nothing."""
    target = v.bars_full.where("trading_day < DATE '2000-01-01'")
    batch = v.bars_full.where("trading_day >= DATE '1999-01-01'").withColumn(
        "close", (F.col("close") * 2).cast("decimal(18,4)")).withColumn("trading_status", F.lit("resumed"))
    table = WrittenTable(v.spark, shared_folder(v.spark, "bars-table"), v.bars_full.schema, F.year("trading_day"))
    table.append("load", target)
    for _ in range(2):
        table.merge("resumed", batch, lambda held, new: merge.upsert_bars(held, new).drop("change"))
    return table.read().select("stock_key", "trading_day", "close", "trading_status")


RAW = """SELECT l_suppkey AS stock_key, CAST(l_shipdate AS DATE) AS trading_day, floor(l_extendedprice / l_quantity) AS open,
 floor(l_extendedprice / l_quantity) + l_linenumber * 10 - 20 AS high, floor(l_extendedprice / l_quantity) - l_linenumber * 10 + 15 AS low,
 floor(l_extendedprice / l_quantity) - 2 AS close, CAST(l_quantity AS BIGINT) - 10 AS volume, l_orderkey, l_linenumber, l_partkey FROM lineitem"""


@query("src_bars_valid", f"""SELECT stock_key, trading_day, open, high, low, close, greatest(volume, 0) AS volume FROM ({RAW})
WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND high >= greatest(open, close) AND low <= least(open, close)
QUALIFY row_number() OVER (PARTITION BY stock_key, trading_day ORDER BY l_orderkey, l_linenumber, l_partkey) = 1""")
def src_bars_valid(v):
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")
    line = F.col("l_linenumber")
    raw = v.table("lineitem").select(
        F.col("l_suppkey").alias("stock_key"), F.to_date("l_shipdate").alias("trading_day"), price.alias("open"),
        (price + line * 10 - 20).alias("high"), (price - line * 10 + 15).alias("low"), (price - 2).alias("close"),
        (F.col("l_quantity").cast("bigint") - 10).alias("volume"), "l_orderkey", "l_linenumber", "l_partkey")
    return feeds.valid_bars(raw, ["l_orderkey", "l_linenumber", "l_partkey"]).drop("l_orderkey", "l_linenumber", "l_partkey")


@query("src_missing_days", "SELECT stock_key, trading_day FROM bars_full WHERE dataset_version IS NULL OR dataset_version > 'v1999'")
def src_missing_days(v):
    stored = v.bars_full.where("dataset_version <= 'v1999'")
    return feeds.missing_rows(v.bars, stored).select("stock_key", "trading_day")


@query("src_symbols_to_sync", "SELECT stock_key, symbol FROM stocks WHERE stock_key NOT IN (SELECT stock_key FROM bars WHERE trading_day = DATE '2000-01-14')")
def src_symbols_to_sync(v):
    return feeds.symbols_needing_sync(v.stocks, v.bars, day_(), day_()).select("stock_key", "symbol")


@query("src_quote_lines", "SELECT concat('sh', CAST(100000 + stock_key AS STRING)) AS code, trading_day, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, volume FROM bars WHERE volume % 500 <> 0 AND low > 0")
def src_quote_lines(v):
    """Bars rendered as quote lines (some too short) and parsed back."""
    blank = F.lit("0")
    fields = [F.lit("name"), F.col("open"), blank, F.col("close"), F.col("high"), F.col("low"), blank, blank,
              (F.col("volume") / 100).cast("bigint"), *([blank] * 21), F.col("trading_day"), F.lit("15:00:00")]
    text = F.concat_ws(",", *[f.cast("string") for f in fields])
    short = F.concat_ws(",", F.lit("name"), F.col("open").cast("string"))
    lines = v.bars.select(F.concat(
        F.lit("var hq_sh"), (100000 + F.col("stock_key")).cast("string"), F.lit('="'),
        F.when(F.col("volume") % 500 != 0, text).otherwise(short), F.lit('";')).alias("value"))
    return feeds.read_quote_lines(lines)


@query("src_spot_snapshot", """SELECT stock_key, DATE '2000-01-14' AS trading_day, close, volume FROM (SELECT l_suppkey AS stock_key, l_extendedprice / l_quantity AS close, CAST(l_quantity AS BIGINT) * 100 AS volume
 FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) = 1) WHERE stock_key IN (SELECT stock_key FROM stocks)""")
def src_spot_snapshot(v):
    feed = v.table("lineitem").select(
        F.col("l_suppkey").alias("stock_key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("close"),
        (F.col("l_quantity").cast("bigint") * 100).alias("volume"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    order = [F.desc("l_shipdate"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]
    return feeds.snapshot_to_bars(feed, v.stocks, day_(), order).select("stock_key", "trading_day", "close", "volume")


CODE = "CASE c_custkey % 4 WHEN 0 THEN concat('SH', {s}) WHEN 1 THEN concat({s}, '.SZ') WHEN 2 THEN {s} ELSE concat('x', {s}) END"


@query("src_symbol_universe", """SELECT lpad(CAST(c_custkey // 5 AS STRING), 6, '0') AS symbol, arg_max(c_name, c_custkey) AS name FROM customer WHERE c_custkey % 4 <> 3 GROUP BY 1""")
def src_symbol_universe(v):
    raw = v.table("customer").select(
        F.expr(CODE.format(s="lpad(cast(c_custkey div 5 as string), 6, '0')")).alias("code"),
        F.col("c_name").alias("name"), F.col("c_custkey").alias("seq"))
    return feeds.symbol_universe(raw)


@query("src_sync_summary", """WITH f AS (SELECT stock_key FROM stocks WHERE stock_key NOT IN (SELECT stock_key FROM bars WHERE trading_day = DATE '2000-01-14'))
SELECT (SELECT count(*) FROM stocks) AS requested, (SELECT count(*) FROM stocks) - (SELECT count(*) FROM f) AS succeeded, (SELECT count(*) FROM f) AS failed,
 (SELECT string_agg(CAST(stock_key AS STRING), ',' ORDER BY stock_key) FROM (SELECT stock_key FROM f ORDER BY 1 LIMIT 10)) AS failed_sample""")
def src_sync_summary(v):
    return feeds.sync_summary(v.stocks, v.bars.where(F.col("trading_day") == day_()), "stock_key")


@query("src_news_json", """SELECT source, title, CASE WHEN news_id % 3 = 0 THEN title ELSE trim(content, ' ') END AS content, concat('u', CAST(news_id AS STRING)) AS url,
 least(published_at, TIMESTAMP '2000-01-15 16:00:00') AS published_at FROM (SELECT news_id, trim(title, ' ') AS title, content, source, published_at FROM news)
WHERE CASE WHEN news_id % 3 = 0 THEN title ELSE trim(content, ' ') END <> ''""")
def src_news_json(v):
    """News rendered as nested payloads (some with only a title) and parsed back."""
    article = F.struct(
        "title", F.when(F.col("news_id") % 3 == 1, F.col("content")).alias("content"),
        F.when(F.col("news_id") % 3 == 2, F.col("content")).alias("summary"),
        F.concat(F.lit("u"), F.col("news_id").cast("string")).alias("url"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"))
    payload = v.news.select(F.to_json(F.struct("source", F.array(article).alias("articles"))).alias("value"))
    return feeds.parse_news(payload, tk.instant("2000-01-15 16:00:00"))


@query("src_local_time", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate - INTERVAL '8' HOUR WHEN 1 THEN o_orderdate + INTERVAL '90' MINUTE
 WHEN 2 THEN o_orderdate + INTERVAL '5415' SECOND WHEN 3 THEN NULL ELSE o_orderdate + INTERVAL '450' MINUTE END AS instant FROM orders""")
def src_local_time(v):
    text = """CASE o_orderkey % 5 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, "yyyy-MM-dd '09:30'")
     WHEN 2 THEN date_format(o_orderdate, "yyyy-MM-dd'T09:30:15'") WHEN 3 THEN date_format(o_orderdate, "yyyy'-02-30 10:00'")
     ELSE date_format(o_orderdate, "yyyy-MM-dd'T09:30:00+02:00'") END"""
    return v.table("orders").select("o_orderkey", tk.parse_local_ts(F.expr(text)).alias("instant"))


view("feed_rows", """SELECT source, news_id AS item_id, CAST(NULL AS STRING) AS url, title, published_at FROM news UNION ALL
SELECT 'web', page_id, url, url, TIMESTAMP '2000-01-01 00:00:00' + page_id * INTERVAL '1' HOUR FROM pages""")


@query("src_multi_source_union", """SELECT source, item_id, url, published_at FROM (SELECT *, CASE WHEN url <> '' THEN url ELSE concat_ws('|', title, strftime(published_at, '%Y-%m-%d %H:%M:%S')) END AS k FROM feed_rows
 WHERE published_at <= TIMESTAMP '2000-01-15 16:00:00' QUALIFY row_number() OVER (PARTITION BY source ORDER BY published_at DESC, item_id) <= 500)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY published_at DESC, source, item_id) = 1""")
def src_multi_source_union(v):
    wire = v.news.select("source", F.col("news_id").alias("item_id"), F.lit(None).cast("string").alias("url"), "title", "published_at")
    web = v.table("pages").select(
        F.lit("web").alias("source"), F.col("page_id").alias("item_id"), "url", F.col("url").alias("title"),
        (F.expr("TIMESTAMP '2000-01-01 00:00:00'").cast("timestamp") + F.col("page_id") * F.expr("INTERVAL '1' HOUR"))
        .alias("published_at"))
    return feeds.union_sources([wire, web], tk.instant("2000-01-15 16:00:00"), 500).select(
        "source", "item_id", "url", "published_at")


@query("src_stable_id", "SELECT evidence_id, concat('ec_', substr(sha256(concat_ws('|', run_id, news_id, stock_key, keyword)), 1, 24)) AS id FROM evidence")
def src_stable_id(v):
    return v.evidence.select("evidence_id", feeds.stable_id("ec", "run_id", "news_id", "stock_key", "keyword").alias("id"))


@query("sink_append_new", """WITH t AS (SELECT DISTINCT news_id, keyword FROM signals WHERE signal_at < TIMESTAMP '2000-01-10 00:00:00')
SELECT news_id, keyword, signal_id FROM signals s WHERE signal_at >= TIMESTAMP '2000-01-10 00:00:00' AND NOT EXISTS (SELECT 1 FROM t WHERE t.news_id = s.news_id AND t.keyword = s.keyword)
QUALIFY row_number() OVER (PARTITION BY news_id, keyword ORDER BY signal_id) = 1""")
def sink_append_new(v):
    edge = tk.instant("2000-01-10 00:00:00")
    target, batch = v.signals.where(F.col("signal_at") < edge), v.signals.where(F.col("signal_at") >= edge)
    table = WrittenTable(v.spark, shared_folder(v.spark, "signals-table"), target.schema, hashed(["news_id", "keyword"]))
    table.append("load", target)
    for _ in range(2):  # the second time changes nothing
        merge.append_rows(table, "new", batch, ["news_id", "keyword"], [F.asc("signal_id")])
    return table.read().where(F.col("signal_at") >= edge).select("news_id", "keyword", "signal_id")


view("cache_rows", """SELECT stock_key, keyword, fact_id, coalesce(match_confidence, 0.5) AS confidence, status, evidence_id FROM evidence JOIN runs USING (run_id)""")
view("cache_target", """SELECT stock_key, keyword, min(fact_id) AS fact_id, max(confidence) AS confidence, count(*) AS hit_count, 'closed' AS status FROM cache_rows WHERE status = 'SUCCESS' GROUP BY 1, 2""")


def cache_rows(v):
    return v.evidence.join(v.runs.select("run_id", "status"), "run_id").withColumn(
        "confidence", F.coalesce("match_confidence", F.lit(0.5)))


@query("sink_merge_cache", """WITH b AS (SELECT stock_key, keyword, min(fact_id) AS fact_id, max(confidence) AS confidence FROM cache_rows WHERE status = 'RUNNING' GROUP BY 1, 2)
SELECT coalesce(t.stock_key, b.stock_key) AS stock_key, coalesce(t.keyword, b.keyword) AS keyword, coalesce(t.fact_id, b.fact_id) AS fact_id,
 greatest(t.confidence, b.confidence) AS confidence, coalesce(t.hit_count, 0) + CASE WHEN b.fact_id IS NOT NULL THEN 1 ELSE 0 END AS hit_count,
 CASE WHEN b.fact_id IS NOT NULL THEN 'open' ELSE t.status END AS status FROM cache_target t FULL JOIN b ON t.stock_key = b.stock_key AND t.keyword = b.keyword""")
def sink_merge_cache(v):
    rows = cache_rows(v)
    target = rows.where("status = 'SUCCESS'").groupBy("stock_key", "keyword").agg(
        F.min("fact_id").alias("fact_id"), F.max("confidence").alias("confidence"), F.count("*").alias("hit_count"),
        F.lit("closed").alias("status"))
    return merge.merge_match_cache(target, rows.where("status = 'RUNNING'"))


@query("sink_cache_written", """WITH b AS (SELECT stock_key, keyword, min(fact_id) AS fact_id, max(confidence) AS confidence FROM cache_rows WHERE status = 'RUNNING' GROUP BY 1, 2)
SELECT coalesce(t.stock_key, b.stock_key) AS stock_key, coalesce(t.keyword, b.keyword) AS keyword, coalesce(t.fact_id, b.fact_id) AS fact_id,
 greatest(t.confidence, b.confidence) AS confidence, coalesce(t.hit_count, 0) + CASE WHEN b.fact_id IS NOT NULL THEN 1 ELSE 0 END AS hit_count,
 CASE WHEN b.fact_id IS NOT NULL THEN 'open' ELSE t.status END AS status FROM cache_target t FULL JOIN b ON t.stock_key = b.stock_key AND t.keyword = b.keyword""")
def sink_cache_written(v):
    """The match cache as a written table; the batch comes twice and counts once."""
    rows = cache_rows(v)
    target = rows.where("status = 'SUCCESS'").groupBy("stock_key", "keyword").agg(
        F.min("fact_id").alias("fact_id"), F.max("confidence").alias("confidence"), F.count("*").alias("hit_count"),
        F.lit("closed").alias("status"))
    table = WrittenTable(v.spark, shared_folder(v.spark, "cache-table"), target.schema, hashed(["stock_key", "keyword"]))
    table.append("load", target)
    for _ in range(2):
        table.merge("running", rows.where("status = 'RUNNING'"), merge.merge_match_cache)
    return table.read()


@query("sink_merge_candidates", """WITH k AS (SELECT stock_key, keyword, evidence_id, confidence, status FROM cache_rows),
t AS (SELECT stock_key, keyword, arg_max(evidence_id, (confidence, evidence_id)) AS evidence_id, max(confidence) AS confidence FROM k WHERE status = 'SUCCESS' GROUP BY 1, 2),
b AS (SELECT stock_key, keyword, arg_max(evidence_id, (confidence, evidence_id)) AS evidence_id, max(confidence) AS confidence FROM k WHERE status = 'FAILED' GROUP BY 1, 2)
SELECT coalesce(t.stock_key, b.stock_key) AS stock_key, coalesce(t.keyword, b.keyword) AS keyword, greatest(t.confidence, b.confidence) AS confidence, coalesce(t.evidence_id, b.evidence_id) AS evidence_id
FROM t FULL JOIN b ON t.stock_key = b.stock_key AND t.keyword = b.keyword""")
def sink_merge_candidates(v):
    rows = cache_rows(v)
    keys = ["stock_key", "keyword"]
    held = rows.where("status = 'SUCCESS'").groupBy(*keys).agg(
        F.max("confidence").alias("confidence"), F.max_by("evidence_id", F.struct("confidence", "evidence_id")).alias("evidence_id"))
    table = WrittenTable(v.spark, shared_folder(v.spark, "candidates-table"), held.select(*keys, "confidence", "evidence_id").schema, hashed(keys))
    table.append("load", held)
    for _ in range(2):
        table.merge("failed", rows.where("status = 'FAILED'"), lambda kept, new: merge.merge_candidates(kept, new, keys))
    return table.read()
