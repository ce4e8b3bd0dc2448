"""Aggregation and audit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl, fixed
from ..functions.timekeys import instant, visible_at
from ..operators import audits as au
from ..operators import bar_features as bf
from ..operators import graph as g
from ..operators import market as mk
from ..operators.latest import topn
from ..operators.lookups import by_hour, theme_members
from .graphs import merged_edges
from .registry import query, rnd, view
from .temporal import BY_HOUR, RUN_HOUR, VIS, candidates

def at_():
    return instant("2000-01-15 16:00:00")

ATS = "TIMESTAMP '2000-01-15 16:00:00'"
VALID = f"valid_from <= {ATS} AND (valid_to IS NULL OR valid_to >= {ATS})"

view("strengths", "SELECT target AS keyword, least(1.0, CAST(sum(CAST(confidence * CASE WHEN weak THEN 0.5 ELSE 1.0 END AS DECIMAL(18,8))) AS DOUBLE) / 10.0::DOUBLE) AS strength FROM merged GROUP BY 1")
view("mom_asof", """WITH s AS (SELECT stock_key, trading_day, CAST(close AS DOUBLE) AS close FROM bars_full WHERE trading_day BETWEEN DATE '1999-11-16' AND DATE '2000-01-15' AND coalesce(visible_at, CAST(trading_day AS TIMESTAMP) + INTERVAL '7' HOUR) <= TIMESTAMP '2000-01-15 16:00:00')
SELECT stock_key, m FROM (SELECT stock_key, trading_day, (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS m FROM s WINDOW w AS (PARTITION BY stock_key ORDER BY trading_day)) QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY trading_day DESC) = 1""")
view("gaps", f"""WITH r AS (SELECT keyword, avg(m) AS reaction FROM (SELECT DISTINCT keyword, stock_key FROM facts WHERE {VALID}) JOIN mom_asof USING (stock_key) WHERE m IS NOT NULL GROUP BY 1)
SELECT s.keyword, {rnd('strength')} AS strength, {rnd('coalesce(reaction, 0.0)')} AS reaction, CASE WHEN reaction IS NOT NULL THEN {rnd('strength - reaction')} ELSE 0.0 END AS gap, reaction IS NOT NULL AS has_price,
 reaction IS NOT NULL AND {rnd('strength - reaction')} > 0.4 AND abs(reaction) < 0.03 AS weak_signal FROM strengths s LEFT JOIN r ON r.keyword = s.keyword""")


def gaps(v):
    return mk.expectation_gap(g.graph_strength(merged_edges(v)), v.facts, v.bars_full, at_(), lookback_days=60)


@query("a_expectation_gap", "SELECT keyword, strength, reaction, gap, has_price, coalesce(weak_signal, false) AS weak_signal FROM gaps")
def a_expectation_gap(v):
    return gaps(v)


view("forecasts", f"""WITH a AS (SELECT keyword, count(*) FILTER (direction = 'positive') AS positive, count(*) FILTER (direction = 'negative') AS negative, count(*) AS total, CAST(sum(CAST(confidence AS DECIMAL(10,4))) AS DOUBLE) AS conf, count(DISTINCT news_id) AS news FROM signals GROUP BY 1),
t AS (SELECT keyword, string_agg(business_variable, ',' ORDER BY c DESC, business_variable) AS variables FROM (SELECT keyword, business_variable, count(*) AS c FROM signals GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY count(*) DESC, business_variable) <= 5) GROUP BY 1),
d AS (SELECT a.*, variables, coalesce(gap, 0.0) AS gap, CASE WHEN positive / total >= 0.6 THEN 'bullish' WHEN positive / total < 0.4 THEN 'bearish' ELSE 'neutral' END AS direction, {rnd('least(1.0, total * (conf / total) / 25.0)')} AS strength FROM a JOIN t USING (keyword) LEFT JOIN gaps USING (keyword))
SELECT keyword, positive, negative, total, news, direction, d.strength, {rnd("greatest(0.0, least(1.0, d.strength * 0.6::DOUBLE + CASE direction WHEN 'bearish' THEN greatest(0.0, -gap) ELSE greatest(0.0, gap) END * 0.4::DOUBLE))")} AS probability, variables FROM d""")


@query("a_theme_forecast", f"""SELECT keyword, positive, negative, total, news, direction, strength, probability, variables, coalesce(members, '') AS members FROM forecasts LEFT JOIN (
 SELECT keyword, string_agg(stock_key, ',' ORDER BY stock_key) AS members FROM (SELECT DISTINCT keyword, stock_key FROM facts WHERE {VALID}
 QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY stock_key) <= 10) GROUP BY 1) USING (keyword)""")
def a_theme_forecast(v):
    return mk.theme_forecast(v.signals, gaps(v), theme_members(v.signals, v.facts, at_()))


def forecast_rows(first: str = "") -> str:
    """SQL of the settled forecasts; ``first`` cuts the members of a keyword."""
    return f"""WITH f AS (SELECT keyword, CASE WHEN count(*) FILTER (direction = 'positive') / count(*) >= 0.6 THEN 'bullish' WHEN count(*) FILTER (direction = 'positive') / count(*) < 0.4 THEN 'bearish' ELSE 'neutral' END AS direction, CAST(signal_at AS DATE) AS day FROM signals GROUP BY keyword, CAST(signal_at AS DATE)),
m AS (SELECT keyword, stock_key FROM (SELECT DISTINCT keyword, stock_key FROM facts WHERE {VALID}){first}),
b AS (SELECT stock_key, trading_day, CAST(close AS DOUBLE) AS close, CAST(coalesce(lead(close, 5) OVER w, lead(close, 4) OVER w, lead(close, 3) OVER w, lead(close, 2) OVER w, lead(close, 1) OVER w) AS DOUBLE) AS last, coalesce(lead(trading_day, 5) OVER w, lead(trading_day, 4) OVER w, lead(trading_day, 3) OVER w, lead(trading_day, 2) OVER w, lead(trading_day, 1) OVER w) AS until FROM bars WINDOW w AS (PARTITION BY stock_key ORDER BY trading_day)),
u AS (SELECT i.stock_key, i.day, max(b.trading_day) AS td FROM (SELECT DISTINCT stock_key, day FROM f JOIN m USING (keyword)) i JOIN bars_full b ON b.stock_key = i.stock_key AND greatest(CAST(b.trading_day AS TIMESTAMP), {VIS}) <= CAST(i.day AS TIMESTAMP) GROUP BY 1, 2),
x AS (SELECT f.keyword, f.day, avg((last - close) / close) AS move, CAST(max(until) AS TIMESTAMP) + INTERVAL '7' HOUR AS ready_at FROM f JOIN m USING (keyword) JOIN u ON u.stock_key = m.stock_key AND u.day = f.day JOIN b ON b.stock_key = u.stock_key AND b.trading_day = u.td WHERE last IS NOT NULL AND close > 0 GROUP BY 1, 2)
SELECT f.keyword, f.day, direction, {rnd('move', 6)} AS move, CASE WHEN move > 0.01 THEN 'up' WHEN move < -0.01 THEN 'down' WHEN move IS NOT NULL THEN 'flat' ELSE 'no_data' END AS realised,
 CASE WHEN move > 0.01 THEN 'up' WHEN move < -0.01 THEN 'down' WHEN move IS NOT NULL THEN 'flat' ELSE 'no_data' END = CASE direction WHEN 'bullish' THEN 'up' WHEN 'bearish' THEN 'down' ELSE 'flat' END AS hit, ready_at FROM f LEFT JOIN x ON x.keyword = f.keyword AND x.day = f.day"""


view("forecast_rows", forecast_rows(" QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY stock_key) <= 10"))
view("review_rows", forecast_rows())


def settled_forecasts(v, most: int | None = None):
    """One forecast per keyword and day of its signals, settled over all members of the keyword or its first ``most``."""
    share = F.count_if(F.col("direction") == "positive") / F.count("*")
    forecasts = v.signals.groupBy("keyword", F.to_date("signal_at").alias("day")).agg(
        F.when(share >= 0.6, "bullish").when(share < 0.4, "bearish").otherwise("neutral").alias("direction")).withColumn(
        "as_of", F.col("day").cast("timestamp"))
    members = theme_members(v.signals, v.facts, at_())
    if most is not None:
        members = topn(members, ["keyword"], [F.asc("stock_key")], most)
    return mk.settle_forecasts(forecasts, members.select("keyword", "stock_key"), v.bars_full)


@query("a_forecast_settle", "SELECT * EXCLUDE (ready_at) FROM forecast_rows")
def a_forecast_settle(v):
    """One forecast per keyword and day of its signals."""
    return settled_forecasts(v, 10).select("keyword", "day", "direction", fixed("move", 6).alias("move"), "realised", "hit")


@query("a_forecast_hit_rate", f"""SELECT keyword, count(*) AS evaluated, {rnd('count(*) FILTER (hit) / count(*)')} AS hit_rate FROM forecast_rows WHERE realised <> 'no_data' GROUP BY 1""")
def a_forecast_hit_rate(v):
    return mk.hit_rate(a_forecast_settle(v), ["keyword"])


@query("a_industry_momentum", f"""WITH f AS (SELECT trading_day, industry, stock_key, momentum5, market_score FROM scored JOIN stocks USING (stock_key)), m AS (SELECT trading_day, industry, avg(momentum5) AS mm FROM f GROUP BY 1, 2)
SELECT stock_key, trading_day, CASE WHEN mm < -0.05 THEN {rnd('greatest(0.3::DOUBLE, 1.0 + mm)')} ELSE 1.0 END AS factor, {rnd(f"market_score * CASE WHEN mm < -0.05 THEN {rnd('greatest(0.3::DOUBLE, 1.0 + mm)')} ELSE 1.0 END")} AS adjusted FROM f JOIN m USING (trading_day, industry)""")
def a_industry_momentum(v):
    rows = bf.market_score(v.bars).select("stock_key", "trading_day", "momentum5", "market_score").join(
        v.stocks.select("stock_key", "industry"), "stock_key")
    return mk.industry_penalty(rows, ["trading_day", "industry"], "momentum5", "market_score").select(
        "stock_key", "trading_day", "factor", "adjusted")


@query("a_market_breadth", f"""WITH d AS (SELECT trading_day, lag(trading_day) OVER (ORDER BY trading_day) AS pd FROM (SELECT DISTINCT trading_day FROM bd)),
p AS (SELECT n.trading_day AS day, count(*) AS n, count(*) FILTER (n.close > p.close) AS up FROM bd_timed n JOIN d USING (trading_day) JOIN bd_timed p ON p.stock_key = n.stock_key AND p.trading_day = d.pd WHERE n.seen <= {BY_HOUR} AND p.seen <= {BY_HOUR} GROUP BY 1),
b AS (SELECT trading_day AS day, count(*) AS m, count(*) FILTER (momentum20 > 0) AS mu FROM feat JOIN bd_timed n USING (stock_key, trading_day) WHERE momentum20 IS NOT NULL AND n.seen <= {BY_HOUR} GROUP BY 1),
x AS (SELECT d.trading_day AS day, CASE WHEN n >= 5 THEN 'bars' WHEN m >= 10 THEN 'momentum' END AS source, CASE WHEN n >= 5 THEN up / n WHEN m >= 10 THEN mu / m END AS breadth FROM d LEFT JOIN p ON p.day = d.trading_day LEFT JOIN b ON b.day = d.trading_day)
SELECT *, CASE WHEN breadth < 0.25 THEN 'bear' WHEN breadth < 0.4 THEN 'neutral' WHEN breadth IS NOT NULL THEN 'bull' ELSE 'neutral' END AS regime FROM x""")
def a_market_breadth(v):
    momentum = bf.momentum(v.bars_full, 20, "momentum20").where(visible_at("trading_day", "visible_at") <= by_hour("trading_day", RUN_HOUR))
    return mk.market_breadth(v.bars_full, momentum, RUN_HOUR, min_stocks=5)


@query("a_ingest_diagnostics", f"""SELECT source, count(*) AS raw, count(*) FILTER (quality >= 0.3) AS normalised, count(*) FILTER (quality >= 0.3 AND quality < 0.75) AS penalised FROM rated WHERE news_id IN (SELECT news_id FROM news WHERE published_at <= {ATS}) GROUP BY 1""")
def a_ingest_diagnostics(v):
    from ..operators.news import news_quality
    from .text import WORDS

    rated = news_quality(v.news, WORDS)
    normal = rated.where("quality >= 0.3").withColumn("weight", F.when(F.col("quality") < 0.75, 0.15).otherwise(1.0))
    return au.ingest_diagnostics(v.news, normal, at_())


@query("a_fact_verify", f"SELECT count(*) AS facts, count(DISTINCT stock_key) AS stocks, count(DISTINCT keyword) AS keywords, count(*) >= 100 AS enough FROM facts WHERE {VALID}")
def a_fact_verify(v):
    return au.verify_facts(v.facts, at_(), 100)


@query("a_fact_fingerprint", f"SELECT exposure_type AS kind, count(*) AS \"rows\" FROM facts WHERE {VALID} GROUP BY 1 UNION ALL SELECT 'alias', count(*) FROM nation")
def a_fact_fingerprint(v):
    """The counts are checked by SQL; the hashes are left to order-independence tests."""
    aliases = v.table("nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").cast("string").alias("canonical"))
    return au.fact_fingerprint(v.facts, aliases, at_()).select("kind", "rows")


@query("a_fact_freshness", f"SELECT count(*) AS facts, count(DISTINCT stock_key) AS stocks, max(valid_from) AS newest, CAST(floor((epoch({ATS}) - epoch(max(valid_from))) / 86400) AS BIGINT) AS age_days, count(*) >= 100 AND floor((epoch({ATS}) - epoch(max(valid_from))) / 86400) <= 30 AS fresh FROM facts WHERE {VALID}")
def a_fact_freshness(v):
    return au.fact_freshness(v.facts, at_(), 100, 30)


@query("a_bar_preflight", "SELECT industry, max(trading_day) AS latest_day, DATE '2000-01-14' AS expected_day, date_diff('day', max(trading_day), DATE '2000-01-14') AS gap_days, max(trading_day) < DATE '2000-01-14' AS stale FROM bars JOIN stocks USING (stock_key) WHERE trading_day <= DATE '2000-01-16' GROUP BY 1")
def a_bar_preflight(v):
    rows = v.bars.join(v.stocks.select("stock_key", "industry"), "stock_key")
    return au.bar_preflight(rows, ["industry"], F.lit("2000-01-16").cast("date"))


@query("a_gap_reasons", """WITH c AS (SELECT stock_key, trading_day AS day FROM feat WHERE day_change >= 0.095 UNION ALL SELECT stock_key + 1000000, trading_day FROM feat WHERE day_change >= 3),
r AS (SELECT run_id, stock_key, CAST(as_of AS DATE) AS day, rnk, final_score FROM recs),
e AS (SELECT r.stock_key, r.day, count(*) AS n FROM evidence x JOIN r USING (run_id, stock_key) WHERE match_confidence >= 0.6 GROUP BY 1, 2), s AS (SELECT stock_key, day, max(final_score) AS score FROM r GROUP BY 1, 2)
SELECT c.stock_key, c.day, CASE WHEN st.stock_key IS NULL THEN 'not_in_stock_pool' WHEN e.n IS NULL THEN 'no_evidence_chain' WHEN score IS NULL OR score < 60 THEN 'score_too_low' ELSE 'filtered_out' END AS reason
FROM c LEFT JOIN stocks st ON st.stock_key = c.stock_key LEFT JOIN e ON e.stock_key = c.stock_key AND e.day = c.day LEFT JOIN s ON s.stock_key = c.stock_key AND s.day = c.day
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.stock_key = c.stock_key AND r.day = c.day AND rnk = 1)""")
def a_gap_reasons(v):
    moves = bf.momentum(v.bars, 1, "day_change").select("stock_key", F.col("trading_day").alias("day"), "day_change")
    cases = moves.where("day_change >= 0.095").unionByName(moves.where("day_change >= 3").withColumn("stock_key", F.col("stock_key") + 1000000))
    recs = v.recs.withColumn("day", F.to_date("as_of"))
    chain = v.evidence.where("match_confidence >= 0.6").join(recs.select("run_id", "stock_key", "day"), ["run_id", "stock_key"])
    return au.coverage_gaps(cases, recs.where("rnk = 1"), chain, recs.withColumn("score", dbl("final_score")), v.stocks)


@query("a_latency_stats", """WITH w AS (SELECT event_type, value, event_id % 13 <> 0 AS ok FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00')
SELECT event_type, count(*) AS requests, count(*) FILTER (NOT ok) AS errors, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_ms, quantile_disc(value, 0.95) AS p95_ms FROM w GROUP BY 1""")
def a_latency_stats(v):
    log = v.table("events").select("event_type", F.col("value").alias("duration_ms"), (F.col("event_id") % 13 != 0).alias("ok"),
                                   F.col("ts").cast("timestamp").alias("created_at"))
    return au.latency_stats(log, instant("2024-01-20 00:00:00"), 10 * 24 * 60, ["event_type"])


@query("a_shard_completeness", """SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_linenumber) AS distinct_parts, CAST(min(l_linenumber) - 1 AS BIGINT) AS first, CAST(max(l_linenumber) - 1 AS BIGINT) AS last,
 count(*) = count(DISTINCT l_linenumber) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1""")
def a_shard_completeness(v):
    parts = v.table("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("index"))
    return au.complete_sets(parts, "l_orderkey", "index")


@query("a_run_overview", """SELECT r.run_id, ok, pending, events, tokens, cost FROM (SELECT l_orderkey AS run_id, count(*) FILTER (l_linestatus = 'F') AS ok, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1) r
LEFT JOIN (SELECT l_orderkey AS run_id, count(*) AS events, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) e USING (run_id)""")
def a_run_overview(v):
    lines = v.table("lineitem")
    steps = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("status"))
    events = lines.where("l_returnflag <> 'N'").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_quantity").cast("bigint").alias("tokens"), F.col("l_extendedprice").alias("cost"))
    return au.run_overview(steps, events, ["F", "O"]).select("run_id", F.col("F").alias("ok"), F.col("O").alias("pending"), "events", "tokens", "cost")


@query("a_run_phases", """SELECT l_orderkey AS run_id, l_returnflag AS phase, count(*) AS steps, count(*) FILTER (l_linestatus = 'F') AS ok, count(*) FILTER (l_linestatus = 'O') AS pending,
 min(l_linenumber)::BIGINT AS first, max(l_linenumber)::BIGINT AS last FROM lineitem GROUP BY 1, 2""")
def a_run_phases(v):
    steps = v.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("phase"), F.col("l_linestatus").alias("status"),
                                       F.col("l_linenumber").alias("position"))
    return au.run_phases(steps, ["F", "O"]).withColumnsRenamed({"F": "ok", "O": "pending"})


@query("a_event_counts", """SELECT l_returnflag AS type, l_linestatus AS level, count(*) AS events, count(DISTINCT l_orderkey) AS runs FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def a_event_counts(v):
    return au.event_counts(v.table("lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("level")))


@query("a_modal_day", "SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def a_modal_day(v):
    return au.modal_day(v.table("lineitem").select(F.to_date("l_shipdate").alias("d")), "d")


@query("d_quality_audit", """WITH x AS (SELECT *, CASE WHEN stock_key % 3 <> 0 AND (volume // 100) % 7 <> 0 THEN lag(trading_day) OVER (PARTITION BY stock_key ORDER BY trading_day) ELSE trading_day END AS latest_day, CASE WHEN stock_key % 17 = 0 THEN '40/25/15/20' ELSE '45/20/15/20' END AS weights, volume % 700 = 0 AS saturated, day_change * 100 AS change_pct FROM gated_input)
SELECT stock_key AS run_id, CAST(date_diff('day', DATE '1970-01-01', trading_day) AS BIGINT) AS stock_key, issue, level FROM (SELECT stock_key, trading_day, unnest([
 CASE WHEN weights <> '45/20/15/20' THEN {'issue': 'weight_mismatch', 'level': 'error'} END,
 CASE WHEN latest_day < trading_day THEN {'issue': 'stale_market_signal', 'level': 'error'} END,
 CASE WHEN evidence_score < 10 AND graph_score >= 12 THEN {'issue': 'graph_dominated', 'level': 'warn'} END,
 CASE WHEN exposure_score < 4 AND NOT (evidence_score >= 18 AND market_score >= 8) THEN {'issue': 'broad_exposure', 'level': 'warn'} END,
 CASE WHEN (coalesce(momentum5, 0) >= 0.15 OR coalesce(momentum20, 0) >= 0.25) AND NOT (coalesce(volume_ratio, 0) >= 1 AND breakout = 1) THEN {'issue': 'overheated', 'level': 'warn'} END,
 CASE WHEN momentum20 <= -0.12 AND coalesce(volume_ratio, 0) < 0.8 THEN {'issue': 'low_volume_rebound', 'level': 'warn'} END,
 CASE WHEN saturated THEN {'issue': 'keyword_saturated', 'level': 'info'} END, CASE WHEN change_pct < 0 THEN {'issue': 'post_return', 'level': 'info'} END]) AS i FROM x), LATERAL (SELECT i.issue AS issue, i.level AS level) WHERE i IS NOT NULL""")
def d_quality_audit(v):
    """Every stock-day stands for a recommendation; the stock is the run and the day number the row.

    A bar that comes a day or more late leaves the recommendation with the bar before, which is stale on that market day.
    """
    late = (F.col("stock_key") % 3 != 0) & (F.floor(F.col("volume") / 100) % 7 != 0)
    before = F.lag("trading_day").over(Window.partitionBy("stock_key").orderBy("trading_day"))
    rows = candidates(v).withColumn("latest_day", F.when(late, before).otherwise(F.col("trading_day"))).select(
        F.col("stock_key").alias("run_id"), F.datediff("trading_day", F.lit("1970-01-01").cast("date")).cast("bigint").alias("stock_key"),
        F.when(F.col("stock_key") % 17 == 0, "40/25/15/20").otherwise("45/20/15/20").alias("weights"), "stale_days",
        "latest_day", F.col("trading_day").alias("latest_market_day"), "evidence_score", "graph_score",
        "exposure_score", "market_score", "momentum5", "momentum20", "volume_ratio", "breakout",
        (F.col("volume") % 700 == 0).alias("saturated"), (F.col("day_change") * 100).alias("change_pct"))
    return au.quality_issues(rows)
