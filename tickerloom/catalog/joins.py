"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..functions.numbers import dbl
from ..operators import asof, bar_features as bf, lookups
from .registry import query, rnd, view

EFF = "greatest(CAST(trading_day AS TIMESTAMP), coalesce(visible_at, CAST(trading_day AS TIMESTAMP) + INTERVAL '7' HOUR))"

view("bars_eff", f"SELECT *, {EFF} AS eff FROM bars_full")
view("asof_rows", """SELECT r.run_id, r.stock_key, max(b.trading_day) AS day FROM recs r LEFT JOIN bars_eff b ON r.stock_key = b.stock_key AND b.eff <= r.as_of GROUP BY 1, 2""")


@query("j_asof_latest", """SELECT a.run_id, a.stock_key, a.day AS bar_day, CAST(b.close AS DOUBLE) AS bar_close FROM asof_rows a LEFT JOIN bars b ON a.stock_key = b.stock_key AND a.day = b.trading_day""")
def j_asof_latest(v):
    out = asof.latest_bar(v.recs, v.bars_full, F.col("as_of"), ["close"])
    return out.select("run_id", "stock_key", F.col("bar.trading_day").alias("bar_day"), F.col("bar.close").alias("bar_close"))


view("bars_ahead", """SELECT stock_key, trading_day, close, trading_status,
 lead(trading_day, 1) OVER w AS d1, lead(close, 1) OVER w AS c1, lead(trading_status, 1) OVER w AS s1, lead(trading_day, 3) OVER w AS d3, lead(close, 3) OVER w AS c3, lead(trading_status, 3) OVER w AS s3,
 lead(trading_day, 5) OVER w AS d5, lead(close, 5) OVER w AS c5, lead(trading_status, 5) OVER w AS s5 FROM bars_full WINDOW w AS (PARTITION BY stock_key ORDER BY trading_day)""")


@query("j_nth_after", """SELECT a.run_id, a.stock_key, a.day AS base_day, CASE WHEN d1 <= DATE '2000-12-31' THEN CAST(c1 AS DOUBLE) END AS t1, CASE WHEN d3 <= DATE '2000-12-31' THEN CAST(c3 AS DOUBLE) END AS t3,
 CASE WHEN d5 <= DATE '2000-12-31' THEN d5 END AS t5_day, CASE WHEN d5 <= DATE '2000-12-31' THEN CAST(c5 AS DOUBLE) END AS t5
FROM asof_rows a LEFT JOIN bars_ahead b ON a.stock_key = b.stock_key AND a.day = b.trading_day""")
def j_nth_after(v):
    out = asof.nth_after(v.recs, v.bars_full, F.col("as_of"), [1, 3, 5], F.lit("2000-12-31").cast("date"))
    return out.select("run_id", "stock_key", F.col("base.trading_day").alias("base_day"), F.col("base.close_1").alias("t1"),
                      F.col("base.close_3").alias("t3"), F.col("base.trading_day_5").alias("t5_day"), F.col("base.close_5").alias("t5"))


view("status_history", """SELECT stock_key, effective_from, is_st, n_name AS industry FROM (SELECT l_suppkey AS stock_key, date_trunc('quarter', CAST(l_shipdate AS TIMESTAMP)) AS effective_from, max(l_returnflag) = 'R' AND count(*) % 2 = 0 AS is_st, max(l_partkey) % 25 AS nk
 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-04-01 00:00:00' GROUP BY 1, 2) JOIN nation ON n_nationkey = nk""")


def status_history(v):
    """Quarterly status rows per stock, starting in the second quarter of 1996."""
    rows = v.table("lineitem").where(F.col("l_shipdate") >= F.lit("1996-04-01").cast("timestamp_ntz")).groupBy(
        F.col("l_suppkey").alias("stock_key"), F.date_trunc("quarter", F.col("l_shipdate").cast("timestamp")).alias("effective_from")).agg(
        ((F.max("l_returnflag") == "R") & (F.count("*") % 2 == 0)).alias("is_st"), (F.max("l_partkey") % 25).alias("nk"))
    return rows.join(v.table("nation"), F.col("nk") == F.col("n_nationkey")).select(
        "stock_key", "effective_from", "is_st", F.col("n_name").alias("industry"))


@query("j_status_asof", """SELECT r.run_id, r.stock_key, h.effective_from, h.is_st, h.industry, h.effective_from IS NULL AS coverage_gap
FROM recs r ASOF LEFT JOIN status_history h ON r.stock_key = h.stock_key AND r.as_of >= h.effective_from""")
def j_status_asof(v):
    rows = v.recs.select("run_id", "stock_key", "as_of")
    return asof.status_as_of(rows, status_history(v), F.col("as_of")).drop("as_of")


VALID = "status = 'active' AND valid_from <= TIMESTAMP '2000-01-15 16:00:00' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2000-01-15 16:00:00')"


@query("j_theme_members", f"SELECT DISTINCT keyword, stock_key FROM facts WHERE {VALID} AND keyword IN (SELECT keyword FROM signals)")
def j_theme_members(v):
    return lookups.theme_members(v.signals, v.facts, tk.instant("2000-01-15 16:00:00"))


@query("j_evidence_detail", """SELECT evidence_id, n.source, length(n.title) AS title_length, f.exposure_type, f.taxonomy_level, r.rnk, e.contribution
FROM evidence e LEFT JOIN news n ON e.news_id = n.news_id LEFT JOIN facts f ON e.fact_id = f.fact_id LEFT JOIN recs r ON e.run_id = r.run_id AND e.stock_key = r.stock_key
WHERE e.run_id IN (SELECT run_id FROM publishes)""")
def j_evidence_detail(v):
    return lookups.evidence_detail(v.evidence, v.news, v.facts, v.recs, v.publishes).select(
        "evidence_id", "source", "title_length", "exposure_type", "taxonomy_level", "rnk", "contribution")


view("evidence_stats", """SELECT run_id, stock_key, count(*) AS evidence_count, count(*) FILTER (match_confidence >= 0.8) AS confident_count,
 CAST(sum(CAST(match_confidence AS DECIMAL(10,4))) AS DOUBLE) / count(match_confidence) AS mean_confidence, CAST(sum(CAST(contribution AS DECIMAL(12,4))) AS DOUBLE) AS total_contribution FROM evidence GROUP BY 1, 2""")


@query("j_evidence_stats", """SELECT r.run_id, r.stock_key, rnk, coalesce(evidence_count, 0) AS evidence_count, coalesce(confident_count, 0) AS confident_count,
 CASE WHEN isnan(mean_confidence) THEN NULL ELSE mean_confidence END AS mean_confidence, total_contribution
FROM recs r LEFT JOIN evidence_stats s ON r.run_id = s.run_id AND r.stock_key = s.stock_key""")
def j_evidence_stats(v):
    return lookups.evidence_stats(v.recs, v.evidence).select(
        "run_id", "stock_key", "rnk", "evidence_count", "confident_count", "mean_confidence", "total_contribution")


view("words", "SELECT DISTINCT run_id, stock_key, word FROM (SELECT run_id, stock_key, keyword AS word FROM evidence UNION ALL SELECT run_id, stock_key, matched_keyword FROM evidence WHERE matched_keyword IS NOT NULL)")


@query("j_cooldown_anti", """WITH told AS (SELECT tenant, CAST(as_of + INTERVAL '8' HOUR AS DATE) + 1 AS day, run_id, stock_key FROM recs WHERE run_id IN (SELECT run_id FROM publishes)),
cooled AS (SELECT DISTINCT tenant, day, word FROM told JOIN words USING (run_id, stock_key)),
asked AS (SELECT *, CAST(as_of + INTERVAL '8' HOUR AS DATE) AS day FROM recs),
hit AS (SELECT DISTINCT a.run_id, a.stock_key FROM asked a JOIN words w ON a.run_id = w.run_id AND a.stock_key = w.stock_key JOIN cooled c ON c.tenant = a.tenant AND c.day = a.day AND c.word = w.word)
SELECT run_id, stock_key, day FROM asked a WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.tenant = a.tenant AND t.day = a.day AND t.stock_key = a.stock_key)
AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.run_id = a.run_id AND h.stock_key = a.stock_key)""")
def j_cooldown_anti(v):
    published = v.recs.join(v.publishes.select("run_id"), "run_id", "left_semi")
    return lookups.apply_cooldown(v.recs, published, v.evidence).select("run_id", "stock_key", "day")


@query("j_news_window", """WITH c AS (SELECT stock_key, trading_day FROM bars), n AS (SELECT published_at + INTERVAL '8' HOUR AS local FROM news),
w AS (SELECT trading_day, count(*) AS news_count FROM (SELECT DISTINCT trading_day FROM c) JOIN n ON local >= CAST(trading_day - 3 AS TIMESTAMP) AND local <= CAST(trading_day AS TIMESTAMP) + INTERVAL '15' HOUR GROUP BY 1)
SELECT stock_key, trading_day, coalesce(news_count, 0) AS news_count, coalesce(news_count, 0) = 0 AS news_missing FROM c LEFT JOIN w USING (trading_day)""")
def j_news_window(v):
    return lookups.news_window(v.bars.select("stock_key", "trading_day"), v.news).select(
        "stock_key", "trading_day", "news_count", "news_missing")


@query("j_prev_day_pair", """WITH d AS (SELECT trading_day, lag(trading_day) OVER (ORDER BY trading_day) AS previous_day FROM (SELECT DISTINCT trading_day FROM bd))
SELECT n.stock_key, n.trading_day AS latest_day, d.previous_day, n.close, p.close AS previous_close FROM bd n JOIN d USING (trading_day) JOIN bd p ON p.stock_key = n.stock_key AND p.trading_day = d.previous_day""")
def j_prev_day_pair(v):
    return lookups.market_day_pairs(v.bars).select("stock_key", "latest_day", "previous_day", "close", "previous_close")


@query("j_name_tiers", """WITH t AS (SELECT stock_key, name, 0 AS tier, 0.0 AS r FROM stocks WHERE name LIKE 'Supplier%' UNION ALL
 SELECT stock_key, p_name, 1, CAST(confidence AS DOUBLE) FROM facts JOIN part ON p_partkey = fact_id WHERE p_name LIKE '%ring%')
SELECT s.stock_key, name, CAST(tier AS BIGINT) AS tier FROM (SELECT stock_key FROM stocks) s LEFT JOIN (SELECT stock_key, name, tier FROM t QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY tier, r DESC, name) = 1) b USING (stock_key)""")
def j_name_tiers(v):
    listed = v.stocks.select("stock_key", "name", F.lit(0.0).alias("rank"))
    named = v.facts.join(v.table("part").select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("name")), "fact_id")
    return lookups.resolve_names(v.stocks.select("stock_key"), [listed, named.select("stock_key", "name", F.col("confidence").alias("rank"))],
                                 "^Supplier|ring")


@query("j_carry_forward", """WITH s AS (SELECT tenant, arg_max(run_id, (as_of, run_id)) AS run_id FROM runs WHERE status = 'SUCCESS' AND as_of < TIMESTAMP '2000-01-15 16:00:00' GROUP BY tenant)
SELECT CAST(-1 AS BIGINT) AS run_id, run_id AS source_run, stock_key, final_score FROM recs WHERE run_id IN (SELECT run_id FROM s)""")
def j_carry_forward(v):
    return lookups.carry_forward(v.recs, v.runs, F.lit(-1).cast("bigint"), tk.instant("2000-01-15 16:00:00")).select(
        "run_id", "source_run", "stock_key", "final_score")


@query("u_semi_members", "SELECT signal_id, news_id FROM signals WHERE keyword IN (SELECT keyword FROM facts)")
def u_semi_members(v):
    return lookups.members(v.signals, v.facts, "keyword").select("signal_id", "news_id")


@query("u_distinct_keywords", "SELECT run_id, stock_key, word FROM words")
def u_distinct_keywords(v):
    return lookups.keywords_of(v.evidence, ["run_id", "stock_key"])
