"""Selection, ordering and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timekeys as tk
from ..functions.numbers import dbl, fixed
from ..operators import bar_features as bf
from ..operators import gates, lookups
from ..operators import selection as sel
from ..operators import settlement as st
from ..plans import reports
from ..session import written
from .registry import query, rnd, view
from .settlement import profits, settled
from .temporal import BY_HOUR, RUN_HOUR, candidates



def gated(v):
    return gates.apply_gates(candidates(v)).select(
        "stock_key", "trading_day", F.col("industry").alias("theme"), "sector", (F.col("market_score") + F.col("evidence_score")).alias("score"), "failed_gate")


def passed(v):
    return gated(v).where("failed_gate is null").drop("failed_gate")


TOPK = """SELECT *, row_number() OVER (PARTITION BY trading_day ORDER BY score DESC, stock_key) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY trading_day, theme ORDER BY score DESC, stock_key) AS t FROM passed) WHERE t <= 1 QUALIFY rank <= 5"""
view("passed2", "SELECT stock_key, trading_day, industry AS theme, market_score + evidence_score AS score FROM gated WHERE failed_gate IS NULL")
view("picked", TOPK.replace("passed)", "passed2)"))


def capped(rows):
    return sel.capped_topk(rows, ["trading_day"], "theme", [F.desc("score"), F.asc("stock_key")], 1, 5)


@query("k_capped_topk", "SELECT trading_day, stock_key, theme, score, rank FROM picked")
def k_capped_topk(v):
    return capped(passed(v)).select("trading_day", "stock_key", "theme", "score", "rank")


ROW = "STRUCT(n BIGINT, theme VARCHAR, industry VARCHAR)[]"
FITS = "len(chosen) < 30 AND len(list_filter(chosen, lambda c: c.theme = r.theme)) < 3 AND (r.industry IS NULL OR len(list_filter(chosen, lambda c: c.industry = r.industry)) < 6)"


@query("k_diverse_topk", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY score DESC, key) AS n FROM (
 SELECT strftime(trading_day, '%Y-%m') AS month, concat_ws('-', lpad(CAST(stock_key AS VARCHAR), 12, '0'), strftime(trading_day, '%Y-%m-%d')) AS key, g.industry AS theme, s.sector AS industry,
  market_score + evidence_score AS score FROM gated g JOIN stocks s USING (stock_key) WHERE failed_gate IS NULL)),
walk AS (SELECT month, count(DISTINCT industry) AS industries, 0::BIGINT AS n, []::{ROW} AS chosen, []::{ROW} AS aside FROM r GROUP BY month
 UNION ALL SELECT month, industries, n, CASE WHEN fits AND NOT waits THEN list_append(chosen, x) ELSE chosen END, CASE WHEN fits AND waits THEN list_append(aside, x) ELSE aside END FROM (
  SELECT w.month, industries, r.n, chosen, aside, struct_pack(n := r.n, theme := r.theme, industry := r.industry) AS x, {FITS} AS fits,
   len(list_filter(chosen, lambda c: c.industry = r.industry)) > 0 AND (len(chosen) < 5 OR len(list_distinct(list_filter(list_transform(chosen, lambda c: c.industry), lambda i: i IS NOT NULL))) < industries) AS waits
  FROM walk w JOIN r ON r.month = w.month AND r.n = w.n + 1)),
back AS (SELECT month, aside, chosen, 0::BIGINT AS n FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC) = 1)
 UNION ALL SELECT month, aside, CASE WHEN {FITS} THEN list_append(chosen, r) ELSE chosen END, n FROM (SELECT month, aside, chosen, aside[n + 1] AS r, n + 1 AS n FROM back WHERE n < len(aside)))
SELECT month, key, theme, industry, score, rank FROM (SELECT month, unnest(chosen) AS c, generate_subscripts(chosen, 1) AS rank FROM (
 SELECT * FROM back QUALIFY row_number() OVER (PARTITION BY month ORDER BY n DESC) = 1)) b JOIN r USING (month) WHERE r.n = c.n""")
def k_diverse_topk(v):
    """Selection per market month, so that groups hold many candidates."""
    rows = passed(v).select(
        F.date_format("trading_day", "yyyy-MM").alias("month"), F.concat_ws("-", F.lpad(F.col("stock_key").cast("string"), 12, "0"), "trading_day").alias("key"),
        "theme", F.col("sector").alias("industry"), "score")
    return sel.diverse_topk(written(rows, "passed"), "month", limit=30, cap=3, top_n=5)


@query("k_topn_per_key", "SELECT keyword, stock_key, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY confidence DESC, fact_id) AS rank FROM facts) WHERE rank <= 6")
def k_topn_per_key(v):
    from ..operators.latest import topn

    return topn(v.facts, ["keyword"], [F.desc("confidence"), F.asc("fact_id")], 6).select("keyword", "stock_key", "fact_id", "rank")


view("surges", f"""WITH d AS (SELECT trading_day, lag(trading_day) OVER (ORDER BY trading_day) AS pd FROM (SELECT DISTINCT trading_day FROM bd)),
p AS (SELECT n.stock_key, n.trading_day AS latest_day, n.close, n.close / p.close - 1 AS gain, CAST(n.volume AS DOUBLE) / p.volume AS ratio, p.volume AS pv FROM bd_timed n JOIN d USING (trading_day) JOIN bd_timed p ON p.stock_key = n.stock_key AND p.trading_day = d.pd WHERE n.seen <= {BY_HOUR} AND p.seen <= {BY_HOUR} AND n.close > 0 AND p.close > 0 AND p.volume > 0)
SELECT p.stock_key, latest_day, gain, ratio, greatest(55.0, least(95.0, 55.0::DOUBLE + (gain - 0.095::DOUBLE) * 250.0 + least(ratio - 1, 3.0) * 5.0)) AS score FROM p JOIN stocks s USING (stock_key)
WHERE s.symbol NOT LIKE '688%' AND upper(name) NOT LIKE '%ST%' AND NOT regexp_matches(name, '^[NC]') AND gain >= 0.095 AND ratio >= 1.2 AND close <= 40""")


def surges(v):
    return sel.surge_candidates(lookups.market_day_pairs(v.bars_full, RUN_HOUR), v.stocks, ["latest_day"])


@query("k_surge_topk", "SELECT stock_key, latest_day, gain, ratio, score, row_number() OVER (PARTITION BY latest_day ORDER BY score DESC, stock_key) AS rank FROM surges QUALIFY rank <= 24")
def k_surge_topk(v):
    return surges(v).select("stock_key", "latest_day", "gain", "ratio", "score", "rank")


@query("u_channels", """SELECT stock_key, day, score, channel FROM (SELECT stock_key, trading_day AS day, score, 'evidence' AS channel FROM passed2 UNION ALL
 SELECT stock_key, latest_day, score, 'surge' FROM (SELECT *, row_number() OVER (PARTITION BY latest_day ORDER BY score DESC, stock_key) AS rank FROM surges) WHERE rank <= 24)
QUALIFY row_number() OVER (PARTITION BY stock_key, day ORDER BY score DESC, channel) = 1""")
def u_channels(v):
    a = passed(v).select("stock_key", F.col("trading_day").alias("day"), "score")
    b = surges(v).select("stock_key", F.col("latest_day").alias("day"), "score")
    return sel.union_channels(a, b, ["stock_key", "day"])


@query("k_sort_nulls_last", """SELECT run_id, stock_key, rnk, return_5, row_number() OVER (ORDER BY return_5 DESC NULLS LAST, rnk, run_id, stock_key) AS position FROM profits""")
def k_sort_nulls_last(v):
    """All profit rows with their place in the null-last order."""
    rows = profits(v).select("run_id", "stock_key", "rnk", "return_5")
    return sel.positions(rows, [F.desc_nulls_last("return_5"), F.asc("rnk"), F.asc("run_id"), F.asc("stock_key")])


WEIGHT = "0.7::DOUBLE * contribution + 0.3::DOUBLE * coalesce(match_confidence, 0.0)"


@query("k_weighted_top4", f"SELECT run_id, stock_key, row_number() OVER (PARTITION BY run_id, stock_key ORDER BY {WEIGHT} DESC, evidence_id) AS rank, coalesce(matched_keyword, keyword) AS node, {WEIGHT} AS weight, evidence_id FROM evidence QUALIFY rank <= 4")
def k_weighted_top4(v):
    return sel.evidence_network(v.evidence)


view("ordered_evidence", """SELECT e.*, row_number() OVER (PARTITION BY run_id, stock_key ORDER BY contribution DESC, match_confidence DESC NULLS LAST, published_at DESC NULLS LAST, e.news_id, evidence_id) AS position FROM evidence e LEFT JOIN news n ON n.news_id = e.news_id""")


@query("k_evidence_order", 'SELECT run_id, stock_key, evidence_id, position, position = 1 AS "primary" FROM ordered_evidence')
def k_evidence_order(v):
    return sel.order_evidence(v.evidence, v.news).select("run_id", "stock_key", "evidence_id", "position", "primary")


@query("k_page", "SELECT evidence_id, contribution FROM evidence WHERE contribution < 0.8 OR (contribution = 0.8 AND evidence_id > '2') ORDER BY contribution DESC, evidence_id LIMIT 100")
def k_page(v):
    return sel.page(v.evidence.select("evidence_id", "contribution"), "contribution", "evidence_id", (0.8, "2"), 100)


GATES = ("stock", "gain", "loss", "price", "day_drop", "quality")


@query("a_selection_diagnostics", f"""WITH c AS (SELECT trading_day, count(*) AS candidates, count(*) FILTER (failed_gate IS NULL) AS eligible, {', '.join(f"count(*) FILTER (failed_gate = '{g}') AS excluded_{g}" for g in GATES)} FROM gated GROUP BY 1),
p AS (SELECT trading_day, count(*) AS selected, count(DISTINCT theme) AS themes FROM picked GROUP BY 1), o AS (SELECT c.*, coalesce(selected, 0) AS selected, coalesce(themes, 0) AS themes FROM c LEFT JOIN p USING (trading_day))
SELECT *, concat_ws(',', CASE WHEN selected < 5 AND eligible < 5 THEN 'too_few_candidates' END, CASE WHEN selected < 5 AND eligible > selected THEN 'theme_cap' END, {', '.join(f"CASE WHEN selected < 5 AND excluded_{g} > 0 THEN 'excluded_{g}' END" for g in GATES)}) AS shortfall FROM o""")
def a_selection_diagnostics(v):
    rows = written(gated(v), "gated")  # read for the counts and for the choice
    return sel.selection_diagnostics(rows, capped(rows.where("failed_gate is null")), "trading_day", "theme", 5, GATES)


COOLED = ("stock", "previous_stock", "previous_keyword")
PICK = "STRUCT(n BIGINT, theme VARCHAR, industry VARCHAR)[]"
THEME_FULL = "len(list_filter(chosen, lambda c: c.theme = r.theme)) >= 1"
INDUSTRY_FULL = "len(list_filter(chosen, lambda c: c.industry = r.industry)) >= 2"
view("told_recs", "SELECT tenant, CAST(as_of + INTERVAL '8' HOUR AS DATE) + 1 AS day, run_id, stock_key FROM recs WHERE run_id IN (SELECT run_id FROM publishes)")
view("tenant_pool", """SELECT concat_ws(' ', a.tenant, strftime(a.day, '%Y-%m-%d')) AS run, a.run_id, a.stock_key, s.industry AS theme, s.sector AS industry, final_score AS score,
 CASE WHEN symbol LIKE '688%' OR upper(name) LIKE '%ST%' THEN 'stock' WHEN t.stock_key IS NOT NULL THEN 'previous_stock' WHEN h.stock_key IS NOT NULL THEN 'previous_keyword' END AS failed_gate
 FROM (SELECT *, CAST(as_of + INTERVAL '8' HOUR AS DATE) AS day FROM recs) a JOIN stocks s ON s.stock_key = a.stock_key
 LEFT JOIN (SELECT DISTINCT tenant, day, stock_key FROM told_recs) t ON t.tenant = a.tenant AND t.day = a.day AND t.stock_key = a.stock_key
 LEFT JOIN (SELECT DISTINCT r.run_id, r.stock_key FROM recs r JOIN words w ON w.run_id = r.run_id AND w.stock_key = r.stock_key JOIN (SELECT DISTINCT tenant, day, word FROM told_recs JOIN words USING (run_id, stock_key)) c
  ON c.tenant = r.tenant AND c.day = CAST(r.as_of + INTERVAL '8' HOUR AS DATE) AND c.word = w.word) h ON h.run_id = a.run_id AND h.stock_key = a.stock_key""")


def tally(column: str) -> str:
    names = f"list_filter(list_transform(chosen, lambda c: c.{column}), lambda x: x IS NOT NULL)"
    return f"array_to_string(list_transform(list_sort(list_distinct({names})), lambda x: concat(x, ':', len(list_filter({names}, lambda y: y = x)))), ',')"


@query("a_selection_report", f"""WITH RECURSIVE r AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY score DESC, run_id, stock_key) AS n, theme, industry FROM tenant_pool WHERE failed_gate IS NULL),
walk AS (SELECT run, count(DISTINCT industry) AS kinds, count(DISTINCT theme) AS themes, 0::BIGINT AS n, []::{PICK} AS chosen, []::{PICK} AS aside, 0::BIGINT AS by_theme, 0::BIGINT AS by_industry FROM r GROUP BY run
 UNION ALL SELECT run, kinds, themes, n, CASE WHEN fits AND NOT waits THEN list_append(chosen, x) ELSE chosen END, CASE WHEN fits AND waits THEN list_append(aside, x) ELSE aside END,
  by_theme + CASE WHEN theme_full THEN 1 ELSE 0 END, by_industry + CASE WHEN NOT theme_full AND industry_full THEN 1 ELSE 0 END FROM (SELECT *, NOT theme_full AND NOT industry_full AS fits FROM (
  SELECT w.run, kinds, themes, r.n, chosen, aside, by_theme, by_industry, struct_pack(n := r.n, theme := r.theme, industry := r.industry) AS x, {THEME_FULL} AS theme_full, {INDUSTRY_FULL} AS industry_full,
   len(list_filter(chosen, lambda c: c.industry = r.industry)) > 0 AND (len(chosen) < 2 OR len(list_distinct(list_transform(chosen, lambda c: c.industry))) < kinds) AS waits
  FROM walk w JOIN r ON r.run = w.run AND r.n = w.n + 1 WHERE len(chosen) < 5))),
back AS (SELECT run, kinds, themes, aside, chosen, by_theme, by_industry, len(chosen) AS early, 0::BIGINT AS dropped, 0::BIGINT AS n FROM (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1)
 UNION ALL SELECT run, kinds, themes, aside, CASE WHEN NOT theme_full AND NOT industry_full THEN list_append(chosen, r) ELSE chosen END, by_theme + CASE WHEN theme_full THEN 1 ELSE 0 END,
  by_industry + CASE WHEN NOT theme_full AND industry_full THEN 1 ELSE 0 END, early, dropped + CASE WHEN theme_full THEN 1 ELSE 0 END, n FROM (
  SELECT *, {THEME_FULL} AS theme_full, {INDUSTRY_FULL} AS industry_full FROM (SELECT run, kinds, themes, aside, chosen, by_theme, by_industry, early, dropped, aside[n + 1] AS r, n + 1 AS n FROM back WHERE n < len(aside) AND len(chosen) < 5))),
f AS (SELECT * FROM back QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC) = 1),
c AS (SELECT run, count(*) AS candidates, count(*) FILTER (failed_gate IS NULL) AS eligible, {', '.join(f"count(*) FILTER (failed_gate = '{g}') AS excluded_{g}" for g in COOLED)} FROM tenant_pool GROUP BY 1),
o AS (SELECT c.*, coalesce(len(chosen), 0) AS selected, coalesce(len(chosen) - early, 0) AS late, coalesce(by_theme, 0) AS skipped_theme_cap, coalesce(by_industry, 0) AS skipped_industry_cap,
 coalesce(len(aside) - (len(chosen) - early) - dropped, 0) AS skipped_diversity, coalesce(themes, 0) AS themes, coalesce(kinds, 0) AS eligible_industries,
 coalesce(len(list_distinct(list_transform(chosen, lambda c: c.industry))), 0) AS industries, coalesce({tally('theme')}, '') AS per_theme, coalesce({tally('industry')}, '') AS per_industry FROM c LEFT JOIN f USING (run))
SELECT *, CASE WHEN selected < 5 THEN concat_ws(',', CASE WHEN eligible = 0 THEN 'no_candidates' WHEN eligible < 5 THEN 'too_few_candidates' END, CASE WHEN themes < 5 THEN 'too_few_themes' END,
 CASE WHEN skipped_theme_cap > 0 THEN 'theme_cap' END, CASE WHEN skipped_diversity > 0 THEN 'diversity' END, CASE WHEN selected > 0 AND industries < least(eligible_industries, 5) THEN 'industry_coverage' END,
 {', '.join(f"CASE WHEN excluded_{g} > 0 THEN 'excluded_{g}' END" for g in COOLED)}) ELSE '' END AS shortfall FROM o""")
def a_selection_report(v):
    """Diversified selection over each tenant's recommendations of a local day, after the stock rule and the cooldowns."""
    published = v.recs.join(v.publishes.select("run_id"), "run_id", "left_semi")
    rows = lookups.cooldown_gate(v.recs, published, v.evidence).join(v.stocks, "stock_key")
    gated = rows.select(
        F.concat_ws(" ", "tenant", tk.local_day("as_of").cast("string")).alias("run"), F.struct("run_id", "stock_key").alias("key"),
        F.col("industry").alias("theme"), F.col("sector").alias("industry"), F.col("final_score").alias("score"),
        F.when(sel.barred(), "stock").otherwise(F.col("cooled")).alias("failed_gate"))
    return sel.selection_report(gated, "run", limit=5, cap=1, top_n=2, gates=COOLED)


CONFIGS = [{"strategy": "even"}, {"strategy": "market_led", "w_market": 2.0, "w_graph": 0.5, "max_price": 25.0, "cap": 1, "limit": 3},
           {"strategy": "strict", "min_score": 40.0, "max_gain": 0.05, "cap": 2, "limit": 5}]
CONF = "(VALUES ('even', 1.0::DOUBLE, 1.0::DOUBLE, 0.2::DOUBLE, 40.0::DOUBLE, NULL::DOUBLE, 30, 30), ('market_led', 2.0, 0.5, 0.2, 25.0, NULL, 1, 3), ('strict', 1.0, 1.0, 0.05, 40.0, 40.0, 2, 5)) c(strategy, wm, wg, mg, mp, ms, cap, lim)"


@query("d_strategy_grid", f"""WITH s AS (SELECT strategy, trading_day, stock_key, industry AS theme, cap, lim, ms, {rnd(f"greatest(0.0, least(100.0, {rnd('evidence_score * 1.0')} + {rnd('graph_score * wg')} + {rnd('exposure_score * 1.0')} + {rnd('market_score * wm')}))")} AS score
 FROM gated_input, {CONF} WHERE symbol NOT LIKE '688%' AND upper(name) NOT LIKE '%ST%' AND NOT coalesce(momentum5 > mg, false) AND close <= mp),
t AS (SELECT * FROM s WHERE NOT coalesce(score < ms, false) QUALIFY row_number() OVER (PARTITION BY strategy, trading_day, theme ORDER BY score DESC, stock_key) <= cap)
SELECT strategy, trading_day, stock_key, theme, score, row_number() OVER (PARTITION BY strategy, trading_day ORDER BY score DESC, stock_key) AS rank FROM t QUALIFY rank <= lim""")
def d_strategy_grid(v):
    return sel.run_strategies(candidates(v), CONFIGS, "trading_day")


@query("a_strategy_report", f"""WITH s AS (SELECT strategy, trading_day, stock_key, industry AS theme, cap, lim, {rnd(f"greatest(0.0, least(100.0, {rnd('evidence_score * 1.0')} + {rnd('graph_score * wg')} + {rnd('exposure_score * 1.0')} + {rnd('market_score * wm')}))")} AS score,
 CASE WHEN symbol LIKE '688%' OR upper(name) LIKE '%ST%' THEN 'stock' WHEN coalesce(momentum5 > mg, false) THEN 'gain' WHEN close > mp THEN 'price' END AS gate, ms FROM gated_input, {CONF}),
l AS (SELECT *, CASE WHEN gate IS NULL AND coalesce(score < ms, false) THEN 'score' ELSE gate END AS g FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY strategy, trading_day, theme ORDER BY score DESC, stock_key) <= cap AS fits FROM l WHERE g IS NULL),
n AS (SELECT *, sum(fits::INT) OVER (PARTITION BY strategy, trading_day ORDER BY score DESC, stock_key) AS upto FROM t),
p AS (SELECT strategy, trading_day, count(DISTINCT theme) AS themes, count(*) FILTER (NOT fits AND upto < lim) AS skipped_theme_cap, count(*) FILTER (fits AND upto <= lim) AS selected,
 max(score) FILTER (fits AND upto <= lim) AS best_score, min(score) FILTER (fits AND upto <= lim) AS last_score FROM n GROUP BY 1, 2),
c AS (SELECT strategy, trading_day, cap, lim, count(*) AS candidates, {', '.join(f"count(*) FILTER (g = '{g}') AS excluded_{g}" for g in ('stock', 'gain', 'price', 'score'))}, count(*) FILTER (g IS NULL) AS eligible FROM l GROUP BY 1, 2, 3, 4),
o AS (SELECT c.*, coalesce(themes, 0) AS themes, coalesce(skipped_theme_cap, 0) AS skipped_theme_cap, coalesce(selected, 0) AS selected, best_score, last_score FROM c LEFT JOIN p USING (strategy, trading_day))
SELECT * EXCLUDE (cap, lim), CASE WHEN selected < lim THEN concat_ws(',', CASE WHEN candidates < lim THEN 'too_few_candidates' END, CASE WHEN themes * cap < lim THEN 'too_few_themes' END,
 {', '.join(f"CASE WHEN excluded_{g} > 0 THEN 'excluded_{g}' END" for g in ('stock', 'gain', 'price', 'score'))}, CASE WHEN skipped_theme_cap > 0 THEN 'theme_cap' END) ELSE '' END AS shortfall FROM o""")
def a_strategy_report(v):
    return sel.strategy_report(candidates(v), CONFIGS, "trading_day")


view("shown", """SELECT CAST(as_of AS DATE) AS day, run_id FROM runs JOIN (SELECT run_id, count(*) AS n FROM recs GROUP BY run_id) c USING (run_id)
QUALIFY row_number() OVER (PARTITION BY CAST(as_of AS DATE) ORDER BY as_of DESC, status = 'SUCCESS' DESC, n DESC, run_id DESC) = 1""")
view("staged", """SELECT *, CASE WHEN rnk <= greatest(1, ceil(n * 0.3::DOUBLE)) THEN 'A' WHEN rnk <= greatest(greatest(1, ceil(n * 0.3::DOUBLE)) + 1, ceil(n * 0.7::DOUBLE)) THEN 'B' ELSE 'C' END AS stage FROM (SELECT r.*, s.day, count(*) OVER (PARTITION BY r.run_id) AS n FROM recs r JOIN shown s ON s.run_id = r.run_id)""")


@query("d_dashboard_snapshot", """SELECT t.day, t.run_id, t.stock_key, t.rnk, stage, CAST(b.close AS DOUBLE) AS close, coalesce(evidence_count, 0) AS evidence_count, total_contribution, win_rate_1
FROM staged t LEFT JOIN asof_rows a ON a.run_id = t.run_id AND a.stock_key = t.stock_key LEFT JOIN bars b ON b.stock_key = t.stock_key AND b.trading_day = a.day
LEFT JOIN evidence_stats e ON e.run_id = t.run_id AND e.stock_key = t.stock_key LEFT JOIN (SELECT stock_key, count(*) FILTER (y1 > 0) / nullif(count(y1), 0) AS win_rate_1 FROM (SELECT *, CASE WHEN CAST(visible_1 + INTERVAL '8' HOUR AS DATE) < DATE '2001-06-30' THEN yield_1 END AS y1 FROM settled WHERE run_id IN (SELECT run_id FROM publishes)
 AND CAST(as_of + INTERVAL '8' HOUR AS DATE) < DATE '2001-06-30' QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY as_of DESC, run_id DESC) <= 30) GROUP BY 1) w ON w.stock_key = t.stock_key""")
def d_dashboard_snapshot(v):
    rates = st.recent_win_rate(settled(v), v.publishes, F.lit("2001-06-30").cast("date")).select("stock_key", "win_rate_1")
    return reports.snapshot(v.recs, v.runs, v.evidence, v.bars_full, rates).select(
        "day", "run_id", "stock_key", "rnk", "stage", "close", "evidence_count", "total_contribution", "win_rate_1")


@query("d_daily_report", """SELECT t.day, t.run_id, t.stock_key, t.rnk, stage, keywords FROM staged t LEFT JOIN (SELECT run_id, stock_key, string_agg(coalesce(matched_keyword, keyword), ',' ORDER BY position) AS keywords FROM ordered_evidence WHERE position <= 3 GROUP BY 1, 2) k ON k.run_id = t.run_id AND k.stock_key = t.stock_key""")
def d_daily_report(v):
    return reports.daily_report(v.recs, v.runs, v.evidence, v.news)
