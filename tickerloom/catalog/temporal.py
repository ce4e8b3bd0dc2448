"""Point-in-time filter and predicate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import timekeys as tk
from ..functions.numbers import dbl
from ..operators import bar_features as bf
from ..operators import gates
from ..operators import temporal as tp
from .registry import query, view

def at_():
    return tk.instant("2000-01-15 16:00:00")

#: Hour of the day at which daily views are taken, the hour of the runs.
RUN_HOUR = 16
VIS = "coalesce(visible_at, CAST(trading_day AS TIMESTAMP) + INTERVAL '7' HOUR)"
BY_HOUR = f"CAST(n.trading_day AS TIMESTAMP) + INTERVAL '{RUN_HOUR}' HOUR"
view("bd_timed", f"SELECT b.*, {VIS.replace('visible_at', 'f.visible_at').replace('trading_day', 'f.trading_day')} AS seen FROM bd b JOIN bars_full f ON b.stock_key = f.stock_key AND b.trading_day = f.trading_day")


@query("t_visible_at", f"SELECT stock_key, trading_day, {VIS} AS visible FROM bars_full")
def t_visible_at(v):
    return v.bars_full.select("stock_key", "trading_day", tk.visible_at("trading_day", "visible_at").alias("visible"))


@query("t_bars_asof", f"""SELECT stock_key, trading_day, CAST(close AS DOUBLE) AS close FROM bars_full
WHERE trading_day BETWEEN DATE '1998-01-01' AND DATE '2000-01-15' AND {VIS} <= TIMESTAMP '2000-01-15 06:00:00'""")
def t_bars_asof(v):
    return tp.bars_as_of(v.bars_full, tk.instant("2000-01-15 06:00:00"), F.lit("1998-01-01").cast("date")).select(
        "stock_key", "trading_day", "close")


@query("t_version_filter", """SELECT 'all' AS filter, count(*) AS n FROM bars_full UNION ALL
SELECT 'unversioned', count(*) FROM bars_full WHERE dataset_version IS NULL UNION ALL SELECT 'v1999', count(*) FROM bars_full WHERE dataset_version = 'v1999'""")
def t_version_filter(v):
    def counted(label, df):
        return df.agg(F.lit(label).alias("filter"), F.count("*").alias("n"))

    b = v.bars_full
    return counted("all", tp.with_version(b)).unionByName(counted("unversioned", tp.with_version(b, None))).unionByName(
        counted("v1999", tp.with_version(b, "v1999")))


@query("t_latest_version", "SELECT max(dataset_version) AS dataset_version FROM bars_full")
def t_latest_version(v):
    versions = v.bars_full.groupBy("dataset_version").agg(F.max("trading_day").alias("imported_at"))
    return tp.latest_version(versions)


@query("t_valid_at", """SELECT fact_id, stock_key, keyword FROM facts WHERE status = 'active' AND valid_from <= TIMESTAMP '2000-01-15 16:00:00'
AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2000-01-15 16:00:00')""")
def t_valid_at(v):
    return tp.valid_at(v.facts, at_()).select("fact_id", "stock_key", "keyword")


@query("t_local_day", """SELECT news_id, CAST(published_at + INTERVAL '8' HOUR AS DATE) AS local_day,
 CAST(published_at + INTERVAL '8' HOUR AS DATE) - 1 AS previous_day, CAST(CAST(published_at + INTERVAL '8' HOUR AS DATE) AS TIMESTAMP) - INTERVAL '8' HOUR AS day_start FROM news""")
def t_local_day(v):
    day = tk.local_day("published_at")
    return v.news.select("news_id", day.alias("local_day"), F.date_sub(day, 1).alias("previous_day"),
                         tk.local_midnight(day).alias("day_start"))


@query("t_replay_split", f"""SELECT stock_key, trading_day, CASE WHEN trading_day <= DATE '2000-01-15' THEN 'base' ELSE 'future' END AS role FROM bars_full
WHERE CAST(trading_day AS TIMESTAMP) >= TIMESTAMP '1999-12-16 06:00:00' AND ((trading_day <= DATE '2000-01-15' AND {VIS} <= TIMESTAMP '2000-01-15 06:00:00')
 OR (trading_day > DATE '2000-01-15' AND {VIS} <= TIMESTAMP '2000-02-04 06:00:00'))""")
def t_replay_split(v):
    return tp.replay_split(v.bars_full, tk.instant("2000-01-15 06:00:00"), tk.instant("2000-06-01 00:00:00")).select(
        "stock_key", "trading_day", "role")


@query("t_admission", """SELECT dataset_version, count(*) AS bars, count(*) FILTER (adj_type IS NULL OR adj_type NOT IN ('hfq', 'none')) AS unknown_adjustment
FROM bars_full WHERE trading_day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' GROUP BY dataset_version""")
def t_admission(v):
    return tp.admission_report(v.bars_full, F.lit("1996-01-01").cast("date"), F.lit("2000-12-31").cast("date"))


@query("t_published_only", "SELECT run_id, stock_key, rnk FROM recs WHERE run_id IN (SELECT run_id FROM publishes)")
def t_published_only(v):
    return tp.published_only(v.recs, v.publishes).select("run_id", "stock_key", "rnk")


@query("t_direction_weight", "SELECT signal_id, CAST(CASE direction WHEN 'positive' THEN 1 WHEN 'mixed' THEN 0.35 WHEN 'negative' THEN -1 ELSE 0 END AS DOUBLE) AS weight FROM signals")
def t_direction_weight(v):
    return v.signals.select("signal_id", tp.direction_weight("direction").alias("weight"))


FACT_SOURCE = """CASE fact_id % 7 WHEN 0 THEN 'tickflow_sw_universe' WHEN 1 THEN 'akshare_industry_board_em' WHEN 2 THEN 'akshare_concept_board_em'
 WHEN 3 THEN 'akshare_individual_info_em' WHEN 4 THEN 'historical_limitup_news' WHEN 5 THEN '' ELSE 'tickflow_sw_universe' END"""


@query("t_source_rank", f"""SELECT fact_id, CAST(CASE WHEN source = 'historical_limitup_news' THEN -1 WHEN source = '' THEN -1
 WHEN source = 'tickflow_sw_universe' THEN CASE taxonomy_level WHEN 'SW3' THEN 100 WHEN 'SW2' THEN 90 WHEN 'SW1' THEN 80 ELSE 70 END
 WHEN source = 'akshare_industry_board_em' THEN 75 WHEN source = 'akshare_concept_board_em' THEN 65 ELSE 55 END AS BIGINT) AS rank
FROM (SELECT *, {FACT_SOURCE} AS source FROM facts)""")
def t_source_rank(v):
    return v.facts.withColumn("source", F.expr(FACT_SOURCE)).select(
        "fact_id", tp.source_rank(F.col("source"), F.col("exposure_type"), F.col("taxonomy_level")).alias("rank"))


LABEL = """CASE p_size % 10 WHEN 0 THEN '芯片设计' WHEN 1 THEN '港口航运' WHEN 2 THEN '航空装备' WHEN 3 THEN '数据中心' WHEN 4 THEN '白酒酿造'
 WHEN 5 THEN '磷肥' WHEN 6 THEN '智能机器人' WHEN 7 THEN '煤炭开采' WHEN 8 THEN '小家电' ELSE p_type END"""


@query("t_theme_bucket", f"""SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN '半导体' WHEN 1 THEN '航运交通' WHEN 2 THEN '国防军工' WHEN 3 THEN '算力通信' WHEN 4 THEN '食品农业'
 WHEN 5 THEN '化工材料' WHEN 6 THEN '机器人设备' WHEN 7 THEN '资源能源' WHEN 8 THEN '家电消费' ELSE p_type END AS theme FROM part""")
def t_theme_bucket(v):
    return v.table("part").select("p_partkey", tp.theme_bucket(F.expr(LABEL)).alias("theme"))


BOARD_SQL = """CASE WHEN upper(name) LIKE '*ST%' OR upper(name) LIKE 'ST%' THEN 'ST' WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN 'CHINEXT'
 WHEN symbol LIKE '68%' THEN 'STAR' WHEN symbol LIKE '8%' OR symbol LIKE '4%' OR symbol LIKE '9%' THEN 'BEIJING' ELSE 'MAIN' END"""


@query("t_limit_rule", f"""SELECT stock_key, board, CAST(CASE board WHEN 'ST' THEN 0.05 WHEN 'MAIN' THEN 0.1 WHEN 'BEIJING' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS limit_pct
FROM (SELECT stock_key, {BOARD_SQL} AS board FROM stocks)""")
def t_limit_rule(v):
    return v.stocks.select("stock_key", bf.limit_rule("symbol", "name").alias("r")).select("stock_key", "r.*")


@query("t_signal_prefilter", f"SELECT news_id FROM news WHERE regexp_matches(title || ' ' || content, '({K.PREFILTER_WORDS}|tion of|aux le)')")
def t_signal_prefilter(v):
    """The fixed words, plus two that occur in the generated languages."""
    return tp.has_business_variable(v.news, K.PREFILTER_WORDS + "|tion of|aux le").select("news_id")


CATEGORY = """CASE p_size % 6 WHEN 0 THEN 'stopword' WHEN 1 THEN 'high_signal' WHEN 2 THEN 'canonical' WHEN 3 THEN 'buzz_positive'
 WHEN 4 THEN 'buzz_negative' ELSE 'blocking' END"""


@query("t_dictionary_views", f"""SELECT category, CASE WHEN category = 'canonical' THEN p_type END AS grp, count(DISTINCT term) AS terms,
 max(length(term)) AS longest, arg_min(term, (-length(term), term)) AS first_term
FROM (SELECT *, {CATEGORY} AS category, concat(p_name, ' ', p_brand) AS term FROM part) WHERE p_size <> 7 GROUP BY 1, 2""")
def t_dictionary_views(v):
    return tp.dictionary_views(dictionary(v))


def dictionary(v):
    return v.table("part").select(
        F.expr(CATEGORY).alias("category"), F.concat_ws(" ", "p_name", "p_brand").alias("term"),
        F.col("p_type").alias("canonical_term"), F.when(F.col("p_size") == 7, "retired").otherwise("active").alias("status"))


@query("t_dictionary_terms", f"""SELECT DISTINCT category, CASE WHEN category = 'canonical' THEN p_type END AS grp, term, length(term) AS length
FROM (SELECT *, {CATEGORY} AS category, concat(p_name, ' ', p_brand) AS term FROM part) WHERE p_size <> 7""")
def t_dictionary_terms(v):
    return tp.dictionary_terms(dictionary(v))


view("gated_input", """SELECT s.*, st.symbol, st.name, st.industry, CAST((volume // 100) % 46 AS DOUBLE) AS evidence_score, CAST((volume // 100) % 21 AS DOUBLE) AS graph_score,
 CAST((volume // 100) % 16 AS DOUBLE) AS exposure_score, CASE WHEN day_change >= 0.095 AND volume_ratio >= 1.2 THEN 'surge' ELSE 'evidence' END AS channel
FROM scored s JOIN stocks st USING (stock_key)""")
view("gated", """SELECT *, CASE WHEN symbol LIKE '688%' OR upper(name) LIKE '%ST%' THEN 'stock'
 WHEN channel = 'evidence' AND momentum5 > 0.2 THEN 'gain' WHEN channel = 'evidence' AND (momentum5 < -0.1 OR momentum20 < -0.15) THEN 'loss'
 WHEN close > 40 THEN 'price' WHEN day_change < -0.03 THEN 'day_drop'
 WHEN channel = 'evidence' AND (coalesce(momentum120 <= -0.3, false) OR (evidence_score < 10 AND graph_score >= 12) OR (exposure_score < 4 AND NOT (evidence_score >= 18 AND market_score >= 8))
  OR ((coalesce(momentum5, 0) >= 0.15 OR coalesce(momentum20, 0) >= 0.25) AND NOT (coalesce(volume_ratio, 0) >= 1 AND breakout = 1))
  OR (coalesce(momentum20 <= -0.12, false) AND coalesce(volume_ratio, 0) < 0.8)) THEN 'quality' END AS failed_gate FROM gated_input""")


def candidates(v):
    """Every stock on every day as a selection candidate; component scores derive from its volume."""
    lots = (F.col("volume") / 100).cast("bigint")
    return (
        bf.market_score(v.bars).join(v.stocks, "stock_key")
        .withColumn("close", dbl("close"))
        .withColumn("evidence_score", (lots % 46).cast("double"))
        .withColumn("graph_score", (lots % 21).cast("double"))
        .withColumn("exposure_score", (lots % 16).cast("double"))
        .withColumn("stale_days", F.lit(0))
        .withColumn("channel", F.when((F.col("day_change") >= K.SURGE_MIN_GAIN) & (F.col("volume_ratio") >= K.SURGE_MIN_RATIO),
                                      "surge").otherwise("evidence"))
    )


@query("t_selection_gates", "SELECT stock_key, trading_day, channel, failed_gate FROM gated")
def t_selection_gates(v):
    return gates.apply_gates(candidates(v)).select("stock_key", "trading_day", "channel", "failed_gate")


@query("t_return_filter", """SELECT stock_key, trading_day, symbol, "return" FROM (SELECT stock_key, trading_day, day_change AS "return", symbol, name FROM feat JOIN stocks USING (stock_key))
WHERE "return" < 0 AND (symbol ILIKE '%00%' OR name ILIKE '%00%')""")
def t_return_filter(v):
    rows = bf.momentum(v.bars, 1, "return").join(v.stocks, "stock_key")
    return tp.return_filter(rows, "loss", "00").select("stock_key", "trading_day", "symbol", "return")
