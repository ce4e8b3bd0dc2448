"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import dbl, fixed
from ..functions.timekeys import instant
from ..operators import bar_features as bf
from ..operators import latest, sessions
from ..operators.movement import movement_adjust
from .registry import query, rnd, view

KEY = ["stock_key", "trading_day"]
W = "OVER (PARTITION BY stock_key ORDER BY trading_day)"
P20 = "OVER (PARTITION BY stock_key ORDER BY trading_day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
L6 = "OVER (PARTITION BY stock_key ORDER BY trading_day ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
L60 = "OVER (PARTITION BY stock_key ORDER BY trading_day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)"


def change_sql(n: int) -> str:
    return f"CASE WHEN lag(close, {n}) {W} > 0 THEN (close - lag(close, {n}) {W}) / lag(close, {n}) {W} END"


view("share", "SELECT *, CASE WHEN close > 0 AND (high - low) / close > 0 THEN (high - low) / close END AS share FROM bd")
view("feat", f"""
SELECT stock_key, trading_day, open, high, low, close, volume, ord,
 {change_sql(1)} AS day_change, {change_sql(5)} AS momentum5, {change_sql(20)} AS momentum20, {change_sql(120)} AS momentum120,
 CAST(volume AS DOUBLE) / (CAST(sum(CASE WHEN volume > 0 THEN volume END) {P20} AS DOUBLE) / count(CASE WHEN volume > 0 THEN 1 END) {P20}) AS volume_ratio,
 max(high) {P20} AS previous_high,
 CAST(sum(CAST(close AS DECIMAL(18,4))) {P20} AS DOUBLE) / count(*) {P20} AS mean_close,
 avg(share) {L6} AS recent_range, avg(share) {P20} AS previous_range,
 max(high) {L60} AS high60, min(low) {L60} AS low60, count(*) {L60} AS n60 FROM share""")
view("feat2", """
SELECT *, CASE WHEN previous_high > 0 AND close >= previous_high THEN 1.0 WHEN previous_high > 0 AND close >= previous_high * 0.97 THEN 0.5 ELSE 0.0 END::DOUBLE AS breakout,
 coalesce(previous_range > 0 AND recent_range / previous_range <= 0.75 AND close >= mean_close, false) AS compressed,
 coalesce(close < mean_close * 0.95, false) AS low_zone,
 coalesce(close < mean_close * 0.95 AND volume_ratio > 1.2, false) AS accumulation,
 coalesce(close < mean_close * 0.95, false) AND coalesce(volume_ratio, 0) < 0.8 AS weak_rebound,
 CASE WHEN n60 >= 10 AND high60 > low60 THEN
  CASE WHEN abs(close - (high60 - 0.382::DOUBLE * (high60 - low60))) / close <= 0.015 THEN 0.382
   WHEN abs(close - (high60 - 0.5::DOUBLE * (high60 - low60))) / close <= 0.015 THEN 0.5
   WHEN abs(close - (high60 - 0.618::DOUBLE * (high60 - low60))) / close <= 0.015 THEN 0.618 END END::DOUBLE AS fib_level,
 CASE WHEN n60 >= 10 AND abs(close - low60) / close <= 0.015 THEN 'support' WHEN n60 >= 10 AND abs(close - high60) / close <= 0.015 THEN 'resistance' END AS touch
FROM feat""")
view("score_parts", """
SELECT *, CASE WHEN momentum5 IS NULL THEN 0.0 WHEN momentum5 > 0.1 THEN 0.2 WHEN accumulation THEN 1.0 WHEN weak_rebound THEN 0.1 WHEN low_zone THEN 0.6
   ELSE greatest(0.0, least(0.5, (0.05::DOUBLE - abs(momentum5)) / 0.05)) END AS s5,
  CASE WHEN momentum20 IS NULL THEN 0.0 WHEN momentum20 > 0.15 THEN 0.3 WHEN momentum20 < -0.05 AND low_zone THEN CASE WHEN weak_rebound THEN 0.2 ELSE 0.9 END
   ELSE greatest(0.0, least(0.6, (0.1::DOUBLE - abs(momentum20)) / 0.1)) END AS s20,
  coalesce(greatest(0.0, least(1.0, (volume_ratio - 1) / 1.5)), 0.0) AS sv FROM feat2""")
view("scored", f"""
SELECT *, CASE WHEN ord >= 6 THEN {rnd("greatest(0.0, least(20.0, ((6.0::DOUBLE * s5 + 5.0::DOUBLE * s20 + 4.0::DOUBLE * sv + 3.0::DOUBLE * breakout + 2.0::DOUBLE * compressed::INT) + 0.0::DOUBLE + 0.0::DOUBLE) / 20.0::DOUBLE * 20))")} ELSE 0.0 END AS market_score
FROM score_parts""")


@query("w_momentum", f"SELECT stock_key, trading_day, {change_sql(5)} AS momentum5, {change_sql(20)} AS momentum20 FROM bd")
def w_momentum(v):
    return bf.momentum(bf.momentum(v.bars, 5, "momentum5"), 20, "momentum20").select(*KEY, "momentum5", "momentum20")


@query("w_day_change", f"SELECT stock_key, trading_day, {change_sql(1)} AS day_change FROM bd")
def w_day_change(v):
    return bf.momentum(v.bars, 1, "day_change").select(*KEY, "day_change")


@query("w_volume_ratio", "SELECT stock_key, trading_day, volume_ratio FROM feat")
def w_volume_ratio(v):
    return bf.volume_ratio(v.bars).select(*KEY, "volume_ratio")


@query("w_breakout", "SELECT stock_key, trading_day, breakout FROM feat2")
def w_breakout(v):
    return bf.breakout(v.bars).select(*KEY, "breakout")


@query("w_compression", f"SELECT stock_key, trading_day, {rnd('recent_range', 8)} AS recent_range, {rnd('previous_range', 8)} AS previous_range, mean_close, compressed FROM feat2")
def w_compression(v):
    return bf.compression(v.bars).select(
        *KEY, fixed("recent_range", 8).alias("recent_range"), fixed("previous_range", 8).alias("previous_range"),
        "mean_close", "compressed")


@query("w_low_zone", "SELECT stock_key, trading_day, low_zone, accumulation, weak_rebound FROM feat2")
def w_low_zone(v):
    return bf.zone_flags(v.bars).select(*KEY, "low_zone", "accumulation", "weak_rebound")


@query("w_fibonacci", "SELECT stock_key, trading_day, fib_level FROM feat2")
def w_fibonacci(v):
    return bf.fib_hit(v.bars).select(*KEY, "fib_level")


@query("w_support_resistance", "SELECT stock_key, trading_day, touch FROM feat2")
def w_support_resistance(v):
    return bf.sr_touch(v.bars).select(*KEY, "touch")


@query("w_market_score", "SELECT stock_key, trading_day, market_score FROM scored")
def w_market_score(v):
    return bf.market_score(v.bars).select(*KEY, "market_score")


view("movement_facts", """
SELECT p_partkey AS fact_id, p_partkey % (SELECT count(*) FROM supplier) AS stock_key, p_name AS text, p_size,
 CASE WHEN contains(p_name, 'small') OR contains(p_name, 'ring') THEN -1 WHEN contains(p_name, 'red') OR contains(p_name, 'large') OR contains(p_name, 'widget') THEN 1 ELSE 0 END AS d,
 CAST(50 + p_size AS DOUBLE) / 100 AS confidence FROM part""")


@query("w_movement_adjust", f"""
SELECT s.stock_key, market_score, coalesce(adj, 0.0) AS movement, {rnd("greatest(0.0, least(20.0, market_score + coalesce(adj, 0.0)))")} AS adjusted
FROM (SELECT stock_key, market_score FROM scored QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY trading_day DESC) = 1) s
LEFT JOIN (SELECT stock_key, {rnd("greatest(-2.0, least(2.0, sum(CAST(a AS DECIMAL(10,4)))::DOUBLE))")} AS adj FROM (
  SELECT stock_key, {rnd("d * confidence * 0.8::DOUBLE")} AS a, row_number() OVER (PARTITION BY stock_key ORDER BY abs({rnd("d * confidence * 0.8::DOUBLE")}) DESC, confidence DESC, fact_id) AS rn
  FROM movement_facts) WHERE rn <= 3 GROUP BY stock_key) m ON s.stock_key = m.stock_key""")
def w_movement_adjust(v):
    part = F.col("p_partkey")
    facts = v.table("part").select(
        part.alias("fact_id"), (part % v.counts["supplier"]).alias("stock_key"), F.col("p_name").alias("text"),
        ((50 + F.col("p_size")) / F.lit(100.0)).alias("confidence"))
    scores = latest.best_per_key(bf.market_score(v.bars).select(*KEY, "market_score"), ["stock_key"],
                                 [F.desc("trading_day")])
    return movement_adjust(facts, ["red", "large", "widget"], ["small", "ring"], scores).select(
        "stock_key", "market_score", "movement", "adjusted")


SEEN = "trading_day <= DATE '2000-01-15' AND coalesce(visible_at, CAST(trading_day AS TIMESTAMP) + INTERVAL '7' HOUR) <= TIMESTAMP '2000-01-15 16:00:00'"
view("snaps", "SELECT stock_key, max(CAST(as_of AS DATE)) AS snap_day FROM recs WHERE as_of <= TIMESTAMP '2000-01-05 16:00:00' GROUP BY stock_key")


@query("w_freshness", f"""
WITH seen AS (SELECT stock_key, trading_day FROM bars_full WHERE {SEEN}),
per AS (SELECT stock_key, max(trading_day) AS latest_day, count(*) FILTER (trading_day > snap_day) AS newer_bars FROM seen JOIN snaps USING (stock_key) GROUP BY stock_key)
SELECT s.stock_key, snap_day, latest_day, coalesce(newer_bars, 0) AS newer_bars,
 CAST(CASE WHEN latest_day < (SELECT max(trading_day) FROM seen) THEN greatest(1, date_diff('day', latest_day, (SELECT max(trading_day) FROM seen))) ELSE 0 END AS BIGINT) AS stale_days
FROM snaps s LEFT JOIN per ON s.stock_key = per.stock_key""")
def w_freshness(v):
    snaps = v.recs.where(F.col("as_of") <= instant("2000-01-05 16:00:00")).groupBy("stock_key").agg(
        F.max(F.to_date("as_of")).alias("snap_day"))
    return latest.freshness(snaps, v.bars_full, instant("2000-01-15 16:00:00"))


@query("w_reuse_snapshot", """
WITH own AS (SELECT run_id, tenant, as_of, stock_key, final_score AS score FROM recs WHERE rnk <= 3),
newest AS (SELECT tenant, as_of, stock_key, run_id AS nrun, score AS nscore FROM own QUALIFY row_number() OVER (PARTITION BY tenant, as_of, stock_key ORDER BY run_id DESC) = 1)
SELECT r.run_id, r.stock_key, CASE WHEN s.score IS NOT NULL THEN r.run_id ELSE nrun END AS source_run, coalesce(s.score, nscore) AS score
FROM recs r LEFT JOIN own s ON r.run_id = s.run_id AND r.stock_key = s.stock_key LEFT JOIN newest n ON r.tenant = n.tenant AND r.as_of = n.as_of AND r.stock_key = n.stock_key
WHERE s.score IS NOT NULL OR nrun IS NOT NULL""")
def w_reuse_snapshot(v):
    snaps = v.recs.where("rnk <= 3").select("run_id", "tenant", "as_of", "stock_key", F.col("final_score").alias("score"),
                                            F.col("as_of").alias("created_at"))
    requests = v.recs.select("run_id", "tenant", "as_of", "stock_key")
    return latest.reusable_snapshots(requests, snaps).select("run_id", "stock_key", "source_run", "score")


@query("w_limit_up", f"""
WITH r AS (SELECT *, CASE WHEN upper(name) LIKE '*ST%' OR upper(name) LIKE 'ST%' THEN 'ST' WHEN symbol LIKE '300%' OR symbol LIKE '301%' THEN 'CHINEXT' WHEN symbol LIKE '68%' THEN 'STAR' WHEN symbol LIKE '8%' OR symbol LIKE '4%' OR symbol LIKE '9%' THEN 'BEIJING' ELSE 'MAIN' END AS board FROM stocks),
p AS (SELECT *, lag(close) OVER (PARTITION BY stock_key ORDER BY trading_day) AS pc FROM bd),
j AS (SELECT p.*, board, {rnd("pc * (1.0::DOUBLE + CASE board WHEN 'ST' THEN 0.05 WHEN 'MAIN' THEN 0.1 WHEN 'BEIJING' THEN 0.3 ELSE 0.2 END)", 2)} AS limit_price FROM p JOIN r USING (stock_key)
 WHERE pc > 0 AND trading_day >= (SELECT min(trading_day) FROM (SELECT DISTINCT trading_day FROM bd ORDER BY 1 DESC LIMIT 120)))
SELECT stock_key, trading_day, board, pc AS previous_close, limit_price, high >= limit_price - 0.0001 AS touched, close >= limit_price - 0.0001 AS sealed
FROM j WHERE high >= limit_price - 0.0001 OR close >= limit_price - 0.0001""")
def w_limit_up(v):
    return bf.limit_up_cases(v.bars, v.stocks).select(
        *KEY, "board", "previous_close", "limit_price", "touched", "sealed")


@query("w_latest_per_key", """
SELECT stock_key, trading_day, close, previous_close, CASE WHEN previous_close > 0 THEN (close - previous_close) / previous_close END AS change
FROM (SELECT *, lag(close) OVER (PARTITION BY stock_key ORDER BY trading_day) AS previous_close, row_number() OVER (PARTITION BY stock_key ORDER BY trading_day DESC) AS rn FROM bd) WHERE rn = 1""")
def w_latest_per_key(v):
    return bf.latest_quote(v.bars)


@query("w_best_per_key", """
SELECT run_id, stock_key, evidence_id, contribution FROM evidence
QUALIFY row_number() OVER (PARTITION BY run_id, stock_key ORDER BY contribution DESC, evidence_id) = 1""")
def w_best_per_key(v):
    return latest.best_per_key(v.evidence, ["run_id", "stock_key"], [F.desc("contribution"), F.asc("evidence_id")]).select(
        "run_id", "stock_key", "evidence_id", "contribution")


@query("w_streak", """
WITH d AS (SELECT l_suppkey AS stock_key, CAST(l_shipdate AS DATE) AS day, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2),
b AS (SELECT stock_key, sum(CASE WHEN q < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY stock_key ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS b FROM d)
SELECT stock_key, CAST(count(*) FILTER (b = 0) AS BIGINT) AS streak FROM b GROUP BY stock_key""")
def w_streak(v):
    daily = v.table("lineitem").groupBy(F.col("l_suppkey").alias("stock_key"), F.to_date("l_shipdate").alias("day")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return sessions.trailing_streak(daily, ["stock_key"], "day", F.col("q") < 30)


view("path", """
SELECT stock_key, trading_day, r, product(1.0::DOUBLE + r) OVER (PARTITION BY stock_key ORDER BY trading_day ROWS UNBOUNDED PRECEDING) AS equity
FROM (SELECT stock_key, trading_day, (close - lag(close) OVER (PARTITION BY stock_key ORDER BY trading_day)) / lag(close) OVER (PARTITION BY stock_key ORDER BY trading_day) AS r FROM bd) WHERE r IS NOT NULL""")


@query("w_max_drawdown", f"""
SELECT stock_key, {rnd("least(0.0, min(equity / greatest(1.0, peak) - 1))", 8)} AS max_drawdown
FROM (SELECT *, max(equity) OVER (PARTITION BY stock_key ORDER BY trading_day ROWS UNBOUNDED PRECEDING) AS peak FROM path) GROUP BY stock_key""")
def w_max_drawdown(v):
    daily = bf.momentum(v.bars, 1, "r").where(F.col("r").isNotNull())
    return sessions.max_drawdown(daily, ["stock_key"], "trading_day", "r").select(
        "stock_key", fixed("max_drawdown", 8).alias("max_drawdown"))


view("market_daily", """
SELECT trading_day AS day, sum(CAST(floor(r * 1e9) AS BIGINT)) / 1e12 / count(*) AS ret FROM path GROUP BY trading_day""")


@query("w_net_equity", f"""
SELECT day, {rnd("ret - 0.002::DOUBLE", 10)} AS net, {rnd("product(1.0::DOUBLE + (ret - 0.002::DOUBLE)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)", 6)} AS equity FROM market_daily""")
def w_net_equity(v):
    daily = market_daily(v).withColumn("net", sessions.net_return(F.col("ret"))).withColumn("series", F.lit(1))
    return sessions.equity_path(daily, ["series"], "day", "net").select(
        "day", fixed("net", 10).alias("net"), fixed("equity", 6).alias("equity"))


def market_daily(v):
    """Equal-weight daily market return in thousandths (generated prices jump wildly); fixed-point sums make it independent of task order."""
    daily = bf.momentum(v.bars, 1, "r").where(F.col("r").isNotNull())
    return daily.groupBy(F.col("trading_day").alias("day")).agg(
        (F.sum(F.floor(F.col("r") * 1e9)) / 1e12 / F.count("*")).alias("ret"))


@query("w_walk_forward", """
WITH d AS (SELECT trading_day AS day, row_number() OVER (ORDER BY trading_day) - 1 AS n FROM (SELECT DISTINCT trading_day FROM bars)),
w AS (SELECT unnest(range(0, ((SELECT count(*) FROM d) - 170) // 20 + 1)) AS win)
SELECT win AS "window", r.role, day FROM w, (VALUES ('train', 0, 120), ('validation', 125, 20), ('test', 150, 20)) r(role, a, len), d
WHERE n >= win * 20 + a AND n < win * 20 + a + len""")
def w_walk_forward(v):
    return sessions.walk_forward(v.bars.select(F.col("trading_day").alias("day")))


view("calendar", """
SELECT day, day IN (SELECT trading_day FROM bars) AS is_open FROM (SELECT CAST(unnest(generate_series(min(trading_day), max(trading_day), INTERVAL 1 DAY)) AS DATE) AS day FROM bars)""")


@query("w_calendar_derive", "SELECT day, is_open FROM calendar")
def w_calendar_derive(v):
    return sessions.derive_calendar(v.bars)


@query("w_session_age", """
SELECT run_id, CAST(as_of AS DATE) AS day, CASE WHEN EXISTS (SELECT 1 FROM calendar c WHERE c.day = CAST(as_of AS DATE)) THEN coalesce(n, 0)
 ELSE greatest(0, len(list_filter(generate_series(CAST(as_of AS DATE) + 1, DATE '2001-07-31', INTERVAL 1 DAY), lambda x: isodow(x) < 6))) END AS age_sessions
FROM runs LEFT JOIN (SELECT c.day, count(*) AS n FROM calendar c JOIN calendar s ON s.is_open AND s.day > c.day AND s.day <= DATE '2001-07-31' GROUP BY c.day) x ON x.day = CAST(as_of AS DATE)""")
def w_session_age(v):
    triggers = v.runs.select("run_id", F.to_date("as_of").alias("day"))
    return sessions.session_age(triggers, sessions.derive_calendar(v.bars), "day", F.lit("2001-07-31").cast("date"))


@query("w_next_session", """
SELECT run_id, CAST(as_of AS DATE) AS day,
 CASE WHEN CAST(as_of AS DATE) IN (SELECT day FROM calendar) THEN (SELECT min(day) FROM calendar c WHERE is_open AND c.day > CAST(as_of AS DATE)) END AS next_day,
 CASE WHEN CAST(as_of AS DATE) IN (SELECT day FROM calendar) THEN (SELECT max(day) FROM calendar c WHERE is_open AND c.day < CAST(as_of AS DATE)) END AS previous_day
FROM runs""")
def w_next_session(v):
    calendar = sessions.derive_calendar(v.bars)
    days = v.runs.select("run_id", F.to_date("as_of").alias("day"))
    ahead = sessions.next_session(days, calendar, "day").withColumnRenamed("session", "next_day")
    return sessions.next_session(ahead, calendar, "day", "backward").withColumnRenamed("session", "previous_day")


@query("w_stage", """
SELECT run_id, stock_key, rnk, CASE WHEN rnk <= greatest(1, ceil(n * 0.3::DOUBLE)) THEN 'A' WHEN rnk <= greatest(greatest(1, ceil(n * 0.3::DOUBLE)) + 1, ceil(n * 0.7::DOUBLE)) THEN 'B' ELSE 'C' END AS stage
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM recs)""")
def w_stage(v):
    from pyspark.sql import Window

    total = F.count("*").over(Window.partitionBy("run_id"))
    return v.recs.select("run_id", "stock_key", "rnk", sessions.stage(F.col("rnk"), total).alias("stage"))


@query("w_grade", """
WITH s AS (SELECT run_id, stock_key, rnk, CASE WHEN rnk <= greatest(1, ceil(n * 0.3::DOUBLE)) THEN 'A' WHEN rnk <= greatest(greatest(1, ceil(n * 0.3::DOUBLE)) + 1, ceil(n * 0.7::DOUBLE)) THEN 'B' ELSE 'C' END AS stage
FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM recs))
SELECT run_id, stock_key, stage, CASE WHEN stage = 'A' AND rnk <= greatest(1, ceil(count(*) FILTER (stage = 'A') OVER (PARTITION BY run_id) * 0.3::DOUBLE)) THEN 'S' ELSE stage END AS grade FROM s WHERE rnk <= 10""")
def w_grade(v):
    return sessions.grade(v.recs, "run_id", "rnk", 10).select("run_id", "stock_key", "stage", "grade")


@query("w_supersede", """
WITH e AS (SELECT run_id, tenant, as_of, CAST(1 AS BIGINT) AS publish_version, as_of + INTERVAL '1' HOUR AS published_at FROM runs WHERE status = 'SUCCESS'
UNION ALL SELECT run_id, tenant, as_of, 1, as_of + INTERVAL '2' HOUR FROM runs WHERE status = 'RUNNING')
SELECT *, lead(run_id) OVER (PARTITION BY tenant, as_of ORDER BY published_at, run_id) AS superseded_by FROM e""")
def w_supersede(v):
    requests = v.runs.where("status <> 'FAILED'").withColumn("published_at", F.col("as_of") + F.expr("INTERVAL '2' HOUR"))
    return latest.publish(v.publishes, requests)


@query("w_latest_run", """
SELECT CAST(as_of AS DATE) AS day, run_id, status, n AS rows_in_run FROM runs JOIN (SELECT run_id, count(*) AS n FROM recs GROUP BY run_id) c USING (run_id)
QUALIFY row_number() OVER (PARTITION BY CAST(as_of AS DATE) ORDER BY as_of DESC, status = 'SUCCESS' DESC, n DESC, run_id DESC) = 1""")
def w_latest_run(v):
    return latest.pick_run(v.recs, v.runs).select("day", "run_id", "status", "rows_in_run")


@query("w_latest_child", """
SELECT c_custkey AS parent_id, run_id, status, as_of FROM customer LEFT JOIN (
 SELECT o_custkey, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status, o_orderdate + INTERVAL '16' HOUR AS as_of FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'P' DESC, o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey""")
def w_latest_child(v):
    parents = v.table("customer").select(F.col("c_custkey").alias("parent_id"))
    owner = v.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("parent_id"))
    steps = v.runs.join(owner, "run_id")
    order = [F.desc(F.col("status") == "FAILED"), F.desc("as_of"), F.desc("run_id")]
    return latest.latest_child(parents, steps, "parent_id", order).select("parent_id", "run_id", "status", "as_of")
