"""Settlement, profit and penalty queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..functions.timekeys import instant
from ..operators import bar_features as bf
from ..operators import sessions
from ..operators import settlement as st
from ..session import shared_folder
from ..sources.tables import WrittenTable
from .registry import query, rnd, view

def ref_():
    return instant("2001-06-30 00:00:00")

REFS = "TIMESTAMP '2001-06-30 00:00:00'"
def at_():
    return instant("2000-06-30 00:00:00")

ATS = "TIMESTAMP '2000-06-30 00:00:00'"
RESTRICTED = "('LIMIT_UP','LIMIT_DOWN','SUSPEND','HALT','ST','RESUMED_LIMIT_UP','RESUMED_LIMIT_DOWN')"

view("ahead5", """SELECT stock_key, trading_day, """ + ", ".join(
    f"lead({c}, {n}) OVER w AS {a}{n}" for n in (1, 2, 3, 4, 5) for c, a in (("trading_day", "d"), ("CAST(close AS DOUBLE)", "c"), ("trading_status", "s")))
    + " FROM bars_full WINDOW w AS (PARTITION BY stock_key ORDER BY trading_day)")
view("day_rows", "SELECT r.run_id, r.stock_key, max(b.trading_day) AS fday FROM recs r JOIN bars b ON r.stock_key = b.stock_key AND b.trading_day <= CAST(r.as_of AS DATE) GROUP BY 1, 2")
view("exits", """SELECT r.*, a.day AS base_day, CAST(b.close AS DOUBLE) AS p0, x.* EXCLUDE (stock_key, trading_day) FROM recs r LEFT JOIN asof_rows a ON a.run_id = r.run_id AND a.stock_key = r.stock_key
 LEFT JOIN bars b ON b.stock_key = a.stock_key AND b.trading_day = a.day LEFT JOIN day_rows f ON f.run_id = r.run_id AND f.stock_key = r.stock_key LEFT JOIN ahead5 x ON x.stock_key = f.stock_key AND x.trading_day = f.fday""")


def y(n):
    return f"CASE WHEN p0 > 0 THEN (c{n} - p0) / p0 END"


def seen(n):
    return f"(CAST(d{n} AS TIMESTAMP) + INTERVAL '7' HOUR)"


def status(n):
    return f"""CASE WHEN d{n} IS NULL THEN 'immature' WHEN s{n} IS NULL THEN 'coverage_gap' WHEN s{n} IN {RESTRICTED} OR {seen(n)} > {REFS} THEN 'pending' ELSE 'mature' END"""


@query("d_yield_records", " UNION ALL ".join(
    f"""SELECT run_id, stock_key, CAST({n} AS BIGINT) AS horizon, {y(n)} AS value, {status(n)} AS status, d{n} AS planned_day,
 CASE WHEN {status(n)} = 'mature' OR ({status(n)} = 'pending' AND {seen(n)} > {REFS}) THEN d{n} END AS actual_day, {seen(n)} AS maturity_at FROM exits WHERE p0 > 0""" for n in (1, 3, 5)))
def d_yield_records(v):
    return st.yield_records(v.recs, v.bars_full, ref_())


@query("d_yield_summary", "WITH s AS (" + " UNION ALL ".join(f"SELECT tenant, CASE WHEN p0 > 0 THEN {status(n)} END AS s FROM exits" for n in (1, 3, 5)) + """)
SELECT tenant, count(*) // 3 AS scanned, count(*) FILTER (s IS NULL) // 3 AS without_base, count(*) FILTER (s = 'immature') AS immature, count(*) FILTER (s = 'pending') AS pending,
 count(*) FILTER (s = 'mature') AS mature, count(*) FILTER (s = 'coverage_gap') + count(*) FILTER (s IS NULL) // 3 AS coverage_gap, count(s) AS records FROM s GROUP BY tenant""")
def d_yield_summary(v):
    """Counts behind the return records; recommendations without a base price are counted, not dropped unseen."""
    return st.yield_summary(v.recs, v.bars_full, ref_())


view("settled", f"""SELECT run_id, tenant, as_of, stock_key, rnk, p0, {', '.join(f'{y(n)} AS yield_{n}, {seen(n)} AS visible_{n}' for n in (1, 3, 5))}, coalesce(c5, c3, c1) AS exit_price,
 {' OR '.join(f'coalesce(c{n} IS NOT NULL AND {seen(n)} <= {REFS}, false)' for n in (1, 3, 5))} AS reconciled FROM exits WHERE p0 > 0 AND d1 IS NOT NULL""")


def settled(v):
    return st.settle(v.recs, v.bars_full, ref_())


@query("d_settle_recs", "SELECT run_id, stock_key, yield_1, yield_3, yield_5, visible_5, exit_price, reconciled FROM settled")
def d_settle_recs(v):
    return settled(v).select("run_id", "stock_key", "yield_1", "yield_3", "yield_5", "visible_5", "exit_price", "reconciled")


view("daily_series", f"""SELECT CAST(as_of AS DATE) AS day, avg(yield_5) AS ret, count(*) AS samples FROM settled WHERE run_id IN (SELECT run_id FROM publishes) AND visible_5 <= {REFS} AND yield_5 IS NOT NULL GROUP BY 1""")


@query("sink_daily_series", f"SELECT day, {rnd('ret', 8)} AS ret, samples FROM daily_series")
def sink_daily_series(v):
    """The series is exported by year and read back."""
    series = st.daily_returns(settled(v), v.publishes, ref_()).withColumn("ret", fixed("ret", 8))
    table = WrittenTable(v.spark, shared_folder(v.spark, "daily-series"), series.schema, F.year("day"))
    table.append("export", series)
    return table.read()


view("last_quote", "SELECT stock_key, arg_max(CAST(close AS DOUBLE), trading_day) AS cl FROM bars GROUP BY 1")
view("profits", f"""SELECT e.run_id, e.tenant, e.stock_key, e.rnk, e.as_of, p0, CASE WHEN p0 > 0 THEN (cl - p0) / p0 END AS return_live, CASE WHEN p0 IS NULL THEN 'NO_BASE_PRICE' WHEN cl IS NULL THEN 'NO_CURRENT_PRICE' ELSE 'LIVE' END AS status_live,
 {', '.join(f"{y(n)} AS return_{n}, CASE WHEN p0 IS NULL THEN 'NO_BASE_PRICE' WHEN c{n} IS NULL THEN 'PENDING' ELSE 'FINAL' END AS status_{n}" for n in (1, 3, 5))} FROM exits e LEFT JOIN last_quote q ON q.stock_key = e.stock_key""")


def profits(v):
    return st.strategy_profits(v.recs, v.bars_full, bf.latest_quote(v.bars))


@query("d_strategy_profits", "SELECT run_id, stock_key, return_live, status_live, return_1, status_1, return_3, status_3, return_5, status_5 FROM profits")
def d_strategy_profits(v):
    return profits(v).select("run_id", "stock_key", "return_live", "status_live", "return_1", "status_1", "return_3", "status_3",
                             "return_5", "status_5")


@query("a_profit_summary", f"""SELECT tenant, count(*) AS recs, count(DISTINCT run_id) AS runs, {rnd('avg(return_live)', 6)} AS avg_return, median(return_live) AS median_return, max(return_live) AS best_return, min(return_live) AS worst_return,
 count(*) FILTER (return_live > 0) / count(return_live) AS win_rate, {', '.join(f"count(*) FILTER (status_{n} = 'PENDING') AS pending_{n}, count(return_{n}) AS final_{n}, {rnd(f'avg(return_{n})', 6)} AS avg_{n}, count(*) FILTER (return_{n} > 0) / count(return_{n}) AS win_rate_{n}, min(return_{n}) AS worst_{n}" for n in (1, 3, 5))} FROM profits GROUP BY tenant""")
def a_profit_summary(v):
    out = st.profit_summary(profits(v))
    return out.withColumns({c: fixed(c, 6) for c in ("avg_return", "avg_1", "avg_3", "avg_5")})


@query("a_performance_report", f"""
WITH e AS (SELECT *, (coalesce(c5, c3, c1) - p0) / p0 AS y FROM exits WHERE p0 > 0 AND c1 IS NOT NULL),
s AS (SELECT run_id, count(*) AS n, count(*) FILTER (y > 0) AS wins, avg(y) AS m, coalesce(avg(y) FILTER (y > 0), 0) AS gain, coalesce(avg(y) FILTER (y < 0), 0) AS loss, {', '.join(f'avg(c{t} / p0) AS v{t}' for t in range(1, 6))} FROM e GROUP BY 1),
p AS (SELECT run_id, unnest([0, 1, 2, 3, 4, 5]) AS t, unnest([1.0, v1, v2, v3, v4, v5]) AS val FROM s),
d AS (SELECT run_id, max((pk - val) / pk) AS dd FROM (SELECT run_id, val, max(val) OVER (PARTITION BY run_id ORDER BY t) AS pk FROM p WHERE val IS NOT NULL) GROUP BY 1)
SELECT s.run_id, n AS recs, {rnd('wins / n')} AS win_rate, {rnd('m', 6)} AS mean_return, CASE WHEN loss <> 0 THEN {rnd('gain / abs(loss)')} END AS profit_ratio, {rnd('greatest(0.0, dd)', 6)} AS max_drawdown FROM s JOIN d USING (run_id)""")
def a_performance_report(v):
    return st.performance_report(v.recs, v.bars_full)


@query("a_win_rate_recent", f"""SELECT stock_key, count(y1) AS total_1, count(*) FILTER (y1 > 0) / nullif(count(y1), 0) AS win_rate_1, count(y3) AS total_3, count(*) FILTER (y3 > 0) / nullif(count(y3), 0) AS win_rate_3
FROM (SELECT *, CASE WHEN CAST(visible_1 + INTERVAL '8' HOUR AS DATE) < DATE '2000-06-30' THEN yield_1 END AS y1, CASE WHEN CAST(visible_3 + INTERVAL '8' HOUR AS DATE) < DATE '2000-06-30' THEN yield_3 END AS y3 FROM settled WHERE run_id IN (SELECT run_id FROM publishes) AND CAST(as_of + INTERVAL '8' HOUR AS DATE) < DATE '2000-06-30' QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY as_of DESC, run_id DESC) <= 30) GROUP BY 1""")
def a_win_rate_recent(v):
    return st.recent_win_rate(settled(v), v.publishes, F.lit("2000-06-30").cast("date"))


@query("a_daily_quality", f"""
WITH d AS (SELECT tenant, CAST(as_of AS DATE) AS day, avg(yield_5) AS v FROM settled WHERE reconciled AND yield_5 IS NOT NULL AND as_of <= {ATS} AND visible_5 <= {ATS} GROUP BY 1, 2),
b AS (SELECT tenant, v, sum(CASE WHEN v < -0.03 THEN 0 ELSE 1 END) OVER (PARTITION BY tenant ORDER BY day DESC) AS b FROM d)
SELECT tenant, {rnd('avg(v)', 8)} AS mean, count(*) AS days, count(*) FILTER (b = 0) AS streak, avg(v) < -0.03 AND count(*) FILTER (b = 0) >= 1 AS triggered FROM b GROUP BY 1""")
def a_daily_quality(v):
    daily = settled(v).where(F.col("reconciled") & F.col("yield_5").isNotNull() & (F.col("as_of") <= at_())
                             & (F.col("visible_5") <= at_())).groupBy(
        "tenant", F.to_date("as_of").alias("day")).agg(F.avg("yield_5").alias("value"))
    return st.guard_triggers(daily, "tenant", "value", -0.03, 1).withColumn("mean", fixed("mean", 8))


view("losers", f"""SELECT run_id, stock_key, loss FROM (SELECT *, least(CASE WHEN visible_1 <= {ATS} THEN yield_1 END, CASE WHEN visible_3 <= {ATS} THEN yield_3 END, CASE WHEN visible_5 <= {ATS} THEN yield_5 END) AS loss
 FROM settled WHERE run_id IN (SELECT run_id FROM publishes) AND as_of >= {ATS} - INTERVAL '30' DAY AND as_of < {ATS} AND reconciled) WHERE loss <= -0.03""")


@query("a_penalty_threshold", f"""SELECT l.run_id, l.stock_key, word, 0.6::DOUBLE AS factor, loss, {ATS} AS valid_from, {ATS} + INTERVAL '7' DAY AS valid_to FROM losers l JOIN words w ON w.run_id = l.run_id AND w.stock_key = l.stock_key""")
def a_penalty_threshold(v):
    return st.threshold_penalties(settled(v), v.publishes, v.evidence, at_())


@query("a_penalty_smooth", f"""
WITH m AS (SELECT run_id, stock_key, word, max(contribution) AS mass FROM (SELECT run_id, stock_key, keyword AS word, contribution FROM evidence UNION ALL SELECT run_id, stock_key, matched_keyword, contribution FROM evidence WHERE matched_keyword IS NOT NULL) WHERE contribution > 0 GROUP BY 1, 2, 3),
t AS (SELECT run_id, stock_key, sum(mass) AS total FROM m GROUP BY 1, 2),
o AS (SELECT day, row_number() OVER (ORDER BY day) AS ord FROM calendar WHERE is_open),
a AS (SELECT s.*, (SELECT count(*) FROM o WHERE day > CAST(s.as_of AS DATE) AND day <= DATE '2000-06-30') AS age FROM settled s WHERE run_id IN (SELECT run_id FROM publishes) AND as_of < {ATS} AND visible_5 <= {ATS} AND reconciled AND as_of > TIMESTAMP '2000-01-01 00:00:00'),
w AS (SELECT word, pow(0.5, age / 20.0) * (mass / total) AS w, yield_5 FROM a JOIN m USING (run_id, stock_key) JOIN t USING (run_id, stock_key) WHERE age <= 60),
r AS (SELECT word, sum(w) AS n, coalesce(sum(w) FILTER (yield_5 <= -0.03), 0) AS lost FROM w GROUP BY 1), g AS (SELECT sum(lost) / sum(n) AS p0 FROM r)
SELECT word, {rnd('n', 6)} AS n, {rnd('lost', 6)} AS lost, {rnd('p0', 6)} AS p0, {rnd("CASE WHEN n < 5 THEN 1.0 ELSE greatest(0.0, least(1.0, 1.0 - 0.6 * greatest(0.0, (lost + p0 * 20) / (n + 20) - p0))) END", 6)} AS factor FROM r, g""")
def a_penalty_smooth(v):
    out = st.smooth_penalties(settled(v), v.publishes, v.evidence, sessions.derive_calendar(v.bars), at_())
    return out.select("word", *[fixed(c, 6).alias(c) for c in ("n", "lost", "p0", "factor")])
