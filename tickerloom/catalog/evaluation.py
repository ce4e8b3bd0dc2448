"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..operators import bar_features as bf
from ..operators import settlement as st
from ..plans import evaluation as pe
from .aggregates import settled_forecasts
from .registry import query, rnd, view
from .settlement import settled
from .windows import market_daily

IM = "((({x}) * (({y}) & 65535) + ((({x}) * (({y}) >> 16)) & 65535) * 65536) & 4294967295)"
T1 = IM.format(x="xor(a, a >> 15)", y="a | 1")
T2 = "xor(t, (t + " + IM.format(x="xor(t, t >> 7)", y="t | 61") + ") & 4294967295)"
view("net_daily", "SELECT day, ret - 0.002::DOUBLE AS ret, row_number() OVER (ORDER BY day) - 1 AS i FROM market_daily")
view("boot", f"""WITH n AS (SELECT count(*) AS n FROM net_daily), g AS (SELECT it, b, n FROM n, (SELECT unnest(range(2000)) AS it), (SELECT unnest(range(0, (SELECT (n + 9) // 10 FROM n))) AS b)),
r AS (SELECT it, b, n, xor(u, u >> 14)::DOUBLE / 4294967296.0::DOUBLE AS r FROM (SELECT it, b, n, {T2} AS u FROM (SELECT it, b, n, {T1} AS t FROM (SELECT it, b, n, (20260910 + (it * (1 + n // 10) + b + 1) * 1831565813) & 4294967295 AS a FROM g)))),
p AS (SELECT it, n, (floor(r * n)::BIGINT + o) % n AS i FROM r, (SELECT unnest(range(10)) AS o) WHERE b * 10 + o < n)
SELECT it, sum(ret) / any_value(n) AS mean FROM p JOIN net_daily USING (i) GROUP BY it""")


@query("d_bootstrap_ci", f"""SELECT {rnd('max(mean) FILTER (r = 99)', 9)} AS lower, {rnd('max(mean) FILTER (r = 1900)', 9)} AS upper, {rnd('avg(mean)', 9)} AS mean FROM (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM boot)""")
def d_bootstrap_ci(v):
    net = market_daily(v).select("day", (F.col("ret") - 0.002).alias("ret"))
    return pe.bootstrap_ci(net).select(*[fixed(c, 9).alias(c) for c in ("lower", "upper", "mean")])


view("sector_daily", """SELECT sector, trading_day AS day, sum(CAST(floor(r * 1e9) AS BIGINT)) / 1e12 / count(*) AS ret, row_number() OVER (PARTITION BY sector ORDER BY trading_day) - 1 AS i,
 count(*) OVER (PARTITION BY sector) AS n FROM path JOIN stocks USING (stock_key) GROUP BY 1, 2""")
view("sector_boot", f"""WITH g AS (SELECT sector, n, it, unnest(range(0, (n + 9) // 10)) AS b FROM (SELECT DISTINCT sector, n FROM sector_daily), (SELECT unnest(range(500)) AS it)),
r AS (SELECT sector, it, b, n, xor(u, u >> 14)::DOUBLE / 4294967296.0::DOUBLE AS r FROM (SELECT sector, it, b, n, {T2} AS u FROM (SELECT sector, it, b, n, {T1} AS t FROM (SELECT sector, it, b, n, (20260910 + (it * (1 + n // 10) + b + 1) * 1831565813) & 4294967295 AS a FROM g)))),
p AS (SELECT sector, it, n, (floor(r * n)::BIGINT + o) % n AS i FROM r, (SELECT unnest(range(10)) AS o) WHERE b * 10 + o < n)
SELECT sector, it, sum(ret) / any_value(p.n) AS mean FROM p JOIN sector_daily USING (sector, i) GROUP BY 1, 2""")


@query("d_bootstrap_series", f"""SELECT sector, {rnd('max(mean) FILTER (r = 24)', 9)} AS lower, {rnd('max(mean) FILTER (r = 475)', 9)} AS upper, {rnd('avg(mean)', 9)} AS mean FROM (
 SELECT sector, mean, row_number() OVER (PARTITION BY sector ORDER BY mean) - 1 AS r FROM sector_boot) GROUP BY sector""")
def d_bootstrap_series(v):
    """Intervals of every sector's daily return, all series at once."""
    moves = bf.momentum(v.bars, 1, "r").where(F.col("r").isNotNull()).join(v.stocks.select("stock_key", "sector"), "stock_key")
    daily = moves.groupBy("sector", F.col("trading_day").alias("day")).agg((F.sum(F.floor(F.col("r") * 1e9)) / 1e12 / F.count("*")).alias("ret"))
    return pe.bootstrap_ci(daily, iterations=500, series=("sector",)).select("sector", *[fixed(c, 9).alias(c) for c in ("lower", "upper", "mean")])


view("base_path", "SELECT day, product(1 + (ret / 2 - 0.002::DOUBLE)) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM market_daily")
view("net_path", "SELECT day, product(1 + ret) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity FROM net_daily")


@query("d_eval_report", f"""SELECT (SELECT (count(*) - 170) // 20 + 1 FROM net_daily) AS windows, {rnd('max(mean) FILTER (r = 99)', 9)} AS lower, {rnd('max(mean) FILTER (r = 1900)', 9)} AS upper, {rnd('avg(mean)', 9)} AS mean,
 (SELECT {rnd('least(0.0, min(equity / pk - 1))', 8)} FROM (SELECT equity, greatest(1.0, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM net_path)) AS max_drawdown,
 (SELECT {rnd('max(ret)', 9)} FROM (SELECT ret, row_number() OVER (ORDER BY ret) - 1 AS r, count(*) OVER () AS n FROM net_daily) WHERE r = floor((n - 1) * 0.05::DOUBLE)) AS worst_5pct,
 (SELECT {rnd('least(0.0, min(equity / pk - 1))', 8)} FROM (SELECT equity, greatest(1.0, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM base_path)) AS baseline_drawdown FROM (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS r FROM boot)""")
def d_eval_report(v):
    daily = market_daily(v)
    out = pe.eval_report(daily, daily.withColumn("ret", F.col("ret") / 2))
    return out.select("windows", *[fixed(c, 9).alias(c) for c in ("lower", "upper", "mean")], fixed("max_drawdown", 8).alias("max_drawdown"),
                      fixed("worst_5pct", 9).alias("worst_5pct"), fixed("baseline_drawdown", 8).alias("baseline_drawdown"))


def guard_side(outcomes: str, threshold: float, level: str) -> str:
    """SQL of the weekly reviews of one indicator: key, as_of, ready_at and value in, 42 days back, five low days trip."""
    return f"""(WITH o AS (SELECT * FROM {outcomes}), w AS (SELECT unnest(generate_series(date_trunc('week', (SELECT min(as_of) FROM o)), date_trunc('week', (SELECT max(as_of) FROM o) + INTERVAL '50' DAY), INTERVAL '7' DAY)) AS review),
d AS (SELECT key, review, CAST(as_of AS DATE) AS day, sum(value) AS total, count(value) AS n FROM w JOIN o ON as_of BETWEEN review - INTERVAL '42' DAY AND review AND ready_at <= review GROUP BY 1, 2, 3),
b AS (SELECT *, max(CASE WHEN NOT total / n < {threshold} THEN day END) OVER (PARTITION BY key, review) AS sound FROM d),
g AS (SELECT key, review, {level} AS level, sum(n)::BIGINT AS reconciled, count(*) AS days, count(*) FILTER (sound IS NULL OR day > sound) AS streak FROM b GROUP BY 1, 2)
SELECT key, CAST(review AS TIMESTAMP) AS review, {rnd('level', 8)} AS level, reconciled, days, streak, level < {threshold} AND streak >= 5 AS triggered FROM g)"""


view("told_yields", "SELECT tenant AS key, as_of, visible_5 AS ready_at, yield_5 AS value FROM settled WHERE yield_5 IS NOT NULL")
view("told_hits", "SELECT keyword AS key, CAST(day AS TIMESTAMP) AS as_of, coalesce(ready_at, CAST(day AS TIMESTAMP) + INTERVAL '7' DAY) AS ready_at, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM review_rows")


@query("a_guard_reviews", f"""SELECT 'recommendation_yield' AS indicator, * FROM {guard_side("told_yields", -0.03, "avg(total / n)")} y
UNION ALL SELECT 'theme_forecast_hitrate', * FROM {guard_side("told_hits", 0.5, "sum(total) / sum(n)")} h""")
def a_guard_reviews(v):
    """Every weekly review of both guard sides: five-day returns per tenant, forecast hits per keyword.

    A forecast is judged by all members of its keyword; one whose members had no bars counts as a miss from a week after it was made.
    """
    made = F.col("day").cast("timestamp")
    yields = settled(v).where("yield_5 is not null").select("tenant", "as_of", F.col("visible_5").alias("ready_at"), F.col("yield_5").alias("value"))
    hits = settled_forecasts(v).select("keyword", made.alias("as_of"), F.coalesce("ready_at", made + F.expr("INTERVAL '7' DAY")).alias("ready_at"),
                                       F.col("hit").cast("double").alias("value"))
    sides = [st.guard_reviews(yields, "tenant", 42, -0.03, 5).withColumnRenamed("tenant", "key").withColumn("indicator", F.lit("recommendation_yield")),
             st.guard_reviews(hits, "keyword", 42, 0.5, 5, pooled=True).withColumnRenamed("keyword", "key").withColumn("indicator", F.lit("theme_forecast_hitrate"))]
    return sides[0].unionByName(sides[1]).withColumn("level", fixed("level", 8))
