"""Decorator that registers a query with its checking SQL, and the SQL text of the derived views."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.views import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Instant used by news, signal and fact queries.
AS_OF = "2000-01-15 16:00:00"

VIEWS: dict[str, str] = {
    "stocks": """
SELECT s_suppkey AS stock_key,
 concat(substr('600000300688830900', CAST(1 + 3 * (s_suppkey % 6) AS INT), 3), lpad(CAST(s_suppkey % 1000 AS STRING), 3, '0')) AS symbol,
 CASE WHEN s_suppkey % 11 = 0 THEN concat('ST', s_name) ELSE s_name END AS name, n_name AS industry, r_name AS sector
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "bars": """
SELECT stock_key, trading_day, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
 max(CASE WHEN rn = n THEN px END) AS close, CAST(sum(qty) * 100 AS BIGINT) AS volume
FROM (SELECT l_suppkey AS stock_key, CAST(l_shipdate AS DATE) AS trading_day,
  CAST(CAST(CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,4)) AS px, CAST(l_quantity AS BIGINT) AS qty,
  row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn,
  count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n FROM lineitem) li
GROUP BY stock_key, trading_day""",
    "bars_full": """
SELECT *, CASE WHEN (volume // 100) % 7 <> 0 THEN CAST(trading_day AS TIMESTAMP) + INTERVAL '8' HOUR + (stock_key % 3) * INTERVAL '1' DAY END AS visible_at,
 CASE WHEN (volume // 100) % 11 = 0 THEN NULL WHEN (volume // 100) % 11 = 1 THEN 'SUSPEND' ELSE 'NORMAL' END AS trading_status,
 CASE WHEN (volume // 100) % 10 = 0 THEN '' WHEN (volume // 100) % 10 = 1 THEN 'qfq' WHEN (volume // 100) % 10 = 2 THEN 'none' ELSE 'hfq' END AS adj_type,
 CASE WHEN year(trading_day) >= 1997 THEN concat('v', CAST(year(trading_day) AS STRING)) END AS dataset_version
FROM bars""",
    "bd": """
SELECT stock_key, trading_day, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low,
 CAST(close AS DOUBLE) AS close, volume,
 row_number() OVER (PARTITION BY stock_key ORDER BY trading_day) AS ord FROM bars""",
    "news": """
SELECT doc_id AS news_id, regexp_extract(text, '^([^.\\n]*)', 1) AS title, text AS content, source,
 TIMESTAMP '2000-01-01 00:00:00' + ((doc_id * 37) % 43200) * INTERVAL '1' MINUTE AS published_at FROM documents""",
    "signals": f"""
SELECT event_id AS signal_id, event_id % (SELECT count(*) FROM documents) AS news_id,
 concat('k', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS STRING)) AS keyword,
 event_type AS business_variable, CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'positive'
 WHEN 'error' THEN 'negative' WHEN 'click' THEN 'mixed' ELSE 'neutral' END AS direction,
 floor(least(1.0, value / 500) * 10000) / 10000.0 AS confidence, ts - INTERVAL '24' YEAR AS signal_at FROM events""",
    "facts": f"""
SELECT p_partkey AS fact_id, p_partkey % (SELECT count(*) FROM supplier) AS stock_key,
 concat('k', CAST(p_partkey % 100 AS STRING)) AS keyword,
 CASE p_size % 3 WHEN 0 THEN 'business_exposure' WHEN 1 THEN 'concept_exposure' ELSE 'industry_exposure' END AS exposure_type,
 concat('SW', CAST(1 + p_size % 3 AS STRING)) AS taxonomy_level, CAST((50 + p_size) AS DOUBLE) / 100 AS confidence,
 count(*) OVER (PARTITION BY p_partkey % 100) AS member_count,
 TIMESTAMP '1999-01-01 00:00:00' + p_size * INTERVAL '10' DAY AS valid_from,
 CASE WHEN p_size % 4 = 0 THEN TIMESTAMP '2000-01-10 00:00:00' END AS valid_to, 'active' AS status FROM part""",
    "runs": """
SELECT o_orderkey AS run_id, o_orderpriority AS tenant, o_orderdate + INTERVAL '16' HOUR AS as_of,
 CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status FROM orders""",
    "recs": """
SELECT run_id, tenant, as_of, stock_key, final_score,
 row_number() OVER (PARTITION BY run_id ORDER BY final_score DESC, stock_key) AS rnk
FROM (SELECT o_orderkey AS run_id, o_orderpriority AS tenant, o_orderdate + INTERVAL '16' HOUR AS as_of, l_suppkey AS stock_key,
  CAST(CAST(max(l_quantity) * 2 AS DECIMAL(10,4)) AS DOUBLE) AS final_score FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_orderpriority, o_orderdate, l_suppkey) x""",
    "publishes": """
SELECT run_id, tenant, as_of, CAST(1 AS BIGINT) AS publish_version, as_of + INTERVAL '1' HOUR AS published_at
FROM runs WHERE status = 'SUCCESS'""",
    "evidence": f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id, l_orderkey AS run_id, l_suppkey AS stock_key,
 l_partkey % (SELECT count(*) FROM documents) AS news_id,
 concat('k', CAST(l_partkey % 100 AS STRING)) AS keyword,
 CASE WHEN l_linenumber % 3 <> 0 THEN concat('k', CAST((l_partkey + l_linenumber) % 100 AS STRING)) END AS matched_keyword,
 l_partkey AS fact_id, floor(l_discount * 1000 + 0.5) / 100.0 AS contribution,
 CASE WHEN l_tax > 0.01 THEN (50 + floor(l_tax * 500 + 0.5)) / 100.0 END AS match_confidence FROM lineitem""",
}


def view(name: str, sql: str) -> None:
    """Add a named SQL view usable by any checking query."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix a query with the views it refers to, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text, re.IGNORECASE):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql.strip()
    prefix = "WITH " + ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\s", body, re.IGNORECASE):
        return prefix.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body.split(None, 2)[2]
    if re.match(r"WITH\s", body, re.IGNORECASE):
        return prefix + ",\n" + body[4:].lstrip()
    return prefix + "\n" + body


def plain_types(df: DataFrame) -> DataFrame:
    """Output types both engines share: decimals as double, ints as bigint, instants without zone."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType | T.FloatType):
            c = c.cast("double")
        elif isinstance(field.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(views) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plain_types(fn(Views(spark, folder)))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def rnd(expr: str, digits: int = 4) -> str:
    """SQL twin of functions.numbers.fixed."""
    scale = f"1e{digits}"
    return f"(floor(({expr}) * {scale} + 0.5) / {scale})"
