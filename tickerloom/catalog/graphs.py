"""Keyword-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from .registry import query, rnd, view

view("cooc", """
WITH f AS (SELECT news_id, keyword, min(signal_id) AS o FROM signals GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY news_id ORDER BY o, keyword) AS p FROM f),
p AS (SELECT a.keyword AS source, b.keyword AS target FROM k a JOIN k b ON a.news_id = b.news_id AND a.p < b.p WHERE a.p <= 4 AND b.p <= 4 AND NOT (a.keyword LIKE '%7' AND b.keyword LIKE '%7'))
SELECT source, target, count(*) AS repeats, """ + rnd("least(0.95::DOUBLE, 0.72::DOUBLE + 0.05::DOUBLE * (count(*) - 1))") + """ AS confidence, 'derived' AS relation FROM p GROUP BY 1, 2""")
view("causal", """
WITH first AS (SELECT word, min(signal_id) AS first_id FROM (SELECT business_variable AS word, signal_id FROM signals UNION ALL SELECT keyword, signal_id FROM signals) GROUP BY 1),
e AS (SELECT business_variable AS source, keyword AS target, """ + rnd("max(confidence)") + """ AS confidence, count(DISTINCT news_id) AS evidence_count, arg_max(direction, signal_id) AS d, arg_max(confidence, signal_id) AS lc, max(signal_id) AS li FROM signals GROUP BY 1, 2)
SELECT source, target, confidence, evidence_count, CASE d WHEN 'positive' THEN 'driver' WHEN 'negative' THEN 'reverse' WHEN 'mixed' THEN 'synchronous' ELSE 'derived' END AS relation,
 CASE d WHEN 'mixed' THEN 'bidirectional' ELSE 'forward' END AS direction, lc < 0.55 AND li <= first_id AS weak FROM e JOIN first ON word = source""")
view("merged", f"""SELECT source, target, relation, confidence, weak, 'causal' AS origin FROM causal UNION ALL
SELECT source, target, relation, {rnd('confidence * 0.6::DOUBLE')}, true, 'cooccurrence' FROM cooc c WHERE NOT EXISTS (SELECT 1 FROM causal k WHERE k.source = c.source AND k.target = c.target)""")
view("final_nodes", """SELECT keyword, frequency, CASE WHEN frequency >= 2 THEN 'hot' WHEN linked THEN 'warming' ELSE 'cold' END AS temperature, frequency = 1 AND linked AS weak FROM (
 SELECT keyword, count(*) AS frequency, keyword IN (SELECT source FROM merged UNION SELECT target FROM merged) AS linked FROM (SELECT business_variable AS keyword FROM signals UNION ALL SELECT keyword FROM signals) GROUP BY keyword)""")


def cooccurrence(v):
    return g.cooccurrence_edges(v.signals, "news_id", "keyword", "signal_id", theme="7$")


def merged_edges(v):
    return g.merge_graphs(g.causal_edges(v.signals), cooccurrence(v))


def nodes(v, edges=None):
    return g.finalise_nodes(g.node_frequencies(v.signals), merged_edges(v) if edges is None else edges)


@query("a_cooccurrence_edges", "SELECT source, target, repeats, confidence FROM cooc")
def a_cooccurrence_edges(v):
    return cooccurrence(v).select("source", "target", "repeats", "confidence")


view("links", """SELECT business_variable AS source, keyword AS target, news_id, direction, count(*) AS signals, max(confidence) AS confidence, arg_min(signal_id, (-confidence, signal_id)) AS signal_id
FROM signals GROUP BY 1, 2, 3, 4""")


@query("a_edge_evidence", "SELECT source, target, news_id, direction, signals, confidence, signal_id FROM links")
def a_edge_evidence(v):
    return g.edge_evidence(v.signals)


@query("a_causal_edges", """WITH top AS (SELECT source, target, string_agg(concat('[', direction, '] ', news_id), '; ' ORDER BY r) AS reasons FROM (
 SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, news_id, direction) AS r FROM links) WHERE r <= 3 GROUP BY 1, 2)
SELECT c.source, c.target, confidence, evidence_count, relation, c.direction, weak, reasons FROM causal c JOIN top USING (source, target)""")
def a_causal_edges(v):
    """Edges with their three surest pieces of evidence; all of it is in a_edge_evidence."""
    return g.causal_edges(v.signals).join(g.top_evidence(g.edge_evidence(v.signals)), ["source", "target"])


@query("a_merge_graphs", "SELECT source, target, relation, confidence, weak, origin FROM merged")
def a_merge_graphs(v):
    return merged_edges(v)


@query("u_except_edges", "SELECT source, target, confidence FROM cooc c WHERE NOT EXISTS (SELECT 1 FROM causal k WHERE k.source = c.source AND k.target = c.target)")
def u_except_edges(v):
    return g.except_edges(cooccurrence(v), g.causal_edges(v.signals)).select("source", "target", "confidence")


@query("a_graph_strength", """SELECT target AS keyword, least(1.0, greatest(0.0, CAST(sum(CAST(confidence * CASE WHEN weak THEN 0.5 ELSE 1.0 END AS DECIMAL(18,8))) AS DOUBLE) / 10.0::DOUBLE)) AS strength FROM merged GROUP BY 1""")
def a_graph_strength(v):
    return g.graph_strength(merged_edges(v))


@query("g_finalise_nodes", "SELECT keyword, frequency, temperature, weak FROM final_nodes")
def g_finalise_nodes(v):
    return nodes(v)


@query("g_expand", """
WITH pair AS (SELECT a, b, max(confidence) AS c FROM (SELECT source AS a, target AS b, confidence FROM causal UNION ALL SELECT target, source, confidence FROM causal) WHERE a <> b GROUP BY 1, 2),
r AS (SELECT DISTINCT business_variable AS k FROM signals),
l2 AS (SELECT k AS root, b AS node, [k, b] AS path, row_number() OVER (PARTITION BY k ORDER BY c DESC, b) AS n FROM r JOIN pair ON a = k),
l3 AS (SELECT root, b AS node, list_append(path, b) AS path, l2.n AS pn, row_number() OVER (PARTITION BY root, path ORDER BY c DESC, b) AS n FROM l2 JOIN pair ON a = node WHERE l2.n <= 6 AND NOT list_contains(path, b))
SELECT root, node, array_to_string(path, '>') AS path, depth FROM (SELECT k AS root, k AS node, [k] AS path, 1::BIGINT AS depth FROM r UNION ALL SELECT root, node, path, 2 FROM l2 WHERE n <= 6
 UNION ALL SELECT root, node, path, 3 FROM l3 WHERE n <= 6)""")
def g_expand(v):
    roots = v.signals.select(F.col("business_variable").alias("keyword")).distinct()
    return g.expand(g.causal_edges(v.signals), roots, 3).withColumn("path", F.array_join("path", ">"))


@query("g_what_if", """
WITH s AS (SELECT stock_key, CAST(count(*) AS DOUBLE) AS score FROM evidence GROUP BY 1),
h AS (SELECT DISTINCT s.stock_key, st.symbol, s.score, w.word, CASE WHEN contains(lower(symbol), '00') THEN 'symbol' WHEN contains(lower(name), '00') THEN 'name' WHEN contains(word, '00') THEN 'keyword' END AS match FROM s JOIN stocks st USING (stock_key) JOIN words w USING (stock_key)),
d AS (SELECT * FROM h WHERE match IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stock_key ORDER BY CASE WHEN match = 'keyword' THEN 0 ELSE 1 END, word) = 1),
t AS (SELECT stock_key, symbol, score, match, word AS seed FROM d ORDER BY score DESC, stock_key LIMIT 10),
n AS (SELECT seed, related, confidence, row_number() OVER (PARTITION BY seed ORDER BY confidence DESC, related) AS r FROM (SELECT source AS seed, target AS related, confidence FROM merged UNION ALL SELECT target, source, confidence FROM merged))
SELECT t.stock_key, symbol, score, match, t.seed, edges, related, best FROM t LEFT JOIN (SELECT seed, count(*) AS edges, arg_min(related, r) AS related, max(confidence) AS best FROM n WHERE r <= 3 GROUP BY 1) x ON x.seed = t.seed""")
def g_what_if(v):
    from ..operators.lookups import keywords_of

    scores = v.evidence.groupBy("stock_key").agg(F.count("*").cast("double").alias("score")).join(
        v.stocks.select("stock_key", "symbol", "name"), "stock_key")
    words = keywords_of(v.evidence, ["stock_key"])
    return g.what_if(scores, words, merged_edges(v), "00")
