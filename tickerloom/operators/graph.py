"""Keyword graph: edges from co-occurrence and causal signals, merging, temperature and expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl, fixed
from ..session import cut_lineage

# Entities used per item, edge confidences, weak-signal bound and fallback factor.
ENTITIES_PER_ITEM, FIRST, STEP, CAP, WEAK_BELOW, FALLBACK = 4, 0.72, 0.05, 0.95, 0.55, 0.60
# Category patterns, and words too general to name an asset or theme.
THEME_PATTERN, INDUSTRY_PATTERN = "白银|黄金", "新能源|制造"
GENERIC_WORDS = ("行业", "产业", "产业链", "项目", "公司", "建设", "发展", "投资", "市场", "企业", "业务", "产品", "服务", "板块",
                 "概念", "主题", "领域", "方向", "趋势")
# Strength divisor.
STRENGTH_SCALE = 10.0


def category(word: Column, theme: str = THEME_PATTERN, industry: str = INDUSTRY_PATTERN) -> Column:
    return F.when(word.rlike(theme), "theme").when(word.rlike(industry), "industry").otherwise("other")


def cooccurrence_edges(items: DataFrame, item: str, word: str, order: str, theme: str = THEME_PATTERN) -> DataFrame:
    """Ordered pairs among the first four distinct words of each item; confidence grows with repeats.

    Four words give at most six pairs per item, whatever its size.
    """
    first = items.groupBy(item, word).agg(F.min(order).alias("_o"))
    position = F.row_number().over(Window.partitionBy(item).orderBy("_o", word))
    kept = first.withColumn("_p", position).where(F.col("_p") <= ENTITIES_PER_ITEM)
    a = kept.select(item, F.col(word).alias("source"), F.col("_p").alias("_i"))
    b = kept.select(item, F.col(word).alias("target"), F.col("_p").alias("_j"))
    pairs = a.join(b, item).where(F.col("_i") < F.col("_j"))
    cs, ct = category(F.col("source"), theme), category(F.col("target"), theme)
    return (
        pairs.where(~((cs == "theme") & (ct == "theme"))).groupBy("source", "target").agg(F.count("*").alias("repeats"))
        .withColumn("confidence", fixed(F.least(F.lit(CAP), F.lit(FIRST) + F.lit(STEP) * (F.col("repeats") - 1)), 4))
        .withColumn("relation", F.when((cs == "industry") | (ct == "industry"), "driver").otherwise("derived"))
        .withColumn("weak", F.lit(True))
    )


def causal_edges(signals: DataFrame) -> DataFrame:
    """Driver to asset edges: highest confidence, relation of the last signal, weak when that signal was the driver's first mention."""
    valid = signals.where((F.col("business_variable") != "") & (F.col("keyword") != ""))
    mentions = valid.select(F.col("business_variable").alias("word"), "signal_id").unionByName(
        valid.select(F.col("keyword").alias("word"), "signal_id"))
    first = mentions.groupBy("word").agg(F.min("signal_id").alias("first_id"))
    edges = valid.groupBy(F.col("business_variable").alias("source"), F.col("keyword").alias("target")).agg(
        fixed(F.max(dbl("confidence")), 4).alias("confidence"), F.countDistinct("news_id").alias("evidence_count"),
        F.max_by(F.struct("direction", "confidence", "signal_id"), "signal_id").alias("last"))
    d = F.col("last.direction")
    # Relation per direction.
    relation = F.when(d == "positive", "driver").when(d == "negative", "reverse").when(d == "mixed", "synchronous").otherwise("derived")
    return edges.join(first, F.col("source") == F.col("word")).select(
        "source", "target", "confidence", "evidence_count", relation.alias("relation"),
        F.when(d == "mixed", "bidirectional").otherwise("forward").alias("direction"),
        ((F.col("last.confidence") < WEAK_BELOW) & (F.col("last.signal_id") <= F.col("first_id"))).alias("weak"))


def edge_evidence(signals: DataFrame) -> DataFrame:
    """One row per causal edge, news item and direction: the links behind the edges, with the best confidence and its signal."""
    valid = signals.where((F.col("business_variable") != "") & (F.col("keyword") != ""))
    return valid.groupBy(F.col("business_variable").alias("source"), F.col("keyword").alias("target"), "news_id", "direction").agg(
        F.count("*").alias("signals"), F.max_by(F.struct(dbl("confidence").alias("confidence"), "signal_id"), F.struct(dbl("confidence"), -F.col("signal_id"))).alias("b")
    ).select("source", "target", "news_id", "direction", "signals", "b.confidence", "b.signal_id")


def top_evidence(links: DataFrame, n: int = 3) -> DataFrame:
    """(source, target, reasons): the n surest links of each edge as ``[direction] news id``, surest first.

    Only n rows per edge and task reach the sort, however many links an edge has.
    """
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("confidence"), "news_id", "direction"))
    best = links.withColumn("_r", rank).where(F.col("_r") <= n)
    told = F.concat(F.lit("["), "direction", F.lit("] "), F.col("news_id").cast("string"))
    listed = F.array_sort(F.collect_list(F.struct("_r", told.alias("t"))))
    return best.groupBy("source", "target").agg(F.array_join(F.transform(listed, lambda x: x["t"]), "; ").alias("reasons"))


def except_edges(edges: DataFrame, covered: DataFrame) -> DataFrame:
    return edges.join(covered.select("source", "target"), ["source", "target"], "left_anti")


def merge_graphs(causal: DataFrame, cooccurrence: DataFrame) -> DataFrame:
    """Causal edges as they are; remaining co-occurrence edges weakened."""
    columns = ["source", "target", "relation", "confidence", "weak"]
    rest = except_edges(cooccurrence, causal).withColumn("confidence", fixed(F.col("confidence") * F.lit(FALLBACK), 4)) \
        .withColumn("weak", F.lit(True))
    return causal.select(*columns, F.lit("causal").alias("origin")).unionByName(
        rest.select(*columns, F.lit("cooccurrence").alias("origin")))


def graph_strength(edges: DataFrame) -> DataFrame:
    """Normalised strength of each target: edge confidences, weak edges counting half."""
    weight = F.when(F.col("weak"), 0.5).otherwise(1.0)
    sums = edges.where(~F.col("target").isin(*GENERIC_WORDS) & (F.col("confidence") > 0)).groupBy(
        F.col("target").alias("keyword")).agg(dbl(F.sum((F.col("confidence") * weight).cast("decimal(18,8)"))).alias("raw"))
    return sums.select("keyword", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("raw") / STRENGTH_SCALE)).alias("strength"))


def node_frequencies(signals: DataFrame) -> DataFrame:
    words = signals.select(F.col("business_variable").alias("keyword")).unionByName(signals.select("keyword"))
    return words.groupBy("keyword").agg(F.count("*").alias("frequency"))


def finalise_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Hot from two mentions; a single mention with an edge is warming and weak; otherwise cold."""
    linked = edges.select(F.col("source").alias("keyword")).unionByName(edges.select(F.col("target").alias("keyword"))) \
        .distinct().withColumn("linked", F.lit(True))
    single = (F.col("frequency") == 1) & F.coalesce("linked", F.lit(False))
    return nodes.join(linked, "keyword", "left").select(
        "keyword", "frequency",
        F.when(F.col("frequency") >= 2, "hot").when(single, "warming").otherwise("cold").alias("temperature"),
        single.alias("weak"))


def expand(edges: DataFrame, roots: DataFrame, depth: int, fanout: int = 6, budget: int = 250) -> DataFrame:
    """Tree of paths from each root: best neighbours first, none revisited, the first ``budget`` nodes in depth-first order.

    The tree grows level by level. A node's place in depth-first order is at least the number of known nodes before it, so those
    beyond the budget can never come in and are dropped at once; deeper nodes push out later ones as they appear. Each level
    joins the frontier (at most ``budget`` rows per root) with the adjacency list already cut to the fanout plus the path
    length, the most that visited nodes can block.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "confidence").unionByName(
        edges.select(F.col("target").alias("a"), F.col("source").alias("b"), "confidence")).where("a <> b")
    pair = both.groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    near = pair.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("confidence"), "b"))) \
        .where(F.col("_r") <= fanout + depth)
    frontier = roots.select(F.col("keyword").alias("root"), F.col("keyword").alias("node"), F.array("keyword").alias("path"),
                            F.lit(1).alias("depth"), F.lit("").alias("order"))
    tree = frontier
    for level in range(2, depth + 1):
        step = frontier.join(near, F.col("node") == F.col("a")).where(~F.array_contains("path", F.col("b")))
        best = F.row_number().over(Window.partitionBy("root", "path").orderBy(F.desc("confidence"), "b"))
        frontier = step.withColumn("_n", best).where(F.col("_n") <= fanout).select(
            "root", F.col("b").alias("node"), F.concat("path", F.array("b")).alias("path"), F.lit(level).alias("depth"),
            F.concat("order", F.lpad(F.col("_n").cast("string"), 2, "0")).alias("order"))
        room = F.row_number().over(Window.partitionBy("root").orderBy("order"))
        tree = tree.unionByName(frontier).withColumn("_n", room).where(F.col("_n") <= budget).drop("_n")
        if level % 4 == 0:
            tree = cut_lineage(tree)
        frontier = tree.where(F.col("depth") == level)
    return tree.drop("order")


def what_if(recs: DataFrame, words: DataFrame, edges: DataFrame, query: str, n: int = 10) -> DataFrame:
    """Recommendations whose symbol, name or keyword contains the text, with up to three touching edges each."""
    needle = query.lower()

    def has(c: str) -> Column:
        return F.contains(F.lower(F.col(c)), F.lit(needle))

    kind = F.when(has("symbol"), "symbol").when(has("name"), "name").when(has("word"), "keyword")
    hits = recs.join(words, "stock_key").withColumn("match", kind).where(F.col("match").isNotNull())
    seeds = hits.groupBy("stock_key", "symbol", "name", "score").agg(
        F.min_by(F.struct("match", F.col("word").alias("seed")),
                 F.struct(F.when(F.col("match") == "keyword", 0).otherwise(1), F.col("word"))).alias("m")
    ).orderBy(F.desc("score"), "stock_key").limit(n).select("stock_key", "symbol", "score", "m.match", "m.seed")
    ends = edges.select(F.col("source").alias("seed"), F.col("target").alias("related"), "confidence").unionByName(
        edges.select(F.col("target").alias("seed"), F.col("source").alias("related"), "confidence"))
    near = ends.join(seeds.select("seed").distinct(), "seed", "left_semi").withColumn(
        "_r", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("confidence"), "related"))).where("_r <= 3")
    links = near.groupBy("seed").agg(
        F.count("*").alias("edges"), F.min_by("related", "_r").alias("related"), F.max("confidence").alias("best"))
    return seeds.join(links, "seed", "left")
