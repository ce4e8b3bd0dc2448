"""Known results: the two-stock scoring case and small hand-computed ones."""

import datetime as dt
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from tickerloom.functions.timekeys import instant
from tickerloom.operators import bar_features as bf
from tickerloom.operators import evidence as ev
from tickerloom.operators import latest, matching, news, sessions

AS_OF = dt.datetime(2026, 5, 24, 12, 0)


def bars(spark, keys):
    start, rows = dt.date(2026, 4, 24), []
    for key in keys:
        for i in range(22):
            base = 10 + 0.5 * (i % 7)
            rows.append((key, start + dt.timedelta(days=i + 2 * (i // 5)), base, base * 1.03, base * 0.97, base * 1.01, 1_000_000 + 1000 * i))
    return spark.createDataFrame(rows, "stock_key bigint, trading_day date, open double, high double, low double, close double, volume bigint")


def test_scores_of_two_stocks(spark):
    silver, copper = "白银", "铜"
    signals = spark.createDataFrame(
        [(1, 1, silver, "供给不足", "positive", 0.8), (2, 2, copper, "需求回暖", "positive", 0.8)],
        "signal_id bigint, news_id bigint, keyword string, business_variable string, direction string, confidence double")
    facts = spark.createDataFrame(
        [(1, 600111, silver, "business_exposure", None, 0.9, 1, dt.datetime(2026, 5, 24), None, "active"),
         (2, 630, copper, "business_exposure", None, 0.9, 1, dt.datetime(2026, 5, 24), None, "active")],
        "fact_id bigint, stock_key bigint, keyword string, exposure_type string, taxonomy_level string, confidence double, "
        "member_count bigint, valid_from timestamp, valid_to timestamp, status string")
    items = spark.createDataFrame([(1, dt.datetime(2026, 5, 24, 8, 0)), (2, dt.datetime(2026, 5, 24, 8, 1))],
                                  "news_id bigint, published_at timestamp")
    penalties = spark.createDataFrame([(copper, 0.6, dt.datetime(2026, 5, 24, 9), dt.datetime(2026, 6, 5, 9))],
                                      "keyword string, factor double, valid_from timestamp, valid_to timestamp")
    nodes = spark.createDataFrame([(silver, True), (copper, True), ("光伏", False)], "keyword string, weak boolean")
    edges = spark.createDataFrame([(silver, "光伏", 0.9, True), (copper, "光伏", 0.85, True)],
                                  "source string, target string, confidence double, weak boolean")
    matches = matching.match_keywords(signals.select(F.col("keyword").alias("source"), F.col("keyword").alias("text")), facts.select("keyword"))
    rows = ev.contributions(signals, matches, facts, items, penalties, instant(AS_OF))
    assert rows.count() == 2
    market = latest.best_per_key(bf.market_score(bars(spark, [600111, 630])), ["stock_key"], [F.desc("trading_day")]).select(
        "stock_key", "market_score")
    got = {r["stock_key"]: r for r in ev.score_symbols(rows, nodes, edges, market).collect()}
    assert got[630].asDict() == {"stock_key": 630, "evidence_score": 13.0364, "graph_score": 11.1, "exposure_score": 13.5,
                                 "market_score": 6.2468, "total_score": 43.8832}
    assert got[600111].asDict() == {"stock_key": 600111, "evidence_score": 18.2077, "graph_score": 11.4, "exposure_score": 13.5,
                                    "market_score": 6.2468, "total_score": 49.3545}


def test_classes_of_stocks_score_as_every_contribution_does(spark):
    rng = random.Random(7)
    words = ["u", "v", "w"]
    signals = spark.createDataFrame(
        [(i, rng.randrange(60), rng.choice(words), rng.choice("xy"), rng.choice(["positive", "mixed", "negative"]),
          rng.choice([0.3, 0.7, 0.70000001, 0.9, 1.0, 1.4, None])) for i in range(400)],
        "signal_id bigint, news_id bigint, keyword string, business_variable string, direction string, confidence double")
    facts = spark.createDataFrame(
        [(i, rng.randrange(25), rng.choice(words), "business_exposure", None, rng.choice([0.5, 0.8, 0.9, 1.3, None]), rng.choice([1, 4, None]),
          dt.datetime(2026, 5, 1), None, "active") for i in range(60)],
        "fact_id bigint, stock_key bigint, keyword string, exposure_type string, taxonomy_level string, confidence double, "
        "member_count bigint, valid_from timestamp, valid_to timestamp, status string")
    items = spark.createDataFrame([(i % 55, AS_OF - dt.timedelta(hours=rng.choice([1, 5, 30, 400])), rng.choice([1.0, 0.15, 3.0])) for i in range(75)],
                                  "news_id bigint, published_at timestamp, reprint_weight double")
    penalties = spark.createDataFrame([("v", 0.6, dt.datetime(2026, 5, 1), dt.datetime(2026, 6, 5))], "keyword string, factor double, valid_from timestamp, valid_to timestamp")
    matches = spark.createDataFrame([("u", "u", "m", 1.0), ("u", "v", "m", 0.9), ("v", "v", "m", 1.0), ("w", "w", "m", 1.0), ("w", "u", "m", 0.86)],
                                    "source string, keyword string, method string, confidence double")
    inputs = signals, matches, facts, items, penalties, instant(AS_OF)
    rows = ev.contributions(*inputs).cache()
    every = rows.select("stock_key", "keyword", "business_variable", "direction", F.col("news_id").cast("string").alias("event"),
                        F.concat_ws("|", "news_id", "stock_key", "keyword", "fact_id", "method").alias("evidence_id"), F.col("contribution").alias("q"))
    leading, members = ev.leading_contributions(*inputs)
    assert {tuple(r) for r in ev.class_events(leading, members).collect()} == {
        tuple(r) for r in ev.event_evidence(every, ["stock_key"]).select("stock_key", "keyword", "e_plus", "e_minus", "e").collect()}
    assert {tuple(r) for r in ev.class_words(leading, members).collect()} == {
        tuple(r) for r in rows.select("stock_key", F.explode(F.array("keyword", "source_keyword"))).distinct().collect()}
    nodes = spark.createDataFrame([(w, w == "u") for w in words], "keyword string, weak boolean")
    edges = spark.createDataFrame([("u", "v", 0.9, True), ("v", "w", 0.4, False)], "source string, target string, confidence double, weak boolean")
    market = spark.createDataFrame([(k, 3.5) for k in range(0, 25, 2)], "stock_key bigint, market_score double")
    old, new = ev.score_symbols(rows, nodes, edges, market), ev.score_members(leading, members, nodes, edges, market)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) and old.count() > 15
    assert leading.count() < rows.count()


def test_noisy_or_keeps_best_per_event_and_breaks_ties(spark):
    items = spark.createDataFrame([
        Row(s=1, keyword="k", business_variable="v", direction="positive", event="a", evidence_id="b", q=0.5),
        Row(s=1, keyword="k", business_variable="v", direction="positive", event="a", evidence_id="a", q=0.5),
        Row(s=1, keyword="k", business_variable="v", direction="positive", event="c", evidence_id="c", q=0.2),
        Row(s=1, keyword="k", business_variable="v", direction="negative", event="d", evidence_id="d", q=0.9),
        Row(s=1, keyword="k", business_variable="v", direction="neutral", event="e", evidence_id="e", q=0.9)])
    row = ev.event_evidence(items, ["s"]).first()
    assert row["e_plus"] == pytest.approx(1 - 0.5 * 0.8) and row["e_minus"] == pytest.approx(0.9) and row["e"] == 0.0


def test_cost_equity_and_drawdown(spark):
    df = spark.createDataFrame([(1, 1, 0.05), (1, 2, -0.02)], "s int, day int, ret double").withColumn("net", sessions.net_return(F.col("ret")))
    path = sessions.equity_path(df, ["s"], "day", "net").orderBy("day").collect()
    assert path[0]["net"] == pytest.approx(0.048)
    assert path[1]["equity"] == pytest.approx((1 + 0.048) * (1 - 0.022))
    assert sessions.max_drawdown(df, ["s"], "day", "net").first()["max_drawdown"] == pytest.approx(-0.022)


def test_walk_forward_sizes(spark):
    days = spark.range(200).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    out = sessions.walk_forward(days, 30, 10, 10, 3).groupBy("window", "role").count().collect()
    assert {(r["role"], r["count"]) for r in out} == {("train", 30), ("validation", 10), ("test", 10)}
    assert len({r["window"] for r in out}) == (200 - 56) // 10 + 1


def test_decay_breadth_precision(spark):
    one = spark.range(1)
    at = instant("2026-01-10 00:00:00")
    row = one.select(ev.time_decay(instant("2026-01-08 00:00:00"), at).alias("half"), ev.time_decay(instant("2026-01-01 00:00:00"), at).alias("old"),
                     ev.time_decay(instant("2026-01-11 00:00:00"), at).alias("future"), ev.breadth(F.lit(4)).alias("b"),
                     ev.breadth(F.lit(10000)).alias("floor"), ev.breadth(F.lit(None)).alias("unknown")).first()
    assert row["half"] == pytest.approx(0.5) and row["old"] == 0.0 and row["future"] == 0.0
    assert (row["b"], row["floor"], row["unknown"]) == (0.5, 0.08, 1.0)


def test_evidence_curve(spark):
    df = spark.createDataFrame([(1, 0.6796), (2, 5.0), (2, 0.1)], "s int, x double")
    got = {r["s"]: r["evidence_score"] for r in ev.evidence_score(df, ["s"], "x").collect()}
    assert got[1] == pytest.approx(45 * (1 - 1 / 1.6796), abs=1e-4)
    assert got[2] == pytest.approx(45 * (1 - 1 / (2.5 * 1.1)), abs=1e-4)


def test_entities_are_ranked_and_pruned(spark):
    df = spark.createDataFrame([(1, "光伏组件需求回暖", "国内光伏装机。")], "news_id int, title string, content string")
    got = news.entities(df, {"新能源": ["光伏"]}, ["光伏", "需求"], []).first()["entities"]
    assert got == ["光伏", "需求", "新能源"]


def test_rule_signal_and_validation(spark):
    df = spark.createDataFrame([(1, "白银库存下降", "供给紧张", "a")], "news_id int, title string, content string, source string")
    got = news.validate_signals(news.rule_signals(df), df).collect()
    assert {(r["keyword"], r["business_variable"], r["status"]) for r in got} == {("白银", "供给不足", "candidate")}
    assert got[0]["confidence"] == pytest.approx(0.58 + 0.08 + 0.02)
