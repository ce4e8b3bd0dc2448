"""Steps of the selection queries on small rows: what they read and pair, and the size of their compiled methods."""

import datetime as dt

from pyspark.sql import functions as F
from tickerloom.operators import lookups, market, matching

DAY = dt.date(2020, 1, 1)


def test_wide_projections_are_split_where_hotspot_stops_compiling(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_lines_of_stocks_meet_their_days_after_one_shuffle(spark, tmp_path):
    from tickerloom.operators import bar_features
    from tickerloom.sources.views import Views

    rows = [(i % 7, i % 3, i % 5, 1, DAY + dt.timedelta(i % 11), 10.0 * i, 5.0) for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate date, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = bar_features.momentum(Views(spark, str(tmp_path)).bars, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_market_day_pairs_move_bars_once(spark):
    day = lambda n: DAY + dt.timedelta(n)
    rows = [(1, day(0), 1.0, 10), (1, day(1), 2.0, 20), (2, day(0), 3.0, 30), (2, day(4), 4.0, 40), (1, day(4), 5.0, None), (None, day(0), 6.0, 60), (None, day(1), 7.0, 70)]
    bars = spark.createDataFrame(rows, "stock_key long, trading_day date, close double, volume long")
    pairs = lookups.market_day_pairs(bars)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, day(0), day(1), 2.0, 20, 1.0, 10), (1, day(1), day(4), 5.0, None, 2.0, 20)]
    assert pairs._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0


def test_forecasts_follow_bars_of_their_members_alone(spark):
    forecasts = spark.createDataFrame([("k", "bullish", dt.datetime(2020, 1, 1, 16))], "keyword string, direction string, as_of timestamp")
    members = spark.createDataFrame([("k", 1)], "keyword string, stock_key long")
    bars = spark.createDataFrame([(s, DAY + dt.timedelta(n), 10.0 + n) for s in (1, 2) for n in range(7)], "stock_key long, trading_day date, close double")
    out = market.settle_forecasts(forecasts, members, bars)
    assert out.select("realised", "hit").collect()[0] == ("up", True)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()


def test_alias_lines_are_cut_once(spark):
    news = spark.createDataFrame([(1, "head", "alpha meets betagamma\nnothing here")], "news_id long, title string, content string")
    signals = spark.createDataFrame([(1, "alpha", 0.8)], "news_id long, keyword string, confidence double")
    facts = spark.createDataFrame([(9, "betagamma", "business_exposure", "SW1")], "stock_key long, keyword string, exposure_type string, taxonomy_level string")
    out = matching.alias_candidates(facts.select("stock_key"), signals, facts, news)
    assert [tuple(r) for r in out.select("source", "canonical", "news_id", F.col("first_sentence")).collect()] == [("alpha", "betagamma", 1, 1)]
    assert "posexplode(" not in out._jdf.queryExecution().optimizedPlan().toString()
