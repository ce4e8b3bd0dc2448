"""SQL functions give what the column functions give."""

from pyspark.sql import functions as F
from tickerloom.functions import sql as named
from tickerloom.functions import text as tx
from tickerloom.operators import bar_features as bf
from tickerloom.operators import evidence as ev
from tickerloom.operators import temporal as tp
from tickerloom.functions.timekeys import instant
from tickerloom.sources.views import Views


def test_sql_functions_equal_column_functions(spark):
    named.register(spark)
    v = Views(spark, "/root/testdata/sf0.001")
    odd = spark.createDataFrame([("（ 白银-Ⅱ ", "芯片 - 新浪财经"), ("Ａｂ　c'd", "煤炭"), ("", "x|证券")], "a string, b string")
    rows = odd.select("*", F.expr("norm_kw(a)").alias("k"), tx.norm_kw("a").alias("k2"), F.expr("norm_title(b)").alias("t"),
                      tx.norm_title("b").alias("t2"), F.expr("theme_bucket(b)").alias("th"), tp.theme_bucket("b").alias("th2"))
    assert all(r["k"] == r["k2"] and r["t"] == r["t2"] and r["th"] == r["th2"] for r in rows.collect())
    stocks = v.stocks.select(F.expr("limit_pct(symbol, name)").alias("x"), bf.limit_rule("symbol", "name")["limit_pct"].alias("y"))
    assert stocks.where("x <> y").isEmpty()
    facts = v.facts.select(F.expr("breadth(member_count)").alias("x"), ev.breadth("member_count").alias("y"))
    assert facts.where("x <> y").isEmpty()
    at = instant("2000-01-15 16:00:00")
    news = v.news.select(F.expr("time_decay(published_at, TIMESTAMP '2000-01-15 16:00:00', 2, 7)").alias("x"),
                         ev.time_decay(F.col("published_at"), at).alias("y"))
    assert news.where("abs(x - y) > 1e-12").isEmpty()
    signals = v.signals.select(F.expr("direction_weight(direction)").alias("x"), tp.direction_weight("direction").alias("y"))
    assert signals.where("x <> y").isEmpty()
