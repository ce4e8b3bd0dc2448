"""Schemas of files read from outside."""

from pyspark.sql import types as T

BAR = T.StructType([
    T.StructField("stock_key", T.LongType()),
    T.StructField("trading_day", T.DateType()),
    T.StructField("open", T.DecimalType(18, 4)),
    T.StructField("high", T.DecimalType(18, 4)),
    T.StructField("low", T.DecimalType(18, 4)),
    T.StructField("close", T.DecimalType(18, 4)),
    T.StructField("volume", T.LongType()),
    T.StructField("trading_status", T.StringType()),
    T.StructField("adj_type", T.StringType()),
])

ARTICLE = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("publishedAt", T.StringType()),
])

NEWS_PAYLOAD = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("articles", T.ArrayType(ARTICLE)),
])
