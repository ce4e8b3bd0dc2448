"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

DataFrame and DataFrame-based ML functions only.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import url_labels

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path prefix, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SIZES, FEATURES = (3, 4, 5), 1 << 16
#: An address is blocked by the model from this score on. One without telling grams scores about the share of blocked rows in the
#: labelled table, which lies below.
THRESHOLD = 0.5
PENALTY = 0.003


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled URL table: url, label (1: block), address (rows of one address are variants of it)."""
    lines = "\n".join("\t".join(map(str, row)) for row in url_labels.addresses())
    options = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    cells = spark.range(1, numPartitions=1).select(F.explode(F.split(F.lit(lines), "\n")).alias("line"))
    rows = cells.select(F.split("line", "\t").alias("r")).select(
        *[F.col("r")[i].alias(c) for i, c in enumerate(("address", "scheme", "name", "rest"))], F.col("r")[4].cast("double").alias("label"))
    rows = rows.withColumn("front", options(url_labels.FRONTS)).withColumn("end", options(url_labels.ENDS))
    return rows.select(F.concat("scheme", F.lit("://"), "front", "name", "end", "rest").alias("url"), "label", "address")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both are empty without ``://`` and for null."""
    whole = F.coalesce(F.col(url), F.lit(""))
    return urls.withColumns({"host": F.translate(F.regexp_extract(whole, "://([^/?#]*)", 1), UPPER, LOWER),
                             "path": F.regexp_extract(whole, "://[^/?#]*([^?#]*)", 1)})


def _grams(text: Column, tag: str) -> Column:
    parts = []
    for n in SIZES:
        places = F.sequence(F.lit(1), F.length(text) - (n - 1))
        parts.append(F.when(F.length(text) >= n, F.transform(places, lambda i, n=n: F.concat(F.lit(tag), text.substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def featured(parts: DataFrame) -> DataFrame:
    """Adds the hashed n-grams of host and path, with marks at their ends."""
    edge = F.lit("^")
    grams = F.array_distinct(F.concat(_grams(F.concat(edge, F.col("host"), F.lit("$")), "h:"), _grams(F.concat(edge, F.col("path"), F.lit("$")), "p:")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(parts.withColumn("_grams", grams))


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """Fit on a small table (url, label)."""
    rows = featured(with_parts(labelled)).select("_features", "label")
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=PENALTY, maxIter=80).fit(rows)


def rule_of(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null; rules of equal length in order of their text."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, model: LogisticRegressionModel, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, block_score of every row.

    Where no rule fits, the model blocks at a score of ``THRESHOLD`` or more. A null URL, or one without ``://``, has an empty host and
    path and is judged by the model's n-grams of nothing. Repeated rows are judged one by one; an empty table gives an empty
    result.
    """
    rows = featured(with_parts(pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")), "_url"))
    scored = model.transform(rows).withColumn("block_score", vector_to_array("probability")[1]).withColumn("_rule", rule_of(rules))
    by_model = F.when(F.col("block_score") >= THRESHOLD, "block").otherwise("allow")
    return scored.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), by_model).alias("verdict"), "block_score")
