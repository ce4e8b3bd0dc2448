"""Market, news and run tables derived from the star-schema parquet inputs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, configure, spread

# Board prefixes given to the derived stock symbols.
BOARD_PREFIXES = "600000300688830900"
#: Keywords of the derived tables, whatever their size: rows per keyword grow with the data.
KEYWORDS = 100


class Views:
    """Lazily built DataFrames over one data folder; nothing is read until used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def counts(self) -> dict[str, int]:
        """Row counts of the two tables that derived keys are folded into (parquet footers only)."""
        return {name: self.table(name).count() for name in ("supplier", "documents")}

    @cached_property
    def stocks(self) -> DataFrame:
        key = F.col("s_suppkey")
        nation = broadcast_if_small(self.table("nation"))
        region = broadcast_if_small(self.table("region"))
        prefix = F.substring(F.lit(BOARD_PREFIXES), (1 + 3 * (key % 6)).cast("int"), F.lit(3))
        return (
            self.table("supplier")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                key.alias("stock_key"),
                F.concat(prefix, F.lpad((key % 1000).cast("string"), 3, "0")).alias("symbol"),
                F.when(key % 11 == 0, F.concat(F.lit("ST"), F.col("s_name"))).otherwise(F.col("s_name")).alias("name"),
                F.col("n_name").alias("industry"),
                F.col("r_name").alias("sector"),
            )
        )

    @cached_property
    def bars(self) -> DataFrame:
        """Daily bars. First and last price come from ordered min_by/max_by, so one aggregation suffices.

        Lines are dealt by stock and sorted once: the aggregation and every window over a stock's days follow without another shuffle.
        """
        ticks = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100)
        order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
        lines = self.table("lineitem").select(
            F.col("l_suppkey").alias("stock_key"),
            F.to_date("l_shipdate").alias("trading_day"),
            (ticks * F.lit(0.0001).cast("decimal(5,4)")).cast("decimal(18,4)").alias("px"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            order.alias("o"),
        )
        return lines.repartition("stock_key").groupBy("stock_key", "trading_day").agg(
            F.min_by("px", "o").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "o").alias("close"),
            (F.sum("qty") * 100).cast("bigint").alias("volume"),
        )

    @cached_property
    def bars_full(self) -> DataFrame:
        """Bars with import metadata: some rows late, some unknown, some suspended."""
        lots = F.col("volume") / F.lit(100)
        lots = lots.cast("bigint")
        day = F.col("trading_day")
        return self.bars.select(
            "*",
            F.when(lots % 7 != 0, day.cast("timestamp") + F.expr("INTERVAL '8' HOUR")
                   + (F.col("stock_key") % 3) * F.expr("INTERVAL '1' DAY")).alias("visible_at"),
            F.when(lots % 11 == 0, F.lit(None)).when(lots % 11 == 1, "SUSPEND").otherwise("NORMAL")
            .alias("trading_status"),
            F.when(lots % 10 == 0, "").when(lots % 10 == 1, "qfq").when(lots % 10 == 2, "none").otherwise("hfq")
            .alias("adj_type"),
            F.when(F.year(day) >= 1997, F.concat(F.lit("v"), F.year(day).cast("string"))).alias("dataset_version"),
        )

    @cached_property
    def news(self) -> DataFrame:
        """Documents as news; the first sentence is the title and the whole text is the content."""
        doc = F.col("doc_id")
        return spread(self.table("documents")).select(
            doc.alias("news_id"),
            F.regexp_extract("text", r"^([^.\n]*)", 1).alias("title"),
            F.col("text").alias("content"),
            "source",
            (F.expr("TIMESTAMP '2000-01-01 00:00:00'").cast("timestamp")
             + ((doc * 37) % 43200) * F.expr("INTERVAL '1' MINUTE")).alias("published_at"),
        )

    @cached_property
    def signals(self) -> DataFrame:
        kind = F.col("event_type")
        number = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
        return self.table("events").select(
            F.col("event_id").alias("signal_id"),
            (F.col("event_id") % self.counts["documents"]).alias("news_id"),
            F.concat(F.lit("k"), number.cast("string")).alias("keyword"),
            kind.alias("business_variable"),
            F.when(kind.isin("purchase", "signup"), "positive").when(kind == "error", "negative")
            .when(kind == "click", "mixed").otherwise("neutral").alias("direction"),
            (F.floor(F.least(F.lit(1.0), F.col("value") / 500) * 10000) / 10000.0).alias("confidence"),
            (F.col("ts").cast("timestamp") - F.expr("INTERVAL '24' YEAR")).alias("signal_at"),
        )

    @cached_property
    def facts(self) -> DataFrame:
        part, size = F.col("p_partkey"), F.col("p_size")
        number = part % KEYWORDS
        base = self.table("part").select(part, size, number.alias("kn"))
        members = base.groupBy("kn").agg(F.count("*").alias("member_count"))
        return base.join(members, "kn").select(
            part.alias("fact_id"),
            (part % self.counts["supplier"]).alias("stock_key"),
            F.concat(F.lit("k"), F.col("kn").cast("string")).alias("keyword"),
            F.when(size % 3 == 0, "business_exposure").when(size % 3 == 1, "concept_exposure")
            .otherwise("industry_exposure").alias("exposure_type"),
            F.concat(F.lit("SW"), (1 + size % 3).cast("string")).alias("taxonomy_level"),
            ((50 + size) / F.lit(100.0)).alias("confidence"),
            "member_count",
            (F.expr("TIMESTAMP '1999-01-01 00:00:00'").cast("timestamp") + size * F.expr("INTERVAL '10' DAY"))
            .alias("valid_from"),
            F.when(size % 4 == 0, F.expr("TIMESTAMP '2000-01-10 00:00:00'").cast("timestamp")).alias("valid_to"),
            F.lit("active").alias("status"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        state = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_orderpriority").alias("tenant"),
            (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL '16' HOUR")).alias("as_of"),
            F.when(state == "F", "SUCCESS").when(state == "O", "RUNNING").otherwise("FAILED").alias("status"),
        )

    @cached_property
    def evidence(self) -> DataFrame:
        """One evidence row per order line: which keyword of which news item supported which stock in a run."""
        part = F.col("l_partkey")
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("evidence_id"),
            F.col("l_orderkey").alias("run_id"),
            F.col("l_suppkey").alias("stock_key"),
            (part % self.counts["documents"]).alias("news_id"),
            F.concat(F.lit("k"), (part % KEYWORDS).cast("string")).alias("keyword"),
            F.when(F.col("l_linenumber") % 3 != 0,
                   F.concat(F.lit("k"), ((part + F.col("l_linenumber")) % KEYWORDS).cast("string")))
            .alias("matched_keyword"),
            part.alias("fact_id"),
            (F.floor(F.col("l_discount") * 1000 + 0.5) / 100.0).alias("contribution"),
            F.when(F.col("l_tax") > 0.01, (50 + F.floor(F.col("l_tax") * 500 + 0.5)) / 100.0).alias("match_confidence"),
        )

    @cached_property
    def recs(self) -> DataFrame:
        """Ranked recommendations per run; lines are dealt by run once."""
        lines = (
            self.table("lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("stock_key"))
            .agg((F.max("l_quantity") * 2).cast("decimal(10,4)").alias("final_score"))
        )
        from pyspark.sql import Window as W

        rank = F.row_number().over(W.partitionBy("run_id").orderBy(F.desc("final_score"), "stock_key"))
        return lines.join(self.runs.drop("status"), "run_id").select(
            "run_id", "tenant", "as_of", "stock_key", "final_score", rank.cast("bigint").alias("rnk"))

    @cached_property
    def publishes(self) -> DataFrame:
        return self.runs.where(F.col("status") == "SUCCESS").select(
            "run_id", "tenant", "as_of", F.lit(1).cast("bigint").alias("publish_version"),
            (F.col("as_of") + F.expr("INTERVAL '1' HOUR")).alias("published_at"))
