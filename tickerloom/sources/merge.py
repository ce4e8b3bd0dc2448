"""Merges expressed as joins; results are new table contents to be written by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import WrittenTable

BAR_METADATA = ("trading_status", "adj_type", "visible_at", "dataset_version")


def upsert_bars(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert new bars; where a bar exists its prices stay and only its metadata is replaced."""
    keys = ["stock_key", "trading_day"]
    t, b = target.alias("t"), batch.alias("b")
    held = F.col("t.close").isNotNull()
    arrived = F.col("b.close").isNotNull()
    prices = [F.coalesce(f"t.{c}", f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")]
    metadata = [F.when(arrived, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in BAR_METADATA]
    change = F.when(held & arrived, "updated").when(arrived, "inserted").otherwise("kept").alias("change")
    return t.join(b, keys, "full").select(*keys, *prices, *metadata, change)


def write_by_month(bars: DataFrame, path: str) -> None:
    """Write bars partitioned by month, replacing only the months present."""
    (
        bars.withColumn("month", F.date_format("trading_day", "yyyy-MM"))
        .repartition("month", "stock_key").sortWithinPartitions("month", "stock_key", "trading_day")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    )


def append_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the batch whose key is new, one per key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    fresh = batch.withColumn("_rn", first).where("_rn = 1").drop("_rn")
    return fresh.join(target.select(*keys), keys, "left_anti")


def merge_match_cache(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Keep the first fact id, raise confidence, count hits and reopen what was hit again."""
    keys = ["stock_key", "keyword"]
    hits = batch.groupBy(*keys).agg(F.min("fact_id").alias("fact_id"), F.max("confidence").alias("confidence"))
    t, b = target.alias("t"), hits.alias("b")
    hit = F.col("b.fact_id").isNotNull()
    return t.join(b, keys, "full").select(
        *keys, F.coalesce("t.fact_id", "b.fact_id").alias("fact_id"),
        F.greatest("t.confidence", "b.confidence").alias("confidence"),
        (F.coalesce("t.hit_count", F.lit(0)) + hit.cast("bigint")).alias("hit_count"),
        F.when(hit, "open").otherwise(F.col("t.status")).alias("status"))


def merge_candidates(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Best row of the batch per key, then the higher confidence of stored and new."""
    best = batch.groupBy(*keys).agg(
        F.max_by(F.struct("confidence", "evidence_id"), F.struct(F.col("confidence"), F.col("evidence_id"))).alias("s")
    ).select(*keys, "s.confidence", "s.evidence_id")
    t, b = target.alias("t"), best.alias("b")
    return t.join(b, keys, "full").select(
        *keys, F.greatest("t.confidence", "b.confidence").alias("confidence"),
        F.coalesce("t.evidence_id", "b.evidence_id").alias("evidence_id"))


def append_rows(table: WrittenTable, batch_id: str, rows: DataFrame, keys: list[str], order: list[Column]) -> bool:
    """Append the rows whose key a written table lacks; a repeated batch changes nothing."""
    if table.applied(batch_id):
        return False
    touched = [r[0] for r in rows.select(table.part).distinct().collect()]  # names of partitions
    return table.append(batch_id, append_new(table.read(touched), rows, keys, order))
