"""Run, data and quality audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import nearest_rank
from .temporal import valid_at


def ingest_diagnostics(raw: DataFrame, normal: DataFrame, as_of: Column) -> DataFrame:
    """Raw, normalised and down-weighted rows per source up to an instant."""
    r = raw.where(F.col("published_at") <= as_of).groupBy("source").agg(F.count("*").alias("raw"))
    n = normal.where(F.col("published_at") <= as_of).groupBy("source").agg(
        F.count("*").alias("normalised"), F.count_if(F.col("weight") < 1).alias("penalised"))
    return r.join(n, "source", "full").select("source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("raw", "normalised", "penalised")])


def verify_facts(facts: DataFrame, as_of: Column, minimum: int) -> DataFrame:
    return valid_at(facts, as_of).agg(
        F.count("*").alias("facts"), F.countDistinct("stock_key").alias("stocks"), F.countDistinct("keyword").alias("keywords")
    ).withColumn("enough", F.col("facts") >= minimum)


def fact_fingerprint(facts: DataFrame, aliases: DataFrame, as_of: Column) -> DataFrame:
    """Order-free fingerprint and size of the active facts and aliases, per fact type."""
    def part(df: DataFrame, group: Column, *columns: str) -> DataFrame:
        h = F.xxhash64(*columns)
        return df.groupBy(group.alias("kind")).agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor_hash"),
                                                   F.sum(h.cast("decimal(38,0)")).alias("sum_hash"))

    return part(valid_at(facts, as_of), F.col("exposure_type"), "stock_key", "keyword", "confidence").unionByName(
        part(aliases, F.lit("alias"), "source", "canonical"))


def fact_freshness(facts: DataFrame, as_of: Column, minimum: int, max_days: int) -> DataFrame:
    out = valid_at(facts, as_of).agg(F.count("*").alias("facts"), F.countDistinct("stock_key").alias("stocks"),
                                     F.max("valid_from").alias("newest"))
    age = F.floor((F.unix_seconds(as_of) - F.unix_seconds("newest")) / 86400)
    return out.withColumn("age_days", age).withColumn("fresh", (F.col("facts") >= minimum) & (F.col("age_days") <= max_days))


def bar_preflight(bars: DataFrame, keys: list[str], as_of_day: Column) -> DataFrame:
    """Latest bar day per group against the expected session (Friday at weekends)."""
    expected = F.when(F.weekday(as_of_day) == 5, F.date_sub(as_of_day, 1)).when(
        F.weekday(as_of_day) == 6, F.date_sub(as_of_day, 2)).otherwise(as_of_day)
    latest = bars.where(F.col("trading_day") <= as_of_day).groupBy(*keys).agg(F.max("trading_day").alias("latest_day"))
    return latest.withColumn("expected_day", expected).withColumn(
        "gap_days", F.datediff("expected_day", "latest_day")).withColumn("stale", F.col("latest_day") < F.col("expected_day"))


def coverage_gaps(cases: DataFrame, recs: DataFrame, evidence: DataFrame, scores: DataFrame, stocks: DataFrame, low: float = 60.0) -> DataFrame:
    """Why a case (stock, day) was not recommended that day: pool, evidence, score or selection."""
    chosen = recs.select("stock_key", "day").distinct()
    counts = evidence.groupBy("stock_key", "day").agg(F.count("*").alias("evidence_count"))
    best = scores.groupBy("stock_key", "day").agg(F.max("score").alias("score"))
    out = (
        cases.select("stock_key", "day").join(chosen, ["stock_key", "day"], "left_anti")
        .join(stocks.select("stock_key", F.lit(True).alias("_listed")), "stock_key", "left")
        .join(counts, ["stock_key", "day"], "left").join(best, ["stock_key", "day"], "left")
    )
    reason = (
        F.when(F.col("_listed").isNull(), "not_in_stock_pool").when(F.col("evidence_count").isNull(), "no_evidence_chain")
        .when(F.col("score").isNull() | (F.col("score") < low), "score_too_low").otherwise("filtered_out")
    )
    return out.select("stock_key", "day", reason.alias("reason"))


def latency_stats(log: DataFrame, as_of: Column, minutes: int, keys: list[str]) -> DataFrame:
    """Requests, errors, mean and nearest-rank p95 in the last minutes, per key."""
    window = log.where((F.col("created_at") >= as_of - F.make_interval(mins=F.lit(minutes))) & (F.col("created_at") <= as_of))
    sums = window.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"),
        (F.sum(F.col("duration_ms").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_ms"))
    return sums.join(nearest_rank(window, keys, "duration_ms", 0.95, name="p95_ms"), keys)


def complete_sets(parts: DataFrame, key: str, index: str) -> DataFrame:
    """A set of parts is complete iff its indices are exactly 0..n-1."""
    return parts.groupBy(key).agg(
        F.count("*").alias("parts"), F.countDistinct(index).alias("distinct_parts"), F.min(index).alias("first"), F.max(index).alias("last")
    ).withColumn("complete", (F.col("parts") == F.col("distinct_parts")) & (F.col("first") == 0) & (F.col("last") == F.col("parts") - 1))


def run_overview(steps: DataFrame, events: DataFrame, statuses: list[str]) -> DataFrame:
    """Steps by status and event totals per run."""
    pivot = steps.groupBy("run_id").pivot("status", statuses).count().na.fill(0)
    totals = events.groupBy("run_id").agg(F.count("*").alias("events"), F.sum("tokens").alias("tokens"),
                                          F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("cost"))
    return pivot.join(totals, "run_id", "left")


def run_phases(steps: DataFrame, statuses: list[str]) -> DataFrame:
    """Steps per run and phase: how many, by status, first and last position."""
    return steps.groupBy("run_id", "phase").agg(
        F.count("*").alias("steps"), *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.min("position").alias("first"), F.max("position").alias("last"))


def event_counts(events: DataFrame) -> DataFrame:
    """Events of all runs by type and level, with the totals of each type, each level and all (null stands for all)."""
    return events.cube("type", "level").agg(F.count("*").alias("events"), F.countDistinct("run_id").alias("runs"))


def modal_day(feed: DataFrame, day: str) -> DataFrame:
    """Most frequent day of a feed; the smallest wins ties."""
    return feed.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


def quality_issues(rows: DataFrame) -> DataFrame:
    """One row per recommendation and issue found."""
    ratio = F.coalesce("volume_ratio", F.lit(0.0))
    confirmed = (ratio >= 1) & (F.col("breakout") == 1.0)
    hot = (F.coalesce("momentum5", F.lit(0.0)) >= 0.15) | (F.coalesce("momentum20", F.lit(0.0)) >= 0.25)

    def issue(name: str, level: str, test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("issue"), F.lit(level).alias("level")))

    # Issue names, levels and bounds.
    found = F.array_compact(F.array(
        issue("weight_mismatch", "error", F.col("weights") != "45/20/15/20"),
        issue("stale_market_signal", "error", (F.col("stale_days") > 1) | (F.col("latest_day") < F.col("latest_market_day"))),
        issue("graph_dominated", "warn", (F.col("evidence_score") < 10) & (F.col("graph_score") >= 12)),
        issue("broad_exposure", "warn", (F.col("exposure_score") < 4) & ~((F.col("evidence_score") >= 18) & (F.col("market_score") >= 8))),
        issue("overheated", "warn", hot & ~confirmed),
        issue("low_volume_rebound", "warn", (F.col("momentum20") <= -0.12) & (ratio < 0.8)),
        issue("keyword_saturated", "info", F.col("saturated")),
        issue("post_return", "info", F.col("change_pct") < 0)))
    return rows.select("run_id", "stock_key", F.explode(found).alias("i")).select("run_id", "stock_key", "i.*")
