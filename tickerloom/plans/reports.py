"""Day views composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import dbl
from ..operators import asof, latest, lookups, sessions
from ..operators.selection import order_evidence


def snapshot(recs: DataFrame, runs: DataFrame, evidence: DataFrame, bars: DataFrame, win_rates: DataFrame) -> DataFrame:
    """Shown run of each day with evidence statistics, stage, last visible close and recent win rates."""
    shown = latest.pick_run(recs, runs).select("run_id", "day")
    rows = recs.join(shown, "run_id")
    total = F.count("*").over(Window.partitionBy("run_id"))
    staged = rows.withColumn("stage", sessions.stage(F.col("rnk"), total))
    priced = asof.latest_bar(staged, bars, F.col("as_of"), ["close"])
    return lookups.evidence_stats(priced, evidence.join(shown.select("run_id"), "run_id", "left_semi")).join(
        win_rates, "stock_key", "left").withColumn("close", dbl("bar.close")).drop("bar")


def daily_report(recs: DataFrame, runs: DataFrame, evidence: DataFrame, news: DataFrame, top: int = 3) -> DataFrame:
    """Recommendations of each day's shown run with stage and their leading evidence as one text."""
    shown = latest.pick_run(recs, runs).select("run_id", "day")
    rows = recs.join(shown, "run_id")
    staged = rows.withColumn("stage", sessions.stage(F.col("rnk"), F.count("*").over(Window.partitionBy("run_id"))))
    lead = order_evidence(evidence.join(shown.select("run_id"), "run_id", "left_semi"), news).where(F.col("position") <= top)
    listed = lead.groupBy("run_id", "stock_key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("position", F.coalesce("matched_keyword", "keyword").alias("w")))), lambda x: x["w"]), ",").alias("keywords"))
    return staged.join(listed, ["run_id", "stock_key"], "left").select("day", "run_id", "stock_key", "rnk", "stage", "keywords")
