"""No look-ahead, idempotent merges, order independence, replays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tickerloom.functions.timekeys import instant
from tickerloom.operators import audits, temporal
from tickerloom.session import shared_folder
from tickerloom.sources import feeds, merge
from tickerloom.sources.views import Views
from tickerloom.streaming import feeds as sf

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, FOLDER)


def test_earlier_instants_never_see_more(views):
    keys = ["stock_key", "trading_day"]
    early = temporal.bars_as_of(views.bars_full, instant("1999-06-30 12:00:00")).select(*keys)
    late = temporal.bars_as_of(views.bars_full, instant("2000-06-30 12:00:00")).select(*keys)
    assert early.join(late, keys, "left_anti").isEmpty()


def test_upsert_twice_changes_nothing(views):
    target, batch = views.bars_full.where("trading_day < DATE '1999-01-01'"), views.bars_full.where("trading_day >= DATE '1998-01-01'")
    once = merge.upsert_bars(target, batch).drop("change")
    twice = merge.upsert_bars(once, batch).drop("change").select(once.columns)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_append_new_twice_adds_nothing(views):
    keys = ["news_id", "keyword"]
    first = merge.append_new(views.signals.limit(0), views.signals, keys, [F.asc("signal_id")])
    assert merge.append_new(first, views.signals, keys, [F.asc("signal_id")]).isEmpty()


def test_checksum_ignores_row_order(views):
    day = instant("2001-12-31")
    a = feeds.describe_dataset(views.bars, "x", day).first()
    b = feeds.describe_dataset(views.bars.repartition(7).sortWithinPartitions(F.desc("close")), "x", day).first()
    assert a == b
    aliases = views.table("nation").select(F.col("n_name").alias("source"), F.col("n_name").alias("canonical"))
    at = instant("2000-01-15")
    x = sorted(audits.fact_fingerprint(views.facts, aliases, at).collect())
    assert x == sorted(audits.fact_fingerprint(views.facts.repartition(5), aliases, at).collect())


def test_strict_admission_fails(views):
    report = temporal.admission_report(views.bars_full, F.lit("1996-01-01").cast("date"), F.lit("2000-01-01").cast("date"))
    with pytest.raises(temporal.StrictAdmissionError):
        temporal.require_admission(report)


def test_files_round_trip(spark, views):
    folder = shared_folder(spark, "files")
    views.bars_full.select("stock_key", "trading_day", "open", "high", "low", "close", "volume", "trading_status", "adj_type").write.json(f"{folder}/bars")
    back = feeds.read_bars(spark, f"{folder}/bars")
    assert back.count() == views.bars.count()
    merge.write_by_month(views.bars, f"{folder}/table")
    merge.write_by_month(views.bars.where("trading_day >= DATE '2000-01-01'"), f"{folder}/table")
    assert spark.read.parquet(f"{folder}/table").count() == views.bars.count()


def test_streak_survives_batches(spark):
    folder = shared_folder(spark, "streak")
    schema = "tenant string, day date, value double"
    days = [dt.date(2026, 1, d) for d in range(1, 7)]
    late = ([days[1], days[2], days[2]], [5.0, 5.0, -1.0])
    for part, (chunk, values) in enumerate(((days[:3], [1.0, -1.0, -1.0]), late, (days[3:], [-1.0, -1.0, 2.0]))):
        spark.createDataFrame([("a", d, v) for d, v in zip(chunk, values)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    out = sf.drain(sf.streak_alert(sf.read_stream(spark, f"{folder}/feed", files_per_trigger=1), "tenant", 0.0, 3), "update")
    streaks = [r["streak"] for r in out.orderBy("batch").collect()]
    assert streaks == [2, 2, 0]


def test_ingest_skips_what_is_stored(spark):
    folder = shared_folder(spark, "ingest")
    schema = "stock_key bigint, trading_day date, open double, high double, low double, close double, volume bigint, seq int"
    row = (1, dt.date(2026, 1, 1), 1.0, 2.0, 0.5, 1.5, 10, 1)
    spark.createDataFrame([row, (1, dt.date(2026, 1, 2), 1.0, 0.5, 0.5, 1.5, 10, 2)], schema).coalesce(1).write.parquet(f"{folder}/feed")
    spark.createDataFrame([row, (2, dt.date(2026, 1, 1), 1.0, 2.0, 0.5, 1.5, -5, 3)], schema).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
    kept = sf.ingest_bars(sf.read_stream(spark, f"{folder}/feed", files_per_trigger=1), ["seq"], folder).collect()
    assert sorted((r["stock_key"], r["volume"]) for r in kept) == [(1, 10), (2, 0)]
