"""Streams fed in several batches with late and repeated rows, against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F
from tickerloom.session import shared_folder
from tickerloom.streaming import feeds


def at(minute):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=minute)


def progress(stream, mode="update"):
    """Rows of state after every batch, and all rows written."""
    folder = shared_folder(stream.sparkSession, "progress")
    written = []
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).foreachBatch(
        lambda batch, n: written.extend((n, tuple(r)) for r in batch.collect())).start()
    query.awaitTermination(300)
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators], written


def test_validity_ends_and_state_falls(spark):
    rng = random.Random(1)
    rows = [(f"k{i}", at(rng.randrange(60))) for i in range(40)] * 2 + [("late", at(5))] + [("live", at(m)) for m in range(0, 2000, 50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    feed = feeds.write_feed(df, "ts", shared_folder(spark, "validity"), batches=4, files=1)
    held, written = progress(feeds.last_success(feed, "k", "ts", F.lit(True), 600))
    last = {}
    for n, (k, when, valid) in sorted(written, key=lambda w: (w[0], not w[1][2])):
        last[k] = (when, valid)
    newest = {k: max(t for key, t in rows if key == k) for k, _ in rows}
    assert {k: t for k, (t, _) in last.items()} == newest
    assert {k for k, (_, valid) in last.items() if valid} == {"live"}
    assert max(held) > 5 and held[-1] <= 2


def test_streaks_over_batches(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=d) for d in range(120)]
    rows = [("a", d, float(i % 7 != 3)) for i, d in enumerate(days)] + [("b", d, 0.0) for d in days[:9]] + [("c", days[0], 0.0), ("c", days[100], 0.0)]
    feed = feeds.write_feed(spark.createDataFrame(rows, "k string, day date, value double"), "day", shared_folder(spark, "streaks"), batches=5, files=1)
    held, written = progress(feeds.streak_alert(feed, "k", 0.5, 2))
    last = {k: (day, streak, alert) for _, (k, day, streak, alert) in sorted(written, key=lambda w: w[0])}
    ends = {k: max(r[1] for r in rows if r[0] == k) for k in "abc"}
    assert {k: v[0] for k, v in last.items()} == ends
    assert last["a"][1:] == (0, False) and last["b"][1:] == (9, True)
    assert last["c"][1:] == (1, False)  # away for longer than the idle limit
    assert held[-1] < max(held)


def test_percentile_summary_keeps_its_bound(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 2) for _ in range(40_000)]
    df = spark.createDataFrame([("e", at(i % 45), v) for i, v in enumerate(values)] + [("e", at(900), 1.0)], "k string, ts timestamp, ms double")
    feed = feeds.write_feed(df, "ts", shared_folder(spark, "latency"), batches=3, files=2, again=False)
    rows = feeds.drain(feeds.latency(feed, "ts", "k", "ms")).collect()
    full = next(r for r in rows if r.window_start == at(0))
    assert full.requests == 40_000
    below, upto = sum(v < full.p95_ms for v in values), sum(v <= full.p95_ms for v in values)
    assert below <= 0.95 * 40_000 + 40_000 / feeds.ACCURACY and upto >= 0.95 * 40_000 - 40_000 / feeds.ACCURACY


def test_counts_and_first_rows_over_batches(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), at(rng.randrange(600))) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    feed = feeds.write_feed(df, "ts", shared_folder(spark, "counts"), batches=4, files=1)
    got = {(r.k, r.bucket): r.n for r in feeds.drain(feeds.bucket_counts(feed, "ts", "k")).collect()}
    want = {}
    for k, t in rows:
        bucket = t - dt.timedelta(minutes=t.minute % 15)
        want[k, bucket] = want.get((k, bucket), 0) + 1
    end = max(t for _, t in rows) - dt.timedelta(minutes=30)
    assert got == {kb: n for kb, n in want.items() if kb[1] + dt.timedelta(minutes=15) <= end}
    again = feeds.write_feed(df, "ts", shared_folder(spark, "first"), batches=4, files=1)
    assert sorted(r.k for r in feeds.drain(feeds.first_seen(again, "ts", ["k"])).collect()) == ["a", "b"]


def test_keyed_streams_run_in_a_session_with_another_store(spark):
    name, other = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, other)
    try:
        feed = feeds.write_feed(spark.createDataFrame([("a", at(0)), ("a", at(5)), ("b", at(900))], "k string, ts timestamp"), "ts",
                                shared_folder(spark, "store"), batches=2, files=1)
        changes = feeds.drain(feeds.last_success(feed, "k", "ts", F.lit(True), 600), "update", keyed=True)
        assert [tuple(r) for r in feeds.still_valid(changes, "k").collect()] == [("b", at(900))]
        assert spark.conf.get(name) == other
    finally:
        spark.conf.set(name, before)


def test_percentile_of_large_windows_is_exact_on_demand(spark):
    rng = random.Random(4)
    values = [rng.lognormvariate(3, 2) for _ in range(30_000)]
    df = spark.createDataFrame([("e", at(i % 45), v) for i, v in enumerate(values)] + [("e", at(900), 1.0)], "k string, ts timestamp, ms double")
    feed = feeds.write_feed(df, "ts", shared_folder(spark, "latency"), batches=3, files=2, again=False)
    rows = feeds.drain(feeds.latency(feed, "ts", "k", "ms", accuracy=None)).collect()
    assert next(r for r in rows if r.window_start == at(0)).p95_ms == sorted(values)[28_500 - 1]


def test_maturity_keeps_one_packed_state_a_stock(spark):
    from tickerloom.operators import settlement

    rng = random.Random(6)
    first = dt.date(2020, 1, 1)
    bars = [(s, first + dt.timedelta(d), 5.0 + rng.random(),
             None if rng.random() < 0.2 else dt.datetime(2020, 1, 1, 8) + dt.timedelta(d + rng.randrange(4)), rng.choice([None, "SUSPEND", "NORMAL"]))
            for s in (1, 2, 3, None) for d in sorted(rng.sample(range(200), 90))]
    recs = [(r, s, dt.datetime(2019, 12, 28) + dt.timedelta(hours=rng.randrange(0, 210 * 24, 8))) for r in range(400) for s in rng.sample((1, 2, 3, 4, None), 2)]
    recs += recs[:5] + [(500, 1, None)]
    bars = spark.createDataFrame(bars, "stock_key long, trading_day date, close double, visible_at timestamp, trading_status string")
    recs = spark.createDataFrame(recs, "run_id long, stock_key long, as_of timestamp")
    reference = F.lit("2020-07-01").cast("timestamp")
    want = sorted(map(repr, settlement.yield_records(recs.where("stock_key is not null").distinct(), bars, reference).collect()))
    feed = feeds.write_feed(bars, "trading_day", shared_folder(spark, "maturity"), batches=5, files=3, again=False)
    found = feeds.newest(feeds.drain(feeds.yield_maturity(recs, feed, reference), "update", keyed=True), ["run_id", "stock_key", "horizon"])
    assert sorted(map(repr, found.where("stock_key is not null").collect())) == want and len(want) > 1000
    held, _ = progress(feeds.yield_maturity(recs, feed, reference))
    assert 0 < max(held) <= 5
