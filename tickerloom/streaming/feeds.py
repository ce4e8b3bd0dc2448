"""Structured Streaming versions of the feed-shaped steps.

Each function takes and returns a streaming DataFrame, or starts a query that
keeps a table. ``drain`` runs a stream over everything available and returns
what it wrote, which is how a stream is compared with its batch twin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.numbers import dbl
from ..operators.asof import bar_usable_from, returns
from ..operators.settlement import HORIZONS, horizon_status
from ..session import shared_folder, written
from ..sources.feeds import missing_rows, valid_bars


def read_stream(spark: SparkSession, folder: str, pattern: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder (optionally those matching a pattern) as a stream, with the schema they already have."""
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{pattern}" if pattern else folder).schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_feed(df: DataFrame, order: str, folder: str, batches: int = 4, files: int = 2, again: bool = True) -> DataFrame:
    """A table as a feed: ranges of a time or date column that arrive one after another, a micro-batch each.

    ``again`` lets the first range arrive once more at the end, late and repeated.
    """
    spark = df.sparkSession
    at = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(at, [k / batches for k in range(1, batches)])).first()[0] or []
    bounds = [None, *cuts, None]
    ranges = [(lo, hi) for lo, hi in zip(bounds, bounds[1:])]
    for lo, hi in ranges + ranges[:1] * again:
        part = df if lo is None else df.where(at > lo)
        part = part if hi is None else part.where(at <= hi)
        part.repartition(files).write.mode("append").parquet(f"{folder}/feed")
    return read_stream(spark, f"{folder}/feed", files_per_trigger=files)


#: The state store that keeps several kinds of state and timers of a key, which ``transformWithState`` needs.
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the keyed store, whatever store the session has; others are left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, KEYED_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def drain(stream: DataFrame, mode: str = "append", keyed: bool = False) -> DataFrame:
    """Run to the end of the available input, appending to a new table. Streams by ``transformWithState`` are ``keyed``."""
    spark = stream.sparkSession
    folder = shared_folder(spark, "stream")
    log = f"{folder}/out"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log}/part={batch_id}")

    with keyed_store(spark) if keyed else nullcontext():
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(
            availableNow=True).foreachBatch(keep).start()
        query.awaitTermination()
    return spark.read.parquet(log).drop("part")


def newest(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Current state of a table kept as a change log: the row of the highest batch per key."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    picked = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return picked.select(*keys, "s.*")


def bucket_counts(stream: DataFrame, ts: str, source: str, width: str = "15 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Tumbling counts per source; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), source).agg(
        F.count("*").alias("n")).select(source, F.col("w.start").alias("bucket"), "n")


def first_seen(stream: DataFrame, ts: str, keys: list[str], horizon: str = "7 days") -> DataFrame:
    """First row of a key within the horizon, across batches."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


class _Refreshes(StatefulProcessor):
    """State: the latest success of a key, in microseconds, and a timer for the end of its validity, which clears both."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("at", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.at.get()[0] if self.at.exists() else None
        latest = max(r["_at"] for r in rows)
        if (held is None or latest > held) and latest + self.ttl > timerValues.getCurrentWatermarkInMs() * 1000:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.at.update((latest,))
            self.handle.registerTimer(-(-(latest + self.ttl) // 1000))
            yield Row(**{"key": key[0], "at": latest, "valid": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = self.at.get()[0]
        self.at.clear()
        yield Row(**{"key": key[0], "at": at, "valid": False})

    def close(self) -> None:
        pass


def last_success(stream: DataFrame, key: str, ts: str, ok: Column, ttl_seconds: int, lateness: str = "30 minutes") -> DataFrame:
    """Changes of validity: (key, refreshed_at, valid) when a newer success comes and when its time to live has passed.

    The stream's clock is its watermark. State is held for valid keys alone: a timer drops a key when it ends, so state falls
    with the keys that go quiet. Rows later than the watermark are dropped; repeated and older ones change nothing.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.withWatermark(ts, lateness).where(ok).select(F.col(key).alias("_key"), ts, F.unix_micros(F.col(ts)).alias("_at"))
    changes = rows.groupBy("_key").transformWithState(
        _Refreshes(ttl_seconds * 1_000_000), f"key {kind}, at bigint, valid boolean", "Update", "EventTime")
    return changes.select(F.col("key").alias(key), F.timestamp_micros("at").alias("refreshed_at"), "valid")


def still_valid(changes: DataFrame, key: str) -> DataFrame:
    """Keys whose last change (an end comes after the success of its batch) left them valid."""
    last = F.max_by(F.struct("refreshed_at", "valid"), F.struct("batch", ~F.col("valid")))
    return changes.groupBy(key).agg(last.alias("s")).where("s.valid").select(key, "s.refreshed_at")


#: The streaming percentile is off by one rank in this many at most.
ACCURACY = 1000


def latency(stream: DataFrame, ts: str, key: str, value: str, width: str = "60 minutes", slide: str = "15 minutes",
            lateness: str = "30 minutes", accuracy: int | None = ACCURACY) -> DataFrame:
    """Sliding count, mean and p95 per endpoint.

    The percentile's state is a mergeable summary of bounded size, whatever the number of values: the rank of its answer is
    within a thousandth of the count, and exact below a thousand rows. With ``accuracy`` None it is exact, and an open window
    keeps its distinct values with their counts.
    """
    p95 = F.percentile_approx(value, 0.95, accuracy) if accuracy else F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)")
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width, slide).alias("w"), key).agg(
        F.count("*").alias("requests"),
        (F.sum(F.col(value).cast("decimal(18,4)")).cast("double") / F.count("*")).alias("avg_ms"),
        p95.alias("p95_ms"),
    ).select(key, F.col("w.start").alias("window_start"), "requests", "avg_ms", "p95_ms")


def _run_batches(stream: DataFrame, folder: str, step: Callable[[DataFrame, int], None]) -> None:
    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def stored(spark: SparkSession, folder: str, schema) -> DataFrame:
    """The table under a folder, empty before its first write."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def ingest_bars(stream: DataFrame, order: list[str], folder: str) -> DataFrame:
    """Keep valid new bars: each micro-batch is checked, anti-joined with what is stored and written under its id.

    Writing by batch id makes a replayed batch overwrite itself instead of appending twice.
    """
    spark = stream.sparkSession
    table = f"{folder}/bars"
    schema = stream.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        held = stored(spark, table, schema)
        if "part" in held.columns:
            held = held.where(F.col("part") < batch_id)
        missing_rows(valid_bars(batch, order), held).write.mode("overwrite").parquet(f"{table}/part={batch_id}")

    _run_batches(stream, folder, step)
    return stored(spark, table, schema)


#: Packed rows of the maturity stream: bars, reports, and the recommendations not yet passed by a bar and those that wait for bars.
BAR = np.dtype([("day", "<i4"), ("usable", "<i8"), ("close", "<f8")])
FOUND = np.dtype([("run", "<i8"), ("p0", "<f8"), ("at", "<i4"), ("horizon", "<i1")])
AHEAD = np.dtype([("as_of", "<i8"), ("run", "<i8"), ("told", "?")])
OPEN = np.dtype([("run", "<i8"), ("p0", "<f8"), ("bars", "<i1")])
#: Bars packed at once and reports unpacked at once.
PACKED = 1 << 18
DAY_MICROS = 86_400_000_000


def _pack_bars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, bars, states): the bars of a key, as far as they stand together in a task, are one row."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).sort_by("key").combine_chunks()
        key, n = rows["key"].combine_chunks(), len(rows)
        # Null where one of two keys is null, which is a change unless both are.
        unlike = pc.fill_null(pc.not_equal(key[1:], key[:-1]), False).to_numpy(zero_copy_only=False) | np.diff(key.is_null().to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], np.flatnonzero(unlike) + 1])
        ends = np.append(starts, n)
        bars = np.empty(n, BAR)
        for name in BAR.names:
            bars[name] = pc.fill_null(rows[name], np.nan if name == "close" else 0).to_numpy()
        raw = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * BAR.itemsize).astype("<i4")), pa.py_buffer(bars.tobytes())])
        states = pa.ListArray.from_arrays(pa.array(ends.astype("<i4")), rows["state"].combine_chunks())
        return pa.RecordBatch.from_arrays([key.take(pa.array(starts)), raw, states], ["_key", "bars", "states"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= PACKED:
            yield packed(held)
            held, n = [], 0
    if held:
        yield packed(held)


def _unpack_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per report of a packed row, with the bar that closes its horizon."""

    def entries(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        cells = column.to_pylist()
        return np.frombuffer(b"".join(cells), kind), np.array([len(c) // kind.itemsize for c in cells])

    for batch in batches:
        found, n = entries(batch.column("found"), FOUND)
        bars, m = entries(batch.column("bars"), BAR)
        row, place = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(m) - m, n) + np.maximum(found["at"], 0)
        states = batch.column("states").flatten()
        for first in range(0, len(found), PACKED):
            part = slice(first, first + PACKED)
            mine, at, none = found[part], place[part], found["at"][part] < 0
            close = bars["close"][at]
            yield pa.RecordBatch.from_arrays([
                batch.column("stock_key").take(pa.array(row[part])), pa.array(mine["run"]), pa.array(mine["horizon"].astype(np.int32)), pa.array(mine["p0"]),
                pa.array(bars["day"][at], mask=none), pa.array(close, mask=none | np.isnan(close)), states.take(pa.array(at, mask=none))],
                ["stock_key", "run_id", "horizon", "p0", "day", "close", "state"])


class _Maturity(StatefulProcessor):
    """State of a stock, packed: recommendations not yet passed by a bar, those that wait for following bars, and the few bars that may
    still be the base of the former. A recommendation leaves the state with its last horizon, the state goes with its last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "ahead binary, open binary, recent binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        ahead = np.zeros(len(initialState["runs"]), AHEAD)
        ahead["run"], ahead["as_of"] = initialState["runs"], initialState["as_of"]
        ahead = ahead[np.lexsort((ahead["as_of"], ahead["run"]))]
        last = np.append(ahead["run"][1:] != ahead["run"][:-1], True)  # a run counts once
        self.state.update((ahead[last].tobytes(), b"", b""))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.state.get()
        if held is None:
            return
        ahead, waiting, recent = (np.frombuffer(v, kind) for v, kind in zip(held, (AHEAD, OPEN, BAR)))
        parts = list(rows)
        bars, states = np.concatenate([np.frombuffer(r["bars"], BAR) for r in parts]), [s for r in parts for s in r["states"]]
        order = np.argsort(bars["day"], kind="stable")
        bars, states = bars[order], [states[i] for i in order]
        known = np.concatenate([recent, bars])
        # The base is the last bar usable at the instant, which is before the first bar dated after it.
        by_use = np.argsort(known["usable"], kind="stable")
        usable = np.searchsorted(known["usable"][by_use], ahead["as_of"], "right") - 1
        base = np.maximum.accumulate(by_use)[usable]
        p0 = np.where(usable >= 0, known["close"][base], np.nan)
        after = np.searchsorted(bars["day"].astype(np.int64) * DAY_MICROS, ahead["as_of"], "right")
        passed, based = after < len(bars), p0 > 0
        begun, early = passed & based, ~passed & based & ~ahead["told"]
        runs, prices = np.concatenate([waiting["run"], ahead["run"][begun]]), np.concatenate([waiting["p0"], p0[begun]])
        first = np.concatenate([-waiting["bars"].astype(np.int64), after[begun]])
        told = np.concatenate([np.ones(len(waiting), bool), ahead["told"][begun]])
        out = []

        def report(which: np.ndarray, run: np.ndarray, price: np.ndarray, at, horizon: int) -> None:
            found = np.empty(int(which.sum()), FOUND)
            found["run"], found["p0"], found["at"], found["horizon"] = run[which], price[which], at, horizon
            out.append(found)

        for horizon in HORIZONS:
            at = first + horizon - 1
            closed = (at >= 0) & (at < len(bars))
            report(closed, runs, prices, at[closed], horizon)
            report((at >= len(bars)) & ~told, runs, prices, -1, horizon)
            report(early, ahead["run"], p0, -1, horizon)
        counted = len(bars) - first
        still = counted < HORIZONS[-1]
        later = np.zeros(int(still.sum()), OPEN)
        later["run"], later["p0"], later["bars"] = runs[still], prices[still], counted[still]
        rest = ahead[~passed].copy()
        rest["told"] |= early[~passed]
        if len(rest):
            sure = known["day"][known["usable"] <= rest["as_of"].min()]
            known = known[known["day"] >= sure.max()] if len(sure) else known
        if len(rest) or len(later):
            self.state.update((rest.tobytes(), later.tobytes(), known.tobytes() if len(rest) else b""))
        else:
            self.state.clear()
        found = np.concatenate(out)
        for start in range(0, len(found), PACKED):
            yield Row(**{"stock_key": key[0], "found": found[start:start + PACKED].tobytes(), "bars": bars.tobytes(), "states": states})

    def close(self) -> None:
        pass


def yield_maturity(recs: DataFrame, bar_stream: DataFrame, reference: Column) -> DataFrame:
    """Changes of the return states as bars arrive: a stream of (run_id, stock_key, horizon, value, status, days).

    ``recs`` is the initial state. A batch touches the recommendations of its stocks that are still open and reads no earlier
    bar. Bars of a stock come in day order, with positive closes; repeated or older ones must have been left out before
    (``ingest_bars``). A recommendation without a visible bar at its instant has no state, as in the batch version. Bars and
    reports travel packed, so a stock costs a few calls a batch however many recommendations it has.
    """
    kind = dict(bar_stream.dtypes)["stock_key"]
    bars = bar_stream.select(
        F.col("stock_key").alias("key"), F.unix_date("trading_day").alias("day"), F.unix_micros(bar_usable_from()).alias("usable"),
        dbl("close").alias("close"), F.col("trading_status").alias("state"))
    packed = bars.mapInArrow(_pack_bars, f"_key {kind}, bars binary, states array<string>")
    begun = written(recs.where("as_of is not null").groupBy(F.col("stock_key").alias("_key")).agg(
        F.collect_list(F.struct("run_id", F.unix_micros("as_of").alias("as_of"))).alias("l")).select(
        "_key", F.col("l.run_id").alias("runs"), F.col("l.as_of").alias("as_of")), "begun").groupBy("_key")
    found = packed.groupBy("_key").transformWithState(
        _Maturity(), f"stock_key {kind}, found binary, bars binary, states array<string>", "Update", "None", begun).mapInArrow(
        _unpack_found, f"stock_key {kind}, run_id bigint, horizon int, p0 double, day int, close double, state string")
    day = F.date_from_unix_date("day")
    seen = day.cast("timestamp") + F.expr("INTERVAL '7' HOUR")
    status = horizon_status(F.col("p0"), day, F.col("state"), reference)
    return found.select(
        "run_id", "stock_key", "horizon", returns("p0", "close").alias("value"), status.alias("status"), day.alias("planned_day"),
        F.when((status == "mature") | ((status == "pending") & (seen > reference)), day).alias("actual_day"), seen.alias("maturity_at"))


class _Streaks(StatefulProcessor):
    """State: the last day counted and the run's length; a timer ends keys that stay away."""

    def __init__(self, threshold: float, days: int, idle: int):
        self.threshold, self.days, self.idle = threshold, days, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", "day int, streak bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, streak = self.run.get() if self.run.exists() else (None, 0)
        before = last
        for day, value in sorted((r["_day"], r["value"]) for r in rows):
            if last is None or day > last:
                last, streak = day, streak + 1 if value < self.threshold else 0
        if last != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.idle) * 86_400_000)
            self.run.update((last, streak))
        if last is not None:
            yield Row(**{"key": key[0], "day": last, "streak": streak, "alert": streak >= self.days})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.run.clear()
        return iter(())

    def close(self) -> None:
        pass


def streak_alert(stream: DataFrame, key: str, threshold: float, days: int, idle: int = 60, lateness: str = "7 days") -> DataFrame:
    """Trailing run of daily values below a threshold per key, with an alert once it is long enough.

    Rows are (key, day, value). The state is the last day counted and the length of the run; a row of that day or an earlier one
    comes too late and is left out, as is a day's second row (the greater value of one batch). A key without rows for ``idle``
    days loses its state and starts anew.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.withColumn("_ts", F.col("day").cast("timestamp")).withWatermark("_ts", lateness).select(
        F.col(key).alias("_key"), "_ts", F.unix_date("day").alias("_day"), "value")
    found = rows.groupBy("_key").transformWithState(
        _Streaks(threshold, days, idle), f"key {kind}, day int, streak bigint, alert boolean", "Update", "EventTime")
    return found.select(F.col("key").alias(key), F.date_from_unix_date("day").alias("last_day"), "streak", "alert")
