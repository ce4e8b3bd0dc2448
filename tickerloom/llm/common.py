"""Helpers shared by the training-data operators: settings, cut lineage, Arrow batches and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, shared_folder

#: Bytes of column data handed to a Python worker at once.
ARROW_BYTES = 8 * 1024 * 1024


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of this package: AQE and skew joins as in the library, and Arrow batches bounded by bytes."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


_open: list[list[str]] = []


@contextmanager
def tracked() -> Iterator[list[str]]:
    """Collects the paths of the tables that ``stored`` writes meanwhile."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open.remove(paths)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later jobs depend on files and not on executors."""
    path = shared_folder(df.sparkSession, purpose)
    if "://" not in path and df.sparkSession.sparkContext.master.startswith("local"):
        path = f"{path}/{purpose}"
    for paths in _open:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the named text column of each part has about ``limit`` bytes (one row at least)."""
    if not batch.num_rows:
        return
    _, bounds = strings(batch.column(name))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


# 64-bit finaliser constants, and the multiplier of the rolling hash.
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROLL = 0x9E3779B97F4A7C15
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * MIX_A
        x = (x ^ (x >> np.uint64(27))) * MIX_B
        return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ROLL))


def _rolls(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd multiplier and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for key, base in (("up", ROLL), ("down", pow(ROLL, -1, 1 << 64))):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts, A-Z lower-cased: by default ``[^\\x20\\x09-\\x0D]+``, else runs of bytes not marked in ``breaks``.

    Returns their 64-bit hashes, their first and last-plus-one byte, and how many each text has.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    inside = ~breaks[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _rolls(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[_LOWER[data]] * up[:n], out=total[1:])
        h = (total[last] - total[first]) * down[first]
        h = mix(h + (last - first).astype(np.uint64))
    counts = np.diff(np.searchsorted(first, bounds))
    return h, first, last, counts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)


def open_shared(path: str, write: bool = False):
    """A stream in the shared folder, from any executor; ``path`` is a local path or a URI that pyarrow's file systems open."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if not write:
        return store.open_input_file(inner)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)
