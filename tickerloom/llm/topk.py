"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are packed into blocks. A block's postings (row, dimension, value) are cut into segments by quantised impact, the bit
length of the value's magnitude, and stored from the highest impact down, each with every row's norm of what lies below. A block
of queries walks a block's segments in that order: after a segment, a pair's score lies within query norm times remaining row
norm of what is accumulated. Rows that can no longer reach a query's k-th best lower bound are out, by proof; once few are left
the walk stops and the possible members are scored again exactly from all their postings.

Every block of vectors meets every block of queries once: the stated query set against all rows, in blocks. Index blocks are dealt
to lanes and query blocks are copied to each lane, so no key gathers more than its share. Each meeting keeps k rows per query, and a window over those picks the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

SCALE, TOP, QUERY_STEP = 256, 5, 50
#: Rows of an index block and of a query block, and queries that walk together.
BLOCK, QUERIES, GROUP = 4096, 2048, 128
#: Query blocks that meet an index block in one place, about.
MEET = 16
#: Segments are walked until at most this share of a block is still possible.
STOP = 0.02


def integers(vectors: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """key, v: floor(scale * x) of every component as long. Vectors that are null or hold a null or non-finite component are left out."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(~bad).select(
        F.col(key).cast("bigint").alias("key"), F.transform(x, lambda c: F.floor(c * scale).cast("bigint")).alias("v"))


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    """Rows of whole numbers as a matrix; shorter vectors are padded with zeros."""
    column = rows.column("v")
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat[offsets[0] : offsets[-1]]
    return out


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list[int], np.ndarray]]:
    held, n = [], 0
    for batch in batches:
        first = 0
        while first < batch.num_rows:
            take = min(size - n, batch.num_rows - first)
            held.append(batch.slice(first, take))
            n, first = n + take, first + take
            if n == size:
                yield _merged(held)
                held, n = [], 0
    if n:
        yield _merged(held)


def _merged(held: list[pa.RecordBatch]) -> tuple[list[int], np.ndarray]:
    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return whole.column("key").to_pylist(), _matrix(whole)


def segments(matrix: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Posting segments by descending impact: (impact, rows, dimensions, values, norm per row of all lower impacts)."""
    rows, dims = np.nonzero(matrix)
    values = matrix[rows, dims]
    impact = np.frexp(np.abs(values).astype(np.float64))[1]
    left = (matrix.astype(np.float64) ** 2).sum(axis=1)
    out = []
    for level in sorted(set(impact.tolist()), reverse=True):
        at = impact == level
        left = left - np.bincount(rows[at], values[at].astype(np.float64) ** 2, len(matrix))
        out.append((level, rows[at], dims[at], values[at], np.sqrt(np.maximum(left, 0.0)) * (1 + 1e-9)))
    return out


def build_index(rows: DataFrame) -> DataFrame:
    """One row per block: keys, width and its segments, each as packed rows, dimensions, values and remaining norms."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, matrix in _chunks(batches, BLOCK):
            cut = segments(matrix)
            yield pa.RecordBatch.from_arrays([
                pa.array([np.array(keys, "<i8").tobytes()]), pa.array([matrix.shape[1]], pa.int64()),
                pa.array([[s[1].astype("<i2").tobytes() for s in cut]], pa.list_(pa.binary())),
                pa.array([[s[2].astype("<i4").tobytes() for s in cut]], pa.list_(pa.binary())),
                pa.array([[s[3].astype("<i8").tobytes() for s in cut]], pa.list_(pa.binary())),
                pa.array([[s[4].astype("<f8").tobytes() for s in cut]], pa.list_(pa.binary()))],
                ["keys", "width", "at", "dims", "vals", "norms"])

    shape = "keys binary, width long, at array<binary>, dims array<binary>, vals array<binary>, norms array<binary>"
    return rows.mapInArrow(pack, shape)


def _query_blocks(rows: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, matrix in _chunks(batches, QUERIES):
            yield pa.RecordBatch.from_arrays([pa.array([np.array(keys, "<i8").tobytes()]), pa.array([matrix.astype("<i8").tobytes()])], ["ids", "asked"])

    return rows.mapInArrow(pack, "ids binary, asked binary")


def walk(queries: np.ndarray, ids: np.ndarray, keys: np.ndarray, cut: list[tuple], width: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its k best rows of a block: (query number, keys, scores), ties to the smaller key, own key excepted."""
    whole = np.zeros((len(keys), width), np.int64)
    for _, at, dims, vals, _ in cut:
        whole[at, dims] = vals
    shared = min(width, queries.shape[1])
    queries = queries[:, :shared]
    asked = queries.astype(np.float64)
    norms = np.sqrt((asked**2).sum(axis=1)) * (1 + 1e-9)
    largest = norms.max(initial=0) * np.sqrt((whole.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)
    slack = largest * 1e-12 * (width + 1)  # rounding of the accumulated floats
    for first in range(0, len(queries), GROUP):
        mine = slice(first, min(first + GROUP, len(queries)))
        total = np.zeros((mine.stop - mine.start, len(keys)))
        own = ids[mine, None] == keys[None, :]
        possible = ~own
        for n, (_, at, dims, vals, left) in enumerate(cut):
            piece = np.zeros((len(keys), width))
            piece[at, dims] = vals
            total += asked[mine] @ piece[:, :shared].T
            if n == len(cut) - 1 or len(keys) <= 2 * k:
                continue
            margin = norms[mine, None] * left[None, :] + slack
            low = np.where(own, -np.inf, total - margin)
            bar = np.partition(low, len(keys) - k, axis=1)[:, len(keys) - k]
            possible = ~own & (total + margin >= bar[:, None])
            if possible.mean() <= STOP:
                break
        for i in range(mine.stop - mine.start):
            members = np.flatnonzero(possible[i])
            scores = whole[members, :shared] @ queries[first + i]
            best = np.lexsort((keys[members], -scores))[:k]
            yield first + i, keys[members][best], scores[best]


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", step: int = QUERY_STEP, k: int = TOP) -> DataFrame:
    """query_id, rank, key, score: the k rows with the highest integer inner product for every query row (key divisible by step).

    Every row but those with the query's own key is a candidate, also rows that repeat a key. A repeated query key is asked
    once, with its smallest vector. Missing trailing components count as zero. Rows without a usable vector or key take no part;
    an empty table gives an empty result. Scores are exact while they fit a long.
    """
    rows = integers(vectors, key, vector)
    index = stored(build_index(rows), "impact-index")
    asked = rows.where(F.col("key") % step == 0).groupBy("key").agg(F.min("v").alias("v"))
    blocks = stored(_query_blocks(asked.repartition(max(1, math.ceil(asked.count() / QUERIES)))), "query-blocks")
    lanes, asked_blocks = max(1, index.count()), max(1, blocks.count())
    # An index block moves once, or once for every group of query blocks where there are few index blocks or very many queries.
    groups = min(asked_blocks, max(math.ceil(index.sparkSession.sparkContext.defaultParallelism / lanes), math.ceil(asked_blocks / MEET)))
    here = index.withColumn("_lane", F.monotonically_increasing_id()).withColumn("_lane", F.pmod(F.xxhash64("_lane"), F.lit(lanes)))
    here = here.select("*", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_other"))
    there = blocks.withColumn("_other", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int"))
    there = there.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(lanes - 1).cast("bigint"))).alias("_lane"))
    # The copies are not in the size estimate of their files: neither side may go through the driver.
    met = here.join(there.hint("merge"), ["_lane", "_other"]).select("keys", "width", "at", "dims", "vals", "norms", "ids", "asked")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, keys = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["keys"], "<i8")
                queries = np.frombuffer(r["asked"], "<i8").reshape(len(ids), -1)
                cut = [(0, np.frombuffer(a, "<i2").astype(np.int64), np.frombuffer(d, "<i4"), np.frombuffer(v, "<i8"), np.frombuffer(n, "<f8"))
                       for a, d, v, n in zip(r["at"], r["dims"], r["vals"], r["norms"])]
                out = [(np.full(len(found), ids[i]), found, scores) for i, found, scores in walk(queries, ids, keys, cut, r["width"], k)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], ["query_id", "key", "score"])

    found = met.mapInArrow(search, "query_id long, key long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
