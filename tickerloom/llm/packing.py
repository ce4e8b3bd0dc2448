"""Bulk-synchronous best-fit packing of token pieces into fixed-length sequences.

State is two tables, pieces still loose (item, size) and open sequences (seq, gap). Every round
1. range-sorts both by size and by gap, as runs of equal value with their lengths (at most ``capacity`` runs, whatever the data);
2. sweeps the runs upwards: loose pieces queue up until their successor gap comes, and each gap takes the largest pieces
   queued below it while any fits;
3. resolves conflicts inside a run by rank: the k-th piece of a run of pieces meets the k-th gap of the run of gaps;
4. updates the gaps and drops the placed pieces.
When no piece fits any gap, the largest pieces open sequences of their own and the rounds go on. Very small pieces are first
tied into bundles by a running sum inside each range partition, so the number of rounds is bounded by the capacity over the
smallest bundle and not by the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import slices, stored
from .tokens import CACHE_WORDS, encoder, vocabulary_path

CAPACITY = 2048
#: Pieces below capacity / SMALL are tied into bundles of capacity / BUNDLE tokens at most.
SMALL, BUNDLE = 64, 24
#: Parts that a run of equal values is numbered in, so that no task holds a whole run.
PARTS = 64


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None,
           cache: tuple[int, int | None] = (CACHE_WORDS, None)) -> DataFrame:
    """One row per piece of every document: doc_id, item (unique), piece, start, length, ids_crc32.

    A document's ids are those of its whole text closed by id 0 (null or empty text: id 0 alone). Documents longer than
    ``capacity`` are cut into full pieces, of which the first may be shorter. Repeated rows are documents of their own; a null
    key stays null; an empty table has no pieces. ``cache`` bounds the words, and their characters, whose ids a worker keeps.
    """
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.monotonically_increasing_id().alias("doc"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, *cache)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, lengths = coder.encode(part.column("text").to_pylist())
                number = -(-lengths // capacity)
                owner = np.repeat(np.arange(len(lengths)), number)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
                head = lengths - (number - 1) * capacity
                start = np.where(piece == 0, 0, head[owner] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[owner], capacity)
                words, first = ids.astype("<u4"), (np.cumsum(lengths) - lengths)[owner] + start
                crc = [zlib.crc32(words[a : a + n].tobytes()) for a, n in zip(first, length)]
                at = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(at), part.column("doc").take(at), pa.array(piece), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64())], ["doc_id", "doc", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, "doc_id long, doc long, piece long, start long, length long, ids_crc32 long")


def _numbered(rows: DataFrame, value: str, by: str) -> tuple[DataFrame, dict[int, int]]:
    """Rows with their rank (from 0) among rows of equal ``value``, and how many rows each value has.

    Ranks come from row numbers inside hashed parts of a run plus the lengths of the parts before.
    """
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    sizes = rows.groupBy(value, "_part").agg(F.count("*").alias("_n"))
    w = W.partitionBy(value).orderBy("_part")
    before = stored(sizes.select(value, "_part", "_n", (F.sum("_n").over(w) - F.col("_n")).alias("_before")), "packing-parts")
    counts = {r[value]: r["n"] for r in before.groupBy(value).agg(F.sum("_n").alias("n")).collect()}  # capacity rows at most
    rank = F.row_number().over(W.partitionBy(value, "_part").orderBy(by)) - 1
    out = rows.withColumn("_row", rank).join(F.broadcast(before.select(value, "_part", "_before")), [value, "_part"])
    return out.withColumn("rank", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before"), counts


def sweep(items: dict[int, int], gaps: dict[int, int]) -> list[tuple[int, int, int, int, int, int]]:
    """Match runs of sizes with runs of gaps: (size, first rank, gap, first rank, how many, tokens already placed in the gap).

    Upwards by value, sizes before gaps of the same value. A gap takes the largest queued size, and what is left of it the
    largest that still fits, until none does.
    """
    sizes, queue, links = [], [], []
    for value in sorted(items.keys() | gaps.keys()):
        if items.get(value):
            sizes.append(value)
            queue.append((0, items[value]))
        runs = [(value, 0, gaps[value])] if gaps.get(value) else []
        while runs:
            room, at, n = runs.pop()
            i = bisect_right(sizes, room) - 1
            if i < 0:
                continue
            first, m = queue[i]
            size, take = sizes[i], min(n, m)
            links.append((size, first, value, at, take, value - room))
            if take == m:
                del sizes[i], queue[i]
            else:
                queue[i] = (first + take, m - take)
            if take < n:
                runs.append((room, at + take, n - take))
            runs.append((room - size, at, take))
    return links


def _bundles(loose: DataFrame, capacity: int) -> DataFrame:
    """Add bundle and place: small items follow one another inside bundles, others are bundles of one."""
    most = capacity // BUNDLE
    small = loose.where(F.col("length") < capacity // SMALL)
    parts = int(loose.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a running sum inside each of many hashed parts; items of a part that fall into the same stretch form a bundle
    spread = small.withColumn("_part", F.pmod(F.xxhash64("doc"), F.lit(parts * 16)))
    w = W.partitionBy("_part").orderBy("length", "doc").rowsBetween(W.unboundedPreceding, -1)
    placed = spread.withColumn("_sum", F.coalesce(F.sum("length").over(w), F.lit(0)))
    stretch = (F.col("_sum") / F.lit(most - capacity // SMALL)).cast("bigint")
    first = F.min("_sum").over(W.partitionBy("_part", stretch))
    key = F.min("doc").over(W.partitionBy("_part", stretch))
    placed = placed.select("doc", "piece", "length", key.alias("bundle"), (F.col("_sum") - first).alias("place"))
    large = loose.where(F.col("length") >= capacity // SMALL)
    return placed.unionByName(large.select("doc", "piece", "length", F.col("doc").alias("bundle"), F.lit(0).cast("bigint").alias("place")))


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of ``pieces`` (a stored table, as it is read several times) with sequence_id and offset.

    Full pieces are sequences of their own. Sequence ids are distinct and otherwise arbitrary (even for shared sequences, odd
    for full pieces); offsets leave no gap. Pieces of one size are alike, so ties change no count of sequences. An empty table
    gives an empty result.
    """
    spark = rows.sparkSession
    full = rows.where(F.col("length") == capacity)
    loose = stored(_bundles(rows.where(F.col("length") < capacity).select("doc", "piece", "length"), capacity), "packing-bundles")
    items = stored(loose.groupBy(F.col("bundle").alias("item")).agg(F.sum("length").alias("size")), "packing-items")
    # no two pieces above half the capacity share a sequence, so each of them opens one
    opening = items.where(F.col("size") * 2 > capacity)
    done = [opening.select("item", F.col("item").alias("seq"), F.lit(0).cast("bigint").alias("begin"))]
    gaps = opening.select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("size")).alias("gap")).where(F.col("gap") > 0)
    items = items.where(F.col("size") * 2 <= capacity)
    while True:
        ranked, sizes = _numbered(items, "size", "item")
        if not sizes:
            break
        spaces, free = _numbered(gaps, "gap", "seq")
        links = sweep(sizes, {g: n for g, n in free.items() if g >= min(sizes)})
        if links:
            plan = F.broadcast(spark.createDataFrame(links, "size long, _first long, gap long, _at long, _n long, _in long"))
            met = ranked.join(plan, "size").where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_first") + F.col("_n")))
            met = met.select("item", "size", "gap", (F.col("_at") + F.col("rank") - F.col("_first")).alias("rank"), "_in")
            met = stored(met.join(spaces, ["gap", "rank"]).select("item", "seq", "size", "gap", "_in"), "packing-matches")
            done.append(met.select("item", "seq", (F.lit(capacity) - F.col("gap") + F.col("_in")).alias("begin")))
            after = gaps.join(met.groupBy("seq").agg(F.sum("size").alias("size")), "seq", "left")
            gaps = after.select("seq", (F.col("gap") - F.coalesce("size", F.lit(0))).alias("gap")).where(F.col("gap") > 0)
        else:
            # the largest pieces open as many sequences as the loose tokens fill
            left, fresh = -(-sum(s * n for s, n in sizes.items()) // capacity), []
            for size in sorted(sizes, reverse=True):
                if left > 0:
                    fresh.append((size, min(left, sizes[size])))
                    left -= sizes[size]
            top = F.broadcast(spark.createDataFrame(fresh, "size long, _n long"))
            met = stored(ranked.join(top, "size").where(F.col("rank") < F.col("_n")).select("item", "size"), "packing-openings")
            done.append(met.select("item", F.col("item").alias("seq"), F.lit(0).cast("bigint").alias("begin")))
            gaps = gaps.unionByName(met.select(F.col("item").alias("seq"), (F.lit(capacity) - F.col("size")).alias("gap")))
        items = stored(items.join(met, "item", "left_anti"), "packing-items")
        least = items.agg(F.min("size")).first()[0]
        gaps = stored(gaps.where(F.col("gap") >= F.lit(least if least is not None else capacity + 1)), "packing-gaps")
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    where = loose.join(placed, loose["bundle"] == placed["item"]).select("doc", "piece", "seq", (F.col("begin") + F.col("place")).alias("offset"))
    # a document has one loose piece at most, so documents name the mixed sequences
    mixed = rows.join(where, ["doc", "piece"])
    mixed = mixed.withColumn("sequence_id", F.col("seq") * 2).drop("seq")
    alone = full.withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("bigint")})
    return mixed.unionByName(alone.select(*mixed.columns))
