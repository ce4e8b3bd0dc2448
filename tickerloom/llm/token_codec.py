"""Binary token files: ids coded by an adaptive context-mixing range coder in independent, checksummed blocks.

A file holds groups; a group holds a document table (ids and lengths) and blocks of at most BLOCK ids. Every block starts with
fresh models and carries the CRC-32 of its ids, so each can be decoded alone. Orders 1 and 2 predict one id each from the last
id seen after the same context; order 0 predicts every id from its high byte's and low byte's frequencies. The mixed
distribution gives the two predicted ids the shares that predictions of the same joint confidence earned so far in the block,
and divides the rest by order 0. Blocks of a group are coded side by side, one numpy lane each.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import open_shared, slices, stored
from .tokens import encoder, vocabulary_path

# Fixed values of the file format.
MAGIC = b"TLTOK1\n\0"
GROUP = struct.Struct("<8sIIIII")  # magic, documents, blocks, ids, bytes of the document table, bytes of the block table
BLOCK = 4096
#: Ids held by one group; a group is what a task holds in memory.
GROUP_IDS = 4 << 20

_ONE = np.uint64(1)
_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_LOW32, _WORD, _FULL = np.uint64((1 << 32) - 1), np.uint64(16), np.uint64((1 << 64) - 1)
_SLOTS, _STATES = 2048, 32
_CEILING = 49152  # of 65536, the most that both predicted ids may share
_HIGHS, _FLOOR = 256, 4


class _Coder:
    """Range coder state of many lanes; words of 16 bits."""

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _FULL)

    def _narrow(self, at: np.ndarray, below: np.ndarray, share: np.ndarray) -> None:
        unit = self.range[at] >> _WORD
        self.low[at] += below.astype(np.uint64) * unit
        self.range[at] = share.astype(np.uint64) * unit
        while len(at):
            low, width = self.low[at], self.range[at]
            settled = (low ^ (low + width)) < _TOP
            small = width < _BOTTOM
            moves = settled | small
            if not moves.any():
                return
            at, low, width = at[moves], low[moves], width[moves]
            width = np.where(settled[moves], width, (~low + _ONE) & _LOW32)
            self._shift(at, low)
            self.low[at] = low << _WORD
            self.range[at] = width << _WORD


class _Writer(_Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.words = np.zeros((lanes, BLOCK), np.uint16)
        self.count = np.zeros(lanes, np.int64)

    def _shift(self, at, low):
        if self.count.max() + 4 >= self.words.shape[1]:
            self.words = np.concatenate([self.words, np.zeros_like(self.words)], axis=1)
        self.words[at, self.count[at]] = (low >> np.uint64(48)).astype(np.uint16)
        self.count[at] += 1

    def put(self, at, below, share):
        self._narrow(at, below, share)

    def finish(self) -> list[bytes]:
        at = np.arange(len(self.low))
        for _ in range(4):
            self._shift(at, self.low)
            self.low <<= _WORD
        return [self.words[i, :n].tobytes() for i, n in enumerate(self.count)]


class _Reader(_Coder):
    def __init__(self, parts: list[bytes]):
        super().__init__(len(parts))
        sizes = np.fromiter((len(p) // 2 for p in parts), np.int64, len(parts))
        self.words = np.frombuffer(b"".join(parts) + bytes(8), np.uint16)
        self.at = np.cumsum(sizes) - sizes
        self.code = np.zeros(len(parts), np.uint64)
        for _ in range(4):
            self._shift(np.arange(len(parts)), self.low)

    def _shift(self, at, low):
        self.code[at] = (self.code[at] << _WORD) | self.words[np.minimum(self.at[at], len(self.words) - 1)]
        self.at[at] += 1

    def peek(self, at) -> np.ndarray:
        """Where in 0..65535 the next symbol of each lane lies."""
        return np.minimum((self.code[at] - self.low[at]) // (self.range[at] >> _WORD), np.uint64(65535)).astype(np.int64)

    def take(self, at, below, share):
        self._narrow(at, below, share)


class _Bytes:
    """Adaptive frequencies of a byte per row, of 65536; renewed from the counts at fixed steps."""

    def __init__(self, rows: int, prior: np.ndarray, search: bool):
        self.counts = np.tile(prior, (rows, 1)).astype(np.int32)
        self.search = search
        self.renew()

    def renew(self) -> None:
        scaled = self.counts.astype(np.int64)
        shares = _FLOOR + scaled * (65536 - 256 * _FLOOR) // scaled.sum(axis=1, keepdims=True)
        shares[:, 0] += 65536 - shares.sum(axis=1)
        self.below = np.zeros((len(shares), 257), np.int64)
        np.cumsum(shares, axis=1, out=self.below[:, 1:])
        if self.search:
            rows = np.arange(len(shares))[:, None]
            first = np.zeros((len(shares), 257), np.uint8)
            first[rows, (self.below[:, :256] + 255) >> 8] = np.arange(256, dtype=np.uint8)[None, :]
            self.first = np.maximum.accumulate(first, axis=1)

    def find(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The byte whose share of 65536 holds ``place``."""
        byte = self.first[row, place >> 8].astype(np.int64)
        later = np.flatnonzero(self.below[row, byte + 1] <= place)
        while len(later):
            byte[later] += 1
            later = later[self.below[row[later], byte[later] + 1] <= place[later]]
        return byte


class _Model:
    """Predictions of orders 0 to 2 for every lane."""

    def __init__(self, lanes: int, search: bool):
        self.lane = np.arange(lanes)
        self.seen = [np.zeros(lanes * _SLOTS, np.uint16) for _ in range(2)]
        self.trust = [np.zeros(lanes * _SLOTS, np.uint8) for _ in range(2)]
        self.hits = [np.full(lanes * _STATES, 8192, np.int64) for _ in range(2)]
        self.high = _Bytes(lanes, 4096 // (8 + np.arange(_HIGHS)) + 1, search)
        self.low = _Bytes(2 * lanes, np.full(256, 2), search)
        self.before = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]

    def predict(self, n: int) -> None:
        """Slots, predicted ids and their shares for the first ``n`` lanes."""
        one, two = self.before[0][:n], self.before[1][:n]
        lane = self.lane[:n]
        self.slot = [lane * _SLOTS + ((one * 40503 >> 5) & (_SLOTS - 1)), lane * _SLOTS + ((one * 40503 + two * 60493 >> 4) & (_SLOTS - 1))]
        self.guess = [self.seen[k][self.slot[k]].astype(np.int64) for k in range(2)]
        trust = [self.trust[k][self.slot[k]].astype(np.int64) for k in range(2)]
        same = self.guess[0] == self.guess[1]
        state = lane * _STATES + trust[1] * 8 + trust[0] * 2 + same
        self.state, self.sure = state, trust
        second = np.where(trust[1] > 0, np.clip(self.hits[1][state], 64, _CEILING - 64), 0)
        first = np.where((trust[0] > 0) & ~(same & (trust[1] > 0)), np.minimum(np.maximum(self.hits[0][state], 64), _CEILING - second), 0)
        self.share = [first, second]
        self.rest = 65536 - first - second

    def learn(self, ids: np.ndarray, missed: np.ndarray, n: int) -> None:
        for k in range(2):
            right = self.guess[k] == ids
            slot, trust = self.slot[k], self.sure[k]
            asked = np.flatnonzero(self.share[k] > 0)
            s = self.state[asked]
            h = self.hits[k][s]
            self.hits[k][s] = h + ((np.where(right[asked], 65535, 0) - h) >> 4)
            self.trust[k][slot] = np.where(right, np.minimum(trust + 1, 3), np.maximum(trust - 1, 1))
            change = ~right & (trust <= 1)
            self.seen[k][slot[change]] = ids[change]
        rows = self.lane[:n][missed]
        got = ids[missed]
        high, low = got >> 8, got & 255
        self.high.counts[rows, high] += 24
        self.low.counts[rows * 2 + (high > 0), low] += 24
        self.before[1][:n] = self.before[0][:n]
        self.before[0][:n] = ids


def _renews(step: int) -> bool:
    return step in (32, 96, 224) or (step >= 256 and step % 256 == 0)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of ids below 65536; longer blocks must come first."""
    if not blocks:
        return []
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    if (np.diff(sizes) > 0).any():
        raise ValueError("blocks must be ordered from long to short")
    grid = np.zeros((sizes[0], len(blocks)), np.int64)
    for lane, block in enumerate(blocks):
        grid[: len(block), lane] = block
    writer, model = _Writer(len(blocks)), _Model(len(blocks), search=False)
    for step in range(int(sizes[0])):
        if _renews(step):
            model.high.renew()
            model.low.renew()
        n = int(np.searchsorted(-sizes, -step, "left")) if sizes[-1] <= step else len(blocks)
        ids = grid[step, :n]
        model.predict(n)
        first, second = model.share
        by_two = (ids == model.guess[1]) & (second > 0)
        by_one = (ids == model.guess[0]) & (first > 0) & ~by_two
        missed = np.flatnonzero(~by_two & ~by_one)
        below = np.where(by_two, 0, second)
        share = np.where(by_two, second, first)
        got, rows, rest = ids[missed], model.lane[:n][missed], model.rest[missed]
        high = got >> 8
        start = model.high.below[rows, high] * rest >> 16
        below[missed] = first[missed] + second[missed] + start
        share[missed] = (model.high.below[rows, high + 1] * rest >> 16) - start
        writer.put(model.lane[:n], below, share)
        row, low = rows * 2 + (high > 0), got & 255
        start = model.low.below[row, low]
        writer.put(rows, start, model.low.below[row, low + 1] - start)
        model.learn(ids, missed, n)
    return writer.finish()


def decode_blocks(parts: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """Inverse of encode_blocks."""
    if not parts:
        return []
    grid = np.zeros((int(sizes[0]), len(parts)), np.int64)
    reader, model = _Reader(parts), _Model(len(parts), search=True)
    for step in range(int(sizes[0])):
        if _renews(step):
            model.high.renew()
            model.low.renew()
        n = int(np.searchsorted(-sizes, -step, "left")) if sizes[-1] <= step else len(parts)
        model.predict(n)
        first, second = model.share
        lanes = model.lane[:n]
        place = reader.peek(lanes)
        by_two = place < second
        by_one = ~by_two & (place < first + second)
        missed = np.flatnonzero(~by_two & ~by_one)
        below = np.where(by_two, 0, second)
        share = np.where(by_two, second, first)
        rows, rest = lanes[missed], model.rest[missed]
        base = first[missed] + second[missed]
        whole = (((place[missed] - base + 1) << 16) - 1) // rest
        high = model.high.find(rows, whole)
        start = model.high.below[rows, high] * rest >> 16
        below[missed] = base + start
        share[missed] = (model.high.below[rows, high + 1] * rest >> 16) - start
        reader.take(lanes, below, share)
        row = rows * 2 + (high > 0)
        low = model.low.find(row, reader.peek(rows))
        start = model.low.below[row, low]
        reader.take(rows, start, model.low.below[row, low + 1] - start)
        ids = np.where(by_two, model.guess[1], model.guess[0])
        ids[missed] = (high << 8) + low
        grid[step, :n] = ids
        model.learn(ids, missed, n)
    return [grid[:n, i] for i, n in enumerate(sizes)]


def _write_group(sink, offset: int, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> tuple[int, int]:
    """Append one group; returns its size in bytes and its number of blocks."""
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    parts = encode_blocks(blocks)
    out = io.BytesIO()
    known = np.asarray(doc_ids.is_valid(), np.uint8)
    documents = zlib.compress(
        doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + known.tobytes() + lengths.astype("<u4").tobytes())
    heads = np.array([(len(b), len(p), zlib.crc32(b.astype("<u4").tobytes())) for b, p in zip(blocks, parts)], "<u4").tobytes()
    out.write(GROUP.pack(MAGIC, len(lengths), len(blocks), len(ids), len(documents), len(heads)))
    out.write(struct.pack("<I", zlib.crc32(documents + heads)))
    for part in (documents, heads, *parts):
        out.write(part)
    sink.write(out.getbuffer())
    return out.tell(), len(blocks)


def read_group(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a group; raises if any checksum fails."""
    magic, documents, blocks, total, table_size, head_size = GROUP.unpack_from(data)
    at = GROUP.size + 4
    table, heads = data[at : at + table_size], data[at + table_size : at + table_size + head_size]
    if magic != MAGIC or zlib.crc32(table + heads) != struct.unpack_from("<I", data, GROUP.size)[0]:
        raise ValueError("damaged group header")
    table = zlib.decompress(table)
    known = np.frombuffer(table, np.uint8, documents, documents * 8)
    doc_ids = [int(v) if k else None for v, k in zip(np.frombuffer(table, "<i8", documents), known)]
    lengths = np.frombuffer(table, "<u4", documents, documents * 9).astype(np.int64)
    head = np.frombuffer(heads, "<u4").reshape(blocks, 3).astype(np.int64)
    ends = at + table_size + head_size + np.cumsum(head[:, 1])
    decoded = decode_blocks([data[e - n : e] for e, n in zip(ends, head[:, 1])], head[:, 0])
    for block, (_, _, crc) in zip(decoded, head):
        if zlib.crc32(block.astype("<u4").tobytes()) != crc:
            raise ValueError("damaged block")
    return doc_ids, lengths, np.concatenate([np.zeros(0, np.int64), *decoded])


def write_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encode whole texts, close each with the end id and write token files in ascending key order.

    Returns the index: one row per group with file, part, group, offset, size, ids, documents. Rows with equal keys keep the
    order of the input files, null keys come first, a null or empty text is the end id alone, an empty table writes no file.
    Each task attempt writes a file of its own name; only the files of committed attempts are in the index.
    """
    spark = docs.sparkSession
    folder, path = shared_folder(spark, "tokens"), vocabulary or vocabulary_path()
    ordered = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("tie"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, group, offset, sink, name = TaskContext.get().partitionId(), 0, 0, None, ""
        keys, lengths, ids, held = [], [], [], 0
        coder = encoder(path)

        def flush():
            nonlocal group, offset, sink, name, keys, lengths, ids, held
            if sink is None:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                sink = open_shared(name, write=True)
            whole = np.concatenate(ids)
            size, _ = _write_group(sink, offset, pa.concat_arrays(keys), np.concatenate(lengths), whole)
            n = sum(map(len, keys))
            row = pa.RecordBatch.from_pydict({"file": [name], "part": [part], "group": [group], "offset": [offset], "size": [size],
                                              "ids": [len(whole)], "documents": [n]}, schema=shape)
            group, offset = group + 1, offset + size
            keys, lengths, ids, held = [], [], [], 0
            return row

        try:
            for batch in batches:
                for piece in slices(batch, "text", 1 << 22):
                    got, sizes = coder.encode(piece.column("text").to_pylist())
                    keys.append(piece.column("key"))
                    lengths.append(sizes)
                    ids.append(got)
                    held += len(got)
                    if held >= GROUP_IDS:
                        yield flush()
            if held:
                yield flush()
        finally:
            if sink is not None:
                sink.close()

    shape = pa.schema([("file", pa.string()), ("part", pa.int64()), ("group", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()),
                       ("ids", pa.int64()), ("documents", pa.int64())])
    index = "file string, part long, `group` long, offset long, size long, ids long, documents long"
    return stored(ordered.mapInArrow(write, index), "token-index")


def read_tokens(index: DataFrame) -> DataFrame:
    """Read token files back: key, start (ids of all documents before it), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    totals = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.sum("ids").alias("n")).collect()}  # one row per output file
    before, run = [], 0
    for part in sorted(totals):
        before.append((part, run))
        run += totals[part]
    starts = index.sparkSession.createDataFrame(before, "part long, _before long")
    w = W.partitionBy("part").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    placed = index.withColumn("start", F.coalesce(F.sum("ids").over(w), F.lit(0))).join(F.broadcast(starts), "part")
    placed = placed.select("file", "offset", "size", (F.col("start") + F.col("_before")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_shared(row["file"]) as source:
                    doc_ids, lengths, ids = read_group(source.read_at(row["size"], row["offset"]))
                words = ids.astype("<u4")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(words[e - n : e].tobytes()) for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, index.count())
    return placed.repartition(n, "file", "offset").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
