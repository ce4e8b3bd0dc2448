"""Scores of texts under a log-bilinear neural model trained with noise-contrastive estimation.

Words are counted exactly over all training documents. The neural model predicts the class of the next token from the two
classes before: frequent words are classes of their own, other words share classes by their last bytes, and the end of a text is
a class. A word's probability is its class's times its smoothed share of the class, so all known words, the end and one unseen
word per class sum to one in every context.

Every block of documents becomes one row of local word numbers and distinct word hashes, written once, its arrays packed. Blocks
send their distinct words, cut by ranges of hashes, once to be counted; the counts come back by block and meet the word numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, slices, stored, strings, word_hashes

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a block.
BLOCK_BYTES = 6 << 20
#: Classes: the end, HEAD frequent words, TAILS groups of other words.
HEAD, TAILS = 190, 64
CLASSES = 1 + HEAD + TAILS
#: Size of the class vectors, noise samples per token, rounds of parameter averaging, examples per step, step size.
WIDTH, NOISE, ROUNDS, BATCH, RATE = 24, 8, 2, 4096, 0.15
#: Ranges of hashes, as a power of two at least, and blocks to a range: a task that counts holds the words of one range.
RANGE_BITS, RANGE_BLOCKS = 6, 16


def _pack(values: np.ndarray) -> bytes:
    """An array of whole numbers, cut into its first bytes, second bytes and so on, and compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes | pa.Buffer, kind: str) -> np.ndarray:
    n, width = int.from_bytes(memoryview(data)[:8], "little"), np.dtype(kind).itemsize
    planes = pa.decompress(memoryview(data)[8:], decompressed_size=n * width, codec="zstd") if n else b""
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def _pack_sorted(hashes: np.ndarray) -> bytes:
    """Rising hashes by their differences, whose upper bytes are mostly zero."""
    return _pack(np.diff(hashes.view(np.uint64), prepend=np.uint64(0)))


def _unpack_sorted(data: bytes | pa.Buffer) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64).view(np.int64)


def _by_rank(counts: np.ndarray) -> np.ndarray:
    """Distinct words from the most frequent down; texts hold their places here, which pack better than those among the hashes."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _tails(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Group of every word by its last three bytes."""
    code = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for back in (1, 2, 3):
            byte = data[np.maximum(last - back, 0)] | 0x20 if len(data) else data
            code = code * np.uint64(257) + np.where(last - back >= first, byte, 0).astype(np.uint64)
    return (mix(code) % np.uint64(TAILS)).astype(np.uint8)


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per block of documents: keys, words per document, training flags, number of training documents, local word numbers
    (by rank), and per distinct word, by rising hash, its hash, training count and group."""
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"),
                       F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(True)).alias("train"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts, held, number = [], 0, TaskContext.get().partitionId() << 32

        def flush():
            nonlocal parts, held, number
            hashes, tails, words = (np.concatenate([p[i] for p in parts]) for i in range(3))
            keys, train = pa.concat_arrays([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            distinct, at, codes = np.unique(hashes.view(np.int64), return_index=True, return_inverse=True)
            counts = np.bincount(codes[np.repeat(train, words)], minlength=len(distinct))
            rank = np.empty(len(distinct), np.int64)
            rank[_by_rank(counts)] = np.arange(len(distinct))
            row = pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([keys.to_pylist()], pa.list_(pa.int64())), pa.array([words.astype("<i4").tobytes()]),
                pa.array([train.astype(np.uint8).tobytes()]), pa.array([int(train.sum())]), pa.array([_pack(rank[codes].astype("<u4"))]),
                pa.array([_pack_sorted(distinct)]), pa.array([_pack(counts.astype("<u4"))]), pa.array([_pack(tails[at])])],
                ["block", "keys", "words", "train", "ends", "codes", "hashes", "counts", "tails"])
            parts, held, number = [], 0, number + 1
            return row

        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = strings(part.column("text"))
                h, first, last, n = word_hashes(data, bounds)
                parts.append((h, _tails(data, first, last), n, part.column("key"), np.asarray(part.column("train"))))
                held += len(data) + 64 * part.num_rows
                if held >= BLOCK_BYTES:
                    yield flush()
        if parts:
            yield flush()

    shape = "block long, keys array<long>, words binary, train binary, ends long, codes binary, hashes binary, counts binary, tails binary"
    return rows.mapInArrow(make, shape)


class LogBilinear:
    """score(c | a, b) = (R[a] * P[0] + R[b] * P[1]) . Q[c] + bias[c]."""

    def __init__(self, unigram: np.ndarray, seed: int = 7):
        rng, k = np.random.default_rng(seed), len(unigram)
        self.noise = unigram
        self.context = rng.normal(0, 0.3, (k, WIDTH)).astype(np.float32)
        self.place = np.ones((2, WIDTH), np.float32)
        self.target = rng.normal(0, 0.05, (k, WIDTH)).astype(np.float32)
        self.bias = np.log(unigram).astype(np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.context, self.place, self.target, self.bias)]).astype(np.float64)

    def load(self, vector: np.ndarray) -> LogBilinear:
        at = 0
        for name in ("context", "place", "target", "bias"):
            x = getattr(self, name)
            setattr(self, name, vector[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return self

    def fit(self, grams: np.ndarray, weights: np.ndarray, memory: dict, rng: np.random.Generator) -> None:
        """One pass of noise-contrastive estimation over weighted (before last, last, next) classes, with adaptive steps."""
        k, edge = len(self.noise), np.log(NOISE * self.noise).astype(np.float32)
        cumulative = np.cumsum(self.noise)
        order = rng.permutation(len(grams))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            (a, b, c), w = grams[pick].T, (weights[pick] / weights[pick].sum()).astype(np.float32)
            noise = np.minimum(np.searchsorted(cumulative, rng.random((len(pick), NOISE)) * cumulative[-1]), k - 1)
            ra, rb = self.context[a], self.context[b]
            h = ra * self.place[0] + rb * self.place[1]
            words = np.concatenate([c[:, None], noise], axis=1)
            q = self.target[words]
            score = np.einsum("nd,nkd->nk", h, q) + self.bias[words] - edge[words]
            real = np.zeros(NOISE + 1, np.float32)
            real[0] = 1
            err = (real - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) * w[:, None]
            grad_h = np.einsum("nk,nkd->nd", err, q)
            steps = {"context": np.zeros_like(self.context), "target": np.zeros_like(self.target)}
            flat = np.zeros((k, len(pick)), np.float32)
            np.add.at(flat, (words.ravel(), np.repeat(np.arange(len(pick)), NOISE + 1)), err.ravel())
            steps["target"] = flat @ h
            steps["bias"] = flat.sum(axis=1)
            for at, part in ((a, grad_h * self.place[0]), (b, grad_h * self.place[1])):
                np.add.at(steps["context"], at, part)
            steps["place"] = np.stack([(grad_h * ra).sum(axis=0), (grad_h * rb).sum(axis=0)])
            for name, g in steps.items():
                memory[name] = memory.get(name, 1e-8) + g * g
                setattr(self, name, getattr(self, name) + (RATE * g / np.sqrt(memory[name])).astype(np.float32))

    def table(self) -> np.ndarray:
        """Normalised log10-probabilities of every class in every context, [before last, last, next]."""
        k = len(self.bias)
        out = np.empty((k, k, k), np.float32)
        for a in range(k):
            logits = (self.context[a] * self.place[0] + self.context * self.place[1]) @ self.target.T + self.bias
            logits -= logits.max(axis=1, keepdims=True)
            logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
            out[a] = logits / np.log(10.0)
        return out


def _cell(batch: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
    """A row's raw column as an array, without a copy."""
    return np.frombuffer(batch.column(name)[i].as_buffer(), kind)


def _packed(batch: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
    return _unpack(batch.column(name)[i].as_buffer(), kind)


def _sequence(words: np.ndarray, codes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Local numbers of all tokens with ends put in, and tokens per document."""
    return np.insert(codes, np.cumsum(words), end), words + 1


def _tokens(batch: pa.RecordBatch, i: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's tokens as places among its hashes, the end behind them all, and tokens per document."""
    order = _by_rank(_packed(batch, i, "counts", "<u4"))
    return _sequence(words, order[_packed(batch, i, "codes", "<u4")], len(order))


def _contexts(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two tokens before, the end's class before the start of a text."""
    starts = np.cumsum(lengths) - lengths
    one, two = np.roll(classes, 1), np.roll(classes, 2)
    one[starts] = two[starts] = 0
    two[(starts + 1)[lengths > 1]] = 0
    return one, two


def _classes(hashes: np.ndarray, tails: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Class of every distinct word, and last that of the end; ``head`` holds the sorted hashes of the frequent words."""
    found = 1 + HEAD + tails.astype(np.int64)
    if len(head) and len(hashes):
        at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
        found = np.where(head[at] == hashes, 1 + at, found)
    return np.append(found, 0)


def count_words(made: DataFrame) -> DataFrame:
    """Training counts of the blocks' distinct words over all blocks, and what the model needs of them.

    A block's hashes are cut into ranges, and all blocks' words of a range are counted together. Per block and range: ``totals``,
    in the order of the block's hashes. Per range, with a null block: ``distinct`` known words, the HEAD most frequent ones
    (``top``), and by group their occurrences (``mass``) and number (``kinds``).
    """
    bits = max(RANGE_BITS, (made.count() // RANGE_BLOCKS).bit_length())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = [(k << (64 - bits)) - (1 << 63) for k in range(1, 1 << bits)]
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = _unpack_sorted(batch.column("hashes")[i].as_buffer())
                counts, tails = _packed(batch, i, "counts", "<u4"), _packed(batch, i, "tails", "u1")
                bounds = [0, *np.searchsorted(hashes, starts).tolist(), len(hashes)]
                used = [(k, a, b) for k, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[i].as_py()] * len(used), pa.int64()), pa.array([k for k, _, _ in used], pa.int32()),
                     *(pa.array([f(x[a:b]) for _, a, b in used], pa.binary()) for x, f in ((hashes, _pack_sorted), (counts, _pack), (tails, _pack)))],
                    ["block", "range", "hashes", "counts", "tails"])

    shape = "block long, range int, totals binary, distinct long, top array<struct<hash:long, c:long, tail:int>>, mass array<long>, kinds array<long>"
    kind = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("totals", pa.binary()), ("distinct", pa.int64()),
                      ("top", pa.list_(pa.struct([("hash", pa.int64()), ("c", pa.int64()), ("tail", pa.int32())]))),
                      ("mass", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64()))])

    def add(key, group):
        parts = [_unpack_sorted(x) for x in group.column("hashes").to_pylist()]
        counts = np.concatenate([_unpack(x, "<u4") for x in group.column("counts").to_pylist()]).astype(np.int64)
        tails = np.concatenate([_unpack(x, "u1") for x in group.column("tails").to_pylist()])
        words, at = np.unique(np.concatenate(parts), return_inverse=True)
        c, tail = np.zeros(len(words), np.int64), np.full(len(words), TAILS, np.uint8)
        np.add.at(c, at, counts)
        np.minimum.at(tail, at, tails)
        totals, stops = c[at], np.cumsum([len(x) for x in parts]).tolist()
        known = np.flatnonzero(c > 0)
        best = known[np.lexsort((words[known], -c[known]))[:HEAD]]
        kinds, mass = np.bincount(tail[known], minlength=TAILS), np.zeros(TAILS, np.int64)
        np.add.at(mass, tail[known], c[known])
        top = [{"hash": int(words[j]), "c": int(c[j]), "tail": int(tail[j])} for j in best]
        n, blank = len(parts), [None] * len(parts)
        return pa.table([[*group.column("block").to_pylist(), None], [key[0].as_py()] * (n + 1),
                         [*(_pack(totals[a:b]) for a, b in zip([0, *stops], stops)), None],
                         [*blank, len(known)], [*blank, top], [*blank, mass.tolist()], [*blank, kinds.tolist()]], schema=kind)

    cuts = made.select("block", "hashes", "counts", "tails").mapInArrow(cut, "block long, range int, hashes binary, counts binary, tails binary")
    return stored(cuts.groupBy("range").applyInArrow(add, shape), "lm-counts")


#: Columns of a block that its scores need.
PASSED = ["block", "keys", "words", "train", "codes", "counts"]


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    A null or empty text is the end alone. A row with a null key is learned from. Repeated rows count as often. An empty table
    gives an empty result; without training rows every token is unseen.
    """
    spark = docs.sparkSession
    made = stored(blocks(docs, key, text), "lm-blocks")
    counted = count_words(made)
    ranges = counted.where("block IS NULL")
    ends = made.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0]
    distinct = ranges.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]
    groups = ranges.select(F.posexplode(F.arrays_zip("mass", "kinds")).alias("tail", "x")).groupBy("tail").agg(
        F.sum("x.mass").alias("n"), F.sum("x.kinds").alias("kinds")).collect()  # TAILS rows
    rest = {r["tail"]: [r["n"], r["kinds"]] for r in groups}
    total, distinct = ends + sum(n for n, _ in rest.values()), distinct + (ends > 0)
    top = ranges.select(F.explode("top").alias("w")).select("w.*").orderBy(F.desc("c"), "hash").limit(HEAD).collect()
    head = np.sort(np.array([r["hash"] for r in top], np.int64))
    counts = {r["hash"]: r["c"] for r in top}
    for r in top:
        rest[r["tail"]][0] -= r["c"]
        rest[r["tail"]][1] -= 1
    mass = np.array([ends, *[counts.get(int(x), 0) for x in head], *[0] * (HEAD - len(head)), *[rest.get(t, (0, 0))[0] for t in range(TAILS)]], float)
    smooth = np.array([sum(rest.get(t, (0, 0))) + 1 for t in range(TAILS)], float)
    model = LogBilinear((mass + 1) / (mass + 1).sum())
    for turn in range(ROUNDS):
        model = _average(made, model, head, turn)

    shared = spark.sparkContext.broadcast((model.vector(), model.noise, head, smooth))  # CLASSES and WIDTH bound it

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value[2]
        for batch in batches:
            found = [_classes(_unpack_sorted(batch.column("hashes")[i].as_buffer()), _packed(batch, i, "tails", "u1"), head) for i in range(batch.num_rows)]
            kinds = pa.array([_pack(x.astype("<u2")) for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PASSED), kinds], [*PASSED, "kinds"])

    floor = float(np.log10(total + distinct + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, noise, head, smooth = shared.value
        table = None
        for batch in batches:
            for i in range(batch.num_rows):
                table = LogBilinear(noise).load(vector).table() if table is None else table
                n, kinds = _cell(batch, i, "words", "<i4").astype(np.int64), _packed(batch, i, "kinds", "<u2").astype(np.int64)
                c = np.concatenate([*(_unpack(x, "<i8") for x in batch.column("totals")[i].as_py() or ()), [ends]])
                tail = kinds > HEAD
                share = np.where(tail, np.log10(c + 1.0) - np.log10(smooth[np.where(tail, kinds - 1 - HEAD, 0)]), 0.0)
                tokens, lengths = _tokens(batch, i, n)
                classes = kinds[tokens]
                one, two = _contexts(classes, lengths)
                starts = np.cumsum(lengths) - lengths
                logs, known = np.log10(c + 1.0), (c > 0).astype(np.int64)
                scores = np.add.reduceat(table[two, one, classes] + share[tokens], starts)
                bases = np.add.reduceat(logs[tokens] - floor, starts)
                train = _cell(batch, i, "train", "u1")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("keys")[i].values, pa.array(train == 0), pa.array(lengths), pa.array(np.add.reduceat(known[tokens], starts)),
                     pa.array(np.full(len(n), total)), pa.array(bases), pa.array(scores)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = counted.where("block IS NOT NULL").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "totals"))).alias("t"))
    shape = "block long, keys array<long>, words binary, train binary, codes binary, counts binary, kinds binary"
    named = made.select(*PASSED, "hashes", "tails").mapInArrow(name, shape)  # hashes stay behind
    both = named.join(back.select("block", F.col("t.totals").alias("totals")), "block", "left")
    return both.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _average(made: DataFrame, model: LogBilinear, head: np.ndarray, turn: int) -> LogBilinear:
    """Every task trains on all its training documents from the same start; the parameters are averaged by tokens seen."""
    shared = made.sparkSession.sparkContext.broadcast((model.vector(), model.noise, head))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector, noise, head = shared.value
        own, memory, seen = LogBilinear(noise).load(vector), {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                tokens, lengths = _tokens(batch, i, _cell(batch, i, "words", "<i4").astype(np.int64))
                hashes = _unpack_sorted(batch.column("hashes")[i].as_buffer())
                classes = _classes(hashes, _packed(batch, i, "tails", "u1"), head)[tokens]
                one, two = _contexts(classes, lengths)
                use = np.repeat(_cell(batch, i, "train", "u1") == 1, lengths)
                grams, times = np.unique(((two * CLASSES + one) * CLASSES + classes)[use], return_counts=True)
                if len(grams):
                    grams = np.stack([grams // CLASSES**2, grams // CLASSES % CLASSES, grams % CLASSES], axis=1)
                    own.fit(grams, times, memory, np.random.default_rng([batch.column("block")[i].as_py(), turn]))
                    seen += int(times.sum())
        if seen:
            at = own.vector()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(at))), pa.array(at), pa.array(np.full(len(at), float(seen)))], ["at", "value", "seen"])

    sums = made.select("block", "words", "train", "codes", "hashes", "counts", "tails").mapInArrow(learn, "at long, value double, seen double")
    rows = sums.groupBy("at").agg((F.sum(F.col("value") * F.col("seen")) / F.sum("seen")).alias("value")).collect()  # one row per parameter
    if not rows:
        return model
    vector = model.vector()
    vector[[r["at"] for r in rows]] = [r["value"] for r in rows]
    return LogBilinear(model.noise).load(vector)
