"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct word shingles. Every shingle is a Poisson process of points with a random register each; a
register keeps the smallest point it got, rounded down on an exponential scale. Registers of a union are the registers' maxima,
so sketches merge, and equal registers grow likely with the Jaccard similarity, so bands of registers serve as buckets.

1. Documents with equal sets form a class; one document stands for it.
2. Members of a bucket are compared with its smallest member: the two sketches' likelihood first, then the full sets.
3. Links give components. Buckets that still hold several components are cut into blocks, and every pair of blocks compares its
   pairs across components, again likelihood first and full sets after. So no pair that shares a bucket is left out, and a
   bucket of one component costs one comparison per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .common import mix, slices, stored, strings, word_hashes

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 80
REGISTERS, BAND = 128, 4  # misses a pair of similarity 0.8 in one of twenty million cases
BASE, RATE, TOP = 1.02, 20.0, 60000
#: A pair is dropped unread if similarity PERCENT is this much less likely (in logs) than the best estimate.
UNLIKELY = 18.0
#: Members of a bucket compared within one row.
BLOCK = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_GRID = np.linspace(0.0, 1.0, 101)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text end to end, and how many each text has.

    A text of fewer words than ``size`` is one shingle as a whole; a text without words has none.
    """
    h, _, _, words = word_hashes(data, bounds)
    out, counts, at = [], np.zeros(len(words), np.int64), 0
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
        for j in range(size):
            rolled += h[j : len(h) - size + 1 + j] * factors[j] if len(rolled) else rolled
        rolled = mix(rolled)
        for i, n in enumerate(words):
            if n >= size:
                found = np.unique(rolled[at : at + n - size + 1])
            elif n:
                found = mix(np.array([(h[at : at + n] * factors[:n]).sum(dtype=np.uint64) + np.uint64(n)]))
            else:
                found = h[:0]
            out.append(found)
            counts[i] = len(found)
            at += n
    return np.concatenate([h[:0], *out]), counts


def registers(hashes: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of every set: larger is a smaller first point. Empty sets have zeros. ``m`` is a power of two."""
    sets = len(counts)
    least = np.full(sets * m, np.inf)
    owner = np.repeat(np.arange(sets), counts)
    state, x, alive = hashes.copy(), np.zeros(len(hashes)), owner
    bound = np.full(sets, np.inf)
    step = 0
    with np.errstate(over="ignore"):
        while len(alive):
            width = 1 if step < 6 else 32
            k = np.arange(step + 1, step + 1 + width, dtype=np.uint64) * _STEP
            draw = mix(state[:, None] + k[None, :])
            gaps = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / m
            place = (draw & np.uint64(m - 1)).astype(np.int64)  # bits that the gap doesn't use
            points = x[:, None] + np.cumsum(gaps, axis=1)
            np.minimum.at(least, (alive[:, None] * m + place).ravel(), points.ravel())
            x = points[:, -1]
            step += width
            if step < 3 or step >= 6 or step % 2 == 0:
                mark = np.zeros(sets, bool)
                mark[alive] = True
                touched = np.flatnonzero(mark)
                bound[touched] = least.reshape(sets, m)[touched].max(axis=1)
            going = x < bound[alive]
            state, x, alive = state[going], x[going], alive[going]
    with np.errstate(divide="ignore"):
        level = np.floor(1.0 - np.log(least / RATE) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, level), 0, TOP).astype(np.uint16).reshape(sets, m)


def band_keys(regs: Column, m: int = REGISTERS, width: int = BAND) -> Column:
    """Array with one key per band of a binary column of registers."""
    return F.array(*[F.xxhash64(F.substring(regs, 2 * width * j + 1, 2 * width)) for j in range(m // width)])


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs of sketches (rows of registers, with set sizes) may reach the similarity.

    The counts of greater, smaller and equal registers have a joint likelihood in the similarity and the known sizes; a pair
    stays unless a similarity of ``percent`` or more is far less likely than the best estimate.
    """
    share = percent / 100.0
    fits = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    curve = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    j = _GRID[None, :]
    up, down = np.clip(curve(u - v * j), 1e-9, 1), np.clip(curve(v - u * j), 1e-9, 1)
    equal = np.clip(1 - up - down, 1e-9, 1)
    likely = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(equal)
    return fits & (likely[:, _GRID >= share - 1e-9].max(axis=1) >= likely.max(axis=1) - UNLIKELY)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact test on two sorted distinct sets."""
    if not len(a) or not len(b) or min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common * 100 >= (len(a) + len(b) - common) * percent


def sketch(rows: DataFrame, size: int) -> DataFrame:
    """row, key, n_shingles, two hashes of the whole set and the registers of every row of ``rows(row, key, text)``."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = shingle_sets(*strings(part.column("text")), size)
                regs = registers(hashes, counts)
                ends = np.concatenate([[0], np.cumsum(counts)])
                with np.errstate(over="ignore"):
                    runs = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(c)))]) for c in (1, 2)]
                    sums = [(r[ends[1:]] - r[ends[:-1]]).view(np.int64) for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("key"), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]),
                     pa.array([r.tobytes() for r in regs], pa.binary())],
                    ["row", "key", "n_shingles", "set_a", "set_b", "regs"])

    return rows.mapInArrow(measure, "row long, key long, n_shingles long, set_a long, set_b long, regs binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label for the nodes of ``nodes(node)``: the smallest node reachable over ``links(a, b)``.

    Labels sink to the smallest neighbour's and then to their own label's label until nothing changes.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    ends = both.select(F.col("a").alias("node")).distinct()
    labels = stored(ends.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", "label", F.least("label", "near").alias("next"))
        lower = stored(lower, "labels")
        jump = lower.select(F.col("node").alias("_via"), F.col("next").alias("_jump"))
        after = stored(lower.join(jump, F.col("next") == F.col("_via"), "left").select(
            "node", F.least("next", "_jump").alias("label"), (F.least("next", "_jump") < F.col("label")).alias("moved")), "labels")
        if not after.where("moved").limit(1).count():
            break
        labels = after.select("node", "label")
    return nodes.join(after.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are linked. The text of b is joined last, so pairs of a hot b can be split."""
    left = stored(pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"), "pair-texts")
    both = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = np.zeros(len(a), bool)
            for part, first in _parts(batch, "text_a"):
                hashes, counts = shingle_sets(*strings(part.column("text_a")), size)
                ends = np.cumsum(counts)
                for i in range(part.num_rows):
                    if b[first + i] != last:
                        last, last_set = b[first + i], shingle_sets(*strings(part.column("text_b").slice(i, 1)), size)[0]
                    keep[first + i] = linked(hashes[ends[i] - counts[i] : ends[i]], last_set, percent)
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return both.mapInArrow(test, "a long, b long")


def _parts(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, int]]:
    first = 0
    for part in slices(batch, name):
        yield part, first
        first += part.num_rows


def _estimated(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sketches' likelihood leaves."""
    one = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    both = stored(pairs.join(one, "a"), "pair-sketches").join(two, "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b")]
            sizes = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            at = pa.array(np.flatnonzero(plausible(*regs, *sizes, percent)))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return both.mapInArrow(test, "a long, b long")


def _cells(open_rows: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket.

    ``open_rows(band, bucket, node, label, major, few, many)``: rows outside the bucket's largest component are dealt to the
    blocks 0..few-1, rows of it to few..few+many-1, and each of the first meets every block. A pair that also shares an earlier
    band is left to that band.
    """
    deal = lambda n: F.pmod(F.xxhash64("node"), n)
    rows = open_rows.withColumn("block", F.when(F.col("major"), F.col("few") + deal(F.col("many"))).otherwise(deal(F.col("few"))))
    reach = F.when(F.col("major"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), reach - 1)).alias("other"))
    rows = rows.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    cell = ["band", "bucket", "low", "high"]
    cells = rows.join(sketches, "node").select(*cell, "block", "node", "label", "n_shingles", "regs")

    def likely(key, group):
        group = group.sort_by("node")
        found = np.zeros(group.num_rows, bool)
        for i, rest in _cell_pairs(key[0].as_py(), group, percent, lambda i, k: True):
            found[i] |= len(rest) > 0
            found[rest] = True
        return group.select(kept).filter(pa.array(found))

    # the sets go only to rows that have a likely partner in their cell
    kept = [*cell, "block", "node", "label", "n_shingles", "regs"]
    kinds = "band int, bucket long, low long, high long, block long, node long, label long, n_shingles long, regs binary"
    some = stored(cells.groupBy(*cell).applyInArrow(likely, kinds), "likely-cells")
    wanted = stored(some.select("node").distinct(), "cell-nodes")
    body = texts.join(broadcast_if_small(wanted), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, counts = shingle_sets(*strings(part.column("text")), size)
                ends = np.cumsum(counts)
                made = pa.array([hashes[e - n : e].tobytes() for e, n in zip(ends, counts)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("node"), made], ["node", "set"])

    full = some.join(stored(body.mapInArrow(sets, "node long, set binary"), "cell-sets"), "node")

    def compare(key, group):
        return pa.table(dict(zip("ab", _cell_links(key[0].as_py(), group.sort_by("node"), percent))), schema=shape)

    shape = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return full.groupBy(*cell).applyInArrow(compare, "a long, b long")


def _cell_pairs(band: int, group: pa.Table, percent: int, apart: Callable[[int, int], bool]) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers (i, later rows) of a cell that are likely alike and ``apart``; none that also share an earlier band."""
    regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(group.num_rows, -1)
    keys = regs[:, : band * BAND].reshape(group.num_rows, band, BAND)
    sizes, block = group.column("n_shingles").to_numpy(), group.column("block").to_numpy()
    labels = group.column("label").to_numpy()
    within = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    for i in range(group.num_rows):
        rest = np.arange(i + 1, group.num_rows)
        rest = rest[(labels[rest] != labels[i]) & (within | (block[rest] != block[i]))]
        rest = np.array([k for k in rest if apart(i, k)], np.int64)
        if len(rest):
            rest = rest[~(keys[rest] == keys[i]).all(axis=2).any(axis=1)]
        if len(rest):
            ok = plausible(np.broadcast_to(regs[i], (len(rest), regs.shape[1])), regs[rest], np.full(len(rest), sizes[i]), sizes[rest], percent)
            yield i, rest[ok]


def _cell_links(band: int, group: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links inside one cell, no more than join its components."""
    nodes, label = group.column("node").to_pylist(), group.column("label").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in group.column("set").to_pylist()]
    root = {x: x for x in label}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    for i, rest in _cell_pairs(band, group, percent, lambda i, k: find(label[i]) != find(label[k])):
        for k in rest:
            if find(label[k]) != find(label[i]) and linked(sets[i], sets[k], percent):
                root[find(label[k])] = find(label[i])
                a.append(nodes[i])
                b.append(nodes[k])
    return a, b


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT,
                    row: str | None = None) -> DataFrame:
    """One row per document: row, key, n_shingles, component_id, kept, first.

    ``row`` names a column of distinct numbers, if ``docs`` is a stored table that has one; else rows are numbered here. ``first``
    marks one row of every component, that of the smallest key (nulls last, then the smallest number).

    component_id is the smallest key reachable over links, the own key included. Null and empty texts, and texts of white space,
    have an empty set and link with nothing. Rows that repeat a key are documents of their own. Null keys are never a
    component_id; a row with a null key is kept only if its component has no other key. An empty table gives an empty result.
    """
    # numbered and written once, so that the numbers hold for every later read
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    rows = docs.select(number.alias("row"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    rows = stored(rows, "rows") if row is None else rows
    sketches = stored(sketch(rows, size), "sketches")
    same = ["set_a", "set_b", "n_shingles"]
    full = sketches.where(F.col("n_shingles") > 0)
    classes = stored(full.groupBy(*same).agg(F.min("row").alias("node")), "classes")
    heads = stored(full.join(classes.select("node"), F.col("row") == F.col("node")).select("node", "n_shingles", "regs"), "class-sketches")
    texts = rows.select(F.col("row").alias("node"), "text")

    keyed = heads.select("node", F.posexplode(band_keys(F.col("regs"))).alias("band", "bucket"))
    buckets = keyed.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.count("*").alias("members")).where("members > 1")
    members = stored(keyed.join(stored(buckets, "buckets"), ["band", "bucket"]).select("band", "bucket", "node", "first"), "bucket-members")
    pairs = members.where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    likely = stored(_estimated(stored(pairs, "star-pairs"), heads, percent), "likely-pairs")
    ends = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
    bodies = stored(texts.join(broadcast_if_small(stored(ends, "pair-ends")), "node"), "pair-texts")
    links = stored(_verify(likely, bodies, size, percent), "star-links")
    found = stored(components(members.select("node").distinct(), links), "star-components")

    labelled = members.select("band", "bucket", "node").join(found, "node")
    sizes = stored(labelled.groupBy("band", "bucket", "label").agg(F.count("*").alias("n")), "bucket-labels")
    mixed = sizes.groupBy("band", "bucket").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.max("n").alias("most"),
                                                F.sum("n").alias("all"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("bigint")
    mixed = stored(mixed.select("band", "bucket", "largest", blocks(F.col("all") - F.col("most")).alias("few"), blocks(F.col("most")).alias("many")),
                   "mixed-buckets")
    open_rows = stored(labelled.join(mixed, ["band", "bucket"]).select(
        "band", "bucket", "node", "label", (F.col("label") == F.col("largest")).alias("major"), "few", "many"), "open-rows")
    more = stored(_cells(open_rows, heads, texts, size, percent), "cell-links")

    final = components(classes.select("node"), stored(links.unionByName(more), "all-links")).withColumnRenamed("label", "root")
    final = stored(final, "components")
    owned = full.join(classes, same).join(final, "node").select("row", "key", "n_shingles", "root")
    alone = sketches.where(F.col("n_shingles") == 0).select("row", "key", "n_shingles", F.col("row").alias("root"))
    owned = stored(owned.unionByName(alone), "owned")
    order = F.struct(F.col("key").isNull(), "key", "row")
    names = stored(owned.groupBy("root").agg(F.min("key").alias("component_id"), F.min_by("row", order).alias("_first")), "component-names")
    out = owned.join(names, "root")
    kept = F.coalesce(F.col("key") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("row", F.col("key").alias(key), "n_shingles", "component_id", kept.alias("kept"), (F.col("row") == F.col("_first")).alias("first"))
