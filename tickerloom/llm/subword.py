"""Sampled segmentations of texts into SentencePiece pieces, without replacement, and their decoding.

A text's lattice has an edge for every piece that spells a part of it. A piece's weight follows Zipf's law in its rank, so a
segmentation has a probability, and the backward sums of the lattice hold the mass of all ways to go on. The search perturbs the
whole lattice with one Gumbel value per segmentation, lazily: a node's perturbed value is the largest below it, and an A-star queue
hands out complete segmentations from the largest value down. These are exactly a sample without replacement. The value left on top
of the queue is the threshold that inclusion scores are taken over. Lattices and searches of all texts of a slice run side by side in
numpy; random numbers are addressed by the row's key and the place in its text, so slices don't change what is drawn.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROLL, mix, slices

SAMPLES = 3
#: Exponent of the law that weighs a piece by its rank.
EXPONENT = 1.2
SPACE = "▁"
#: Bytes of text whose lattices are built together.
SLICE = 1 << 20
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MIX_STEP = 0xD1342543DE82EF95
#: Steps whose nodes are valued at first, and a bound of the noise ``uniform`` can give: its numbers are within 2**-54 of 1.
REACH, HIGHEST = 768, 38.0
EMPTY = np.empty(0, np.int64)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Vocabulary of a SentencePiece model as a lattice builder."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.words: dict[str, tuple[int, float]] = {}
        self.bytes: list[tuple[int, float]] = [(self.library.unk_id(), -60.0)] * 256
        self.starts: set[str] = set()
        for i in range(self.library.get_piece_size()):
            if self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                continue
            text, weight = self.library.id_to_piece(i), -EXPONENT * math.log(2.0 + max(0.0, -self.library.get_score(i)))
            if self.library.is_byte(i):
                self.bytes[int(text[3:5], 16)] = (i, -EXPONENT * math.log(2.0 + self.library.get_piece_size()))
            else:
                self.words[text] = (i, weight)
                self.starts.update(text[:n] for n in range(1, len(text) + 1))
        self.trie = Trie(self.words)
        # Text of every piece; None for the bytes of longer characters, which the library puts together.
        self.spelling: list[str | None] = [None] * self.library.get_piece_size()
        for text, (i, _) in self.words.items():
            self.spelling[i] = text.replace(SPACE, " ")
        for b in range(128):
            if self.bytes[b][0] != self.library.unk_id():
                self.spelling[self.bytes[b][0]] = chr(b)

    def lattice(self, text: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Edges (to, weight, ids) from every place of the escaped text, and the log mass of all ways from a place to the end."""
        s = SPACE + text.replace(" ", SPACE)
        n, edges = len(s), []
        for i in range(n):
            out, j = [], i + 1
            while j <= n and (part := s[i:j]) in self.starts:
                found = self.words.get(part)
                if found is not None:
                    out.append((j, found[1], (found[0],)))
                j += 1
            if s[i] not in self.words:
                raw = [self.bytes[b] for b in s[i].encode("utf-8", "surrogatepass")]
                out.append((i + 1, sum(w for _, w in raw), tuple(k for k, _ in raw)))
            edges.append(out)
        mass = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            logs = [w + mass[j] for j, w, _ in edges[i]]
            top = max(logs)
            mass[i] = top + math.log(sum(math.exp(x - top) for x in logs))
        return edges, mass

    def sample(self, text: str, seed: int, k: int = SAMPLES) -> list[tuple[list[int], float, float]]:
        """Up to ``k`` distinct segmentations (ids, log-probability, inclusion score), in order of their perturbed values."""
        return [(ids, log_prob, math.exp(log_inclusion)) for ids, log_prob, log_inclusion in self.draw(text, seed, k)]

    def draw(self, text: str, seed: int, k: int = SAMPLES) -> list[tuple[list[int], float, float]]:
        """As ``sample``, with the logarithm of the inclusion score: long texts' scores are too small for a double."""
        return [(ids.tolist(), log_prob, log_inclusion) for _, ids, log_prob, log_inclusion in self.draw_all([text], [seed], k)]

    def draw_all(self, texts: list[str], seeds: list[int], k: int = SAMPLES) -> list[tuple[int, np.ndarray, float, float]]:
        """(place of the text, ids, log-probability, log inclusion score) of every sample of every text, texts in order.

        No piece goes past a space behind another character, so a lattice is a chain of its words' lattices; each distinct word's
        is built once a call, all of them side by side.
        """
        index: dict[str, int] = defaultdict(count().__next__)
        words, sizes, where = [], [], []
        for n, text in enumerate(texts):
            if text:
                found = WORD.findall(SPACE + text.replace(" ", SPACE))
                words.extend(map(index.__getitem__, found))
                sizes.append(len(found))
                where.append(n)
        drawn: dict[int, list] = {n: [] for n in where}
        if where:
            search = Search(Chart(self, list(index)), np.array(words), np.array(sizes), np.array([seeds[n] for n in where], np.uint64), k)
            for n, samples in zip(where, search.run()):
                drawn[n] = samples
        nothing = [(np.empty(0, np.int32), 0.0, 0.0)]
        return [(n, *sample) for n in range(len(texts)) for sample in drawn.get(n, nothing)]

    def decode(self, ids: list[int]) -> str:
        """The text behind the space that every text begins with."""
        parts = list(map(self.spelling.__getitem__, ids))
        return self.library.decode(ids) if None in parts else "".join(parts).removeprefix(" ")


class Trie:
    """Pieces by their characters: states and transitions in a hash table that numpy looks up in bulk."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        letters = sorted({c for p in pieces for c in p})
        self.classes = np.zeros(0x110000, np.int64)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        number, moves, ends = {c: i + 1 for i, c in enumerate(letters)}, {}, {}
        for text in pieces:
            state = 0
            for c in text:
                state = moves.setdefault(state * self.width + number[c], len(moves) + 1)
            ends[state] = text
        self.id = np.full(len(moves) + 1, -1, np.int64)
        self.weight = np.zeros(len(moves) + 1)
        for state, text in ends.items():
            self.id[state], self.weight[state] = pieces[text]
        self.mask = (1 << (len(moves) * 4).bit_length()) - 1
        self.keys, self.to = np.full(self.mask + 1, -1, np.int64), np.zeros(self.mask + 1, np.int64)
        for key, state in moves.items():
            slot = key * ROLL >> 32 & self.mask
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.to[slot] = key, state

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        key = state * self.width + letter
        slot = ((key.astype(np.uint64) * np.uint64(ROLL)) >> np.uint64(32)).astype(np.int64) & self.mask
        seen = self.keys[slot]
        out = np.where(seen == key, self.to[slot], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            seen = self.keys[slot[open_]]
            same = seen == key[open_]
            out[open_[same]] = self.to[slot[open_[same]]]
            open_ = open_[~same & (seen >= 0)]
        return out


class Chart:
    """Lattices of many distinct words in one set of arrays.

    Places of all words are numbered through. Edges are grouped by place, with their chance among the edges of the place given the
    masses of what follows; ``sums`` runs over all edges, so one search among sorted numbers draws an edge for each of many places.
    """

    def __init__(self, pieces: Pieces, words: list[str]):
        trie = pieces.trie
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) for w in words])
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        end, letters = np.repeat(self.stop, sizes), trie.classes[codes]
        at, state, width = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        source, target, ids, weights = [], [], [], []
        while len(at):
            state = trie.step(state, letters[at + width])
            at, state, width = at[state >= 0], state[state >= 0], width + 1
            hit = trie.id[state] >= 0
            source.append(at[hit])
            target.append(at[hit] + width)
            ids.append(trie.id[state[hit]])
            weights.append(trie.weight[state[hit]])
            more = at + width < end[at]
            at, state = at[more], state[more]
        # A character that is no piece is spelt in bytes; the ids of such an edge are listed beside the others.
        alone = np.ones(len(codes), bool)
        alone[source[0]] = False
        kinds, kind = np.unique(codes[alone], return_inverse=True)
        spelt = [[pieces.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds]
        self.spelt = np.array([i for x in spelt for i, _ in x], np.int64)
        self.spelt_sizes = np.array([len(x) for x in spelt], np.int64)
        self.spelt_stops = np.cumsum(self.spelt_sizes)
        source.append(np.flatnonzero(alone))
        target.append(source[-1] + 1)
        ids.append(-1 - kind)
        weights.append(np.array([sum(w for _, w in x) for x in spelt])[kind] if len(kinds) else np.empty(0))
        # Places by their distance to the word's end; edges of a place side by side, short pieces first.
        distance = end - np.arange(len(codes))
        places = np.argsort(distance.astype(np.uint16) if len(codes) and distance.max() < 1 << 16 else distance, kind="stable")
        degree = np.zeros(len(codes), np.int64)
        for x in source:
            degree[x] += 1  # a place has one edge of a width at most
        counts = degree[places]
        heads = np.cumsum(counts) - counts
        self.first, self.degree = np.empty(len(codes), np.int64), degree
        self.first[places] = heads
        free, total = self.first.copy(), int(counts.sum())
        self.source, self.to, self.ids, weight = (np.empty(total, t) for t in (np.int64, np.int64, np.int32, np.float64))
        for x, y, i, w in zip(source, target, ids, weights):
            slot = free[x]
            free[x] += 1
            self.source[slot], self.to[slot], self.ids[slot], weight[slot] = x, y, i, w
        del source, target, ids, weights, free
        # Masses from the ends backwards, all places of one distance at once.
        mass, last = np.zeros(len(codes) + 1), self.to == end[self.source]
        levels = np.flatnonzero(np.diff(distance[places], prepend=0, append=-1))
        for a, b in zip(levels[:-1].tolist(), levels[1:].tolist()):
            e, f = int(heads[a]), int(heads[b]) if b < len(heads) else total
            x, h, c = weight[e:f] + np.where(last[e:f], 0.0, mass[self.to[e:f]]), heads[a:b] - e, counts[a:b]
            top = np.maximum.reduceat(x, h)
            mass[places[a:b]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, c)), h))
        self.log = np.minimum(weight + np.where(last, 0.0, mass[self.to]) - mass[self.source], 0.0)
        self.log[heads[counts == 1]] = 0.0
        self.chance = np.exp(self.log)
        with np.errstate(divide="ignore"):
            self.others = np.where(self.log < 0, np.log(-np.expm1(self.log)), -np.inf)
        self.sums = np.cumsum(self.chance)
        self.before = np.empty(len(codes))
        self.before[places] = self.sums[heads] - self.chance[heads]

    def draw(self, places: np.ndarray, u: np.ndarray) -> np.ndarray:
        """One edge for every place; the longest piece is tried first, as it mostly is the likeliest."""
        first, goal = self.first[places], self.before[places] + u
        found = first + self.degree[places] - 1
        live = np.flatnonzero(found > first)
        while len(live):
            lower = found[live] - 1
            live = live[self.sums[lower] > goal[live]]
            found[live] -= 1
            live = live[found[live] > first[live]]
        return found

    def spell(self, edges: np.ndarray) -> np.ndarray:
        """Ids of edges in order; an edge of bytes has several."""
        ids = self.ids[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        kinds, sizes = -1 - ids[odd], np.ones(len(ids), np.int64)
        sizes[odd] = self.spelt_sizes[kinds]
        ends = np.cumsum(sizes)
        out = np.repeat(ids, sizes)
        many = sizes[odd]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(ends[odd] - many, many) + inner] = self.spelt[np.repeat(self.spelt_stops[kinds] - many, many) + inner]
        return out.astype(np.int32)


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Numbers within (0, 1), addressed by seed and counter."""
    with np.errstate(over="ignore"):
        return ((mix(seed + counter.astype(np.uint64) * np.uint64(ROLL)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Search:
    """Perturbed A-star search over the chains of many texts at once.

    A node is the set of all segmentations that begin with given edges and then take none of some excluded ones; it carries the
    largest perturbed value within. The best node of a text is opened: the segmentation that holds its value is drawn, edge by edge,
    from the lattice, and what is left of the node falls into one node per edge drawn, which leaves the segmentation at that edge.
    Given the largest value, the values of these are independent Gumbel values cut off at it. Each text keeps as many nodes as can
    still be opened, and one more for the threshold.
    """

    def __init__(self, chart: Chart, words: np.ndarray, sizes: np.ndarray, seeds: np.ndarray, k: int):
        self.chart, self.words, self.k = chart, words, k
        self.stop = np.cumsum(sizes)
        self.start = self.stop - sizes
        self.seeds = mix(seeds + np.uint64(1))
        lengths = chart.stop[words] - chart.start[words]
        ends = np.cumsum(lengths)
        # Place of a word's first character in its text, less its place in the chart: makes counters of random numbers.
        self.shift = ends - lengths - np.repeat((ends - lengths)[self.start], sizes) - chart.start[words]

    def walk(self, items: np.ndarray, places: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw edges of the items (places of ``words``) from the given places to their words' ends: edges by item, and their counts."""
        chart, ends, shift = self.chart, self.chart.stop[self.words[items]], self.shift[items]
        live, places = np.flatnonzero(places < ends), places.copy()
        rows, edges = [], []
        while len(live):
            at = places[live]
            found = chart.draw(at, uniform(seeds[live], shift[live] + at))
            rows.append(live)
            edges.append(found)
            places[live] = to = chart.to[found]
            live = live[to < ends[live]]
        counts = np.bincount(np.concatenate(rows), minlength=len(items)) if rows else np.zeros(len(items), np.int64)
        out, at = np.empty(int(counts.sum()), np.int64), np.cumsum(counts) - counts
        for n, (row, edge) in enumerate(zip(rows, edges)):
            out[at[row] + n] = edge
        return out, counts

    def run(self) -> list[list[tuple[np.ndarray, float, float]]]:
        """Per text: (ids, log-probability, log inclusion score) of its samples."""
        chart, n = self.chart, len(self.start)
        tops = -np.log(-np.log(uniform(self.seeds, np.full(n, -1))))
        # A node: value, edges kept, excluded edges, word of the text and place in the chart where it goes on.
        nodes = [[(top, EMPTY, (), 0, None)] for top in tops.tolist()]
        done: list[list] = [[] for _ in range(n)]
        for turn in range(self.k):
            rows = [r for r in range(n) if nodes[r]]
            if not rows:
                break
            opened = [nodes[r].pop(0) for r in rows]
            salts = mix(self.seeds + np.uint64((turn + 1) * MIX_STEP & (1 << 64) - 1))
            heads = []
            for r, (_, edges, barred, item, place) in zip(rows, opened):
                if place is None:
                    heads.append((edges, int(chart.start[self.words[self.start[r]]])))
                    continue
                first = int(chart.first[place])
                free = [e for e in range(first, first + int(chart.degree[place])) if e not in barred]
                chances = np.cumsum(chart.chance[free])
                u = float(uniform(salts[r:r + 1], np.array([-2]))[0]) * chances[-1]
                edge = free[min(int(np.searchsorted(chances, u, "right")), len(free) - 1)]
                heads.append((np.append(edges, edge), int(chart.to[edge])))
            of = np.array(rows)
            begin = self.start[of] + np.array([x[3] for x in opened])
            counts = self.stop[of] - begin
            offsets = np.cumsum(counts) - counts
            items = np.repeat(begin - offsets, counts) + np.arange(int(counts.sum()))
            places = chart.start[self.words[items]]
            places[offsets] = [x[1] for x in heads]
            fresh, sizes = self.walk(items, places, np.repeat(salts[of], counts))
            ends = np.cumsum(sizes)
            parts, lengths, b = [], [], 0
            for (edges, _), e in zip(heads, ends[offsets + counts - 1].tolist()):
                parts += [edges, fresh[b:e]]
                lengths.append(len(edges) + e - b)
                b = e
            path, lengths = np.concatenate(parts), np.array(lengths)
            at = np.cumsum(lengths) - lengths
            for r, a, size, total in zip(rows, at.tolist(), lengths.tolist(), np.add.reduceat(chart.log[path], at).tolist()):
                done[r].append((path[a:a + size], total))
            ahead = np.array([len(x[0]) for x in heads])
            for g, step, value in self.split(self.k - turn, opened, path, at, lengths, salts[of]):
                _, edges, barred, item, place = opened[g]
                again = place is not None and step == len(edges)
                if not again:  # the word that the step belongs to
                    drawn = int(ends[offsets[g] - 1]) if offsets[g] else 0
                    item += int(np.searchsorted(ends[offsets[g]:offsets[g] + counts[g]], drawn + step - ahead[g], "right"))
                p = int(at[g]) + step
                nodes[rows[g]].append((value, path[at[g]:p].copy(), (*(barred if again else ()), int(path[p])), item, int(chart.source[path[p]])))
            for r in rows:
                nodes[r].sort(key=lambda x: -x[0])
                del nodes[r][self.k - turn:]
        return [self.score(done[r], nodes[r]) for r in range(n)]

    def split(self, wanted: int, opened: list, path: np.ndarray, at: np.ndarray, sizes: np.ndarray, salts: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(group, step, value) of the best nodes, ``wanted`` a group, that opened nodes leave beside the segmentations drawn.

        A node's value is at most its mass and HIGHEST. Masses fall along a path, so only the first REACH steps are read, and
        more in groups whose nodes don't prove to be better than all that follow.
        """
        todo, reach = np.arange(len(sizes)), REACH
        while len(todo):
            take = np.minimum(sizes[todo], reach)
            values, group, step, mass = self.values([opened[g] for g in todo], path, at[todo], take, salts[todo])
            better = np.bincount(group, values > (mass + HIGHEST)[group], len(todo))
            enough = (take == sizes[todo]) | (better >= wanted)
            values[~enough[group]] = -np.inf
            for _ in range(wanted):
                top = np.maximum.reduceat(values, np.cumsum(take) - take)
                found = np.flatnonzero((values == top[group]) & (values > -np.inf))
                _, first = np.unique(group[found], return_index=True)
                found = found[first]
                yield from zip(todo[group[found]].tolist(), step[found].tolist(), values[found].tolist())
                values[found] = -np.inf
            todo, reach = todo[~enough], reach * 8

    def values(self, opened: list, path: np.ndarray, at: np.ndarray, reach: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Values of the nodes left at the first ``reach`` steps of each group, their groups and steps, and each group's log mass behind them."""
        chart, begin = self.chart, np.cumsum(reach) - reach
        group = np.repeat(np.arange(len(reach)), reach)
        step = np.arange(len(group)) - begin[group]
        edges = path[at[group] + step]
        logs = chart.log[edges]
        running = np.cumsum(logs) - logs
        before = np.minimum(running - running[begin][group], 0.0)
        masses = before + chart.others[edges]
        masses[step < np.array([len(x[1]) for x in opened])[group]] = -np.inf
        for g, (_, kept, barred, _, place) in enumerate(opened):
            if place is not None and len(kept) < reach[g]:  # the edge drawn joins the excluded ones of this node
                s, first = int(begin[g]) + len(kept), int(chart.first[place])
                left = sum(float(chart.chance[e]) for e in range(first, first + int(chart.degree[place])) if e not in barred and e != edges[s])
                masses[s] = before[s] + math.log(left) if left > 0 else -math.inf
        top = np.array([x[0] for x in opened])[group]
        noise = -np.log(uniform((salts ^ np.uint64(MIX_STEP))[group], step))
        return masses - np.log(np.exp(np.minimum(masses - top, 700.0)) + noise), group, step, np.add.reduceat(logs, begin)

    def score(self, samples: list, left: list) -> list[tuple[np.ndarray, float, float]]:
        """Inclusion scores over the largest value not handed out."""
        bar = left[0][0] if left else -math.inf
        out = []
        for path, log_prob in samples:
            x = min(log_prob - bar, 700.0)
            out.append((self.chart.spell(path), log_prob, x if x < -40 else math.log(-math.expm1(-math.exp(x)))))
        return out


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """This worker's vocabulary."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def seed_of(key: list) -> int:
    """Seed of a row from its key columns alone."""
    return zlib.crc32(repr(key).encode()) << 8 | len(key)


def sample_segmentations(rows: DataFrame, keys: list[str], text: str = "text", k: int = SAMPLES, path: str | None = None) -> DataFrame:
    """keys, sample (from 0), ids, log_prob, inclusion, log_inclusion, decoded for every row.

    A text has as many rows as distinct segmentations were drawn (fewer than ``k`` only if it has no more). A null or empty text
    has one empty segmentation. The inclusion score of a long text may be zero as a double; its logarithm is exact. The same key and text always give the same samples, so repeated rows agree; null keys are keys
    like others. Decoding restores the text, except that U+2581 stands for a space.
    """
    source = path or model_path()
    narrow = rows.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.col(text).alias("text"))
    kinds = dict(narrow.dtypes)
    names = [f"_key{i}" for i in range(len(keys))]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(source)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                values = [part.column(c).to_pylist() for c in names]
                seeds = [seed_of([v[i] for v in values]) for i in range(part.num_rows)]
                where, ids, log_probs, scores = zip(*vocabulary.draw_all([x or "" for x in part.column("text").to_pylist()], seeds, k))
                at = np.array(where)
                heads = np.flatnonzero(np.diff(at, prepend=-1))
                order = np.arange(len(at)) - np.repeat(heads, np.diff(heads, append=len(at)))
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(at)) for c in names), pa.array(order.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32))),
                     pa.array(log_probs, pa.float64()), pa.array(np.exp(scores)), pa.array(scores, pa.float64()),
                     pa.array([vocabulary.decode(x.tolist()) for x in ids], pa.string())],
                    [*names, "sample", "ids", "log_prob", "inclusion", "log_inclusion", "decoded"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", sample int, ids array<int>, log_prob double, inclusion double, log_inclusion double, decoded string"
    out = narrow.mapInArrow(draw, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keys)], "sample", "ids", "log_prob", "inclusion", "log_inclusion", "decoded")
