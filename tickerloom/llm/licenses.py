"""Licence scans by template-markup matching.

Templates (``license_templates``) are compiled into one token automaton: a state per word still to come, jumps over optional
regions, loops of bounded length for replaceable ones. Its deterministic form is built as texts need it. A text is accepted
where the mandatory wording stands word for word; the automaton starts only at word pairs that some template begins with, so
a text costs one hash per word and a walk per beginning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, strings, word_hashes
from .license_templates import PHRASES, TEMPLATES

#: Bytes that stand between words: all of ASCII but 0-9, a-z and (lower-cased) A-Z.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: States of the deterministic form that a worker keeps before it starts over.
CACHED_STATES = 20_000
FOUND = "array<struct<label:string,base:boolean,mandatory:int,first:long,last:long>>"
_MARK = re.compile(r"<<(.*?)>>", re.S)


def tokens(text: str) -> list[str]:
    """Words of a text, A-Z lower-cased."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def parse(markup: str) -> list:
    """Parts of a template: a word, ``("any", most)``, ``("oneof", [words, ...])`` or ``("optional", parts)``."""
    stack: list[list] = [[]]
    for i, piece in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            stack[-1] += tokens(piece)
        elif piece == "beginOptional":
            stack.append([])
        elif piece == "endOptional":
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif piece.startswith("var;most="):
            stack[-1].append(("any", int(piece.removeprefix("var;most="))))
        elif piece.startswith("oneof="):
            stack[-1].append(("oneof", [tokens(x) for x in piece.removeprefix("oneof=").split("|")]))
        else:
            raise ValueError(f"unknown mark <<{piece}>>")
    if len(stack) != 1:
        raise ValueError("an optional region is not closed")
    return stack[0]


def mandatory(parts: list) -> int:
    """Words that a text must have: plain words, and the shortest of each choice."""
    return sum(1 if isinstance(p, str) else min(map(len, p[1])) if p[0] == "oneof" else 0 for p in parts)


class Automaton:
    """Token automaton of many templates; ``find`` gives all places where one is accepted, each at its longest."""

    def __init__(self, templates: Sequence[list]):
        self.words: list[str] = [""]
        self.number: dict[str, int] = {}
        self.by_word: list[dict[int, set[int]]] = []
        self.by_any: list[set[int]] = []
        self.free: list[set[int]] = []
        self.ends: dict[int, int] = {}
        begin = self._state()
        for n, parts in enumerate(templates):
            at = self._state()
            self.free[begin].add(at)
            self.ends[self._chain(at, parts)] = n
        self.start = self._closed({begin})
        if self.by_any and any(self.by_any[s] for s in self.start):
            raise ValueError("a template may not begin with a replaceable region")
        self.clear()
        self.hashes, self.order = self._hashed()
        self.pairs = self._openings()

    def _state(self) -> int:
        self.by_word.append({})
        self.by_any.append(set())
        self.free.append(set())
        return len(self.free) - 1

    def _chain(self, at: int, parts: list) -> int:
        for part in parts:
            after = self._state()
            if isinstance(part, str):
                if part not in self.number:
                    self.number[part] = len(self.words)
                    self.words.append(part)
                self.by_word[at].setdefault(self.number[part], set()).add(after)
            elif part[0] == "any":
                step = at
                for _ in range(part[1]):
                    self.free[step].add(after)
                    far = self._state()
                    self.by_any[step].add(far)
                    step = far
                self.free[step].add(after)
            elif part[0] == "optional":
                self.free[at].add(after)
                self.free[self._chain(at, part[1])].add(after)
            else:
                for choice in part[1]:
                    self.free[self._chain(at, choice)].add(after)
            at = after
        return at

    def _closed(self, states: set[int]) -> tuple[int, ...]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return tuple(sorted(seen))

    def _hashed(self) -> tuple[np.ndarray, np.ndarray]:
        data = " ".join(self.words[1:]).encode()
        found = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), BREAKS)[0]
        order = np.argsort(found)
        return found[order], order + 1

    def clear(self) -> None:
        """Forget the deterministic states but the dead one (0) and the start (1)."""
        self.names: dict[tuple[int, ...], int] = {(): 0, self.start: 1}
        self.sets: list[tuple[int, ...]] = [(), self.start]
        self.moves: list[dict[int, int]] = [{}, {}]
        self.accepts: list[tuple[int, ...]] = [(), self._accepted(self.start)]

    def _accepted(self, states: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(sorted({self.ends[s] for s in states if s in self.ends}))

    def step(self, state: int, word: int) -> int:
        """The state after one more word (0: a word of no template)."""
        known = self.moves[state].get(word)
        if known is not None:
            return known
        reached: set[int] = set()
        for s in self.sets[state]:
            reached |= self.by_any[s] | self.by_word[s].get(word, set())
        name = self._closed(reached)
        if name not in self.names:
            self.names[name] = len(self.sets)
            self.sets.append(name)
            self.moves.append({})
            self.accepts.append(self._accepted(name))
        self.moves[state][word] = self.names[name]
        return self.names[name]

    def _openings(self) -> np.ndarray:
        """Which pairs of words some accepted text begins with; one-word templates are refused."""
        pairs = np.zeros((len(self.words), len(self.words)), bool)
        for first in range(1, len(self.words)):
            state = self.step(1, first)
            if self.accepts[state]:
                raise ValueError("a template needs two words at least")
            if state:
                pairs[first] = [self.step(state, second) > 0 for second in range(len(self.words))]
        return pairs

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of word hashes, 0 for words of no template."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], 0)

    def find(self, word: Sequence[int], first: int, end: int) -> dict[int, int]:
        """Of every template accepted from word ``first`` on (and before ``end``), the number of the word after its longest match."""
        if len(self.sets) > CACHED_STATES:
            self.clear()
        state, longest = 1, {}
        for i in range(first, end):
            state = self.step(state, word[i])
            if not state:
                break
            for template in self.accepts[state]:
                longest[template] = i + 1
        return longest


def standard() -> list[tuple[str, bool, list]]:
    """Label, whether it is a base phrase, and parts of every template."""
    return [(label, True, parse(phrase)) for phrase, label in PHRASES.items()] + [(label, False, parse(m)) for label, m in TEMPLATES]


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates: list[tuple[str, bool, list]] | None = None) -> DataFrame:
    """Columns ``keep`` of every row (all but the text by default), n_words, and ``found``, all places of licence wording.

    A place has label, base, mandatory (words the template demands), first and last (numbers of its first and last word, from
    0). Of one template and one beginning the longest match counts; beginnings may overlap. Null and empty texts have no words
    and an empty list; repeated rows are scanned one by one; an empty table gives an empty result; a column called n_words or
    found is replaced.
    """
    chosen = templates or standard()
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "found") and (keep is not None or c != text)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).alias("_")]).alias("kept"), F.col(f"`{text}`").alias("text"))
    facts = [(label, base, mandatory(parts)) for label, base, parts in chosen]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([parts for _, _, parts in chosen])
        spelled = [w.encode() for w in automaton.words]
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("mandatory", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = strings(part.column("text"))
                hashes, first, last, counts = word_hashes(data, bounds, BREAKS)
                ids, ends = automaton.ids(hashes), np.cumsum(counts)
                owner = np.repeat(np.arange(len(counts)), counts)
                seeds = np.flatnonzero(automaton.pairs[ids[:-1], ids[1:]] & (owner[:-1] == owner[1:])) if len(ids) > 1 else ids[:0]
                out: list[list[dict]] = [[] for _ in counts]
                word = ids.tolist() if len(seeds) else []
                for s in seeds.tolist():
                    row = int(owner[s])
                    begin = int(ends[row] - counts[row])
                    for n, end in automaton.find(word, s, int(ends[row])).items():
                        same = all(not word[i] or data[first[i] : last[i]].tobytes().lower() == spelled[word[i]] for i in range(s, end))
                        if same:  # equal hashes of unequal words would end here
                            label, base, words = facts[n]
                            out[row].append({"label": label, "base": base, "mandatory": words, "first": s - begin, "last": end - begin - 1})
                yield pa.RecordBatch.from_arrays([part.column("kept"), pa.array(counts.astype(np.int64)), pa.array(out, kind)], ["kept", "n_words", "found"])

    shape = f"kept {rows.schema['kept'].dataType.simpleString()}, n_words long, found {FOUND}"
    done = rows.mapInArrow(places, shape)
    return done.select(*([F.col(f"kept.`{c}`").alias(c) for c in names]), "n_words", "found")


def labels(found: Column, base: bool | None = None) -> Column:
    """Distinct labels of the places (of base phrases alone, if asked), sorted and joined by commas."""
    chosen = found if base is None else F.filter(found, lambda x: x["base"] == base)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(chosen, lambda x: x["label"]))), ",")


def score(found: Column) -> Column:
    """How sure the scan is, 0 to 1: m / (m + 2) for the place whose template demands most words, m; 0 without a place."""
    m = F.array_max(F.transform(found, lambda x: x["mandatory"])).cast("double")
    return F.coalesce(m / (m + 2), F.lit(0.0))


def pattern(parts: list) -> str:
    """The template as a regular expression over words that are each followed by one space."""
    out = ""
    for p in parts:
        if isinstance(p, str):
            out += p + " "
        elif p[0] == "any":
            out += f"(?:[^ ]+ ){{0,{p[1]}}}"
        elif p[0] == "optional":
            out += f"(?:{pattern(p[1])})?"
        else:
            out += "(?:" + "|".join(pattern(c) for c in p[1]) + ")"
    return out
