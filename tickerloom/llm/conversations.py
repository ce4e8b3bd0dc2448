"""Repair of conversation structure by a survivor-coalescence Viterbi search.

Roles of a repaired conversation read system (or nothing), then user and assistant in turn, or there is no turn at all. Edits
keep, rerole or delete a row and insert empty turns; the cheapest sequence wins, and of equally cheap ones that whose letters
(D, I, K, R) are least. States are what may come next; each has one survivor.

* Survivors form a tree of backpointers. A node is dropped when no survivor leads over it any more, and as soon as all of them
  share their first step, that step is emitted. Tied survivors are compared over their complete unresolved edits: as two of them
  that cover the same rows never are each other's beginnings, their order stays for good and is carried on as a rank.
* Rows are range-sorted by conversation and turn and cut into blocks of ``BLOCK`` rows. A conversation that crosses a border
  is searched block by block from each state it may enter with, all blocks at once; a second search of the same kind over the
  blocks' costs and ranks, a few numbers each, picks the ways. So a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Log2 of the rows searched at once.
BLOCK_BITS = 12
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)  # the turn before
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Turns inserted at the end, by state; one that ends legally has none.
ENDING = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")


def after_turn(state: int, initial: str) -> int | None:
    """State after one more turn, None if it may not stand here."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def next_turn(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(None)
def moves(initial: str, condemned: bool, truncated: bool) -> tuple[dict[int, tuple[int, str]], ...]:
    """Per state the states that one row may lead to, each with the least cost and letters (inserts stand before the row)."""
    out = []
    for start in STATES:
        found: dict[int, tuple[int, str]] = {}
        state = start
        for inserts in range(3):
            ways = [(state, DELETE, "D")]
            if not condemned:
                if (kept := after_turn(state, initial)) is not None:
                    ways.append((kept, KEEP + TRUNCATED * truncated, "K"))
                ways.append((next_turn(state), REROLE + TRUNCATED * truncated, "R"))
            for end, cost, letter in ways:
                way = (cost + INSERT * inserts, "I" * inserts + letter)
                found[end] = min(way, found.get(end, way))
            state = next_turn(state)
        out.append(found)
    return tuple(out)


Front = tuple[tuple[int, int] | None, ...]  # cost and rank of every state's survivor


def advance(front: Front, ways) -> tuple[Front, tuple]:
    """Survivors after one more row or block, and for each the state it came from and its edits.

    ``ways`` gives per state the reachable states with cost and edits (or anything that sorts like the edits of one state).
    Of equally cheap survivors the one of the lower rank stays.
    """
    back: list[tuple[int, object] | None] = [None] * len(front)
    best: dict[int, tuple[int, int]] = {}
    for start, survivor in enumerate(front):
        if survivor is not None:
            for end, (cost, edits) in ways[start].items():
                key = (survivor[0] + cost, survivor[1])
                if end not in best or key < best[end]:
                    best[end], back[end] = key, (start, edits)
    order = sorted(best, key=lambda j: (best[j][1], back[j][1]))
    rank = {j: r for r, j in enumerate(order)}
    return tuple((best[j][0], rank[j]) if j in best else None for j in STATES), tuple(back)


@lru_cache(100_000)
def advance_row(front: Front, initial: str, condemned: bool, truncated: bool) -> tuple[Front, tuple, int]:
    """``advance`` over a row, with costs from the least one up, which is returned; survivors that can never win are left out.

    An opening without turns is beaten by one that ends with an assistant and is more than a deletion cheaper, a lone system
    turn by any such that is cheaper. With them gone, fronts are few and this table of them stays small.
    """
    new, back = advance(front, moves(initial, condemned, truncated))
    least = min(s[0] for s in new if s)
    full = new[ASSISTANT]
    doomed = {NOTHING: full and new[NOTHING] and new[NOTHING][0] > full[0] + DELETE, SYSTEM: full and new[SYSTEM] and new[SYSTEM][0] > full[0]}
    new = tuple(None if s is None or doomed.get(j) else (s[0] - least, s[1]) for j, s in enumerate(new))
    return new, tuple(b if new[j] else None for j, b in enumerate(back)), least


class Node:
    """A step of a survivor; its references are the steps that follow it."""

    __slots__ = ("before", "edits", "heirs")

    def __init__(self, before: Node | None, edits):
        self.before, self.edits, self.heirs = before, edits, []


class Survivors:
    """Tree of backpointers; ``emitted`` holds the steps that all survivors share."""

    def __init__(self, start: int):
        self.root = Node(None, None)
        self.tips: list[Node | None] = [self.root if s == start else None for s in STATES]
        self.emitted: list = []

    def step(self, back: tuple) -> None:
        tips: list[Node | None] = [None] * len(back)
        for end, came in enumerate(back):
            if came is not None:
                tips[end] = Node(self.tips[came[0]], came[1])
                tips[end].before.heirs.append(tips[end])
        for node in self.tips:
            while node is not None and not node.heirs and node is not self.root:
                gone, node = node, node.before
                node.heirs.remove(gone)
        self.tips = tips
        while len(self.root.heirs) == 1:
            self.root = self.root.heirs[0]
            self.root.before = None
            self.emitted.append(self.root.edits)

    def open_steps(self, state: int) -> list:
        """The steps of a survivor that are not emitted yet."""
        out, node = [], self.tips[state]
        while node is not self.root:
            out.append(node.edits)
            node = node.before
        return out[::-1]

    def __len__(self) -> int:
        """Nodes held."""
        todo, n = [self.root], 0
        while todo:
            n += 1
            todo += todo.pop().heirs
        return n


def start_front(state: int) -> Front:
    return tuple((0, 0) if s == state else None for s in STATES)


def ending(front: Front) -> tuple[int, int]:
    """The state to end in and the whole cost with the turns inserted after the last row."""
    cost, _, state = min((s[0] + INSERT * ENDING[j], s[1], j) for j, s in enumerate(front) if s)
    return state, cost


def search(rows: list[tuple[str, bool, bool]], entry: int = NOTHING) -> tuple[Front, Survivors]:
    """Survivors after rows given as initial, must be deleted, truncated."""
    front, tree, base = start_front(entry), Survivors(entry), 0
    for initial, condemned, truncated in rows:
        front, back, least = advance_row(front, initial, condemned, truncated)
        base += least
        tree.step(back)
    return tuple(None if s is None else (s[0] + base, s[1]) for s in front), tree


def arrange(conversations: DataFrame) -> DataFrame:
    """All rows in order, written, with conv_id, turn, role, text and their number ``id``, which rises within a conversation.

    Null roles and texts become one space. Null turns come first; rows of one turn are ordered by role and then text, so
    repeated rows stand side by side. Rows of one conversation may lie in many files.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()), "conversation-rows")


def faults(rows: DataFrame) -> DataFrame:
    """id, conv_id, turn, initial (s, u, a or x) and fault of arranged rows: blank, duplicate, truncated or null, the first that holds.

    The first row of equal role and text is found by grouping, which combines before it shuffles, and joined by row number.
    """
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    letter = F.substring("role", 1, 1)
    light = rows.select("id", "conv_id", "turn", F.when(letter.isin("s", "u", "a"), letter).otherwise("x").alias("initial"), blank.alias("blank"),
                        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    firsts = rows.where(~blank).groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return light.join(firsts, "id", "left").select("id", "conv_id", "turn", "initial", fault.alias("fault"))


def _summary(part: list[tuple]) -> dict:
    turns = [t for _, t, _, _ in part if t is not None]
    kinds = [f for *_, f in part]
    return {
        "blank": kinds.count("blank"), "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"),
        "illegal": sum(a[2] + b[2] not in LEGAL for a, b in zip(part, part[1:])), "turns": len(set(turns)),
        "least": min(turns, default=None), "most": max(turns, default=None), "opens": part[0][2], "closes": part[-1][2],
    }


_SUMMARY = ("blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, opens string, closes string")
_WAYS = "array<struct<entry:int,exit:int,cost:long,rank:int,edits:string>>"


def search_blocks(light: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """One row per conversation and block of 2^bits rows, written: summary figures, and the edits.

    ``whole`` rows have all of their conversation, its cost, its edits and how many turns are inserted after them. Others have ``ways``, the best edits from every state
    they may be entered with to every state they may end in.
    """
    kind = light.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, id long, whole boolean, cost long, inserts int, edits string, ways {_WAYS}, {_SUMMARY}"

    def piece(conv, part: list[tuple], begins: bool, ends: bool) -> dict:
        row = {"conv_id": conv, "id": part[0][0], "whole": not begins and not ends, "cost": None, "inserts": None, "edits": None, "ways": None, **_summary(part)}
        given = [(initial, fault in ("blank", "duplicate"), fault == "truncated") for _, _, initial, fault in part]
        if row["whole"]:
            front, tree = search(given)
            state, row["cost"] = ending(front)
            row["edits"], row["inserts"] = "".join([*tree.emitted, *tree.open_steps(state)]), ENDING[state]
            return row
        row["ways"] = []
        for entry in STATES if begins else [NOTHING]:
            front, tree = search(given, entry)
            row["ways"] += [{"entry": entry, "exit": j, "cost": s[0], "rank": s[1], "edits": "".join([*tree.emitted, *tree.open_steps(j)])}
                            for j, s in enumerate(front) if s]
        return row

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, out = None, [], []

        def finished() -> Iterator[dict]:
            first = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i][0] != rows[first][0]:
                    yield piece(rows[first][0], [r[1:] for r in rows[first:i]], first == 0, i == len(rows))
                    first = i

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "id", "turn", "initial", "fault")]
            for r in zip(*columns):
                if r[1] >> bits != block:
                    out += finished()
                    block, rows = r[1] >> bits, []
                rows.append(r)
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out = []
        out += finished()
        yield pa.RecordBatch.from_pylist(out, arrow)

    arrow = _arrow(light, shape)
    spread = light.repartition(F.shiftright("id", bits)).sortWithinPartitions("id")
    return stored(spread.mapInArrow(pieces, shape), "conversation-pieces")


def _arrow(df: DataFrame, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


def stitch(pieces: DataFrame) -> DataFrame:
    """Conversations that lie in several blocks: a row per block with the way taken (``entry``, ``exit``), and one per
    conversation with its cost, the inserts at its end and its summary (``id`` null). Blocks stream by in order."""
    kind = pieces.schema["conv_id"].dataType.simpleString()
    shape = f"conv_id {kind}, id long, entry int, exit int, cost long, inserts int, {_SUMMARY}"
    narrow = pieces.where("not whole").select("conv_id", "id", F.transform("ways", lambda w: w.dropFields("edits")).alias("ways"),
                                              *[c.split()[0] for c in _SUMMARY.split(", ")])
    arrow = _arrow(pieces, shape)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, front, tree, total, out = None, None, None, None, []

        def decided(labels: list) -> None:
            out.extend({"conv_id": conv, "id": i, "entry": a, "exit": b} for i, a, b in labels)
            labels.clear()

        def close() -> None:
            if total is not None:
                state, cost = ending(front)
                decided(tree.emitted)
                decided(tree.open_steps(state))
                out.append({"conv_id": conv, "cost": cost, "inserts": ENDING[state], **total})

        for batch in batches:
            for r in batch.to_pylist():
                if total is None or r["conv_id"] != conv:
                    close()
                    conv, front, tree = r["conv_id"], start_front(NOTHING), Survivors(NOTHING)
                    total = {c: r[c] for c in ("least", "most", "opens", "closes", *_COUNTS)}
                else:
                    for c in _COUNTS:
                        total[c] += r[c]
                    total["turns"] -= total["most"] is not None and total["most"] == r["least"]
                    total["illegal"] += total["closes"] + r["opens"] not in LEGAL
                    total["least"] = r["least"] if total["least"] is None else total["least"]
                    total["most"] = total["most"] if r["most"] is None else r["most"]
                    total["closes"] = r["closes"]
                ways: list[dict] = [{} for _ in STATES]
                for w in r["ways"]:
                    ways[w["entry"]][w["exit"]] = (w["cost"], w["rank"])
                front, back = advance(front, ways)
                tree.step(tuple(b and (b[0], (r["id"], b[0], j)) for j, b in enumerate(back)))
                decided(tree.emitted)
            yield pa.RecordBatch.from_pylist(out, arrow)
            out = []
        close()
        yield pa.RecordBatch.from_pylist(out, arrow)

    return stored(narrow.repartition("conv_id").sortWithinPartitions("conv_id", "id").mapInArrow(walk, shape), "conversation-ways")


class Repair:
    """Repair of all conversations of a table ``conv_id, turn, role, text``; other columns are not read.

    ``totals`` has a row per conversation: cost, blank, duplicate, truncated, illegal and gaps. ``turns()`` gives the repaired
    conversations, ``digests()`` their audits. Null conversation ids are one conversation. An empty table gives empty results;
    empty texts are blank; see ``arrange`` for nulls, ties and repeated rows.
    """

    def __init__(self, conversations: DataFrame, bits: int = BLOCK_BITS):
        self.rows = arrange(conversations)
        pieces = search_blocks(faults(self.rows), bits)
        ways = stitch(pieces)
        whole = pieces.where("whole")
        gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
        figures = ["conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"]
        self.totals = whole.select(*figures).unionByName(ways.where("id is null").select(*figures))
        every = pieces.where("not whole").select("conv_id", "id", F.explode("ways").alias("w")).select(
            "conv_id", "id", F.col("w.entry").alias("entry"), F.col("w.exit").alias("exit"), F.col("w.edits").alias("edits"))
        taken = every.join(ways.where("id is not null").select("id", "entry", "exit"), ["id", "entry", "exit"]).select("conv_id", "id", "edits")
        ends = whole.select("conv_id", "inserts").unionByName(ways.select("conv_id", "inserts")).where("inserts > 0").select("conv_id", F.lit((1 << 63) - 1).alias("id"), F.expr("repeat('I', inserts)").alias("edits"))
        self.edits = whole.select("conv_id", "id", "edits").unionByName(taken).unionByName(ends)

    def _in_order(self) -> DataFrame:
        """Edits of a piece before its rows, each conversation in one partition, as its digest needs it; rows stream by."""
        text = self.rows.select("conv_id", "id", F.lit(1).alias("kind"), "role", "text", F.lit(None).cast("string").alias("edits"))
        edits = self.edits.select("conv_id", "id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("role"),
                                  F.lit(None).cast("string").alias("text"), "edits")
        return text.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "id", "kind")

    def turns(self) -> DataFrame:
        """Repaired turns: conv_id, place (from 0), role, text and the edit that made them (K, R or I)."""
        shape = f"conv_id {self.rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string, edit string"
        arrow = _arrow(self.rows, shape)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _followed(batches):
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, (conv, *turn))) for conv, edits, turns in batch for turn in turns], arrow)

        return self._in_order().mapInArrow(write, shape)

    def digests(self) -> DataFrame:
        """conv_id, audit (all edits) and repaired_sha256 (of ``role:text``, joined by line feeds)."""
        shape = f"conv_id {self.rows.schema['conv_id'].dataType.simpleString()}, audit string, repaired_sha256 string"
        arrow = _arrow(self.rows, shape)

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, audit, digest, out = None, None, None, []
            row = lambda: {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
            for batch in _followed(batches):
                for name, edits, turns in batch:
                    if audit is None or name != conv:
                        out += [row()] if audit is not None else []
                        conv, audit, digest = name, [], hashlib.sha256()
                    audit.append(edits)
                    for place, role, text, _ in turns:
                        digest.update((("\n" if place else "") + f"{role}:{text}").encode())
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
            yield pa.RecordBatch.from_pylist([row()] if audit is not None else [], arrow)

        return self._in_order().mapInArrow(write, shape)


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Per batch the rows as (conversation, edits of the row or piece, turns they leave), applying the edits as they come."""
    conv, state, place, todo = None, NOTHING, 0, iter(())
    began = False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if not began or r["conv_id"] != conv:
                began, conv, state, place, todo = True, r["conv_id"], NOTHING, 0, iter(())
            turns = []
            if r["kind"] == 0:
                letters = r["edits"]
                inner = len(letters.rstrip("I"))
                todo = iter(letters)
                if inner == 0:  # inserts after the last row
                    for _ in letters:
                        state = next_turn(state)
                        turns.append((place, ROLES[state], "", "I"))
                        place += 1
                out.append((conv, letters, turns))
                continue
            for edit in todo:
                if edit == "D":
                    break
                if edit == "I":
                    state = next_turn(state)
                    turns.append((place, ROLES[state], "", "I"))
                elif edit == "R":
                    state = next_turn(state)
                    turns.append((place, ROLES[state], r["text"], "R"))
                else:
                    state = after_turn(state, r["role"][:1])
                    turns.append((place, r["role"], r["text"], "K"))
                place += 1
                if edit != "I":
                    break
            out.append((conv, "", turns))
        yield out


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20 (nulls are one space): 0 drops the row, 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
