"""Conversation repair, licence scans and whitening against plain loops, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import TEXTS
from tickerloom.llm import conversations, licenses, whitening
from tickerloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


# conversation repair


def damage_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv, turn))
        role, text, fault = role if role is not None else " ", text if text is not None else " ", zlib.crc32(name.encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def loop_repair(turns):
    """Digest of one conversation's rows in order: best (cost, whole edits) per structure state, over whole strings."""
    seen, faults = set(), []
    for _, role, text in turns:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else None)
        seen.add((role, text))
    following = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "", [])}

    def better(pool, state, cost, edits, made):
        if state is not None and (state not in pool or (cost, edits) < pool[state][:2]):
            pool[state] = (cost, edits, made)

    def insert(pool):
        for _ in range(3):
            for state, (cost, edits, made) in list(pool.items()):
                for new, role in (("u", "user"), ("a", "assistant")):
                    better(pool, following.get((state, new)), cost + 2, edits + "I", [*made, (role, "")])

    # inserts and the row's own edit are tried together, so that equal costs are told apart by whole strings
    for (_, role, text), fault in zip(turns, faults):
        after, pending = {}, [(state, *v) for state, v in best.items()]
        for _ in range(3):
            grown = []
            for state, cost, edits, made in pending:
                late = fault == "truncated"
                better(after, state, cost + 3, edits + "D", made)
                if fault not in ("blank", "duplicate"):
                    better(after, following.get((state, role[:1])), cost + late, edits + "K", [*made, (role, text)])
                    for new, name in (("u", "user"), ("a", "assistant")):
                        better(after, following.get((state, new)), cost + 2 + late, edits + "R", [*made, (name, text)])
                for new, name in (("u", "user"), ("a", "assistant")):
                    if (state, new) in following:
                        grown.append((new, cost + 2, edits + "I", [*made, (name, "")]))
            pending = grown
        best = after
    final = []
    for state, (cost, edits, made) in best.items():
        pool = {state: (cost, edits, made)}
        insert(pool)
        final += [v for s, v in pool.items() if s in ("", "a")]
    cost, edits, made = min(final, key=lambda v: v[:2])
    kept = sorted({t for t, _, _ in turns if t is not None})
    initials = [role[:1] if role[:1] in ("s", "u", "a") else "x" for _, role, _ in turns]
    count = Counter(faults)
    return (kept[-1] - kept[0] + 1 - len(kept) if kept else 0, count["blank"], count["duplicate"], count["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def loop_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        out[conv] = loop_repair(turns)
    return out


def random_turns(seed, conversations_, most):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", "Ünder"]
    texts = ["Yes.", "No!", "open", "", " \t", "é?  ", "a\nb.", "x:y", "same."]
    rows = []
    for conv in conversations_:
        for turn in range(rnd.randint(1, most)):
            rows.append((conv, turn + rnd.choice((0, 0, 0, 1)), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.5 else f"{rnd.choice(texts)}{turn}."))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_repairs_equal_the_loop(spark, bits):
    rows = random_turns(bits, [*range(60), None], 14)
    rows += [(100, t, "tool", f"t{t}.") for t in range(200)] + [(101, t, "user", f"t{t}.") for t in range(101)] + [(102, t, "user", "") for t in range(50)]
    rows += [(103, None, "user", "a."), (103, None, None, None), (103, 2, "system", "z"), (103, 2, "system", "z"), (104, 0, "user", "x. " * 60_000)]
    given = spark.createDataFrame([(*r, 7, "k") for r in rows], TURNS + ", id long, edits string").repartition(5)
    repair = conversations.Repair(given, bits)
    clean = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]
    want = loop_digests(clean)
    totals = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) for r in repair.totals.collect()}
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in repair.digests().collect()}
    assert {c: (*totals[c], *digests[c]) for c in want} == want and len(totals) == len(digests) == len(want)
    told = {}
    for r in sorted(repair.turns().collect(), key=lambda r: r.place):
        told.setdefault(r.conv_id, []).append(r)
    for conv, turns in told.items():
        assert [r.place for r in turns] == list(range(len(turns)))
        assert re.fullmatch("s?(ua)+", "".join(r.role[:1] for r in turns))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == digests[conv][1]
    assert all(not re.sub("D", "", digests[c][0]) for c in set(want) - set(told))


def test_repair_query_equals_the_loop(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = loop_digests(damage_rows(given))
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
           for r in QUERIES["op11_conversation_repair"](spark, FOLDER).collect()}
    assert got == {c: want.get(c, nothing) for c in {r[0] for r in given}}


def test_no_conversations(spark):
    none = spark.createDataFrame([], TURNS)
    repair = conversations.Repair(conversations.damaged(none))
    assert repair.totals.count() == repair.digests().count() == repair.turns().count() == 0


def test_survivors_are_dropped_and_emitted():
    rnd = random.Random(5)
    front, tree, held = conversations.start_front(conversations.NOTHING), conversations.Survivors(conversations.NOTHING), 0
    for _ in range(5000):
        front, back, _ = conversations.advance_row(front, rnd.choice("uuaas"), rnd.random() < 0.1, rnd.random() < 0.1)
        tree.step(back)
        held = max(held, len(tree))
    assert held < 150 and len(tree.emitted) > 4900  # without emission it would hold thousands
    assert conversations.advance_row.cache_info().currsize < 1000


# licence scans


def loop_scan(text, templates):
    words = licenses.tokens(text or "")

    def ends(parts, at):
        if not parts:
            return {at}
        first, rest = parts[0], parts[1:]
        if isinstance(first, str):
            return ends(rest, at + 1) if at < len(words) and words[at] == first else set()
        if first[0] == "any":
            return set().union(*(ends(rest, at + k) for k in range(min(first[1], len(words) - at) + 1)))
        if first[0] == "optional":
            return ends(rest, at).union(*(ends(rest, e) for e in ends(first[1], at)))
        return set().union(*(ends(rest, e) for c in first[1] for e in ends(c, at)))

    found = Counter()
    for label, base, parts in templates:
        for i in range(len(words)):
            if hit := ends(parts, i):
                found[(label, base, licenses.mandatory(parts), i, max(hit) - 1)] += 1
    return len(words), found


MARKED = [("ab", True, licenses.parse("a b")), ("opt", False, licenses.parse("a <<beginOptional>>x <<oneof=y|z z>><<endOptional>> b <<var;most=3>> c")),
          ("deep", False, licenses.parse("<<oneof=p|p q>> <<beginOptional>>r <<beginOptional>>s<<endOptional>><<endOptional>> t"))]


def test_scan_equals_the_loop(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice("abcxyzpqrst") for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, "", "A-B\x00c", "a b " * 500]
    frame = spark.createDataFrame([(i % 150, t, "f", i) for i, t in enumerate(texts)], "doc_id long, text string, found string, n_words int")
    got = [(r.doc_id, r.n_words, Counter(map(tuple, r.found))) for r in licenses.scan(frame, templates=MARKED).collect()]
    want = [(i % 150, *loop_scan(t, MARKED)) for i, t in enumerate(texts)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_whole_licence_texts_are_known(spark, odd, empty):
    fill = lambda m: re.sub("<<oneof=([^|>]*)[^>]*>>", r"\1", re.sub("<<(begin|end)Optional>>|<<var;most=[0-9]+>>", " ", m))
    plain = {label: fill(m) for label, m in licenses.TEMPLATES}
    frame = spark.createDataFrame([(k, f"Intro. {t} More.") for k, t in plain.items()], "label string, text string")
    for r in licenses.scan(frame).select("label", licenses.labels("found").alias("labels"), licenses.score("found").alias("score")).collect():
        assert r.label in r.labels.split(",") and 0 < r.score < 1, r
    broken = [(k, t.replace("software", "firmware").replace("Software", "Firmware")) for k, t in plain.items() if "oftware" in t]
    frame = spark.createDataFrame(broken, "label string, text string")
    assert all(r.label not in r.labels.split(",") for r in licenses.scan(frame).select("label", licenses.labels("found").alias("labels")).collect())
    got = licenses.scan(odd, keep=["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((i, len(licenses.tokens(t or ""))) for i, t in TEXTS)
    assert licenses.scan(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.Automaton([licenses.parse("<<var;most=2>> a b")])


# whitening


def plain_whitening(vectors, count):
    x = [[math.floor(64 * float(v)) + 1_000_000 for v in row] for row in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    whole = [[n * a - b for a, b in zip(row, s)] for row in x]
    z = np.array(whole, float) / n
    e, v = np.linalg.eigh(z.T @ z / n)
    e, v = np.maximum(e[::-1], 0), v[:, ::-1]
    return [sum(a * a for a in row) for row in whole], z @ v[:, :count] / np.sqrt(np.maximum(e[:count], 1e-300)), e


@pytest.mark.parametrize("dims,rows", [(64, 500), (40, 3000), (5, 200)])
def test_whitening_equals_eigenvectors(spark, dims, rows):
    rng = np.random.default_rng(dims)
    made = rng.standard_normal((rows, dims)) * np.geomspace(1, 0.2, dims)
    data = [(i, [float(v) for v in row], i, "n") for i, row in enumerate(made)] + [(7, [float(v) for v in made[7]], 0, "n")] * 40
    bad = [(900, None, 1, "x"), (901, [None] * dims, 1, "x"), (902, [math.nan] * dims, 1, "x"), (903, [math.inf] * dims, 1, "x"), (904, [0.1], 1, "x"),
           (905, [], 1, "x"), (906, [1e300] * dims, 1, "x")]
    frame = spark.createDataFrame(data + bad, "vec_id long, embedding array<double>, n long, whitened string").repartition(40)
    got = whitening.whiten(frame).toPandas()
    k = min(32, dims)
    deviation, w, e = plain_whitening([r[1] for r in data], k)
    assert len(got) == len(data) * k and set(got.vec_id) == {r[0] for r in data}
    table = got.pivot_table(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.abs(np.abs(table) - np.abs(w[:rows])).max() < 1e-7
    assert dict(zip(got.vec_id, got.deviation)) == {r[0]: d for r, d in zip(data, deviation)}
    share = got.drop_duplicates("component").sort_values("component").explained.to_numpy()
    assert np.abs(share / (e[:k] / e.sum()) - 1).max() < 1e-9 and got.identity_error.max() < 1e-9


def test_whitening_of_constant_and_single_vectors(spark):
    same = spark.createDataFrame([(i, [0.5, i / 8, i / 8]) for i in range(9)] + [(None, [0.5, 0.0, 0.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(same).collect()
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)} and got[0].identity_error < 1e-9 and len(got) == 30
    one = whitening.whiten(same.limit(1)).collect()
    assert len(one) == 3 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in one)
    assert whitening.whiten(same.where("false")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    huge = spark.createDataFrame([(i, [float(i) * 2.0**45, float(i % 3)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert all(r.deviation is None or r.deviation >= 0 for r in whitening.whiten(huge).collect())


@pytest.mark.parametrize("kind", ["spread", "equal", "graded", "lacking"])
def test_singular_values_and_vectors(kind):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((80, 24))
    a = np.linalg.qr(a)[0] if kind == "equal" else a * np.logspace(0, -12, 24) if kind == "graded" else a
    if kind == "lacking":
        a[:, 20:] = a[:, :4]
    values, vectors = whitening.components(np.linalg.qr(a, mode="r"), 20)
    want = np.linalg.svd(a, compute_uv=False) ** 2
    assert np.abs(values - want)[:20].max() <= 1e-13 * want[0]
    assert np.abs(vectors.T @ vectors - np.eye(20)).max() < 1e-12
    assert np.abs(a.T @ (a @ vectors) - vectors * values[:20]).max() < 1e-13 * want[0]
    if kind == "graded":  # small values too are right to many digits
        assert np.abs(values / want - 1)[:20].max() < 1e-6
