"""Document operators against plain loops, on rows with nulls, empty, long and repeated texts, and on empty tables."""

import bisect
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import LONG, TEXTS
from tickerloom.llm import langid, lm, near_dup, packing, quality, subword, token_codec, tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    data = (text or "").encode()
    return WORD.findall(data.lower() if lower else data)  # bytes.lower() changes A-Z alone


def figures(text):
    w = [x.decode() for x in words(text, lower=False)]
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside))


def test_quality_figures_equal_the_loop(odd):
    got = quality.judge(odd, keep=["doc_id"]).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(figures(t) for _, t in TEXTS)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_thresholds_follow_their_group(spark):
    clean = [(i, " ".join(f"w{i}x{j}" for j in range(40)), "en", "a") for i in range(100)]
    noisy = [(i + 100, " ".join(f"w{i}x{j}" + "#" * (j % 2) for j in range(40)), "en", "b") for i in range(100)]
    odd_one = [(500, noisy[0][1], "en", "a")]
    rows = spark.createDataFrame(clean + noisy + odd_one, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(rows).collect()}
    assert all(kept[i] for i in range(200)) and not kept[500]


def shingles(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def loop_components(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        names[r] = min((x for x in (names.get(r), key) if x is not None), default=None)
    return [(key, len(s), names[find(i)], key == names[find(i)] if names[find(i)] is not None else True) for i, ((key, _), s) in enumerate(zip(rows, sets))]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_equal_the_loop(odd, size):
    got = near_dup.near_duplicates(odd, size=size).collect()
    want = [(k, n, c, bool(kept)) for k, n, c, kept in loop_components(TEXTS, size)]
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter(want)
    assert sum(r["first"] for r in got) == len({r.component_id if r.component_id is not None else ("alone", r.row) for r in got})


def test_chain_and_crowd_of_near_copies(spark):
    rng = np.random.default_rng(3)
    base = [f"t{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 80, int(rng.integers(0, 7))):
            w[at] = f"r{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(10)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4).collect()
    want = {k: c for k, _, c, _ in loop_components(rows, 4)}
    assert {r.doc_id: r.component_id for r in got} == want


def test_likelihood_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.85, 0.95):
        n = 400
        common = int(round(n * 2 * share / (1 + share)))
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        b[:common] = a[:common]
        regs = near_dup.registers(np.concatenate([np.unique(a), np.unique(b)]), np.array([len(np.unique(a)), len(np.unique(b))]))
        assert near_dup.plausible(regs[:1], regs[1:], np.array([n]), np.array([n]))[0]
        merged = near_dup.registers(np.unique(np.concatenate([a, b])), np.array([len(np.unique(np.concatenate([a, b])))]))
        assert (merged[0] == regs.max(axis=0)).all()  # sketches of a union are the maxima


def library_ids(text):
    return tokens.encoder(tokens.vocabulary_path()).library.encode(text or "", add_special_tokens=False).ids + [0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files_hold_every_document(odd):
    got = token_codec.read_tokens(token_codec.write_tokens(odd)).orderBy("start").collect()
    want, start = [], 0
    for key, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_ids(text)
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert [tuple(r) for r in got] == want


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(5)
    for sizes in ([1], [4096, 4096, 700, 3, 1], [300] * 9):
        blocks = [(rng.zipf(1.2, n) % 65536).astype(np.int64) for n in sizes]
        parts = token_codec.encode_blocks(blocks)
        for a, b in zip(token_codec.decode_blocks(parts, np.array(sizes)), blocks):
            assert (a == b).all()
    same = [np.zeros(4096, np.int64)]
    assert len(token_codec.encode_blocks(same)[0]) < 400  # repeated ids cost next to nothing
    import io

    import pyarrow as pa

    sink = io.BytesIO()
    token_codec._write_group(sink, 0, pa.array([7, None]), np.array([3, 2]), np.array([5, 6, 0, 9, 0]))
    data = sink.getvalue()
    assert token_codec.read_group(data)[0] == [7, None]
    for at in (len(data) - 9, token_codec.GROUP.size + 8):
        with pytest.raises(ValueError):
            token_codec.read_group(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


def test_packing_places_every_piece(odd):
    from tickerloom.llm.common import stored

    got = packing.pack(stored(packing.pieces(odd), "test-pieces")).collect()
    want = Counter()
    for key, text in TEXTS:
        ids = library_ids(text)
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(key, n, a, b - a, crc(ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    rows = {}
    for r in got:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in rows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(rows) == -(-sum(r.length for r in got) // 2048)


def test_sweep_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes = Counter((rng.integers(1, 60, 300)).tolist())
    gaps = Counter((rng.integers(1, 100, 150)).tolist())
    links = packing.sweep(dict(sizes), dict(gaps))
    used, filled = Counter(), Counter()
    for size, first, gap, at, n, inside in links:
        for k in range(n):
            used[(size, first + k)] += 1
            assert filled[(gap, at + k)] == inside
            filled[(gap, at + k)] += size
            assert filled[(gap, at + k)] <= gap
    assert max(used.values()) == 1
    left = Counter(sizes)
    for size, _ in used:
        left[size] -= 1
    open_gaps = [g - filled.get((g, k), 0) for g, n in gaps.items() for k in range(n)]
    loose = [s for s, n in left.items() for _ in range(n)]
    assert not loose or max(open_gaps) < min(loose)


def test_language_model_counts_and_normalises(odd):
    got = lm.score_texts(odd).collect()
    rows = [(k, [*words(t), "END"]) for k, t in TEXTS]
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, ws in rows if not held(k) for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = Counter()
    for k, ws in rows:
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws)
        want[(k, held(k), len(ws), sum(count[w] > 0 for w in ws), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    model = lm.LogBilinear(np.arange(1, lm.CLASSES + 1) / (lm.CLASSES * (lm.CLASSES + 1) / 2))
    rng = np.random.default_rng(0)
    model.fit(rng.integers(0, lm.CLASSES, (5000, 3)), rng.integers(1, 9, 5000), {}, rng)
    assert np.allclose((10.0 ** model.table().astype(float)).sum(axis=2), 1, atol=1e-4)


def test_language_model_has_its_full_size():
    model = lm.LogBilinear(np.full(lm.CLASSES, 1 / lm.CLASSES))
    assert model.vector().size == lm.CLASSES * (24 + 24 + 1) + 2 * 24  # context and target vectors, biases, places
    rng, drawn = np.random.default_rng(0), []

    class Watched:
        permutation = rng.permutation

        def random(self, shape):
            drawn.append(shape)
            return rng.random(shape)

    model.fit(rng.integers(0, lm.CLASSES, (5000, 3)), np.ones(5000), {}, Watched())
    assert drawn == [(4096, 8), (904, 8)]


def test_language_model_beats_its_base_on_held_out_texts(spark):
    got = lm.score_texts(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_words_of_blocks_travel_packed_and_once(spark):
    """Blocks' words meet their training counts over all blocks in ranges of hashes, each word of a block in one packed cell."""
    from pyspark.sql import functions as F
    from tickerloom.llm.common import stored

    texts = [(i, " ".join(f"w{i * i * j % (97 + i)} {chr(97 + j % 26)}{i}" for j in range(400)) if i % 5 else None) for i in range(40)]
    made = stored(lm.blocks(spark.createDataFrame(texts, "doc_id long, text string").repartition(5, "doc_id")), "blocks")
    rows = {r.block: r for r in made.collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 7 == 2
    count = Counter(w for k, t in texts for w in (t or "").split() if not held(k))
    n_tokens, n_words = sum(len((t or "").split()) for _, t in texts), sum(len(lm._unpack(r.counts, "<u4")) for r in rows.values())
    assert len(rows) > 1 and sum(len(r.codes) for r in rows.values()) < 2.5 * n_tokens and sum(len(r.hashes) for r in rows.values()) < 8 * n_words
    counted = lm.count_words(made)
    totals = Counter()
    for r in counted.where("block IS NOT NULL").orderBy("block", "range").collect():
        totals[r.block] += len(lm._unpack(r.totals, "<i8"))
    assert totals == {b: len(lm._unpack(r.hashes, "<u8")) for b, r in rows.items() if len(lm._unpack(r.hashes, "<u8"))}
    ranges = counted.where("block IS NULL")
    assert ranges.agg(F.sum("distinct")).first()[0] == len(count)
    assert sum(sum(r.mass) for r in ranges.collect()) == sum(count.values()) and sum(sum(r.kinds) for r in ranges.collect()) == len(count)
    top = sorted((w["c"] for r in ranges.collect() for w in r.top), reverse=True)[: lm.HEAD]
    assert top == sorted(count.values(), reverse=True)[: lm.HEAD]
    plan = lm.score_texts(spark.createDataFrame(texts, "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashes" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    for values in (np.arange(0), np.array([5]), np.array([-2**63, -7, 0, 2**63 - 1])):
        assert (lm._unpack_sorted(lm._pack_sorted(values)) == values).all() and (lm._unpack(lm._pack(values), "<i8") == values).all()


def test_sampled_segmentations(odd):
    got = subword.sample_segmentations(odd, ["doc_id", "seq"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.seq, []).append(r)
    for n, (_, text) in enumerate(TEXTS):
        rows = by[n]
        assert len({tuple(r.ids) for r in rows}) == len(rows) and (len(rows) == 3 if len((text or '').split()) > 1 else 1 <= len(rows) <= 3)
        for r in rows:
            assert r.decoded == (text or "").replace("▁", " ") and 0 <= r.inclusion <= 1 and r.log_prob <= 1e-6
            assert -math.inf < r.log_inclusion <= 1e-9  # a long text's score is too small for a double, its logarithm is not
    again = subword.sample_segmentations(odd.repartition(3), ["doc_id", "seq"]).collect()
    assert Counter((r.seq, r["sample"], tuple(r.ids)) for r in again) == Counter((r.seq, r["sample"], tuple(r.ids)) for r in got)


def test_documents_and_turns_are_segmented(spark):
    from tickerloom.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = QUERIES["op6_sampled_pieces"](spark, folder).where("sample = 0").select("doc_id", "conv_id", "turn", "decoded").collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "text").collect()
    want = Counter((r.doc_id, None, None, (r.text or "").replace("▁", " ")) for r in docs)
    want.update((None, r.conv_id, r.turn, (r.text or "").replace("▁", " ")) for r in turns)
    assert Counter(map(tuple, got)) == want
    p = subword.pieces(subword.model_path())
    assert all(-math.inf < x < -745 for _, _, x in p.draw(LONG, 1))  # too small for a double


def test_samples_follow_the_lattice():
    p = subword.pieces(subword.model_path())
    edges, mass = p.lattice("the cat")
    ways = []

    def go(at, weight, ids):
        if at == len(edges):
            ways.append((tuple(ids), math.exp(weight - mass[0])))
            return
        for to, w, more in edges[at]:
            go(to, weight + w, [*ids, *more])

    go(0, 0.0, [])
    assert abs(sum(x for _, x in ways) - 1) < 1e-9
    first, estimate, runs = Counter(), Counter(), 4000
    for seed in range(runs):
        drawn = p.sample("the cat", seed * 7919 + 3, 3)
        first[tuple(drawn[0][0])] += 1
        for ids, _, inclusion in drawn:
            estimate[tuple(ids)] += 1 / inclusion
    for ids, chance in ways:
        if chance > 0.01:
            assert abs(first[ids] / runs - chance) < 0.04
            assert abs(estimate[ids] / runs - 1) < 0.25  # inclusion scores make unbiased weights
    assert len(p.sample("a", 1, 50)) == len({tuple(x[0]) for x in p.sample("a", 1, 50)}) <= 50


def test_language_fusion_equals_the_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = [(1, "the and of", "fr", None, "h1", "d"), (2, "", "de", None, "h1", "d"), (3, None, None, None, None, None), (4, LONG, None, "de", "h2", "d"),
            (5, "le la de que les", "xx", "fr", "h1", "d"), (5, "le la de que les", "xx", "fr", "h1", "d"), (6, "1234 567", None, None, "h3", None)]
    ev = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string")
    got = {r.key: r for r in langid.identify(ev, model).collect()}
    names = model.languages

    def told(name, trust):
        return [math.log(trust if x == name else (1 - trust) / (len(names) - 1)) if name in names else 0.0 for x in names]

    own = []
    for _, text, declared, suffix, host, domain in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        mean, n = model.score(data, np.array([0, len(data)]))
        own.append((np.array(told(declared, langid.DECLARED)) + told(suffix, langid.SUFFIX) + mean[0] * min(n[0], langid.WEIGHT), bool(re.search("[a-z]", text or ""))))
    first = [names[int(np.argmax(o))] for o, _ in own]
    live = [(first[i], rows[i][4], rows[i][5]) for i in range(len(rows)) if own[i][1]]
    corpus = np.array([(sum(f == x for f, _, _ in live) + 1) / (len(live) + len(names)) for x in names])

    def level(members, wider):
        return np.array([(sum(f == x for f in members) + langid.PULL * w) / (len(members) + langid.PULL) for x, w in zip(names, wider)])

    for i, (key, _, _, _, host, domain) in enumerate(rows):
        hosted = [f for f, h, d in live if h == host and d == domain]
        prior = corpus if host is None or not hosted else level(hosted, level([f for f, _, d in live if d == domain], corpus))
        total = own[i][0] + np.log(prior)
        post = np.exp(total - total.max())
        assert abs(got[key].confidence - post.max() / post.sum()) < 1e-9
        assert got[key].lang == (names[int(np.argmax(total))] if own[i][1] else None)
    assert not got[2].kept and not got[3].kept and not got[6].kept and got[5].kept


def test_language_of_documents_without_declarations(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    none = F.lit(None).cast("string")
    model = langid.train(docs.where("doc_id % 2 = 0"))
    ev = docs.where("doc_id % 2 = 1 and n_chars > 60").select(F.col("doc_id").alias("key"), "text", none.alias("declared"), none.alias("suffix"), none.alias("host"),
                                                              none.alias("domain"), "lang")
    got = langid.identify(ev.withColumnRenamed("lang", "truth"), model, ["truth"]).collect()
    assert sum(r.lang == r.truth for r in got) >= 0.95 * len(got)


def test_every_labelled_language_is_learned(spark):
    names = [f"l{n:02d}" for n in range(70)]
    words = {x: " ".join(chr(97 + n // 9) + chr(97 + n % 9) + chr(110 + k) for k in range(12)) for n, x in enumerate(names)}
    docs = spark.createDataFrame([(100 * n + k, words[x], x) for n, x in enumerate(names) for k in range(3)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == names
    rows = [(n, words[x], x if n % 2 else None, None, None, None) for n, x in enumerate(names)]
    ev = spark.createDataFrame(rows, "key long, text string, declared string, suffix string, host string, domain string")
    got = {r.key: r for r in langid.identify(ev, model).collect()}
    assert all(got[n].lang == got[n].text_lang == x and got[n].kept for n, x in enumerate(names))


def test_empty_tables(empty):
    from tickerloom.llm.common import stored

    assert quality.judge(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert token_codec.read_tokens(token_codec.write_tokens(empty)).count() == 0
    assert packing.pack(stored(packing.pieces(empty), "none")).count() == 0
    assert lm.score_texts(empty).count() == 0
    assert subword.sample_segmentations(empty, ["doc_id"]).count() == 0
    assert langid.keep_documents(empty).count() == 0


def test_best_fit_reaches_the_bound(spark):
    """Sequences are as few as best-fit decreasing uses."""
    from tickerloom.llm.common import stored

    cut = stored(packing.pieces(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")), "bound")
    got = packing.pack(cut).collect()
    gaps, n = [], 0
    for s in sorted((r.length for r in got), reverse=True):
        i = bisect.bisect_left(gaps, s)
        if i == len(gaps):
            n, gap = n + 1, 2048 - s
        else:
            gap = gaps.pop(i) - s
        bisect.insort(gaps, gap)
    assert len({r.sequence_id for r in got}) <= n


def test_words_of_a_batch_keep_their_lattice():
    """The batched lattice has the masses of the plain one, and a batch draws what each text draws alone."""
    p = subword.pieces(subword.model_path())
    words = ["▁the", "▁un𝄞believable\n", "▁▁▁", "▁日本語", "▁" + "ab" * 40, "a\ud800b"]
    chart = subword.Chart(p, words)
    for n, w in enumerate(words):
        edges, mass = p.lattice(w[1:].replace("▁", " ") if w[0] == "▁" else "")
        if w[0] != "▁":
            continue
        for i, out in enumerate(edges):
            place = chart.start[n] + i
            mine = slice(chart.first[place], chart.first[place] + chart.degree[place])
            want = sorted((j, round(math.exp(x + mass[j] - mass[i]), 9)) for j, x, _ in out)
            assert sorted((int(t - chart.start[n]), round(float(c), 9)) for t, c in zip(chart.to[mine], chart.chance[mine])) == want
    texts = ["", "a", "the cat sat", "x " * 300, "𝄞\n𝄞", "  ", "w" * 700, "the cat sat"]
    together = p.draw_all(texts, list(range(len(texts))), 4)
    for n, text in enumerate(texts):
        alone = p.draw(text, n, 4)
        mine = [(ids.tolist(), x, y) for m, ids, x, y in together if m == n]
        assert [x[0] for x in mine] == [x[0] for x in alone]
        assert all(a[1] == pytest.approx(b[1], abs=1e-6) and a[2] == pytest.approx(b[2], abs=1e-6) for a, b in zip(mine, alone))
        assert all(p.decode(x[0]) == text for x in mine) and len({tuple(x[0]) for x in mine}) == len(mine)


def test_late_nodes_change_nothing(monkeypatch):
    p = subword.pieces(subword.model_path())
    texts = ["the quick brown fox " * n for n in (1, 2, 5, 40)] + ["q", "a b"]
    want = p.draw_all(texts, [7] * 6, 3)
    for bound in (1, 2, 10**6):
        monkeypatch.setattr(subword, "REACH", bound)
        got = p.draw_all(texts, [7] * 6, 3)
        assert [(n, i.tolist(), x, y) for n, i, x, y in got] == [(n, i.tolist(), x, y) for n, i, x, y in want]


def test_every_segmentation_is_handed_out_once():
    p = subword.pieces(subword.model_path())
    edges, mass = p.lattice("abc")
    ways = {}

    def go(at, weight, ids):
        if at == len(edges):
            ways[tuple(ids)] = weight - mass[0]
            return
        for to, w, more in edges[at]:
            go(to, weight + w, [*ids, *more])

    go(0, 0.0, [])
    for seed in range(20):
        drawn = p.draw("abc", seed, len(ways) + 5)
        assert {tuple(x[0]): round(x[1], 9) for x in drawn} == {k: round(v, 9) for k, v in ways.items()} and len(drawn) == len(ways)
        assert all(x[2] == 0.0 for x in drawn)
