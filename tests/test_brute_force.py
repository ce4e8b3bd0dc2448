"""Iterative and order-dependent operators against plain loops on small inputs."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F
from tickerloom.operators import near_duplicates as nd
from tickerloom.operators import quantiles, selection, settlement
from tickerloom.functions import text as tx
from tickerloom.plans import evaluation


def cosine(a, b):
    def grams(t):
        t = "".join(c for c in t.lower() if c.isascii() and c.isalnum())
        return Counter(t[i:i + 2] for i in range(len(t) - 1))

    x, y = grams(a), grams(b)
    if not x or not y:
        return 0.0
    return sum(x[g] * y[g] for g in x) / (math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values())))


def loop_groups(rows):
    def keys(r):
        bare = "".join(c for c in r["title"].lower() if c.isalnum())[:12]
        day = r["published_at"].date()
        return {("s", r["source"], day)} | ({("t", bare, day)} if len(bare) >= 6 else set())

    rows = sorted(rows, key=lambda r: (r["published_at"], r["news_id"]))
    group = {}
    for i, a in enumerate(rows):
        if a["news_id"] in group:
            continue
        group[a["news_id"]] = a["news_id"]
        for b in rows[i + 1:]:
            if b["news_id"] not in group and keys(a) & keys(b) and (
                    cosine(a["title"], b["title"]) > 0.6 or cosine(a["content"], b["content"]) > 0.85):
                group[b["news_id"]] = a["news_id"]
    return group


@pytest.mark.parametrize("probes", [256, 2])
def test_near_duplicate_groups_equal_the_loop(spark, monkeypatch, probes):
    """A tiny probe size forces many rounds; the result must not change."""
    monkeypatch.setattr(nd, "PROBES", probes)
    rng = random.Random(5)
    words = ["silver", "copper", "price", "demand", "order", "plant", "solar", "chip", "stock", "rises", "falls", "again"]
    rows = []
    for i in range(60):
        if i and rng.random() < 0.5:
            base = rng.choice(rows)
            title = base["title"] if rng.random() < 0.5 else base["title"] + " " + rng.choice(words)
            content = base["content"] + rng.choice(["", " " + rng.choice(words)])
        else:
            title, content = " ".join(rng.sample(words, 4)), " ".join(rng.choices(words, k=14))
        rows.append({"news_id": i, "title": title, "content": content, "source": f"s{i % 3}",
                     "published_at": dt.datetime(2026, 1, 1 + i % 2, i % 24, i % 60)})
    df = spark.createDataFrame(rows, "news_id bigint, title string, content string, source string, published_at timestamp")
    got = nd.near_dup_groups(df).collect()
    assert {r["news_id"]: r["group_id"] for r in got} == loop_groups(rows)
    sizes = Counter(r["group_id"] for r in got)
    assert all(r["group_size"] == sizes[r["group_id"]] and r["weight"] == (1.0 if r["news_id"] == r["group_id"] else 0.15) for r in got)
    leaders = nd.group_leaders(nd.near_dup_groups(df).join(df.select("news_id", "published_at"), "news_id")).collect()
    assert all(r["group_id"] == r["news_id"] for r in leaders)
    audit = nd.dedup_audit(nd.near_dup_groups(df).join(df.select("news_id", "title", "published_at"), "news_id")).collect()
    assert sum(r["news"] for r in audit) == 60 and sum(r["groups"] for r in audit) >= len(sizes)


def plain_diverse(rows, limit, cap, top_n):
    """The rule on (key, theme, industry) rows in score order: spread over industries first, then fill, under both caps.

    A row is spread while fewer than top_n rows are chosen or an industry is missing; then only rows of industries without a row
    count, and others wait for the end. Rows without an industry never wait.
    """
    most, every = max(cap, 2, -(-limit // 5)), {d for _, _, d in rows if d is not None}
    chosen, waiting = [], []

    def allowed(row):
        return (len(chosen) < limit and sum(t == row[1] for _, t, _ in chosen) < cap
                and (row[2] is None or sum(d == row[2] for _, _, d in chosen) < most))

    for row in rows:
        have = {d for _, _, d in chosen if d is not None}
        spreading = len(chosen) < min(top_n, limit) or have != every
        if allowed(row):
            (waiting if row[2] in have and spreading else chosen).append(row)
    for row in waiting:
        if allowed(row):
            chosen.append(row)
    return [k for k, _, _ in chosen]


@pytest.mark.parametrize("seed", range(4))
def test_diverse_topk_equals_one_pass_over_everything(spark, seed):
    rng = random.Random(seed)
    n_industries, limit, cap, top_n = rng.choice([(3, 12, 2, 5), (8, 10, 3, 5), (20, 10, 2, 3), (2, 30, 4, 5)])
    rows = [(1, i, f"t{rng.randrange(6)}", rng.choice([None] + [f"i{j}" for j in range(n_industries)]), float(rng.randrange(200)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "run int, key bigint, theme string, industry string, score double")
    want = plain_diverse([(k, t, d) for _, k, t, d, _ in sorted(rows, key=lambda r: (-r[4], r[1]))], limit, cap, top_n)
    got = [r["key"] for r in selection.diverse_topk(df, "run", limit, cap, top_n).orderBy("rank").collect()]
    assert got == want


def test_one_row_per_industry_comes_first(spark):
    rows = [(1, i, f"t{i}", "a" if i < 6 else "b", 100.0 - i) for i in range(8)]
    df = spark.createDataFrame(rows, "run int, key bigint, theme string, industry string, score double")
    got = [r["key"] for r in selection.diverse_topk(df, "run", 4, 2, 2).orderBy("rank").collect()]
    assert got[:2] == [0, 6]


def plain_draws(seed, n):
    out, a = [], seed
    for _ in range(n):
        a = (a + 0x6D2B79F5) % 2**32
        t = (a ^ (a >> 15)) * (a | 1) % 2**32
        t ^= (t + (t ^ (t >> 7)) * (t | 61)) % 2**32
        out.append((t ^ (t >> 14)) / 2**32)
    return out


def test_draws_and_bootstrap_equal_a_plain_loop(spark):
    got = [r["x"] for r in spark.range(1, 51).select("id", evaluation.draw(F.col("id"), 7).alias("x")).orderBy("id").collect()]
    assert got == plain_draws(7, 50)
    returns = [0.01 * math.sin(i) for i in range(43)]
    draws, means, n, block = iter(plain_draws(7, 10**4)), [], 43, 5
    for _ in range(50):
        cur, total = int(next(draws) * n), 0.0
        for count in range(1, n + 1):
            total += returns[cur]
            cur = int(next(draws) * n) if count % block == 0 else (cur + 1) % n
        means.append(total / n)
    df = spark.createDataFrame(list(enumerate(returns)), "day int, ret double")
    got = sorted(r["mean"] for r in evaluation.bootstrap_means(df, 50, block, 7).collect())
    assert got == pytest.approx(sorted(means), abs=1e-12)
    row = evaluation.bootstrap_ci(df, 50, block, 7).first()
    assert row["lower"] <= row["mean"] <= row["upper"]


def test_many_series_are_resampled_as_if_alone(spark):
    rng = random.Random(2)
    rows = [(s, d, rng.gauss(0, 0.01)) for s, n in (("a", 43), ("b", 7), ("c", 100), ("d", 1)) for d in range(n)]
    df = spark.createDataFrame(rows, "s string, day int, ret double")
    got = {}
    for r in evaluation.bootstrap_means(df, 40, 10, 7, ("s",)).collect():
        got.setdefault(r["s"], {})[r["iteration"]] = r["mean"]
    for name in "abcd":
        alone = evaluation.bootstrap_means(df.where(F.col("s") == name).drop("s"), 40, 10, 7).collect()
        assert {r["iteration"]: r["mean"] for r in alone} == pytest.approx(got[name], abs=1e-15) and len(alone) == 40
    assert {r["s"] for r in evaluation.bootstrap_ci(df, 40, 10, 7, ("s",)).collect()} == set("abcd")


@pytest.mark.parametrize("small,parts", [(500_000, 64), (5, 4)])
def test_order_statistics_are_exact(spark, small, parts):
    """Small sizes force many rounds; one key is hot, one has equal values only, one lies on a steep scale."""
    rng = random.Random(1)
    rows = [(k, rng.gauss(0, 0.01)) for k in (1, 2, 3) for _ in range(100 + k)] + [(4, 0.5)] * 500 + [(5, 2.0 ** (i - 150)) for i in range(301)]
    rows += [(6, float(rng.randrange(40))) for _ in range(900)] + [(7, None), (8, -3.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    want = pd.DataFrame(rows, columns=["k", "v"]).dropna().groupby("k")["v"].median().to_dict()
    assert {r["k"]: r["median"] for r in quantiles.exact_median(df, ["k"], "v", small=small, parts=parts).collect()} == want
    near = {k: sorted(v for key, v in rows if key == k)[math.ceil(0.95 * sum(key == k for key, _ in rows)) - 1] for k in (1, 2, 3, 4, 5, 6, 8)}
    assert {r["k"]: r["quantile"] for r in quantiles.nearest_rank(df, ["k"], "v", 0.95, small=small, parts=parts).collect()} == near
    assert quantiles.exact_median(df.where("k = 7"), ["k"], "v").count() == 0


def test_common_substring(spark):
    pairs = [("smallring", "ringsmall"), ("abcd", "xabcx"), ("abc", "abcdefgh"), ("", "a"), ("aaaa", "aaa")]

    def plain(a, b):
        if not a or not b or min(len(a), len(b)) / max(len(a), len(b)) < 0.6:
            return 0
        return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)

    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", tx.lcs_length("a", "b").alias("n"))
    assert all(r["n"] == plain(r["a"], r["b"]) for r in df.collect())


def test_bases_and_following_bars_equal_the_loop(spark):
    """Months without bars, late bars, rows before the first and after the last bar; bars reach the plan's join once."""
    rng, day0 = random.Random(8), dt.date(2026, 1, 1)
    days = sorted(rng.sample(range(400), 24))
    bars = [(k, day0 + dt.timedelta(days=d), float(i + 100 * k), dt.datetime(2026, 1, 1, 8) + dt.timedelta(days=d + rng.choice([0, 0, 40])), f"s{i}")
            for k in (1, 2) for i, d in enumerate(days)]
    recs = [(i, rng.choice([1, 2, 3]), dt.datetime(2025, 12, 20, 16) + dt.timedelta(days=rng.randint(0, 460))) for i in range(120)] + [(900, 1, None), (901, None, dt.datetime(2026, 3, 1))]
    left = spark.createDataFrame(recs, "run_id int, stock_key int, as_of timestamp")
    right = spark.createDataFrame(bars, "stock_key int, trading_day date, close double, visible_at timestamp, trading_status string")
    got = settlement.exits(left, right, (1, 2, 5)).collect()
    assert len(got) == len(recs)
    for r in got:
        own = [b for b in bars if b[0] == r.stock_key and r.as_of]
        seen = [b for b in own if max(b[3], dt.datetime.combine(b[1], dt.time())) <= r.as_of]
        upto = sum(dt.datetime.combine(b[1], dt.time()) <= r.as_of for b in own)
        want = [own[upto - 1 + n] if upto and upto - 1 + n < len(own) else None for n in (1, 2, 5)]
        assert (r.base_day, r.p0) == ((seen[-1][1], seen[-1][2]) if seen else (None, None))
        assert [(r[f"day_{n}"], r[f"close_{n}"], r[f"state_{n}"]) for n in (1, 2, 5)] == [(b[1], b[2], b[4]) if b else (None, None, None) for b in want]
    plan = settlement.exits(left, right, (1, 2, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow ", plan)) == 2  # following bars, and what earlier months leave
