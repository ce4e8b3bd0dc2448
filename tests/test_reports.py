"""Selection reports and guard reviews against plain loops on small inputs."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tickerloom.operators import lookups, selection, settlement

ROW = "run string, key bigint, theme string, industry string, score double, failed_gate string"


def plain_report(rows, limit, cap, top_n, most):
    chosen, waiting, seen, skips = [], [], set(), Counter()
    kinds = {r[3] for r in rows if r[3] is not None}

    def full(row):
        if sum(c[2] == row[2] for c in chosen) >= cap:
            return "theme"
        return "industry" if row[3] is not None and sum(c[3] == row[3] for c in chosen) >= most else None

    for row in sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0), r[1])):
        if len(chosen) >= limit:
            break
        why = full(row)
        if why:
            skips[why] += 1
        elif row[3] in seen and (len(chosen) < min(top_n, limit) or len(seen) < len(kinds)):
            waiting.append(row)
        else:
            chosen.append(row)
            seen |= {row[3]} - {None}
    early, dropped = len(chosen), 0
    for row in waiting:
        if len(chosen) >= limit:
            break
        why = full(row)
        if why:
            skips[why] += 1
            dropped += why == "theme"
        else:
            chosen.append(row)
    late = len(chosen) - early
    return {"selected": len(chosen), "late": late, "skipped_theme_cap": skips["theme"], "skipped_industry_cap": skips["industry"],
            "skipped_diversity": len(waiting) - late - dropped, "themes": len({r[2] for r in rows}), "eligible_industries": len(kinds),
            "industries": len({c[3] for c in chosen} - {None}),
            "per_theme": ",".join(f"{t}:{n}" for t, n in sorted(Counter(c[2] for c in chosen if c[2] is not None).items())),
            "per_industry": ",".join(f"{t}:{n}" for t, n in sorted(Counter(c[3] for c in chosen if c[3] is not None).items()))}


@pytest.mark.parametrize("seed", range(5))
def test_report_counts_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    kinds, limit, cap, top_n = [(3, 12, 2, 5), (8, 10, 3, 5), (20, 10, 2, 3), (2, 6, 4, 5), (6, 40, 3, 2)][seed]
    rows = [(f"r{i % 5}", i, rng.choice([None] + [f"t{j}" for j in range(9)]), rng.choice([None] + [f"i{j}" for j in range(kinds)]),
             rng.choice([None] + [float(rng.randrange(60))] * 9), rng.choice([None, None, None, "price", "stock"]))
            for i in range(rng.choice([40, 400]))] + [("barred", 1, "t1", "i1", 3.0, "price")]
    got = {r["run"]: r.asDict() for r in selection.selection_report(
        spark.createDataFrame(rows, ROW), "run", limit, cap, top_n, ("price", "stock")).collect()}
    assert set(got) == {r[0] for r in rows}
    late = 0
    for run, row in got.items():
        mine = [r for r in rows if r[0] == run]
        good = [r for r in mine if r[5] is None]
        want = plain_report(good, limit, cap, top_n, selection.industry_cap(limit, cap))
        assert {k: row[k] for k in want} == want
        assert (row["candidates"], row["eligible"]) == (len(mine), len(good))
        assert row["excluded_price"] == sum(r[5] == "price" for r in mine)
        assert (row["shortfall"] == "") == (row["selected"] >= limit)
        late += row["late"]
    assert got["barred"]["shortfall"].split(",") == ["no_candidates", "too_few_themes", "excluded_price"]
    assert late > 0 or seed != 4


def test_report_of_nothing(spark):
    assert selection.selection_report(spark.createDataFrame([], ROW), "run", 5, 1, 2, ("price",)).count() == 0


def test_cooldown_gate_keeps_rows_and_names_the_reason(spark):
    t = lambda d, h=4: dt.datetime(2000, 1, d, h)
    recs = spark.createDataFrame([(1, "a", t(1), 10), (2, "a", t(2), 10), (2, "a", t(2), 11), (2, "a", t(2), 12), (3, "b", t(2), 10), (4, "a", t(2, 17), 11)],
                                 "run_id int, tenant string, as_of timestamp, stock_key int")
    evidence = spark.createDataFrame([(1, 10, "x", "y"), (2, 11, "z", "y"), (2, 12, "z", None), (3, 10, "x", None), (4, 11, "y", None)],
                                     "run_id int, stock_key int, keyword string, matched_keyword string")
    out = lookups.cooldown_gate(recs, recs.where("run_id = 1"), evidence).collect()
    assert {(r["run_id"], r["stock_key"]): r["cooled"] for r in out} == {
        (1, 10): None, (2, 10): "previous_stock", (2, 11): "previous_keyword", (2, 12): None, (3, 10): None, (4, 11): None}
    assert len(out) == 6


@pytest.mark.parametrize("pooled", [False, True])
def test_guard_reviews_equal_the_loop(spark, pooled):
    rng = random.Random(3)
    start = dt.datetime(2000, 1, 1)
    rows = [(rng.choice("ab"), start + dt.timedelta(hours=rng.randrange(24 * 60))) for _ in range(300)]
    rows = [(k, t, t + dt.timedelta(hours=rng.randrange(24 * 12)), rng.choice([None, *[x / 64 for x in range(-8, 7)]])) for k, t in rows]
    # A Monday at midnight belongs to its own review, as does an outcome of just the window's age.
    rows += [("edge", dt.datetime(2000, 1, 3), dt.datetime(2000, 1, 3), -1.0), ("only null", start, start, None), (None, start, start, 1.0), ("never", start, None, 1.0)]
    df = spark.createDataFrame(rows, "key string, as_of timestamp, ready_at timestamp, value double")
    got = {(r["key"], r["review"]): r for r in settlement.guard_reviews(df, "key", 14, 0.0, 2, pooled).collect()}
    want = {}
    for week in range(20):
        review = dt.datetime(2000, 1, 3) + dt.timedelta(days=7 * week)
        for key in ("a", "b", "edge", "only null", "never"):
            told = [r for r in rows if r[0] == key and review - dt.timedelta(days=14) <= r[1] <= review and r[2] is not None and r[2] <= review]
            if not told:
                continue
            days = {}
            for r in told:
                if r[3] is not None:
                    days.setdefault(r[1].date(), []).append(r[3])
            means = {d: sum(v) / len(v) for d, v in days.items()}
            streak = 0
            for d in sorted(means, reverse=True):
                if means[d] >= 0:
                    break
                streak += 1
            values = [x for v in days.values() for x in v]
            level = None if not values else sum(values) / len(values) if pooled else sum(means.values()) / len(means)
            want[key, review] = (level, len(told), len(means), streak, level is not None and level < 0 and streak >= 2)
    assert set(got) == set(want)
    for k, (level, reconciled, days, streak, trips) in want.items():
        r = got[k]
        assert r["level"] is level is None or r["level"] == pytest.approx(level)
        assert (r["reconciled"], r["days"], r["streak"], r["triggered"]) == (reconciled, days, streak, trips)
    assert ("edge", dt.datetime(2000, 1, 17)) in got and ("edge", dt.datetime(2000, 1, 24)) not in got
    assert any(w[4] for w in want.values()) and not all(w[4] for w in want.values())


def test_strategy_report_equals_the_loop(spark):
    rng = random.Random(11)
    configs = [{"strategy": "wide"}, {"strategy": "tight", "w_market": 0.0, "max_price": 20.0, "max_gain": 0.1, "min_score": 30.0, "cap": 2, "limit": 6}]
    rows = [(f"d{i % 3}", i, rng.choice(["600001", "688001"] + ["000002"] * 4), rng.choice(["Plain", "Plain", "*ST Some"]), rng.choice(["metal", "chip", "food", "bank"]),
             rng.choice([None, 10.0, 25.0, 50.0]), rng.choice([None, 0.05, 0.15, 0.5]), *[float(rng.randrange(20)) for _ in range(4)]) for i in range(240)]
    names = "day string, stock_key int, symbol string, name string, industry string, close double, momentum5 double, evidence_score double, graph_score double, exposure_score double, market_score double"
    df = spark.createDataFrame(rows, names)
    got = {(r["strategy"], r["day"]): r for r in selection.strategy_report(df, configs, "day").collect()}
    picks = Counter((r["strategy"], r["day"]) for r in selection.run_strategies(df, configs, "day").collect())
    assert len(got) == 6
    for c in configs:
        for day in ("d0", "d1", "d2"):
            failed, good = Counter(), []
            for r in (r for r in rows if r[0] == day):
                score = min(100.0, r[7] + r[8] + r[9] + r[10] * c.get("w_market", 1.0))
                if r[2].startswith("688") or "ST" in r[3]:
                    failed["stock"] += 1
                elif r[6] is not None and r[6] > c.get("max_gain", 0.2):
                    failed["gain"] += 1
                elif r[5] is None or r[5] > c.get("max_price", 40.0):
                    failed["price"] += 1
                elif score < c.get("min_score", -1):
                    failed["score"] += 1
                else:
                    good.append((-score, r[1], r[4]))
            held, chosen, skipped = Counter(), 0, 0
            for _, _, theme in sorted(good):
                if chosen == c.get("limit", 30):
                    break
                full = held[theme] >= c.get("cap", 30)
                skipped += full
                chosen += not full
                held[theme] += not full
            row = got[c["strategy"], day]
            assert {g: row[f"excluded_{g}"] for g in ("stock", "gain", "price", "score")} == {g: failed[g] for g in ("stock", "gain", "price", "score")}
            assert (row["candidates"], row["eligible"], row["selected"], row["skipped_theme_cap"]) == (80, len(good), chosen, skipped)
            assert picks[c["strategy"], day] == chosen
            assert (row["shortfall"] == "") == (chosen == c.get("limit", 30))


def penalties(spark, rows):
    """Penalties of (keyword, return, age in sessions) rows, one recommendation each."""
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    at = dt.datetime.combine(days[-1], dt.time(16))
    seen = dt.datetime.combine(days[-1], dt.time(7))
    settled = spark.createDataFrame([(i, 1, dt.datetime.combine(days[-1 - age], dt.time(1)), float(y), seen, True) for i, (_, y, age) in enumerate(rows)],
                                    "run_id int, stock_key int, as_of timestamp, yield_5 double, visible_5 timestamp, reconciled boolean")
    evidence = spark.createDataFrame([(i, 1, k, None, 1.0) for i, (k, _, _) in enumerate(rows)],
                                     "run_id int, stock_key int, keyword string, matched_keyword string, contribution double")
    calendar = spark.createDataFrame([(d, True) for d in days], "day date, is_open boolean")
    out = settlement.smooth_penalties(settled, settled.select("run_id"), evidence, calendar, F.lit(at))
    return {r["word"]: r for r in out.collect()}


def test_few_observations_are_not_penalised(spark):
    assert penalties(spark, [("silver", -0.05, 1)])["silver"]["factor"] == 1.0


def test_a_losing_keyword_is_held_against_the_overall_rate(spark):
    out = penalties(spark, [("lithium", -0.05, i) for i in range(10)] + [("silver", 0.02, i) for i in range(10)])
    bad, good = out["lithium"], out["silver"]
    n = sum(0.5 ** (i / 20) for i in range(10))
    assert bad["p0"] == pytest.approx(0.5, abs=1e-12) and good["p0"] == pytest.approx(bad["p0"], abs=1e-12)
    assert bad["n"] == pytest.approx(n) and bad["p"] == pytest.approx((n + 10) / (n + 20))
    assert bad["factor"] == pytest.approx(1 - 0.6 * (bad["p"] - 0.5)) and good["factor"] == 1.0


def test_weight_halves_after_one_half_life(spark):
    assert penalties(spark, [("k", -0.05, 0), ("k", -0.05, 20)])["k"]["n"] == pytest.approx(1.5)


def test_reviewed_forecasts_are_settled_over_all_members(spark):
    from types import SimpleNamespace

    from tickerloom.catalog import aggregates

    made, bars = dt.datetime(2000, 1, 5, 9), "stock_key long, trading_day date, close double, visible_at timestamp"
    facts = [("k1", s, dt.datetime(1999, 1, 1), None, "active") for s in range(12)] + [("k2", 0, dt.datetime(1999, 1, 1), None, "active")] * 2
    closes = [(s, dt.date(2000, 1, 3 + n), 100.0 + n * (200 if s >= 10 else -1), None) for s in range(12) for n in range(7)]
    v = SimpleNamespace(
        signals=spark.createDataFrame([(k, "positive", made) for k in ("k1", "k2", "k3")], "keyword string, direction string, signal_at timestamp"),
        facts=spark.createDataFrame(facts, "keyword string, stock_key long, valid_from timestamp, valid_to timestamp, status string"),
        bars_full=spark.createDataFrame(closes, bars))
    found = lambda *most: {r["keyword"]: r["realised"] for r in aggregates.settled_forecasts(v, *most).collect()}
    assert found() == {"k1": "up", "k2": "down", "k3": "no_data"}
    assert found(10) == {"k1": "down", "k2": "down", "k3": "no_data"}
