"""Written tables: commits, replays, failures and merges; depth-first trees against a recursive loop."""

import random

import pytest
from pyspark.sql import functions as F
from tickerloom.operators import graph
from tickerloom.session import shared_folder
from tickerloom.sources import merge
from tickerloom.sources.tables import WrittenTable, hashed

ROWS = "k bigint, v string"


def rows(spark, *items):
    return spark.createDataFrame(list(items), ROWS)


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_commits_replays_and_failures(spark):
    folder = shared_folder(spark, "table")
    table = WrittenTable(spark, folder, rows(spark, (1, "a")).schema, F.col("k") % 3)
    assert content(table) == [] and table.read().columns == ["k", "v"]
    assert table.append("one", rows(spark, (1, "a"), (2, "b"), (2, "b"), (None, "n")))
    assert not table.append("one", rows(spark, (9, "z")))
    first = [(1, "a"), (2, "b"), (2, "b")]
    assert [r for r in content_with_null(table) if r[0] is not None] == first and (None, "n") in content_with_null(table)
    fail = F.udf(lambda v: 1 / 0, "string")
    with pytest.raises(Exception):  # noqa: B017
        table.append("two", rows(spark, (4, "d")).select("k", fail("v").alias("v")))
    assert len(content_with_null(table)) == 4 and not table.applied("two")  # files may lie there, no reader sees them
    assert table.append("two", rows(spark, (4, "d")))
    again = WrittenTable(spark, folder, table.schema, F.col("k") % 3)
    assert len(content_with_null(again)) == 5 and again.applied("two")


def content_with_null(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_two_commits_cannot_take_one_number(spark):
    table = WrittenTable(spark, shared_folder(spark, "table"), rows(spark, (1, "a")).schema, F.col("k") % 2)
    table.append("one", rows(spark, (1, "a")))
    with pytest.raises(Exception):  # noqa: B017
        table._publish(1, {"batches": ["other"], "parts": {}})
    assert content(table) == [(1, "a")]


def test_merge_touches_its_partitions_only(spark):
    table = WrittenTable(spark, shared_folder(spark, "table"), rows(spark, (1, "a")).schema, F.col("k") % 4)
    table.append("load", rows(spark, *[(k, "old") for k in range(8)]))
    before = table._manifest()[1]["parts"]

    def step(held, new):
        return held.join(new.select("k"), "k", "left_anti").unionByName(new)

    assert table.merge("m", rows(spark, (1, "new"), (9, "new")), step)
    assert not table.merge("m", rows(spark, (1, "newer")), step)
    assert content(table) == sorted([(k, "old") for k in range(8) if k != 1] + [(1, "new"), (9, "new")])
    after = table._manifest()[1]["parts"]
    assert {p for p in before if before[p] != after[p]} == {"1"}


def test_append_new_rows_once(spark):
    table = WrittenTable(spark, shared_folder(spark, "table"), rows(spark, (1, "a")).schema, hashed(["k"], 4))
    table.append("load", rows(spark, (1, "a"), (2, "b")))
    for batch in ("x", "x", "y"):
        merge.append_rows(table, batch, rows(spark, (2, "c"), (3, "d"), (3, "e")), ["k"], [F.asc("v")])
    assert content(table) == [(1, "a"), (2, "b"), (3, "d")]


@pytest.mark.parametrize("depth,fanout,budget", [(3, 3, 10), (5, 3, 40), (6, 2, 25), (4, 6, 1000), (7, 2, 1)])
def test_trees_equal_a_depth_first_loop(spark, depth, fanout, budget):
    rng = random.Random(depth * budget)
    names = [f"n{i:02d}" for i in range(14)]
    edges = {}
    while len(edges) < 34:
        a, b = rng.sample(names, 2)
        edges[a, b] = round(rng.random(), 2)
    near = {}
    for (a, b), c in edges.items():
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, {})[y] = max(c, near.get(x, {}).get(y, 0))

    def walk(path, out):
        if len(out) >= budget:
            return
        out.append(tuple(path))
        if len(path) < depth:
            best = sorted((n for n in near.get(path[-1], {}) if n not in path), key=lambda n: (-near[path[-1]][n], n))[:fanout]
            for n in best:
                if len(out) < budget:
                    walk([*path, n], out)

    roots, want = names[:4], set()
    for r in roots:
        found = []
        walk([r], found)
        want |= set(found)
    df = spark.createDataFrame([(a, b, c) for (a, b), c in edges.items()], "source string, target string, confidence double")
    got = graph.expand(df, spark.createDataFrame([(r,) for r in roots], "keyword string"), depth, fanout, budget).collect()
    assert {tuple(r.path) for r in got} == want and len(got) == len(want)


def test_surest_evidence_of_an_edge(spark):
    signals = spark.createDataFrame(
        [(1, 10, "d", "a", "positive", 0.5), (2, 10, "d", "a", "positive", 0.7), (3, 11, "d", "a", "negative", 0.7), (4, 12, "d", "a", "mixed", 0.1), (5, 13, "d", "a", "mixed", 0.9),
         (6, 13, "", "a", "mixed", 0.9)], "signal_id bigint, news_id bigint, business_variable string, keyword string, direction string, confidence double")
    links = graph.edge_evidence(signals)
    assert {(r.news_id, r.signals, r.signal_id) for r in links.collect()} == {(10, 2, 2), (11, 1, 3), (12, 1, 4), (13, 1, 5)}
    assert [tuple(r) for r in graph.top_evidence(links).collect()] == [("d", "a", "[mixed] 13; [positive] 10; [negative] 11")]
