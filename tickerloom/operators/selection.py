"""Top-K selection with caps, diversity, channels and strategy grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import clamp, dbl, fixed
from ..session import cut_lineage, written
from .latest import best_per_key
from .temporal import theme_bucket


def capped_topk(df: DataFrame, run: list[str], theme: str, order: list[Column], cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows per theme, first ``limit`` per run: equal to the greedy loop."""
    in_theme = F.row_number().over(Window.partitionBy(*run, theme).orderBy(*order))
    kept = df.withColumn("_t", in_theme).where(F.col("_t") <= cap).drop("_t")
    rank = F.row_number().over(Window.partitionBy(*run).orderBy(*order))
    return kept.withColumn("rank", rank).where(F.col("rank") <= limit)


def industry_cap(limit: int, cap: int) -> int:
    # A fifth of the limit, at least two.
    return max(cap, max(2, math.ceil(limit * 0.2)))


def _offer(rows: Column, begin: Column, limit: int, cap: int, least: int | None = None, industries: Column | None = None) -> Column:
    """Fold of rows, best first, over a choice: struct(chosen, aside, edge).

    A row enters while the choice has room for it, for its theme and for its industry. Given ``least`` and the number of
    industries, a row of an industry that is present waits aside until ``least`` rows are chosen and every industry has one;
    ``edge`` is the row that completes this.
    """
    most = industry_cap(limit, cap)

    def merge(state: Column, row: Column) -> Column:
        chosen = state["chosen"]
        peers = F.filter(chosen, lambda c: c["industry"] == row["industry"])
        room = ((F.size(chosen) < limit) & (F.size(F.filter(chosen, lambda c: c["theme"].eqNullSafe(row["theme"]))) < cap)
                & (row["industry"].isNull() | (F.size(peers) < most)))
        if industries is None:
            return F.struct(F.when(room, F.array_append(chosen, row)).otherwise(chosen).alias("chosen"), state["aside"].alias("aside"), state["edge"].alias("edge"))
        present = lambda c: F.size(F.array_distinct(F.filter(F.transform(c, lambda x: x["industry"]), lambda i: i.isNotNull())))
        waits = (F.size(peers) > 0) & ((F.size(chosen) < min(least, limit)) | (present(chosen) < industries))
        more = F.when(room & ~waits, F.array_append(chosen, row)).otherwise(chosen)
        complete = state["edge"].isNull() & (F.size(more) > F.size(chosen)) & (present(more) == industries)
        return F.struct(more.alias("chosen"), F.when(room & waits, F.array_append(state["aside"], row)).otherwise(state["aside"]).alias("aside"),
                        F.when(complete, row).otherwise(state["edge"]).alias("edge"))

    return F.aggregate(rows, begin, merge)


def diverse_topk(df: DataFrame, run: str, limit: int = 30, cap: int = 3, top_n: int = 5, marks: bool = False) -> DataFrame:
    """Theme and industry caps with one row per industry first.

    ``df`` has the run, ``key``, ``theme``, ``industry`` (nullable) and ``score``; it is read twice, so
    a costly one should be written by the caller. The order of choices matters, so the rows of a run are folded in order, but
    only rows that can win reach the fold. Rows of one (theme, industry) pair
    differ only in order: until all industries are covered its first row matters,
    afterwards at most ``cap`` more, and at most ``cap`` rows set aside come back.
    A first fold over cap + 1 rows per pair finds where coverage ends, a second
    one over those rows and the first cap rows of each pair behind that point
    selects, and rows set aside are offered last. With ``marks`` a column ``late`` tells which rows came back.
    """
    order = [F.desc_nulls_last("score"), F.asc("key")]
    rows = df.select(run, "key", "theme", "industry", "score")
    pair = Window.partitionBy(run, "theme", "industry").orderBy(*order)
    head = cut_lineage(rows.withColumn("_r", F.row_number().over(pair)).where(F.col("_r") <= cap + 1).drop("_r"))
    place = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("down"), "key", "theme", "industry", "score")

    def folded(pool: DataFrame) -> DataFrame:
        listed = pool.groupBy(run).agg(F.array_sort(F.collect_list(place)).alias("rows"), F.count_distinct("industry").alias("industries"))
        row = listed.schema["rows"].dataType
        nothing = F.struct(F.array().cast(row).alias("chosen"), F.array().cast(row).alias("aside"), F.lit(None).cast(row.elementType).alias("edge"))
        return listed.select(run, _offer(F.col("rows"), nothing, limit, cap, top_n, F.col("industries")).alias("state"))

    edges = folded(head).where("state.edge is not null").select(run, F.col("state.edge.none").alias("n"), F.col("state.edge.down").alias("d"), F.col("state.edge.key").alias("k"))
    behind = rows.join(edges, run).where(F.struct(F.col("score").isNull(), -F.col("score"), F.col("key")) > F.struct("n", "d", "k")).drop("n", "d", "k")
    tail = behind.withColumn("_r", F.row_number().over(pair)).where(F.col("_r") <= cap).drop("_r")
    done = folded(head.unionByName(tail).dropDuplicates([run, "key"]))
    final = _offer(F.col("state.aside"), F.col("state"), limit, cap)["chosen"]
    late = [(F.col("at") >= F.size("early")).alias("late")] if marks else []
    return done.select(run, F.col("state.chosen").alias("early"), F.posexplode(final).alias("at", "row")).select(
        run, "row.key", "row.theme", "row.industry", "row.score", (F.col("at") + 1).cast("bigint").alias("rank"), *late)


def selection_outcomes(eligible: DataFrame, picked: DataFrame, run: str, limit: int, cap: int) -> DataFrame:
    """What became of each row offered to ``diverse_topk`` (``picked``, with marks): column ``outcome``.

    selected or late; theme_cap or industry_cap where the rows chosen ahead left no room; aside where it waited for other industries and
    its turn never came; aside_theme_cap or aside_industry_cap where its turn came and there was no room; unread behind a full list.
    The fold is not run again: the rows chosen, at most ``limit`` per run, fix every cap at every place, so each row is judged alone.
    """
    most = industry_cap(limit, cap)
    place = lambda r: F.struct(r("score").isNull(), -r("score"), r("key"))
    picks = picked.groupBy(run).agg(F.collect_list(F.struct(
        place(F.col).alias("place"), "key", "theme", "industry", "late")).alias("_picks"))
    rows = eligible.join(picks, run, "left").withColumn("_place", place(F.col))
    early, back = F.filter("_picks", lambda p: ~p["late"]), F.filter("_picks", lambda p: p["late"])
    before = lambda found: F.filter(found, lambda p: p["place"] < F.col("_place"))
    in_theme = lambda found: F.size(F.filter(found, lambda p: p["theme"].eqNullSafe(F.col("theme"))))
    in_industry = lambda found: F.size(F.filter(found, lambda p: p["industry"] == F.col("industry")))
    behind = lambda found: F.coalesce(F.col("_place") > F.array_max(F.transform(found, lambda p: p["place"])), F.lit(True))
    mine = F.filter("_picks", lambda p: p["key"] == F.col("key"))
    outcome = (
        F.when(F.size(mine) > 0, F.when(F.element_at(mine, 1)["late"], "late").otherwise("selected"))
        .when((F.size(early) >= limit) & behind(early), "unread")
        .when(in_theme(before(early)) >= cap, "theme_cap").when(in_industry(before(early)) >= most, "industry_cap")
        .when((F.size("_picks") >= limit) & behind(back), "aside")
        .when(in_theme(early) + in_theme(before(back)) >= cap, "aside_theme_cap").otherwise("aside_industry_cap"))
    return rows.withColumn("outcome", outcome).drop("_picks", "_place")


def surge_score(gain: Column, ratio: Column) -> Column:
    # Points per excess gain and volume.
    return F.greatest(F.lit(K.SURGE_BASE), F.least(F.lit(K.SURGE_CAP), F.lit(K.SURGE_BASE) + (gain - K.SURGE_MIN_GAIN) * F.lit(250.0)
                                                   + F.least(ratio - 1, F.lit(3.0)) * F.lit(5.0)))


def surge_candidates(pairs: DataFrame, stocks: DataFrame, keys: list[str], top: int = K.SURGE_TOP) -> DataFrame:
    """Strong risers on rising volume, best first, at most ``top`` per market day."""
    name = F.upper(F.trim("name"))
    gain, ratio = F.col("close") / F.col("previous_close") - 1, F.col("volume") / F.col("previous_volume")
    rows = (
        pairs.where("close > 0 and previous_close > 0 and previous_volume > 0").join(stocks.select("stock_key", "symbol", "name"), "stock_key")
        .where(~F.col("symbol").startswith("688") & ~name.contains("ST") & ~name.contains("ＳＴ") & ~F.trim("name").rlike("^[NC]"))
        .withColumn("gain", gain).withColumn("ratio", ratio)
        .where((F.col("gain") >= K.SURGE_MIN_GAIN) & (F.col("ratio") >= K.SURGE_MIN_RATIO) & (F.col("close") <= K.MAX_PRICE))
        .withColumn("score", surge_score(F.col("gain"), F.col("ratio")))
    )
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "stock_key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def union_channels(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence and surge candidates; the higher score per stock stays, evidence wins ties."""
    both = a.withColumn("channel", F.lit("evidence")).unionByName(b.withColumn("channel", F.lit("surge")))
    return best_per_key(both, keys, [F.desc("score"), F.asc("channel")])


def order_profit(df: DataFrame, by: str, direction: str = "desc") -> DataFrame:
    """Sort by a column with nulls last either way, rank breaking ties."""
    c = F.desc_nulls_last(by) if direction == "desc" else F.asc_nulls_last(by)
    return df.orderBy(c, "rnk", "run_id")


def page(df: DataFrame, order: str, key: str, after: tuple | None, n: int) -> DataFrame:
    """Next n rows behind a (value, key) cursor of a descending order; the filter replaces an offset."""
    out = df
    if after is not None:
        out = out.where((F.col(order) < after[0]) | ((F.col(order) == after[0]) & (F.col(key) > after[1])))
    return out.orderBy(F.desc(order), key).limit(n)


def evidence_network(evidence: DataFrame) -> DataFrame:
    """Four weightiest evidence rows per recommendation as stock-keyword edges."""
    # Blend and count.
    weight = F.lit(0.7) * dbl("contribution") + F.lit(0.3) * F.coalesce(dbl("match_confidence"), F.lit(0.0))
    order = Window.partitionBy("run_id", "stock_key").orderBy(F.desc("weight"), "evidence_id")
    return evidence.withColumn("weight", weight).withColumn("rank", F.row_number().over(order)).where("rank <= 4").select(
        "run_id", "stock_key", "rank", F.coalesce("matched_keyword", "keyword").alias("node"), "weight", "evidence_id")


def order_evidence(evidence: DataFrame, news: DataFrame) -> DataFrame:
    """Evidence of a recommendation ordered by contribution, confidence, time and ids; the first is primary."""
    order = Window.partitionBy("run_id", "stock_key").orderBy(
        F.desc("contribution"), F.desc_nulls_last("match_confidence"), F.desc_nulls_last("published_at"), "news_id", "evidence_id")
    return evidence.join(news.select("news_id", "published_at"), "news_id", "left").withColumn(
        "position", F.row_number().over(order)).withColumn("primary", F.col("position") == 1)


def selection_diagnostics(gated: DataFrame, selected: DataFrame, run: str, theme: str, limit: int, gates: tuple[str, ...]) -> DataFrame:
    """One row per run: counts of candidates, exclusions, themes and the reasons for a short list."""
    counts = gated.groupBy(run).agg(
        F.count("*").alias("candidates"), F.count_if(F.col("failed_gate").isNull()).alias("eligible"),
        *[F.count_if(F.col("failed_gate") == g).alias(f"excluded_{g}") for g in gates])
    picked = selected.groupBy(run).agg(F.count("*").alias("selected"), F.countDistinct(theme).alias("themes"))
    out = counts.join(picked, run, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("selected", "themes")})
    short = F.col("selected") < limit
    reasons = F.array_compact(F.array(
        F.when(short & (F.col("eligible") < limit), "too_few_candidates"),
        F.when(short & (F.col("eligible") > F.col("selected")), "theme_cap"),
        *[F.when(short & (F.col(f"excluded_{g}") > 0), f"excluded_{g}") for g in gates]))
    return out.withColumn("shortfall", F.array_join(reasons, ","))


def selection_report(gated: DataFrame, run: str, limit: int, cap: int, top_n: int, gates: tuple[str, ...]) -> DataFrame:
    """One row per run of a diversified selection: every count, counts per theme and industry, and the reasons for a short list.

    ``gated`` has the run, key, theme, industry, score and failed_gate, with one of ``gates`` or null. Rows that came back are part of
    the rows that waited; of those, ``skipped_diversity`` counts the ones not chosen for another reason than the theme cap.
    """
    slim = written(gated.select(run, "key", "theme", "industry", "score", "failed_gate"), "gated")
    eligible = slim.where("failed_gate is null").drop("failed_gate")
    picked = cut_lineage(diverse_topk(eligible, run, limit, cap, top_n, marks=True))
    outcomes = selection_outcomes(eligible, picked, run, limit, cap)
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    counts = slim.groupBy(run).agg(F.count("*").alias("candidates"), F.count_if(F.col("failed_gate").isNull()).alias("eligible"),
                                   *[F.count_if(F.col("failed_gate") == g).alias(f"excluded_{g}") for g in gates])
    steps = outcomes.groupBy(run).agg(
        of("selected", "late").alias("selected"), of("late").alias("late"), of("theme_cap", "aside_theme_cap").alias("skipped_theme_cap"),
        of("industry_cap", "aside_industry_cap").alias("skipped_industry_cap"), of("aside", "aside_industry_cap").alias("skipped_diversity"),
        F.count_distinct(F.coalesce("theme", F.lit(""))).alias("themes"), F.count_distinct("industry").alias("eligible_industries"))

    def tally(column: str) -> Column:
        each = F.filter(F.array_sort(F.array_distinct(F.collect_list(column))), lambda x: x.isNotNull())  # at most limit entries
        held = F.collect_list(column)
        return F.array_join(F.transform(each, lambda x: F.concat(x, F.lit(":"), F.size(F.filter(held, lambda y: y == x)).cast("string"))), ",")

    lists = picked.groupBy(run).agg(F.count_distinct("industry").alias("industries"), tally("theme").alias("per_theme"), tally("industry").alias("per_industry"))
    out = counts.join(steps, run, "left").join(lists, run, "left")
    numbers = [c for c in (*steps.columns, "industries") if c != run]
    out = out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in numbers}, **{c: F.coalesce(c, F.lit("")) for c in ("per_theme", "per_industry")}})
    reasons = F.array_compact(F.array(
        F.when(F.col("eligible") == 0, "no_candidates").when(F.col("eligible") < limit, "too_few_candidates"),
        F.when(F.col("themes") * cap < limit, "too_few_themes"), F.when(F.col("skipped_theme_cap") > 0, "theme_cap"),
        F.when(F.col("skipped_diversity") > 0, "diversity"),
        F.when((F.col("selected") > 0) & (F.col("industries") < F.least("eligible_industries", F.lit(limit))), "industry_coverage"),
        *[F.when(F.col(f"excluded_{g}") > 0, f"excluded_{g}") for g in gates]))
    return out.withColumn("shortfall", F.when(F.col("selected") < limit, F.array_join(reasons, ",")).otherwise(""))


def strategy_rows(features: DataFrame, configs: list[dict]) -> DataFrame:
    """Each feature row under each config: theme, score and the first gate it fails (null where it passes all).

    The configs are a short literal array exploded on each row.
    """
    table = F.array(*[F.struct(
        F.lit(c["strategy"]).alias("strategy"), *[F.lit(float(c.get(f"w_{p}", 1.0))).alias(f"w_{p}") for p in ("evidence", "graph", "exposure", "market")],
        F.lit(float(c.get("max_gain", K.MAX_GAIN_5D))).alias("max_gain"), F.lit(float(c.get("max_price", K.MAX_PRICE))).alias("max_price"),
        F.lit(c.get("min_score")).cast("double").alias("min_score"), F.lit(int(c.get("cap", 30))).alias("cap"), F.lit(int(c.get("limit", 30))).alias("limit"))
        for c in configs])
    rows = features.withColumn("c", F.explode(table))
    parts = [fixed(dbl(f"{p}_score") * F.col(f"c.w_{p}"), 4) for p in ("evidence", "graph", "exposure", "market")]
    rows = rows.withColumn("score", fixed(clamp(parts[0] + parts[1] + parts[2] + parts[3], 0, 100), 4)).withColumn("theme", theme_bucket("industry"))
    failed = (
        F.when(barred(), "stock")
        .when(F.coalesce(F.col("momentum5") > F.col("c.max_gain"), F.lit(False)), "gain")
        .when(F.col("close").isNull() | (F.col("close") > F.col("c.max_price")), "price")
        .when(F.coalesce(F.col("score") < F.col("c.min_score"), F.lit(False)), "score")
    )
    return rows.withColumn("failed_gate", failed)


def barred() -> Column:
    """Stocks no strategy selects: the 688 board and ST names."""
    name = F.upper(F.trim("name"))
    return F.coalesce(F.col("symbol").startswith("688") | name.contains("ST") | name.contains("ＳＴ"), F.lit(False))


def run_strategies(features: DataFrame, configs: list[dict], run: str) -> DataFrame:
    """Score, gate and select the same features under every config in one job.

    Rows that fail every config are gone before the configs multiply them. Windows partition by (strategy, run). The largest cap
    and limit filter first, as constants, so ranks are limited before the shuffle; each config's own follow.
    """
    hope = (~barred() & (F.col("close") <= max(float(c.get("max_price", K.MAX_PRICE)) for c in configs))
            & ~F.coalesce(F.col("momentum5") > max(float(c.get("max_gain", K.MAX_GAIN_5D)) for c in configs), F.lit(False)))
    good = strategy_rows(features.where(hope), configs).where("failed_gate is null").select(run, "stock_key", "theme", "score", "c.*")
    order = [F.desc("score"), F.asc("stock_key")]
    in_theme = good.withColumn("_t", F.row_number().over(Window.partitionBy("strategy", run, "theme").orderBy(*order)))
    in_theme = in_theme.where(F.col("_t") <= max(int(c.get("cap", 30)) for c in configs)).where("_t <= cap")
    ranked = in_theme.withColumn("rank", F.row_number().over(Window.partitionBy("strategy", run).orderBy(*order)))
    return ranked.where(F.col("rank") <= max(int(c.get("limit", 30)) for c in configs)).where(F.col("rank") <= F.col("limit")).select("strategy", run, "stock_key", "theme", "score", "rank")


def strategy_report(features: DataFrame, configs: list[dict], run: str) -> DataFrame:
    """One row per config and run: rows by gate, rows the theme cap passed over, rows selected, and the reasons for a short list.

    A row over its theme's cap counts as passed over only while the list has room; behind a full list nothing is read. The running
    count of rows within their caps tells where that is. Both windows follow one shuffle on (strategy, run).
    """
    rows = strategy_rows(features, configs).select(run, "stock_key", "theme", "score", "failed_gate", "c.strategy", "c.cap", "c.limit")
    order = [F.col("failed_gate").isNotNull(), F.desc("score"), F.asc("stock_key")]
    rows = rows.repartition("strategy", run).withColumn("_t", F.row_number().over(Window.partitionBy("strategy", run, "theme").orderBy(*order)))
    fits = F.col("failed_gate").isNull() & (F.col("_t") <= F.col("cap"))
    ahead = Window.partitionBy("strategy", run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_fits", fits).withColumn("_n", F.count_if(fits).over(ahead))
    passed = F.col("failed_gate").isNull()
    chosen = F.col("_fits") & (F.col("_n") <= F.col("limit"))
    gates = ("stock", "gain", "price", "score")
    out = rows.groupBy("strategy", run).agg(
        F.count("*").alias("candidates"), *[F.count_if(F.col("failed_gate") == g).alias(f"excluded_{g}") for g in gates],
        F.count_if(passed).alias("eligible"), F.count_if(passed & (F.col("_t") == 1)).alias("themes"),
        F.count_if(passed & ~F.col("_fits") & (F.col("_n") < F.col("limit"))).alias("skipped_theme_cap"), F.count_if(chosen).alias("selected"),
        F.max(F.when(chosen, F.col("score"))).alias("best_score"), F.min(F.when(chosen, F.col("score"))).alias("last_score"),
        F.max("cap").alias("cap"), F.max("limit").alias("limit"))
    reasons = F.array_compact(F.array(
        F.when(F.col("candidates") < F.col("limit"), "too_few_candidates"), F.when(F.col("themes") * F.col("cap") < F.col("limit"), "too_few_themes"),
        *[F.when(F.col(f"excluded_{g}") > 0, f"excluded_{g}") for g in gates], F.when(F.col("skipped_theme_cap") > 0, "theme_cap")))
    return out.withColumn("shortfall", F.when(F.col("selected") < F.col("limit"), F.array_join(reasons, ",")).otherwise("")).drop("cap", "limit")


def positions(rows: DataFrame, order: list[Column], into: str = "position") -> DataFrame:
    """Place of every row in a total order, counted from 1, without a global window.

    Rows are range-partitioned and sorted; only the partitions' row counts meet, and are added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(placed.select("*", F.spark_partition_id().alias("_part"), local.alias("_row")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(into, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
