"""Point-in-time filters and row predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.numbers import col
from ..functions.timekeys import visible_at

OMITTED = object()


def with_version(df: DataFrame, version=OMITTED) -> DataFrame:
    """No argument keeps all rows, None keeps unversioned rows, text keeps that version."""
    if version is OMITTED:
        return df
    if version is None:
        return df.where(F.col("dataset_version").isNull())
    return df.where(F.col("dataset_version") == version)


def latest_version(df: DataFrame) -> DataFrame:
    """Newest imported dataset version."""
    return df.where(F.col("dataset_version").isNotNull()).agg(
        F.max_by("dataset_version", F.struct("imported_at", "dataset_version")).alias("dataset_version"))


def bars_as_of(bars: DataFrame, as_of: Column, from_day: Column | None = None, version=OMITTED) -> DataFrame:
    """Bars whose day and visible instant are both at or before as_of; the bare day filter reaches the scan."""
    out = bars.where(F.col("trading_day") <= F.to_date(as_of))
    if from_day is not None:
        out = out.where(F.col("trading_day") >= from_day)
    return with_version(out, version).where(visible_at("trading_day", "visible_at") <= as_of)


def valid_at(df: DataFrame, as_of: Column) -> DataFrame:
    """Active rows whose closed validity interval holds as_of."""
    return df.where((F.col("status") == "active") & (F.col("valid_from") <= as_of)
                    & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))


def replay_split(bars: DataFrame, as_of: Column, evaluation: Column | None = None) -> DataFrame:
    """Label bars base (usable at as_of) or future (after it, visible by the cutoff); others drop out."""
    cutoff = as_of + F.expr("INTERVAL '20' DAY")
    if evaluation is not None:
        cutoff = F.least(evaluation, cutoff)
    day = F.col("trading_day").cast("timestamp")
    seen = visible_at("trading_day", "visible_at")
    role = F.when((day <= as_of) & (seen <= as_of), "base").when((day > as_of) & (seen <= cutoff), "future")
    return (
        bars.where((F.col("trading_day") >= F.to_date(as_of - F.expr("INTERVAL '30' DAY")))
                   & (F.col("trading_day") <= F.to_date(cutoff)))
        .where(day >= as_of - F.expr("INTERVAL '30' DAY"))
        .withColumn("role", role).where(F.col("role").isNotNull())
    )


class StrictAdmissionError(ValueError):
    """Bars of unknown adjustment in a window that demanded known ones."""


def admission_report(bars: DataFrame, first: Column, last: Column) -> DataFrame:
    """Per dataset version: bars in the window and those with unknown or forward adjustment."""
    unknown = F.col("adj_type").isNull() | ~F.col("adj_type").isin("hfq", "none")
    return bars.where(F.col("trading_day").between(first, last)).groupBy("dataset_version").agg(
        F.count("*").alias("bars"), F.count_if(unknown).alias("unknown_adjustment"))


def require_admission(report: DataFrame) -> None:
    """Strict mode: fail when any bar of the window is inadmissible (reads one number)."""
    bad = report.agg(F.coalesce(F.sum("unknown_adjustment"), F.lit(0))).first()[0]
    if bad:
        raise StrictAdmissionError(f"{bad} bars have unknown or forward adjustment")


def published_only(df: DataFrame, publishes: DataFrame) -> DataFrame:
    live = publishes.where(F.col("superseded_by").isNull()) if "superseded_by" in publishes.columns else publishes
    return df.join(live.select("run_id"), "run_id", "left_semi")


def direction_weight(c: Column | str) -> Column:
    c = col(c)
    # Weight per direction.
    return F.when(c == "positive", 1.0).when(c == "mixed", 0.35).when(c == "negative", -1.0).otherwise(0.0)


def source_rank(source: Column, kind: Column, level: Column) -> Column:
    """Trust rank of a fact; -1 excludes it."""
    known = [K.UNIVERSE_SOURCE, *K.SOURCE_RANKS, *K.MANUAL_SOURCES]
    blank = (F.coalesce(source, F.lit("")) == "") & (F.coalesce(kind, F.lit("")) == "")
    universe = reduce(lambda c, kv: c.when(F.upper(level) == kv[0], kv[1]), list(K.TAXONOMY_RANKS.items())[1:],
                      F.when(F.upper(level) == "SW3", K.TAXONOMY_RANKS["SW3"])).otherwise(70)
    rank = (
        F.when((F.coalesce(source, F.lit("")) == K.EXCLUDED_SOURCE) | (F.coalesce(kind, F.lit("")) == K.EXCLUDED_TYPE), -1)
        .when(blank, 1)
        .when(~F.coalesce(source, F.lit("")).isin(known), -1)
        .when(source == K.UNIVERSE_SOURCE, universe)
    )
    for name, value in K.SOURCE_RANKS.items():
        rank = rank.when(source == name, value)
    return rank.otherwise(40)


def theme_bucket(c: Column | str) -> Column:
    """First matching theme of a label, else the label."""
    c = col(c)
    out = None
    for name, pattern in K.THEME_BUCKETS:
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(c)


def has_business_variable(news: DataFrame, words: str = K.PREFILTER_WORDS) -> DataFrame:
    """News mentioning a business-variable word in its title or text."""
    pattern = f"({words})"
    return news.where(F.col("title").rlike(pattern) | F.col("content").rlike(pattern))


def dictionary_views(terms: DataFrame) -> DataFrame:
    """Active terms by use: canonical groups gather their variants, other categories list terms by length."""
    active = terms.where(F.col("status") == "active")
    return active.groupBy("category", F.when(F.col("category") == "canonical", F.col("canonical_term")).alias("grp")).agg(
        F.countDistinct("term").alias("terms"),
        F.max(F.length("term")).alias("longest"),
        F.min_by("term", F.struct(-F.length("term"), F.col("term"))).alias("first_term"))


def dictionary_terms(terms: DataFrame) -> DataFrame:
    """The terms behind the views, one row each: (category, grp, term, length). Uses read them by length, longest first."""
    group = F.when(F.col("category") == "canonical", F.col("canonical_term"))
    return terms.where(F.col("status") == "active").select("category", group.alias("grp"), "term", F.length("term").alias("length")).distinct()


def return_filter(rows: DataFrame, status: str | None = None, text: str | None = None,
                  horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Rows gaining, losing, flat or having a horizon in the given status; text matches symbol or name."""
    out = rows
    if status in ("gain", "positive"):
        out = out.where(F.col("return") > 0)
    elif status in ("loss", "negative"):
        out = out.where(F.col("return") < 0)
    elif status == "flat":
        out = out.where(F.col("return") == 0)
    elif status:
        wanted = status.upper()
        out = out.where(reduce(lambda a, b: a | b, [F.col(f"status_{h}") == wanted for h in horizons]))
    if text:
        pattern = f"%{text}%"
        out = out.where(F.col("symbol").ilike(pattern) | F.col("name").ilike(pattern))
    return out
