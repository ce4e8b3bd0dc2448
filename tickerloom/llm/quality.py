"""Quality rules with thresholds that follow each language and source.

Every figure is an integer that SQL can recompute. The distribution of each figure in a (language, source) group is held as a
mergeable quantile sketch: counts per bucket of a fixed log-linear scale (exact below 64, then 32 buckets per doubling, so a
quantile is at most 1/32 too small). Sketches of a group merge into its language's and into the whole corpus by adding counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Figures with a threshold from the sketches, and the slack each gets above the spread of its group.
FIGURES = {"symbol_pm": 60, "dup_line_pm": 400, "repeat_pm": 220, "long_word_cp": 400}
#: A group of fewer documents takes its language's thresholds, and a language of fewer the corpus'.
LEAST_GROUP = 64
#: Quantiles read from a sketch, in percent, and how many times their distance a figure may lie above the upper one.
LOWER, UPPER, SPREADS = 50, 75, 6


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more in the text, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_runs(s: Column) -> Column:
            n = F.size(s)
            same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])))
            places = F.sort_array(F.transform(same, lambda x: x["i"]))
            zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("p"))
            step = lambda a, p: F.struct((a["n"] + F.least(p - a["p"], F.lit(WINDOW))).alias("n"), p.alias("p"))
            return F.aggregate(places, zero, step, lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("bigint")).otherwise(let(order, of_runs))

    def of_words(w: Column) -> Column:
        keys = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return F.when(F.size(w) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(keys, covered))

    return let(words, of_words)


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint"))


def _per_mille(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 1000 / whole)).otherwise(0).cast("bigint")


def figures(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the scaled figures.

    A null or empty text has no words and zero in every figure.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    measured = let(
        words_of(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = docs.select("*", measured.alias("_m"), F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                      duplicate_lines(F.col(text)).alias("n_dup_lines"), lines.cast("bigint").alias("n_lines"))
    out = out.select("*", "_m.n_words", "_m.word_chars", "_m.n_repeat_words").drop("_m")
    return out.withColumns({
        "symbol_pm": _per_mille(F.col("n_symbols"), F.col("word_chars")),
        "dup_line_pm": _per_mille(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_pm": _per_mille(F.col("n_repeat_words"), F.col("n_words")),
        "long_word_cp": F.when(F.col("n_words") > 0, F.floor(F.col("word_chars") * 100 / F.col("n_words"))).otherwise(0).cast("bigint"),
    })


def bucket(value: Column) -> Column:
    """Lower edge of the value's bucket: the value below 64, else its six leading bits."""
    bits = F.length(F.bin(value))
    unit = F.pow(F.lit(2.0), (bits - 6).cast("double")).cast("bigint")
    return F.when(value < 64, value).otherwise(F.floor(value / unit).cast("bigint") * unit)


def sketches(measured: DataFrame) -> DataFrame:
    """One row per language, source, figure and bucket with its count. Adding counts merges sketches."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("figure"), bucket(F.col(k)).alias("bucket")) for k in FIGURES]))
    return (measured.select("lang", "source", pairs.alias("_p")).groupBy("lang", "source", "_p.figure", "_p.bucket")
            .agg(F.count("*").alias("n")))


def _limits(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Threshold per key and figure: the upper quantile plus a multiple of its distance from the median, plus slack."""
    merged = counts.groupBy(*keys, "figure", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*keys, "figure")
    run = F.sum("n").over(w.orderBy("bucket"))
    placed = merged.select("*", run.alias("upto"), F.sum("n").over(w).alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    slack = F.create_map(*[x for k, v in FIGURES.items() for x in (F.lit(k), F.lit(v))])[F.col("figure")]
    found = placed.groupBy(*keys, "figure").agg(F.max("total").alias("total"), at(LOWER).alias("mid"), at(UPPER).alias("high"))
    limit = F.col("high") + SPREADS * (F.col("high") - F.col("mid")) + slack
    wide = found.groupBy(*keys).agg(F.max("total").alias("size"), *[
        F.max(F.when(F.col("figure") == k, limit)).alias(f"{k}_max") for k in FIGURES])
    return wide


def thresholds(measured: DataFrame) -> DataFrame:
    """One row per language and source with the thresholds in force there (nulls are groups of their own)."""
    counts = stored(sketches(measured), "quality-sketches")
    names = [f"{k}_max" for k in FIGURES]
    own = _limits(counts, ["lang", "source"])
    lang = _limits(counts, ["lang"]).select(F.col("lang").alias("_l"), F.col("size").alias("_ls"), *[F.col(c).alias(f"_l_{c}") for c in names])
    every = _limits(counts.withColumn("_one", F.lit(1)), ["_one"]).select("_one", *[F.col(c).alias(f"_c_{c}") for c in names])
    out = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")), "left").withColumn("_one", F.lit(1))
    out = out.join(F.broadcast(every), "_one")  # one row
    pick = lambda c: F.when(F.col("size") >= LEAST_GROUP, F.col(c)).when(F.col("_ls") >= LEAST_GROUP, F.col(f"_l_{c}")).otherwise(F.col(f"_c_{c}"))
    return out.select("lang", "source", *[pick(c).alias(c) for c in names])


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Figures of every document with base_failed and kept.

    ``keep`` names the columns of ``docs`` carried along (all but the text by default). A document passes the adaptive rules if
    none of its figures lies above the threshold of its language and source. Null languages and sources form groups of their
    own; an empty table gives an empty result; repeated rows are judged one by one. Input columns named like a figure are
    replaced.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made = {"n_words", "word_chars", "n_repeat_words", "n_symbols", "n_dup_lines", "n_lines", *FIGURES, "base_failed", "kept", "_m"}
    keep = [c for c in keep if c not in made]
    narrow = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "lang", "source", text]) if c not in made])
    measured = stored(figures(narrow, text).drop(*([] if text in keep else [text])), "quality-figures")
    tag = "_" * (1 + max([len(c) for c in keep], default=0))  # no column of the caller's
    limits = stored(thresholds(measured).select(F.col("lang").alias(f"{tag}lang"), F.col("source").alias(f"{tag}source"),
                                                *[f"{k}_max" for k in FIGURES]), "quality-limits")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col(f"{tag}lang")) & F.col("source").eqNullSafe(F.col(f"{tag}source")), "left")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    within = F.lit(True)
    for k in FIGURES:
        within = within & (F.col(k) <= F.col(f"{k}_max"))
    return joined.withColumns({"base_failed": failed, "kept": ~failed & within}).drop(f"{tag}lang", f"{tag}source")
