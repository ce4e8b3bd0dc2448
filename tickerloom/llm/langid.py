"""Language identification by Bayesian fusion of evidence.

The posterior of a language is its prior times four likelihoods: of the text (hashed byte trigrams), of the declared markup
language, of the address suffix, and of the host. The host's share is a prior that is smoothed hierarchically, host by domain
by corpus, from counts of each level's languages by grouped aggregation. Evidence that is missing has likelihood one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, slices, stored, strings

BUCKETS = 1 << 15
#: Labelled rows per language that the text model is trained on.
SAMPLE = 400
#: Trigrams a text counts for at most, as neighbours aren't independent.
WEIGHT = 40.0
#: How often a declaration and a suffix name the language of the text.
DECLARED, SUFFIX = 0.9, 0.85
#: Documents' worth of the wider level in the prior of the narrower one.
PULL = 8.0
#: A text whose trigrams are less likely than this many times uniform under every language is none, as is one below CONFIDENCE.
LEAST_LIFT, CONFIDENCE = 0.2, 0.5
# Country suffixes and the language most of their pages are in.
SUFFIXES = {"at": "de", "au": "en", "de": "de", "es": "es", "fr": "fr", "ie": "en", "mx": "es", "nz": "en", "uk": "en", "us": "en"}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram with a letter, per text end to end, and how many each text has; ASCII is lower-cased."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
    folded = _FOLD[data].astype(np.uint32)
    code = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)
    code = (code ^ (code >> np.uint32(15))) & np.uint32(BUCKETS - 1)
    valid = folded[1:-1] != 32
    valid &= ((folded[:-2] != 32) | (folded[2:] != 32))
    owner_end = np.zeros(len(data), bool)
    inner = bounds[(bounds > 0) & (bounds <= len(data))]
    for back in (1, 2):
        owner_end[np.maximum(inner - back, 0)] = True
    valid &= ~owner_end[: len(valid)]
    at = np.flatnonzero(valid)
    return code[at].astype(np.int64), np.diff(np.searchsorted(at, bounds))


class TextModel:
    """Log-probabilities of trigram buckets per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + 0.5) / (total + 0.5 * BUCKETS)).astype(np.float32)

    def score(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of each text's trigrams per language, and their number."""
        code, n = trigrams(data, bounds)
        ends = np.concatenate([[0], np.cumsum(n)])
        sums = [np.concatenate([[0.0], np.cumsum(row[code], dtype=np.float64)]) for row in self.logs]
        return np.stack([(s[ends[1:]] - s[ends[:-1]]) / np.maximum(n, 1) for s in sums], axis=1) if sums else np.zeros((len(n), 0)), n


def train(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> TextModel:
    """Text model from about SAMPLE rows (never more) of each label, drawn by hashes of the key."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    counted = rows.groupBy(label).count().collect()  # one row per language
    names = [r[0] for r in counted]
    # a hash keeps about twice the sample of each label, so what is ranked per label is bounded as well
    share = F.create_map(*[x for r in counted for x in (F.lit(r[0]), F.lit(min(1.0, 2.0 * SAMPLE / r[1] + 64.0 / r[1])))])[F.col("label")] if counted else F.lit(0.0)
    drawn = rows.select(F.col(label).alias("label"), F.col(key).alias("_key")).where(F.pmod(F.xxhash64("_key"), F.lit(1 << 20)) < share * float(1 << 20))
    drawn = drawn.withColumn("_n", F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("_key", F.lit(1)), "_key"))).where(F.col("_n") <= SAMPLE)
    texts = rows.select(F.col(key).alias("_key"), F.col(text).alias("text"), F.col(label).alias("_label"))
    used = texts.join(F.broadcast(drawn.select("label", "_key")), "_key").where(F.col("label") == F.col("_label")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                code, n = trigrams(*strings(part.column("text")))
                owner = np.repeat(np.asarray(part.column("label").to_pylist(), object), n)
                for name in set(owner.tolist()):
                    found, times = np.unique(code[owner == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(times)], ["label", "bucket", "n"])

    totals = used.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(names)
    counts = np.zeros((len(names), BUCKETS))
    place = {name: i for i, name in enumerate(names)}
    counts[totals["label"].map(place).to_numpy(int), totals["bucket"].to_numpy(int)] = totals["n"].to_numpy(float)
    return TextModel(names, counts)


def page_evidence(pages: DataFrame) -> DataFrame:
    """key, text, declared, suffix, host, domain of raw pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[a-z]+;", " ")
    declared = F.lower(F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    host = F.lower(F.regexp_extract(F.col("url"), r"://([^/?#]*)", 1))
    segment = F.lower(F.regexp_extract(F.col("url"), r"://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    country = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.regexp_extract(host, r"\.([a-z]+)(?::\d+)?$", 1)]
    named = F.when(segment.isin(sorted(set(SUFFIXES.values()))), segment)
    return pages.select(F.col("page_id").alias("key"), bare.alias("text"), F.nullif(declared, F.lit("")).alias("declared"),
                        F.coalesce(named, country).alias("suffix"), F.nullif(host, F.lit("")).alias("host"),
                        F.nullif(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.lit("")).alias("domain"))


def _told(name: Column, languages: list[str], trust: float) -> Column:
    """Log-likelihood of a named language under each language; zeros if none or an unknown one is named."""
    other = (1 - trust) / max(len(languages) - 1, 1)
    per = F.transform(F.lit(languages), lambda x: F.when(name == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log(other)))))
    return F.when(name.isin(languages), per).otherwise(F.array_repeat(F.lit(0.0), len(languages)))


def _add(*parts: Column) -> Column:
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), parts)


def _best(logs: Column, languages: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position(logs, F.array_max(logs)).cast("int"))


def _prior(languages: list[str], wider: Column) -> Column:
    """Smoothed log-prior of a level from its counts and the wider level's probabilities."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)),
                       lambda i: (F.get("n", i) + PULL * F.get(wider, i)) / (F.col("total") + PULL))


def identify(evidence: DataFrame, model: TextModel, carry: list[str] | None = None) -> DataFrame:
    """key, carried columns, lang, confidence, text_lang, kept for rows of (key, text, declared, suffix, host, domain).

    A row is rejected (kept false) if its text has no letters, if no language makes its trigrams likelier than LEAST_LIFT times
    uniform, or if the best posterior is below CONFIDENCE; lang is then null for texts without letters. Null or unknown
    declarations, suffixes and hosts are no evidence. Ties go to the smaller name. Repeated rows are judged one by one and counted
    as often in the priors. With no labelled rows at all nothing is known and every row is rejected.
    """
    carry = carry or []
    languages = model.languages
    if not languages:
        return evidence.select("key", *carry, F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                               F.lit(None).cast("string").alias("text_lang"), F.lit(False).alias("kept"))
    shared = evidence.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, 131 kB, per language
    names = list(dict.fromkeys(["declared", "suffix", "host", "domain", "key", *carry]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, bounds = strings(part.column("text"))
                logs, n = shared.value.score(data, bounds)
                letters = np.diff(np.concatenate([[0], np.cumsum(_FOLD[data] != 32)])[bounds])
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(list(logs), pa.list_(pa.float64())), pa.array(n), pa.array(letters)],
                    [*names, "mean_log", "n_grams", "n_letters"])

    kinds = dict(evidence.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", mean_log array<double>, n_grams long, n_letters long"
    rows = stored(evidence.select(*dict.fromkeys([*names, "text"])).mapInArrow(score, schema), "language-evidence")
    size = F.least(F.col("n_grams").cast("double"), F.lit(WEIGHT))
    own = _add(F.transform("mean_log", lambda x: x * size), _told(F.col("declared"), languages, DECLARED), _told(F.col("suffix"), languages, SUFFIX))
    rows = rows.withColumn("own", own)
    counted = rows.where(F.col("n_letters") > 0).select("host", "domain", _best(F.col("own"), languages).alias("first"))
    tally = [F.count_if(F.col("first") == x).cast("double") for x in languages]
    hosts = stored(counted.groupBy("host", "domain").agg(F.array(*tally).alias("n"), F.count("*").alias("total")), "language-hosts")
    sums = F.array(*[F.sum(F.get("n", F.lit(i))) for i in range(len(languages))]).alias("n")
    every = hosts.agg(sums, F.sum("total").alias("total")).first()
    corpus = [((every["n"][i] or 0) + 1.0) / ((every["total"] or 0) + len(languages)) for i in range(len(languages))]
    domains = hosts.groupBy("domain").agg(sums, F.sum("total").alias("total"))
    domains = stored(domains.select(F.col("domain").alias("_domain"), _prior(languages, F.array(*map(F.lit, corpus))).alias("wide")), "language-domains")
    hosts = hosts.join(domains, F.col("domain").eqNullSafe(F.col("_domain")))
    hosts = stored(hosts.select(F.col("host").alias("_host"), F.col("domain").alias("_domain"), _prior(languages, F.col("wide")).alias("prior")), "language-priors")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host")) & F.col("domain").eqNullSafe(F.col("_domain")), "left")
    prior = F.when(F.col("host").isNotNull() & F.col("prior").isNotNull(), F.col("prior")).otherwise(F.array(*map(F.lit, corpus)))
    total = _add(F.col("own"), F.transform(prior, lambda x: F.log(x)))
    confidence = let(total, lambda t: let(F.array_max(t), lambda m: 1.0 / F.aggregate(t, F.lit(0.0), lambda a, x: a + F.exp(x - m))))
    found = joined.withColumn("total_log", total).select(
        "key", *carry, "n_grams", "n_letters", "mean_log", _best(F.col("total_log"), languages).alias("lang"), confidence.alias("confidence"),
        _best(F.col("mean_log"), languages).alias("text_lang"))
    some = F.col("n_letters") > 0
    lift = F.exp(F.array_max("mean_log")) * BUCKETS
    return found.select("key", *carry, F.when(some, F.col("lang")).alias("lang"), "confidence", F.when(some, F.col("text_lang")).alias("text_lang"),
                        (some & ((lift >= LEAST_LIFT) | (F.col("n_grams") == 0)) & (F.col("confidence") >= CONFIDENCE)).alias("kept"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """key, text, declared, suffix, host, domain of documents: their source stands for the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), none.alias("suffix"), F.col("source").alias("host"),
                       none.alias("domain"))


def identify_corpus(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Language of every page and every document: page_id or doc_id, declared, suffix, host, lang, confidence, text_lang, kept.

    The text model learns from the documents; priors are counted over both tables.
    """
    none = F.lit(None).cast("bigint")
    both = page_evidence(pages).withColumns({"page_id": F.col("key"), "doc_id": none}).unionByName(
        document_evidence(docs).withColumns({"page_id": none, "doc_id": F.col("key")}))
    return identify(both, train(docs), carry=["page_id", "doc_id", "declared", "suffix", "host"]).drop("key")


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that aren't rejected, with all their columns as they were.

    Their own declared languages train the text model and count as declarations, their sources count as hosts.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")
    none = F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("declared"), none.alias("suffix"),
                       F.col("source").alias("host"), none.alias("domain"), rest)
    found = identify(rows, train(docs), carry=["text", "_rest"]).where("kept")
    return found.select(*["text" if c == "text" else F.col(f"_rest.`{c}`") for c in docs.columns])
