"""Registered queries of the training-data operators, each over the whole of its table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, langid, licenses, lm, near_dup, packing, quality, subword, token_codec, topk, url_filter, warc, whitening
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def wrap(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return wrap


_FIGURES = "('symbol_pm', symbol_pm, 60), ('dup_line_pm', dup_line_pm, 400), ('repeat_pm', repeat_pm, 220), ('long_word_cp', long_word_cp, 400)"

#: Figures and verdicts of the quality rules over a relation ``docs(rid, doc_id, lang, source, text)``.
QUALITY_SQL = rf"""
words AS (
 SELECT rid, doc_id, lang, source, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
windows AS (
 SELECT rid, i, count(*) OVER (PARTITION BY rid, key) AS n
 FROM (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS key
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM words WHERE len(ws) > 7))),
repeats AS (
 SELECT rid, CAST(sum(CASE WHEN before IS NULL THEN 8 ELSE least(8, i - before) END) AS BIGINT) AS n_repeat_words
 FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM windows WHERE n > 1) GROUP BY rid),
counted AS (
 SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
 FROM words w LEFT JOIN repeats r ON w.rid = r.rid),
measured AS (
 SELECT *, CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS symbol_pm,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line_pm,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_pm,
  CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS long_word_cp FROM counted),
valued AS (
 SELECT rid, lang, source, f.figure, f.v, f.slack,
  CASE WHEN f.v < 64 THEN f.v ELSE (f.v // (1::BIGINT << (length(bin(f.v)) - 6))) * (1::BIGINT << (length(bin(f.v)) - 6)) END AS bucket
 FROM measured, LATERAL (VALUES {_FIGURES}) AS f(figure, v, slack)),
leveled AS (
 SELECT 1 AS level, lang, source, figure, slack, bucket FROM valued
 UNION ALL SELECT 2, lang, NULL, figure, slack, bucket FROM valued
 UNION ALL SELECT 3, NULL, NULL, figure, slack, bucket FROM valued),
sketch AS (SELECT level, lang, source, figure, slack, bucket, count(*) AS n FROM leveled GROUP BY ALL),
placed AS (
 SELECT *, sum(n) OVER (PARTITION BY level, lang, source, figure ORDER BY bucket) AS upto,
  sum(n) OVER (PARTITION BY level, lang, source, figure) AS total FROM sketch),
quantiles AS (
 SELECT level, lang, source, figure, max(total) AS total, max(slack) AS slack,
  min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS mid, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS high
 FROM placed GROUP BY ALL),
limits AS (SELECT level, lang, source, figure, total, high + 6 * (high - mid) + slack AS top FROM quantiles),
chosen AS (
 SELECT a.lang, a.source, a.figure, CASE WHEN a.total >= 64 THEN a.top WHEN b.total >= 64 THEN b.top ELSE c.top END AS top
 FROM limits a JOIN limits b ON b.level = 2 AND a.figure = b.figure AND a.lang IS NOT DISTINCT FROM b.lang
 JOIN limits c ON c.level = 3 AND a.figure = c.figure WHERE a.level = 1),
above AS (
 SELECT v.rid, bool_or(v.v > c.top) AS out FROM valued v JOIN chosen c
 ON v.figure = c.figure AND v.lang IS NOT DISTINCT FROM c.lang AND v.source IS NOT DISTINCT FROM c.source GROUP BY v.rid),
judged AS (
 SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT out AS kept FROM measured m JOIN above a ON m.rid = a.rid)"""


@query(f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, text FROM documents), {QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Figures and verdicts of the quality rules for every document."""
    docs = table(spark, folder, "documents")
    return quality.judge(docs, keep=["doc_id"]).select(
        F.col("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op8_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, written in doc_id order and read back."""
    return token_codec.read_tokens(token_codec.write_tokens(table(spark, folder, "documents")))


@query()
def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    cut = stored(packing.pieces(table(spark, folder, "documents")), "packing-pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(r"""
WITH RECURSIVE docs AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
shingles AS (
 SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
 FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
 SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
 SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS other FROM either UNION SELECT r.doc_id, e.b FROM reach r JOIN either e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id,
 d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN least l ON d.doc_id = l.doc_id""")
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles are 80 % alike."""
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every page and document from text, markup or declaration, address and host or source."""
    return langid.identify_corpus(table(spark, folder, "pages"), table(spark, folder, "documents"))


@query("""
WITH bodies AS (
 SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT payload_digest AS d, min(page_id) AS first FROM bodies WHERE octet_length(payload) >= 100 GROUP BY 1)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, payload_digest,
 CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to
FROM bodies LEFT JOIN firsts ON payload_digest = d AND octet_length(payload) >= 100""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records and read back by their index."""
    return warc.read_records(warc.archive(table(spark, folder, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's address, by rule or by the model of the labelled URL table."""
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, url_filter.train(url_filter.labelled_urls(spark)))


@query()
def op5_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of every document under the neural model, beside a smoothed unigram base."""
    return lm.score_texts(table(spark, folder, "documents"))


@query("""
WITH ints AS (
 SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
 SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM ints q JOIN ints c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5""")
def op2_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five best inner products of every fiftieth vector among all others."""
    return topk.top_k(table(spark, folder, "embeddings"))


@query()
def op6_sampled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Three distinct segmentations of every document and of every conversation turn, decoded again."""
    none = F.lit(None).cast("bigint")
    docs, turns = table(spark, folder, "documents"), table(spark, folder, "conversations")
    found = subword.sample_segmentations(docs, ["doc_id"]).withColumns({"conv_id": none, "turn": none}).unionByName(
        subword.sample_segmentations(turns, ["conv_id", "turn"]).withColumn("doc_id", none))
    return found.select("doc_id", "conv_id", "turn", "sample", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "log_prob", "inclusion", "log_inclusion", "decoded")


_TEMPLATES = licenses.standard()


def _license_sql() -> str:
    hit = lambda parts: f"regexp_matches(t, ' {licenses.pattern(parts)}')"
    listed = ", ".join(f"CASE WHEN {hit(parts)} THEN '{label}' END" for label, _, parts in _TEMPLATES)
    certain = ", ".join(f"CASE WHEN {hit(parts)} THEN {(m := licenses.mandatory(parts))} / ({m} + 2.0::DOUBLE) ELSE 0 END" for _, _, parts in _TEMPLATES)
    phrases = [(label, parts) for label, base, parts in _TEMPLATES if base]
    places = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label, i - 1 AS place FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM docs) WHERE "
        + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(parts)) for label, parts in phrases)
    return f"""
WITH texts AS (
 SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g') AS raw FROM documents),
docs AS (SELECT doc_id, ' ' || trim(raw) || ' ' AS t, list_filter(string_split(raw, ' '), lambda x: x <> '') AS ws FROM texts),
places AS ({places}),
based AS (
 SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
 FROM places GROUP BY doc_id),
scored AS (
 SELECT doc_id, len(ws) AS n_words, array_to_string(list_sort(list_distinct(list_filter([{listed}], lambda x: x IS NOT NULL))), ',') AS labels,
  greatest({certain}) AS score FROM docs)
SELECT s.doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, labels, score
FROM scored s LEFT JOIN based b ON s.doc_id = b.doc_id"""


@query(_license_sql())
def op12_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence wording in every document, by base phrases and by templates."""
    found, based = F.col("found"), F.filter("found", lambda x: x["base"])
    starts = F.transform(based, lambda x: x["first"])
    return licenses.scan(table(spark, folder, "documents"), keep=["doc_id"]).select(
        "doc_id", "n_words", F.size(based).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), licenses.labels(found, base=True).alias("base_labels"),
        licenses.labels(found).alias("labels"), licenses.score(found).alias("score"))


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of every conversation, after planted damage."""
    given = table(spark, folder, "conversations")
    repair = conversations.Repair(conversations.damaged(given))
    found = given.select("conv_id").distinct().unionByName(repair.totals, True).unionByName(repair.digests(), True)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
