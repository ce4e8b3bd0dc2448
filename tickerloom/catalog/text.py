"""Text, news and extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as tx
from ..functions import timekeys as tk
from ..functions.numbers import fixed
from ..operators import bar_features as bf
from ..operators import evidence as ev
from ..operators import near_duplicates as nd
from ..operators import news as nw
from ..operators import sessions
from .registry import query, rnd, view

WS = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def squeeze_sql(e):
    return f"regexp_replace(regexp_replace({e}, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')"


def q(s):
    return s.replace("'", "''")


def title_sql(e):
    return f"regexp_replace(translate({squeeze_sql(e)}, '{q(tx.FULL)}', '{q(tx.HALF)}'), '{K.SITE_SUFFIX_PATTERN}', '')"


def bare_sql(e):
    return f"regexp_replace(lower({e}), '[^\\x{{4E00}}-\\x{{9FA5}}a-z0-9]', '', 'g')"


def flat_sql(e):
    return f"lower(regexp_replace({title_sql(e)}, '{WS}+', '', 'g'))"


@query("f_normalise_keyword", """SELECT news_id, lower(regexp_replace(regexp_replace(regexp_replace(title, '""" + WS + """+', '', 'g'), '[()（）【】\\[\\]《》\"“”、,，.。:：;；/\\\\|-]', '', 'g'), '[ⅡⅢ]$', '')) AS norm FROM news""")
def f_normalise_keyword(v):
    return v.news.select("news_id", tx.norm_kw("title").alias("norm"))


SUFFIXED = "concat(title, CASE news_id % 4 WHEN 0 THEN ' - 新浪财经' WHEN 1 THEN '｜证券时报网' WHEN 2 THEN '　ＡＢＣ１２３！' ELSE '' END)"


@query("f_normalise_title", f"SELECT news_id, {title_sql(SUFFIXED)} AS norm FROM news")
def f_normalise_title(v):
    return v.news.select("news_id", tx.norm_title(F.expr(SUFFIXED)).alias("norm"))


@query("f_exact_dedup", f"""SELECT news_id FROM (SELECT news_id, published_at, concat_ws('::', {flat_sql('title')}, {flat_sql('content')}, '') AS k FROM news)
QUALIFY row_number() OVER (PARTITION BY k ORDER BY published_at, news_id) = 1""")
def f_exact_dedup(v):
    return nw.exact_dedup(v.news, [F.asc("published_at"), F.asc("news_id")]).select("news_id")


@query("f_dedup_key", f"SELECT news_id, sha256(concat_ws('::', {flat_sql('title')}, {flat_sql('content')}, source)) AS key_hash FROM news")
def f_dedup_key(v):
    """The key itself holds the whole text, so its digest is shown."""
    return v.news.select("news_id", F.sha2(tx.dedup_key("title", "content", "source"), 256).alias("key_hash"))


@query("f_bigrams", f"SELECT news_id, substr(b, i, 2) AS gram, count(*) AS tf FROM (SELECT news_id, b, unnest(range(1, length(b))) AS i FROM (SELECT news_id, {bare_sql('title')} AS b FROM news) WHERE length(b) >= 2) GROUP BY 1, 2")
def f_bigrams(v):
    return nd.gram_counts(v.news, "news_id", "title")


view("bare", f"SELECT news_id, source, published_at, {bare_sql('content')} AS b FROM news")
view("grams", "SELECT news_id, substr(b, i, 2) AS gram, count(*) AS tf FROM (SELECT news_id, b, unnest(range(1, length(b))) AS i FROM bare WHERE length(b) >= 2) GROUP BY 1, 2")


@query("f_ngrams", "SELECT news_id, gram, tf FROM grams")
def f_ngrams(v):
    return nd.gram_counts(v.news, "news_id", "content")


view("next_pairs", "SELECT a.news_id AS left_id, b.news_id AS right_id FROM news a JOIN news b ON b.news_id = a.news_id + 1")


def next_pairs(v):
    """Each item with the one of the following id: an equi-join, so no source or day gathers in one task."""
    ids = v.news.select("news_id")
    return ids.select(F.col("news_id").alias("left_id"), (F.col("news_id") + 1).alias("right_id")).join(
        ids.withColumnRenamed("news_id", "right_id"), "right_id", "left_semi").select("left_id", "right_id")


@query("f_cosine", f"""WITH p AS (SELECT * FROM next_pairs), n AS (SELECT news_id, sqrt(CAST(sum(tf * tf) AS DOUBLE)) AS norm FROM grams GROUP BY 1),
d AS (SELECT left_id, right_id, CAST(sum(a.tf * b.tf) AS DOUBLE) AS dot FROM p JOIN grams a ON a.news_id = left_id JOIN grams b ON b.news_id = right_id AND b.gram = a.gram GROUP BY 1, 2)
SELECT p.left_id, p.right_id, {rnd('coalesce(dot / (n1.norm * n2.norm), 0.0)', 10)} AS cosine FROM p LEFT JOIN d ON d.left_id = p.left_id AND d.right_id = p.right_id LEFT JOIN n n1 ON n1.news_id = p.left_id LEFT JOIN n n2 ON n2.news_id = p.right_id""")
def f_cosine(v):
    return nd.pair_cosine(next_pairs(v), v.news, "news_id", "content").withColumn("cosine", fixed("cosine", 10))


view("title_pairs", f"SELECT left_id, right_id, {bare_sql('a.title')} AS x, {bare_sql('b.title')} AS y FROM next_pairs JOIN news a ON a.news_id = left_id JOIN news b ON b.news_id = right_id")


@query("f_lcs_length", """WITH p AS (SELECT *, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM title_pairs),
c AS (SELECT left_id, max(CASE WHEN contains(l, substr(s, i, k)) THEN k ELSE 0 END) AS lcs FROM (SELECT left_id, s, l, i, unnest(range(1, length(s) - i + 2)) AS k FROM (SELECT left_id, s, l, unnest(range(1, length(s) + 1)) AS i FROM p WHERE length(s) > 0 AND length(s)::DOUBLE / length(l) >= 0.6)) GROUP BY 1)
SELECT p.left_id, p.right_id, coalesce(lcs, 0) AS lcs FROM p LEFT JOIN c ON c.left_id = p.left_id""")
def f_lcs_length(v):
    titles = v.news.select("news_id", tx.bare_text("title").alias("t"))
    rows = next_pairs(v).join(titles.select(F.col("news_id").alias("left_id"), F.col("t").alias("x")), "left_id").join(
        titles.select(F.col("news_id").alias("right_id"), F.col("t").alias("y")), "right_id")
    return rows.select("left_id", "right_id", tx.lcs_length("x", "y").alias("lcs"))


TERMS = ("tion of", "eaux le")


@query("j_near_dup_pairs", f"""WITH k AS (SELECT news_id, concat_ws(':', 'source', source, strftime(published_at, '%Y-%m-%d')) AS block FROM news
UNION ALL SELECT news_id, concat_ws(':', 'title', strftime(published_at, '%Y-%m-%d'), substr(t, 1, 12)) FROM (SELECT *, {bare_sql(title_sql('title'))} AS t FROM news) WHERE length(t) >= 6
UNION ALL SELECT news_id, concat_ws(':', 'kw', strftime(published_at, '%Y-%m-%d'), term) FROM news, (VALUES ('tion of'), ('eaux le')) w(term) WHERE contains(lower(title || ' ' || content), term))
SELECT block, count(*) AS members, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS pairs FROM k GROUP BY 1""")
def j_near_dup_pairs(v):
    """Blocks with their members; candidate pairs are counted, not emitted."""
    return nd.block_sizes(nd.blocking_keys(v.news, TERMS))


def _cosine_sql(field: str) -> str:
    return f"""SELECT p.a, p.b, CAST(sum(x.tf * y.tf) AS DOUBLE) / (sqrt(CAST(any_value(n.m) AS DOUBLE)) * sqrt(CAST(any_value(o.m) AS DOUBLE))) AS c
 FROM near_pairs p JOIN {field}_grams x ON x.news_id = p.a JOIN {field}_grams y ON y.news_id = p.b AND x.gram = y.gram
 JOIN {field}_mass n ON n.news_id = p.a JOIN {field}_mass o ON o.news_id = p.b GROUP BY 1, 2"""


view("unique_news", f"""SELECT news_id, title, content, source, published_at, row_number() OVER (ORDER BY published_at, news_id) AS ord FROM (
 SELECT *, concat_ws('::', {flat_sql('title')}, {flat_sql('content')}, '') AS k FROM news QUALIFY row_number() OVER (PARTITION BY k ORDER BY published_at, news_id) = 1)""")
view("near_blocks", f"""SELECT news_id, ord, concat_ws(':', 'source', source, strftime(published_at, '%Y-%m-%d')) AS block FROM unique_news
UNION ALL SELECT news_id, ord, concat_ws(':', 'title', strftime(published_at, '%Y-%m-%d'), substr(t, 1, 12)) FROM (SELECT *, {bare_sql(title_sql('title'))} AS t FROM unique_news) WHERE length(t) >= 6
UNION ALL SELECT news_id, ord, concat_ws(':', 'kw', strftime(published_at, '%Y-%m-%d'), term) FROM unique_news, (VALUES ('tion of'), ('eaux le')) w(term) WHERE contains(lower(title || ' ' || content), term)""")
view("near_pairs", "SELECT DISTINCT x.news_id AS a, x.ord AS ao, y.news_id AS b, y.ord AS bo FROM near_blocks x JOIN near_blocks y ON x.block = y.block AND x.ord < y.ord")
for _field in ("title", "content"):
    view(f"{_field}_grams", f"""SELECT news_id, substr(b, i, 2) AS gram, count(*) AS tf FROM (SELECT news_id, b, unnest(range(1, length(b))) AS i FROM (
 SELECT news_id, {bare_sql(title_sql(_field))} AS b FROM unique_news) WHERE length(b) >= 2) GROUP BY 1, 2""")
    view(f"{_field}_mass", f"SELECT news_id, sum(tf * tf) AS m FROM {_field}_grams GROUP BY 1")
view("near_edges", f"""SELECT p.ao, p.bo FROM near_pairs p LEFT JOIN ({_cosine_sql('title')}) t ON t.a = p.a AND t.b = p.b LEFT JOIN ({_cosine_sql('content')}) c ON c.a = p.a AND c.b = p.b
WHERE coalesce(t.c, 0) > 0.6::DOUBLE OR coalesce(c.c, 0) > 0.85::DOUBLE""")
view("news_groups", """WITH RECURSIVE adj AS (SELECT bo, list(ao ORDER BY ao) AS early FROM near_edges GROUP BY bo),
walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS leaders UNION ALL
 SELECT w.n + 1, CASE WHEN list_has_any(coalesce(early, []::BIGINT[]), leaders) THEN leaders ELSE list_append(leaders, w.n + 1) END
 FROM walk w LEFT JOIN adj ON bo = w.n + 1 WHERE w.n < (SELECT count(*) FROM unique_news)),
led AS (SELECT u.news_id, ord, CASE WHEN list_contains(leaders, ord) THEN ord ELSE list_filter(early, lambda e: list_contains(leaders, e))[1] END AS lead
 FROM unique_news u LEFT JOIN adj ON bo = ord, (SELECT leaders FROM walk ORDER BY n DESC LIMIT 1))
SELECT l.news_id, h.news_id AS group_id, CASE WHEN l.ord = l.lead THEN 1.0::DOUBLE ELSE 0.15::DOUBLE END AS weight, count(*) OVER (PARTITION BY l.lead) AS group_size
FROM led l JOIN led h ON l.lead = h.ord""")


def grouped(v):
    unique = nw.exact_dedup(v.news, [F.asc("published_at"), F.asc("news_id")])
    return nd.near_dup_groups(unique, TERMS)


@query("f_near_dup_groups", "SELECT news_id, group_id, weight, group_size FROM news_groups")
def f_near_dup_groups(v):
    return grouped(v)


@query("f_group_leader", "SELECT group_id, news_id FROM news_groups JOIN news USING (news_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY weight DESC, published_at, news_id) = 1")
def f_group_leader(v):
    return nd.group_leaders(grouped(v).join(v.news.select("news_id", "published_at"), "news_id"))


@query("a_dedup_audit", f"""WITH g AS (SELECT news_id, group_id, title, CAST(published_at AS DATE) AS day FROM news_groups JOIN news USING (news_id)),
c AS (SELECT day, group_id, count(*) AS n FROM g GROUP BY 1, 2),
t AS (SELECT day, CAST(sum(n) AS BIGINT) AS news, count(*) AS groups, count(*) FILTER (WHERE n > 1) AS multi_groups, CAST(sum(n - 1) AS BIGINT) AS reprints FROM c GROUP BY day),
s AS (SELECT day, count(*) AS suspects FROM (SELECT day, substr({title_sql('title')}, 1, 8) AS p, count(DISTINCT group_id) AS k FROM g GROUP BY 1, 2) WHERE length(p) >= 8 AND k > 1 GROUP BY day)
SELECT t.day, news, groups, multi_groups, reprints, coalesce(suspects, 0) AS suspects, reprints::DOUBLE / news AS reprint_rate FROM t LEFT JOIN s USING (day)""")
def a_dedup_audit(v):
    return nd.dedup_audit(grouped(v).join(v.news.select("news_id", "title", "published_at"), "news_id"))


WORDS = K.BUSINESS_WORDS + "|tion of|aux le"
view("rated", f"""SELECT news_id, source, tq AS title_quality, cq AS content_quality, hv AS has_variable, {rnd("least(1.0::DOUBLE, CASE tq WHEN 'normal' THEN 0.3::DOUBLE WHEN 'short' THEN 0.15 ELSE 0 END + CASE cq WHEN 'content' THEN 0.35::DOUBLE WHEN 'summary' THEN 0.25 WHEN 'title_only' THEN 0.1 ELSE 0 END + CASE WHEN hv THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN hs THEN 0.05::DOUBLE ELSE 0.1 END)")} AS quality FROM (
 SELECT *, CASE WHEN tl = 0 THEN 'empty' WHEN tl < 8 THEN 'short' ELSE 'normal' END AS tq, CASE WHEN cl = 0 THEN 'empty' WHEN cl <= tl + 4 THEN 'title_only' WHEN cl >= 80 THEN 'content' ELSE 'summary' END AS cq FROM (
 SELECT *, length({bare_sql('title')}) AS tl, length({bare_sql('content')}) AS cl, regexp_matches(title || ' ' || content, '({WORDS})') AS hv, regexp_matches(' ' || title || ' ' || content || ' ', '{K.STOCK_NAME_PATTERN}') AS hs FROM news))""")


@query("f_news_quality", "SELECT news_id, title_quality, content_quality, has_variable, quality, CASE WHEN quality < 0.3 THEN 'low_news_quality' WHEN NOT has_variable THEN 'missing_business_variable' END AS reason FROM rated")
def f_news_quality(v):
    return nw.news_quality(v.news, WORDS).select("news_id", "title_quality", "content_quality", "has_variable", "quality", "reason")


@query("a_news_source_summary", "SELECT source, count(*) AS visible, count(*) FILTER (quality >= 0.3 AND has_variable) AS effective, count(*) FILTER (has_variable) AS with_variable, count(*) FILTER (quality < 0.3) AS low_quality FROM rated GROUP BY 1")
def a_news_source_summary(v):
    return nw.source_summary(nw.news_quality(v.news, WORDS))


# Terms and patterns that occur in the generated languages, in the shape of the fixed dictionaries.
ASSETS = ("tion", "eaux", "ment", "ing", "chen", "ción")
PATTERNS = (("the rise", "positive", "(the|and).{0,8}(tion|er)"), ("la fall", "negative", "(le|la).{0,8}(ment|eaux)"), ("de risk", "negative", "(der|ung|iere)"))
view("rule_text", f"SELECT news_id, title, (SELECT count(DISTINCT source) FROM news) AS ns, regexp_replace(concat(title, '。', content), '{WS}+', '', 'g') AS t FROM news")
view("rules", "SELECT *, greatest(0, c - 48) AS s, least(length(t), c + 72) AS e FROM (SELECT r.*, a.keyword, p.variable, p.direction, greatest(strpos(t, a.keyword) - 1, CASE WHEN m = '' THEN -1 ELSE strpos(t, m) - 1 END, 0) AS c FROM (SELECT *, regexp_extract(t, p.pattern) AS m FROM rule_text, (VALUES "
     + ", ".join(f"('{n}', '{d}', '{p}')" for n, d, p in PATTERNS) + ") p(variable, direction, pattern)) r, (VALUES " + ", ".join(f"('{a}')" for a in ASSETS)
     + ") a(keyword), (SELECT 1) p0(x), LATERAL (SELECT r.variable, r.direction) p WHERE contains(t, a.keyword) AND m <> '')")
view("rule_out", f"SELECT news_id, keyword, variable AS business_variable, direction, {rnd('least(0.86::DOUBLE, 0.58::DOUBLE + CASE WHEN contains(title, keyword) OR contains(title, substr(variable, 1, 2)) THEN 0.08::DOUBLE ELSE 0 END + least(0.08::DOUBLE, ns * 0.02::DOUBLE))')} AS confidence, s AS start, e AS \"end\", substr(t, s + 1, e - s) AS evidence FROM rules")


def rules(v):
    return nw.rule_signals(v.news, ASSETS, PATTERNS)


@query("f_rule_signals", 'SELECT news_id, keyword, business_variable, direction, confidence, start, "end", evidence FROM rule_out')
def f_rule_signals(v):
    return rules(v)


BROKEN = "CASE WHEN news_id % 5 = 0 THEN concat(evidence, '#') ELSE evidence END"
RENAMED = "CASE WHEN news_id % 7 = 0 THEN 'zzzz' WHEN news_id % 7 = 1 THEN 'yyyy' ELSE keyword END"
view("checked", f"""SELECT news_id, business_variable, base, keyword, CASE WHEN pos < 0 THEN NULL ELSE pos END AS offset_start, CASE WHEN pos < 0 THEN NULL ELSE pos + length(p) END AS offset_end,
 CASE WHEN pos < 0 THEN 'evidence_text_not_found' WHEN NOT (contains(concat(p, '。', t), keyword) OR (keyword = 'yyyy' AND contains(concat(p, '。', t), 'tion'))) THEN 'keyword_not_supported_by_evidence' END AS failure
 FROM (SELECT r.news_id, business_variable, r.keyword AS base, {RENAMED.replace('news_id', 'r.news_id').replace('ELSE keyword', 'ELSE r.keyword')} AS keyword, lower(x.t) AS t, lower({BROKEN.replace('news_id', 'r.news_id')}) AS p, strpos(lower(x.t), lower({BROKEN.replace('news_id', 'r.news_id')})) - 1 AS pos FROM rule_out r JOIN rule_text x ON x.news_id = r.news_id)""")


@query("f_validate_signals", "SELECT news_id, business_variable, keyword, offset_start, offset_end, failure, CASE WHEN failure IS NULL THEN 'candidate' ELSE 'rejected' END AS status FROM checked")
def f_validate_signals(v):
    """Some evidence is broken and some keywords are replaced; one replacement has a synonym."""
    signals = rules(v).withColumn("evidence", F.expr(BROKEN)).withColumn("keyword", F.expr(RENAMED))
    synonyms = v.spark.range(1).select(F.lit("yyyy").alias("keyword"), F.lit("tion").alias("synonym"))
    return nw.validate_signals(signals, v.news, synonyms).select(
        "news_id", "business_variable", "keyword", "offset_start", "offset_end", "failure", "status")


KNOWN = "['tion', 'ment', 'ung']"


@query("f_entities", f"""
WITH t AS (SELECT news_id, regexp_replace(regexp_replace(concat_ws(' ', title, content), '[，。；：、“”‘’（）()【】《》,.;:!?]', '', 'g'), '[\\s\\x0B]', '', 'g') AS x FROM news),
c AS (SELECT news_id, list_concat(list_filter([CASE WHEN contains(x, 'tion') OR contains(x, 'ción') THEN 'nation' END, CASE WHEN contains(x, 'eaux') THEN 'water' END], lambda e: e IS NOT NULL),
  list_filter({KNOWN}, lambda k: contains(x, k)),
  list_filter(regexp_extract_all(x, '[a-zéèê]{{2,12}}'), lambda r: r <> 'mention' AND (contains(r, 'tion') OR contains(r, 'ment') OR contains(r, 'ung')))) AS l FROM t),
d AS (SELECT news_id, list_filter(l, lambda e, i: list_position(l, e) = i) AS l FROM c),
r AS (SELECT news_id, list_sort(list_transform(l, lambda e, i: {{'a': CASE WHEN list_contains({KNOWN}, e) THEN 0 ELSE 1 END, 'b': -length(e), 'c': i, 'e': e}})) AS l FROM d)
SELECT news_id, array_to_string(list_reduce(list_concat([[]::VARCHAR[]], list_transform(l, lambda x: [x.e])),
 lambda acc, x: CASE WHEN len(list_filter(acc, lambda held: contains(held, x[1]) OR contains(x[1], held))) > 0 THEN acc ELSE list_concat(acc, x) END)[1:6], ',') AS entities FROM r""")
def f_entities(v):
    out = nw.entities(v.news, {"nation": ["tion", "ción"], "water": ["eaux"]}, ["tion", "ment", "ung"], ["mention"], "[a-zéèê]{2,12}")
    return out.withColumn("entities", F.array_join("entities", ","))


def at_():
    return tk.instant("2000-01-15 16:00:00")

DAYS = "(epoch_us(TIMESTAMP '2000-01-15 16:00:00') - epoch_us(published_at)) / 86400e6"


@query("f_time_decay", "SELECT news_id, " + ", ".join(
    f"{rnd(f'CASE WHEN d < 0 OR d > {w} THEN 0.0 ELSE exp(d * (-0.6931471805599453::DOUBLE / {h})) END', 8)} AS {n}" for n, (h, w) in K.DECAY_PROFILES.items())
    + f" FROM (SELECT news_id, {DAYS} AS d FROM news)")
def f_time_decay(v):
    return v.news.select("news_id", *[fixed(ev.time_decay(F.col("published_at"), at_(), p), 8).alias(p) for p in K.DECAY_PROFILES])


B = f"CASE WHEN member_count > 0 THEN greatest(0.08, {rnd('1.0::DOUBLE / sqrt(member_count::DOUBLE)')}) ELSE 1.0 END"


@query("f_breadth_weight", f"SELECT fact_id, {B} AS weight FROM facts")
def f_breadth_weight(v):
    return v.facts.select("fact_id", ev.breadth("member_count").alias("weight"))


@query("f_exposure_precision", f"""SELECT fact_id, {rnd(f"greatest(0.0, least(15.0, pb * confidence * (0.5::DOUBLE + 0.5::DOUBLE * b)))")} AS "precision" FROM (SELECT *, {B} AS b,
 CASE exposure_type WHEN 'business_exposure' THEN 15.0 WHEN 'concept_exposure' THEN 12.0 ELSE CASE taxonomy_level WHEN 'SW3' THEN 10.0 WHEN 'SW2' THEN 7.0 ELSE 4.0 END END::DOUBLE AS pb FROM facts)""")
def f_exposure_precision(v):
    return v.facts.select("fact_id", ev.precision("exposure_type", "taxonomy_level", "confidence", ev.breadth("member_count")).alias("precision"))


MC = rnd("greatest(0.45::DOUBLE, CASE {l} WHEN 'SW3' THEN 0.92::DOUBLE WHEN 'SW2' THEN 0.84 ELSE 0.76 END - least(0.28::DOUBLE, greatest(0, {m} - 30) * 0.002::DOUBLE))")


@query("f_industry_confidence", f"SELECT fact_id, {MC.format(l='taxonomy_level', m='fact_id % 300')} AS confidence FROM facts")
def f_industry_confidence(v):
    return v.facts.select("fact_id", ev.member_confidence("taxonomy_level", F.col("fact_id") % 300).alias("confidence"))


view("board_rows", """SELECT p_brand AS board, concat('SW', CAST(1 + CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 AS STRING)) AS level,
 CASE WHEN p_partkey % 9 = 0 THEN concat('bad', CAST(p_partkey AS STRING)) ELSE concat('sh', lpad(CAST(600000 + p_partkey % 1500 AS STRING), 6, '0')) END AS raw, CASE WHEN p_partkey % 9 <> 0 THEN CAST(600000 + p_partkey % 1500 AS STRING) END AS symbol FROM part""")


@query("f_membership_facts", f"""SELECT board, level, raw, b.symbol, n AS member_count, CASE WHEN b.symbol IS NULL THEN 'unsupported_symbol_format' WHEN s.symbol IS NULL THEN 'stock_not_found' END AS failure,
 CASE WHEN s.symbol IS NULL THEN 'rejected' ELSE 'candidate' END AS status, CASE WHEN s.symbol IS NULL THEN 0.0 ELSE {MC.format(l='level', m='n')} END AS confidence
FROM (SELECT *, count(*) OVER (PARTITION BY board) AS n FROM board_rows) b LEFT JOIN (SELECT DISTINCT symbol FROM stocks) s ON s.symbol = b.symbol""")
def f_membership_facts(v):
    part = F.col("p_partkey")
    code = F.when(part % 9 == 0, F.concat(F.lit("bad"), part.cast("string"))).otherwise(
        F.concat(F.lit("sh"), F.lpad((600000 + part % 1500).cast("string"), 6, "0")))
    boards = v.table("part").select(
        F.col("p_brand").alias("board"),
        F.concat(F.lit("SW"), (1 + F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") % 3).cast("string")).alias("level"),
        F.array(code).alias("members"))
    return nw.membership_facts(boards, v.stocks)


@query("f_read_json_score", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 2 END AS score FROM events""")
def f_read_json_score(v):
    number = F.regexp_extract("props", "([0-9]+)", 1)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"score": "'), number, F.lit('"}'))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit('{"score": "n/a", "rawScores": {"score": '), (number.cast("double") / 2).cast("string"), F.lit("}}"))
    ).otherwise(F.lit('{"other": 1}'))
    return v.table("events").select("event_id", tx.json_number(text, "score", "total").alias("score"))


@query("f_parse_reason", "SELECT stock_key, CAST(stock_key * 0.5 AS DOUBLE) AS evidence, CAST(stock_key * 0.25 AS DOUBLE) AS graph, 13.5::DOUBLE AS exposure, 6.25::DOUBLE AS market, CAST(stock_key AS DOUBLE) AS total FROM stocks")
def f_parse_reason(v):
    key = F.col("stock_key")
    line = F.format_string("评分组件：证据 %.4f/45，图谱 %.4f/20，暴露 13.5000/15，市场 6.2500/20，总分 %.4f/100",
                           key * F.lit(0.5).cast("double"), key * F.lit(0.25).cast("double"), key.cast("double"))
    return v.stocks.select("stock_key", tx.parse_components(line).alias("c")).select("stock_key", "c.*")


@query("f_bucket_key", "SELECT event_id, time_bucket(INTERVAL '15' MINUTE, ts + INTERVAL '8' HOUR) AS bucket FROM events")
def f_bucket_key(v):
    return v.table("events").select("event_id", tk.bucket(F.col("ts").cast("timestamp"), 15).alias("bucket"))


def plan_sql(x, d=2):
    return rnd(x, d)


@query("f_trade_plan", f"""SELECT stock_key, trading_day, {plan_sql('close')} AS price, {plan_sql("close * CASE WHEN hot THEN 0.94 ELSE 0.97 END::DOUBLE")} AS buy_low, {plan_sql("close * CASE WHEN hot THEN 0.985 ELSE 1.01 END::DOUBLE")} AS buy_high,
 {plan_sql("close * CASE WHEN volume % 300 = 0 THEN 0.91 ELSE 0.9 END::DOUBLE")} AS stop_loss, {plan_sql("close * CASE WHEN breakout = 1 THEN 1.08 ELSE 1.06 END::DOUBLE")} AS target_low, {plan_sql("close * CASE WHEN breakout = 1 THEN 1.16 ELSE 1.12 END::DOUBLE")} AS target_high
FROM (SELECT *, coalesce(momentum5 >= 0.12, false) AS hot FROM feat2)""")
def f_trade_plan(v):
    rows = bf.breakout(bf.momentum(v.bars, 5, "momentum5")).withColumn(
        "stage", F.when(F.col("volume") % 300 == 0, "A").otherwise("B"))
    return sessions.trade_plan(rows).select(
        "stock_key", "trading_day", "price", "buy_low", "buy_high", "stop_loss", "target_low", "target_high")


view("cand_rows", f"SELECT news_id % (SELECT count(*) FROM supplier) AS stock_key, keyword AS word, news_id, confidence, {BROKEN} AS evidence FROM rule_out")


def fact_candidates(v):
    return rules(v).select((F.col("news_id") % v.counts["supplier"]).alias("stock_key"), "keyword", "news_id", "confidence",
                           F.expr(BROKEN).alias("evidence"))


@query("d_promote_evidence", """WITH ok AS (SELECT c.*, contains(lower(x.t), lower(evidence)) AS good FROM cand_rows c JOIN rule_text x ON x.news_id = c.news_id)
SELECT stock_key, word AS keyword, arg_max(news_id, (confidence, -news_id)) AS news_id, max(confidence) AS confidence, 'active' AS status FROM ok WHERE good AND word <> 'ing' GROUP BY 1, 2""")
def d_promote_evidence(v):
    """Facts already held: the keyword 'ing' for every stock."""
    held = v.stocks.select("stock_key", F.lit("ing").alias("keyword"))
    return nw.promote(nw.validate_candidates(fact_candidates(v), v.news), held)


@query("a_outcome_contract", f"""WITH o AS (SELECT doc_id AS news_id, CASE WHEN quality = 1 THEN 'signals' ELSE 'no_signal' END AS status FROM labels UNION ALL SELECT doc_id, 'no_signal' FROM labels WHERE toxic = 1
 UNION ALL SELECT doc_id + 1000000000, 'signals' FROM labels WHERE toxic = 1),
t AS (SELECT news_id, count(*) AS n, min(status) AS status FROM o GROUP BY 1), s AS (SELECT news_id, count(*) AS signals FROM rule_out GROUP BY 1),
b AS (SELECT coalesce(e.news_id, t.news_id) AS news_id, e.news_id IS NOT NULL AS known, n, status, coalesce(signals, 0) AS sg FROM (SELECT news_id FROM news) e FULL JOIN t ON t.news_id = e.news_id LEFT JOIN s ON s.news_id = coalesce(e.news_id, t.news_id))
SELECT news_id, issue FROM (SELECT news_id, unnest([CASE WHEN NOT known THEN 'unknown_news' END, CASE WHEN n IS NULL THEN 'missing_news' END, CASE WHEN n > 1 THEN 'duplicate_news' END, CASE WHEN status = 'signals' AND sg = 0 THEN 'empty_signals' END, CASE WHEN status = 'no_signal' AND sg > 0 THEN 'unexpected_signals' END]) AS issue FROM b) WHERE issue IS NOT NULL
UNION ALL SELECT DISTINCT news_id, 'evidence_not_found' FROM rule_out WHERE news_id % 5 = 0""")
def a_outcome_contract(v):
    labels = v.table("labels")
    outcomes = labels.select(F.col("doc_id").alias("news_id"), F.when(F.col("quality") == 1, "signals").otherwise("no_signal").alias("status"))
    extra = labels.where("toxic = 1")
    outcomes = outcomes.unionByName(extra.select(F.col("doc_id").alias("news_id"), F.lit("no_signal").alias("status"))).unionByName(
        extra.select((F.col("doc_id") + 1000000000).alias("news_id"), F.lit("signals").alias("status")))
    return nw.check_outcomes(v.news.select("news_id"), outcomes, rules(v).withColumn("evidence", F.expr(BROKEN)), v.news)


WORD = "[^A-Za-z0-9\\x{4E00}-\\x{9FFF}]+"
view("case_terms", f"""SELECT DISTINCT case_id, term FROM (SELECT case_id, unnest(regexp_split_to_array(t, '{WORD}')) AS term FROM (
 SELECT item_id AS case_id, unnest([symbol, name]) AS t FROM benchmark JOIN stocks ON stock_key = item_id % (SELECT count(*) FROM supplier)
 UNION ALL SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{{7,}}')) FROM benchmark)) WHERE length(term) >= 2""")


@query("k_relevant_news", """WITH t AS (SELECT case_id, news_id, published_at, CASE WHEN contains(title, term) THEN 5 ELSE 1 END AS p FROM case_terms, news WHERE contains(concat_ws(chr(10), title, content), term)
 UNION ALL SELECT case_id, news_id, published_at, 0 FROM (SELECT DISTINCT case_id FROM case_terms), (SELECT news_id, published_at FROM news ORDER BY published_at DESC, news_id DESC LIMIT 5)),
k AS (SELECT case_id, news_id, published_at, sum(p) AS score FROM t GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, published_at DESC, news_id DESC) <= 5)
SELECT case_id, news_id, published_at, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY case_id ORDER BY published_at, news_id) AS position FROM k""")
def k_relevant_news(v):
    """Every benchmark item is a case of some stock; its long words are the keywords of its exposures."""
    items = v.table("benchmark")
    cases = items.select(F.col("item_id").alias("case_id"), (F.col("item_id") % v.counts["supplier"]).alias("stock_key")).join(
        v.stocks.select("stock_key", "symbol", F.col("name").alias("stock_name")), "stock_key")
    exposures = items.select(F.col("item_id").alias("case_id"), F.lit(None).cast("string").alias("stock_name"),
                             F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{7,})"))).alias("keyword"))
    return nw.relevant_news(nw.relevance_terms(cases, exposures), v.news, 5)
