"""Text normalisation, n-grams and substring measures as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .numbers import col

HALF = "".join(chr(c) for c in range(0x21, 0x7F))
# Fixed value: the blanks a Unicode-aware \\s covers.
BLANK = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
#: The same blanks one by one: a translation drops them without a pattern.
BLANKS = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Frequent characters that a bare text never holds; U+0130 is none, as its lower case begins with an i.
NEVER_BARE = "".join(chr(c) for c in range(1, 0x180) if not (c < 0x80 and chr(c).isalnum()) and c != 0x130)
#: Characters at the end of a text searched for a site suffix; no suffix without its separators is as long.
TAIL = 200


def norm_kw(c: Column | str) -> Column:
    """Keyword without blanks, punctuation and a trailing numeral, lower-cased."""
    bare = F.regexp_replace(drop_blanks(c), K.KEYWORD_PUNCTUATION, "")
    return F.lower(F.regexp_replace(bare, K.KEYWORD_NUMERALS, ""))


def drop_blanks(c: Column | str) -> Column:
    return F.translate(col(c), BLANKS, "")


def squeeze(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), f"^{BLANK}+|{BLANK}+$", ""), BLANK + "+", " ")


def norm_title(c: Column | str) -> Column:
    """Half-width form without a site suffix."""
    return F.regexp_replace(F.translate(squeeze(c), FULL, HALF), K.SITE_SUFFIX_PATTERN, "")


def bare_text(c: Column | str) -> Column:
    """Lower-case letters, digits and Chinese characters only."""
    return F.regexp_replace(F.lower(F.translate(col(c), NEVER_BARE, "")), r"[^\x{4E00}-\x{9FA5}a-z0-9]", "")


def without_suffix(c: Column | str) -> Column:
    """Text up to its site suffix; blanks and widths before its last characters stay as they are.

    Where the last characters are nothing but separators and a suffix, separators before them belong to it, and all is searched.
    """
    text = F.rtrim(col(c), F.lit(BLANKS))
    end = norm_title(F.concat(F.lit("x"), F.right(text, F.lit(TAIL))))  # a letter in front keeps blanks there from being trimmed
    return F.when((F.length(text) <= TAIL) | (F.length(end) < 3), norm_title(c)).otherwise(
        F.concat(F.left(text, F.length(text) - TAIL), F.substr(end, F.lit(2))))


def bare_title(c: Column | str) -> Column:
    """bare_text of norm_title, without patterns over a long text."""
    return bare_text(F.translate(without_suffix(c), FULL, HALF))


def dedup_key(title: Column | str, content: Column | str, url: Column | str) -> Column:
    def flat(c: Column | str) -> Column:
        return F.lower(F.translate(without_suffix(c), FULL + BLANKS, HALF))

    return F.concat_ws("::", flat(title), flat(content), F.coalesce(col(url), F.lit("")))


def let(value: Column, fn) -> Column:
    """Bind a computed value once; a plain expression used inside a lambda would be recomputed per element."""
    return F.transform(F.array(value), fn)[0]


def ngrams(c: Column | str, n: int) -> Column:
    """All character n-grams in order, repeats kept; linear in the text (array access, no substring scans)."""
    def grams(chars: Column) -> Column:
        size = F.size(chars)
        return F.when(size >= n, F.transform(
            F.sequence(F.lit(0), size - n), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(
            F.array().cast("array<string>"))

    return let(F.filter(F.split(col(c), ""), lambda x: x != ""), grams)


def gram_set(c: Column | str, n: int) -> Column:
    return F.array_distinct(ngrams(c, n))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Longest common substring; 0 when the lengths differ too much (ratio below 0.6).

    Scanning end positions of the shorter text, the best length can grow by at
    most one per position, so one containment test each suffices.
    """
    a, b = col(a), col(b)

    def measure(pair: Column) -> Column:
        short, long = pair["s"], pair["l"]
        grown = F.aggregate(
            F.sequence(F.lit(1), F.length(short)), F.lit(0),
            lambda best, i: F.when((i > best) & F.contains(long, F.substring(short, i - best, best + 1)), best + 1).otherwise(best))
        return F.when((F.length(short) == 0) | (F.length(short) / F.length(long) < 0.6), 0).otherwise(grown)

    return let(F.when(F.length(a) <= F.length(b), F.struct(a.alias("s"), b.alias("l"))).otherwise(
        F.struct(b.alias("s"), a.alias("l"))), measure)


def sentences(c: Column | str) -> Column:
    """Trimmed non-empty segments between sentence marks and line breaks."""
    parts = F.split(col(c), r"[。！？!?；;\n\r]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def support_text(title: Column | str, content: Column | str) -> Column:
    """Text against which evidence is checked: title and content, blanks dropped, lower case."""
    return F.lower(drop_blanks(F.concat(col(title), F.lit("。"), col(content))))


def json_number(c: Column | str, *paths: str) -> Column:
    """First finite number among JSON paths, each also tried under rawScores."""
    c = col(c)
    tries = []
    for p in paths:
        for path in (f"$.{p}", f"$.rawScores.{p}"):
            value = F.get_json_object(c, path).try_cast("double")
            tries.append(F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value))
    return F.coalesce(*tries)


def parse_components(c: Column | str) -> Column:
    """Component scores from a formatted score line."""
    c = col(c)

    def part(label: str) -> Column:
        return F.nullif(F.regexp_extract(c, label + r"\s+(-?[\d.]+)/", 1), F.lit("")).try_cast("double")

    # Labels of the score line.
    return F.struct(part("证据").alias("evidence"), part("图谱").alias("graph"), part("暴露").alias("exposure"),
                    part("市场").alias("market"), part("总分").alias("total"))
