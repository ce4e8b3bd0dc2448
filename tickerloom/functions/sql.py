"""The column functions as temporary SQL functions, so they can be used from spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import constants as K
from .text import BLANK, FULL, HALF


def _quote(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def definitions() -> dict[str, str]:
    """Signature to body."""
    themes = " ".join(f"WHEN x RLIKE '{pattern}' THEN '{name}'" for name, pattern in K.THEME_BUCKETS)
    squeezed = f"regexp_replace(regexp_replace(x, {_quote(f'^{BLANK}+|{BLANK}+$')}, ''), {_quote(BLANK + '+')}, ' ')"
    return {
        "norm_kw(x STRING) RETURNS STRING":
            f"lower(regexp_replace(regexp_replace(regexp_replace(x, {_quote(BLANK + '+')}, ''), {_quote(K.KEYWORD_PUNCTUATION)}, ''), "
            f"{_quote(K.KEYWORD_NUMERALS)}, ''))",
        "norm_title(x STRING) RETURNS STRING":
            f"regexp_replace(translate({squeezed}, {_quote(FULL)}, {_quote(HALF)}), {_quote(K.SITE_SUFFIX_PATTERN)}, '')",
        "time_decay(published TIMESTAMP, as_of TIMESTAMP, half_life DOUBLE, max_days DOUBLE) RETURNS DOUBLE":
            "CASE WHEN as_of < published OR (unix_micros(as_of) - unix_micros(published)) / 86400e6 > max_days THEN 0D "
            "ELSE exp((unix_micros(as_of) - unix_micros(published)) / 86400e6 * -ln(2) / half_life) END",
        "breadth(members BIGINT) RETURNS DOUBLE":
            f"CASE WHEN members > 0 THEN greatest({K.BREADTH_FLOOR}D, floor(1 / sqrt(members) * 1e4 + 0.5) / 1e4) ELSE 1D END",
        "direction_weight(x STRING) RETURNS DOUBLE":
            "CASE x WHEN 'positive' THEN 1D WHEN 'mixed' THEN 0.35D WHEN 'negative' THEN -1D ELSE 0D END",
        "theme_bucket(x STRING) RETURNS STRING": f"CASE {themes} ELSE x END",
        "limit_pct(symbol STRING, name STRING) RETURNS DOUBLE":
            "CASE WHEN startswith(upper(name), '*ST') OR startswith(upper(name), 'ST') THEN 0.05D WHEN symbol RLIKE '^(300|301|68)' THEN 0.2D "
            "WHEN symbol RLIKE '^[849]' THEN 0.3D ELSE 0.1D END",
    }


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for signature, body in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in definitions()]
