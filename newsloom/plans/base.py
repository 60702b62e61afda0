"""What the queries read: the news tables, split by time.

The tables hold one stream of behaviour; impressions before ``SPLIT`` are the
train split, later ones the validation split.  Both splits share the history
table.  The SQL twins use the same definitions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.sources import load

SPLIT = "2016-01-29 00:00:00"
#: Share of articles from which an entity is too frequent to tie articles together.
HIGH_DF = 0.05


def articles(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "articles")


def behaviors(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    b = load(spark, d, "behaviors")
    return b if split is None else b.where(in_split(split))


def in_split(split: str) -> F.Column:
    late = F.coalesce(F.col("impression_time") >= F.lit(SPLIT).cast("timestamp_ntz"), F.lit(False))
    return late if split == "validation" else ~late


def history(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "history")


def split_sql(split: str) -> str:
    late = f"coalesce(impression_time >= timestamp '{SPLIT}', false)"
    return f"(select * from behaviors where {late if split == 'validation' else 'not ' + late})"


def _nfkc_sql(expression: str) -> str:
    """NFKC in SQL for the characters of these tables: what NFC doesn't do is replaced by rule."""
    one, other, many = [], [], []
    for block in (range(0xA0, 0x250), range(0x3F0, 0x400), range(0x2000, 0x2190), range(0x3000, 0x3001), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)):
        for code in block:
            ch = chr(code)
            norm = unicodedata.normalize("NFKC", ch)
            if norm != unicodedata.normalize("NFC", ch):
                if len(norm) == 1:
                    one.append(ch)
                    other.append(norm)
                else:
                    many.append((ch, norm))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({expression}, {quote(''.join(one))}, {quote(''.join(other))})"
    for ch, norm in many:
        out = f"replace({out}, {quote(ch)}, {quote(norm)})"
    return f"nfc_normalize({out})"


#: SQL twins of the text forms, as DuckDB macros can't be created by the driver: plain expressions.
WS = r"[\s\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def entity_text_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({_nfkc_sql(x)}, '{WS}+', ' ', 'g'), ' '))"


def entity_group_sql(x: str) -> str:
    return f"upper({strip_sql(_nfkc_sql(x))})"


def blank_sql(x: str) -> str:
    return f"({x} is null or {strip_sql(x)} = '')"
