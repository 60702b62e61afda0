"""Text forms shared by the entity operators."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(values: pd.Series) -> pd.Series:
    """NFKC, which no built-in function offers."""
    return values.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKC", s))


@F.pandas_udf(T.StringType())
def casefold_nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


def strip(c: Column) -> Column:
    """Without white space at either end, in the Unicode sense."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def entity_text(c: Column) -> Column:
    """A mention as it is compared."""
    return F.lower(collapse(nfkc(c)))


def entity_group(c: Column) -> Column:
    return F.upper(strip(nfkc(c)))


def entity_key(group: Column, text: Column) -> Column:
    return F.concat(group, F.lit("::"), text)


def word_tokens(c: Column) -> Column:
    """Letter-digit runs of an already normalised text."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def truncated(c: Column, chars: int) -> Column:
    """The first ``chars`` characters and an ellipsis, if there are more."""
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.regexp_replace(F.left(c, F.lit(chars)), r"(?U)\s+$", ""), F.lit(" …")))


def loose_cast(c: Column, kind: str) -> Column:
    """The value in another type, null where it can't be read as that."""
    return c.try_cast(kind)


def content_key(*parts: Column) -> Column:
    """Key of what is asked for, the same at every run: SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256)


@F.pandas_udf(T.StringType())
def character_name(characters: pd.Series) -> pd.Series:
    """Unicode name of a character; meant for the few distinct ones of an inventory."""
    return characters.map(lambda ch: None if ch is None else unicodedata.name(ch, f"U+{ord(ch):04X}"))
