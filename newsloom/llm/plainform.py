"""One consistent form of texts that look the same (problem 1).

Method: the vocabulary of the corpus' plain words is held in tries, which a
weighted edit automaton traverses for each odd word: look-alike letters and
ignorable characters are free of cost.  The canonical spelling is the word of
least cost, then the most frequent.  Words without a match are normalised by
table.

Layout: texts are made distinct before anything else, so a reprint costs once.
Only texts with a character outside the plain ranges (a JVM pattern) go on to
Python.  The vocabulary is cut into shards by a hash of the words' skeletons, so
each trie has a bounded size and none is broadcast.  A skeleton is equal for any
two words that match free of cost: with budget 0 (the default) an odd word goes
to the shard of its skeleton and no match is missed.  With a budget above 0 its
matches may stand in any shard: it goes to all of them, and the best of their
answers is taken, whatever the number of shards.

Defined results: null texts stay null; empty and blank texts are plain;
ordinary spaces are left as they are; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.lookalikes import ODD_TEXT, WORD, Trie, is_odd, plain_text, skeleton
from newsloom.runtime import Scratch

#: Words of a trie, on average.
SHARD_WORDS = 20_000


@F.pandas_udf(T.StringType())
def skeleton_udf(words: pd.Series) -> pd.Series:
    return words.map(skeleton)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("odd", T.BooleanType())])))
def tokens_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"token": m.group(), "odd": is_odd(m.group())} for m in WORD.finditer(t)])


@F.pandas_udf(T.StringType())
def plain_udf(texts: pd.Series, tokens: pd.Series, found: pd.Series) -> pd.Series:
    def one(t: str, keys: list | None, words: list | None) -> str:
        return plain_text(t, dict(zip(keys, words, strict=True)) if keys is not None else {})

    return pd.Series([one(t, k, w) for t, k, w in zip(texts, tokens, found, strict=True)])


FOUND = "token string, cost double, rank bigint, canonical string"


def _read_shard(budget: float):
    def read(_: tuple, words: pd.DataFrame, odd: pd.DataFrame) -> pd.DataFrame:
        found = []
        if not odd.empty and not words.empty:
            trie = Trie()
            for w, n in zip(words["word"], words["n"], strict=True):
                trie.add(w, int(n))
            found = [(t, *best) for t in odd["token"] if (best := trie.best(t, budget))]
        return pd.DataFrame(found, columns=["token", "cost", "rank", "canonical"]).astype({"cost": "float64", "rank": "int64"})

    return read


def plain_forms(texts: DataFrame, scratch: Scratch, budget: float = 0.0, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``text, plain`` for the distinct texts (column ``text``) that hold an odd character."""
    distinct = scratch.keep(texts.where("text is not null").groupBy("text").agg(F.count("*").alias("n")))
    odd_texts = distinct.where(F.col("text").rlike(ODD_TEXT))
    tokens = scratch.keep(odd_texts.select("text", "n", F.posexplode(tokens_udf("text")).alias("pos", "t")).select("text", "n", "pos", "t.token", "t.odd"))
    words = (
        distinct.where(~F.col("text").rlike(ODD_TEXT))
        .select("n", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
        .unionByName(tokens.where("not odd").select("n", F.lower("token").alias("word")))
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )
    vocabulary = scratch.keep(words.withColumn("skeleton", skeleton_udf("word")))
    shards = max(4, vocabulary.count() // shard_words + 1)
    shard = F.pmod(F.xxhash64("skeleton"), F.lit(shards)).alias("shard")
    odd = tokens.where("odd").select("token").distinct().withColumn("skeleton", skeleton_udf("token"))
    meets = shard if budget == 0 else F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))).alias("shard")
    found = (
        vocabulary.select(shard, "word", "n")
        .groupBy("shard")
        .cogroup(odd.select(meets, "token").groupBy("shard"))
        .applyInPandas(_read_shard(budget), FOUND)
    )
    if budget > 0:
        found = found.groupBy("token").agg(F.min(F.struct("cost", "rank", "canonical")).alias("b")).select("token", "b.canonical")
    spelt = tokens.where("odd").select("text", "token").distinct().join(found, "token", "left").groupBy("text").agg(F.collect_list(F.struct("token", "canonical")).alias("m"))
    return odd_texts.select("text").join(spelt, "text", "left").select("text", plain_udf("text", F.col("m.token"), F.col("m.canonical")).alias("plain"))
