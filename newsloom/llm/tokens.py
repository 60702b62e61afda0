"""Encoding a corpus with a public byte-level BPE vocabulary (problem 7).

Method: Spark higher-order functions fold ranked merges over the byte arrays of
the distinct words, with the rank table as a literal map in the plan.

* Texts are cut into words by the vocabulary's pattern (``regexp_extract_all``).
* The words of the corpus are counted; every *distinct* word is encoded once.
  A word is the string of its bytes (ISO-8859-1), each in brackets; one step of
  the fold finds the adjacent pair of lowest rank and replaces it wherever it
  stands, left to right.  A merged pair never has a rank below the pair it was
  made of, so replacing all places at once gives the same as one at a time.
* The rank table is one literal, bound once: an array of small maps, addressed by
  CRC-32, so that a lookup doesn't scan 50 000 keys.
* A step looks at the whole word, so words above ``LONG`` bytes (an unbroken
  string may have any length) are folded in segments, distributed over tasks.  A
  list of pieces is the encoding of its text exactly if each two neighbours are
  the encoding of theirs; so where two segments meet, their two pieces are folded
  by themselves, and only segments that fail are folded again together, cut anew
  between two pieces of the result and looked at again.
* Encoded words return to the texts without a shuffle: the ``frequent`` most
  frequent words form a dictionary of bounded size (a one-row subquery of the
  same array-of-maps form).  Texts that hold a rarer word take an exact second
  way: what was looked up is written once, and the missing words are joined with
  their encodings by shuffle and filled in.

Defined results: null and empty texts give an empty list; text that looks like
a special token is ordinary text; texts of any length are encoded whole; rows
with a null or a repeated key are encoded each by itself.
"""

from __future__ import annotations

import base64
import json
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.runtime import Scratch

#: Column that numbers the rows whose gaps are filled.
ROW = "__row_of_gaps"
#: Where the public vocabulary lies; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that this vocabulary's texts are cut by; (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bound of the dictionary of frequent words; rarer words are joined.
FREQUENT = 200_000
#: Words of more bytes are folded in segments, of so many bytes at first.  Failures are mended in pairs for so many rounds;
#: what still moves along a word by then (the rest of a repeated letter) is joined with 4, 8, 16 ... segments: such a fold has few steps.
LONG, SEGMENT, PAIR_ROUNDS = 160, 64, 4
RANK_BUCKETS = 8192
WORD_BUCKETS = 32_768
NO_RANK = 2**31 - 1
#: Brackets around pieces; no byte maps to them.
OPEN, CLOSE = "‹", "›"


@lru_cache(maxsize=4)
def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _rank_json(path: str) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for piece, rank in read_ranks(path).items():
        text = piece.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % RANK_BUCKETS][text] = rank
    return json.dumps(buckets, separators=(",", ":"))


def _rank(piece: Column, table: Column) -> Column:
    """Rank of a piece or null."""
    return F.try_element_at(F.get(table, F.pmod(F.crc32(piece.cast("binary")), F.lit(RANK_BUCKETS)).cast("int")), piece)


def with_ranks(vocabulary: str, body) -> Column:
    """``body(table)``, with the rank table standing in the plan once, as a constant that the optimiser folds to a literal."""
    table = F.from_json(F.lit(_rank_json(vocabulary)), "array<map<string,int>>")
    return F.element_at(F.transform(F.array(table), body), 1)


def raw_bytes(word: Column) -> Column:
    """A word as the string of its bytes."""
    return F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")


def pieces_of(raw: Column, table: Column) -> Column:
    """The pieces (array<string>) that the bytes of a word are merged to."""
    start = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(raw)), lambda i: F.concat(F.lit(OPEN), F.substring(raw, i, F.lit(1)), F.lit(CLOSE))))

    def pieces(s: Column) -> Column:
        return F.split(F.substring(s, F.lit(2), F.length(s) - 2), CLOSE + OPEN)

    def best(s: Column) -> Column:
        """The adjacent pair of lowest rank as struct(rank, left, right)."""
        p = pieces(s)
        pairs = F.zip_with(F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.struct(F.coalesce(_rank(F.concat(a, b), table), F.lit(NO_RANK)).alias("r"), a.alias("a"), b.alias("b")))
        return F.array_min(pairs)

    def with_best(s: Column) -> Column:
        # found once, through a one-element array that names the string
        return F.element_at(F.transform(F.array(s), lambda x: F.struct(x.alias("s"), best(x).alias("pair"))), 1)

    def step(state: Column, _: Column) -> Column:
        pair = state["pair"]
        done = pair.isNull() | (pair["r"] == NO_RANK)
        merged = F.replace(state["s"], F.concat(F.lit(OPEN), pair["a"], F.lit(CLOSE + OPEN), pair["b"], F.lit(CLOSE)), F.concat(F.lit(OPEN), pair["a"], pair["b"], F.lit(CLOSE)))
        return F.when(done, state).otherwise(with_best(merged))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(raw) - 1, F.lit(1))), with_best(start), step, lambda state: pieces(state["s"]))


def encode_word(word: Column, vocabulary: str = VOCABULARY) -> Column:
    """Token ids of one word (array<int>)."""
    raw = raw_bytes(word)

    def ids(table: Column) -> Column:
        whole = _rank(raw, table)
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.transform(pieces_of(raw, table), lambda p: _rank(p, table)))

    return with_ranks(vocabulary, ids)


def encode_long(words: DataFrame, scratch: Scratch, vocabulary: str = VOCABULARY) -> DataFrame:
    """``word, n, ids`` of words (``word, n``) of any length, folded in segments."""
    numbered = scratch.keep(words.select(F.monotonically_increasing_id().alias("w"), "word", "n"))
    raw = raw_bytes(F.col("word"))
    segments = numbered.select("w", F.explode(F.sequence(F.lit(0), F.floor((F.length(raw) - 1) / SEGMENT).cast("int"))).alias("at"), raw.alias("raw"))
    segments = scratch.keep(segments.select("w", "at", F.substring("raw", F.col("at") * SEGMENT + 1, F.lit(SEGMENT)).alias("raw")))
    spread = min(2000, segments.count() // 64 + 1)  # CPU-bound on few bytes
    folded = lambda text: with_ranks(vocabulary, lambda t: pieces_of(text, t))
    done = scratch.keep(segments.repartition(spread).select("w", "at", folded(F.col("raw")).alias("parts")))
    along = Window.partitionBy("w").orderBy("at")  # one row for each SEGMENT bytes of one value
    before = along.rowsBetween(Window.unboundedPreceding, 0)
    rounds = 0
    while True:
        last, following = F.element_at("parts", -1), F.lead(F.element_at("parts", 1)).over(along)
        meet = done.select("w", "at", last.alias("x"), following.alias("y"), F.row_number().over(along).alias("nth"))
        # most borders are alike: each pair of pieces is folded once
        pairs = scratch.keep(meet.where("y is not null").select("x", "y").distinct())
        bad = pairs.repartition(min(2000, pairs.count() // 256 + 1)).withColumn("ok", folded(F.concat("x", "y")) == F.array("x", "y")).where("not ok").select("x", "y", F.lit(True).alias("bad"))
        marked = scratch.keep(meet.join(bad, ["x", "y"], "left").select("w", "at", "nth", F.coalesce("bad", F.lit(False)).alias("bad")))
        if marked.where("bad").isEmpty():
            break
        if rounds < PAIR_ROUNDS:  # every other one of neighbouring failures, so that segments stay short
            of_run = F.col("nth") - F.coalesce(F.max(F.when(~F.col("bad"), F.col("nth"))).over(before), F.lit(0))
            taken = marked.withColumn("joins", F.col("bad") & (of_run % 2 == 1))
            head = F.when(F.lag("joins").over(along), F.lag("at").over(along)).otherwise(F.col("at"))
        else:
            far = F.col("nth") - F.max(F.when(F.col("bad"), F.col("nth"))).over(along.rowsBetween(Window.unboundedPreceding, -1))
            taken = marked.withColumn("joins", F.coalesce(far <= 4 << (rounds - PAIR_ROUNDS), F.lit(False)))
            head = F.max(F.when(~F.col("joins"), F.col("at"))).over(before)
        grouped = done.join(taken.select("w", "at", head.alias("head")), ["w", "at"]).groupBy("w", "head").agg(F.sort_array(F.collect_list(F.struct("at", "parts"))).alias("m"))
        alone = F.size("m") == 1
        kept = grouped.where(alone).select("w", F.col("head").alias("at"), F.col("m")[0]["parts"].alias("parts"))
        again = scratch.keep(grouped.where(~alone).select("w", F.col("m.at").alias("ats"), F.array_join(F.flatten("m.parts"), "").alias("raw")))
        fresh = again.repartition(min(2000, again.count() // 32 + 1)).select("w", "ats", folded(F.col("raw")).alias("parts"))
        half = F.floor(F.size("parts") / 2).cast("int")
        cuts = F.array(F.struct(F.col("ats")[0].alias("at"), F.slice("parts", 1, half).alias("parts")), F.struct(F.col("ats")[1].alias("at"), F.slice("parts", half + 1, F.size("parts")).alias("parts")))
        whole = F.array(F.struct(F.col("ats")[0].alias("at"), F.col("parts")))
        two = (half > 0) & F.lit(rounds < PAIR_ROUNDS)
        done = scratch.keep(kept.unionByName(fresh.select("w", F.inline(F.when(two, cuts).otherwise(whole)))))
        rounds += 1
    merged = done.groupBy("w").agg(F.flatten(F.sort_array(F.collect_list(F.struct("at", "parts")))["parts"]).alias("parts"))
    return numbered.join(merged, "w").select("word", "n", with_ranks(vocabulary, lambda t: F.transform("parts", lambda p: _rank(p, t))).alias("ids"))


def cut(text: Column) -> Column:
    """Words of a text, in order; an empty array for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


class Encoder:
    """Distinct words of a corpus with their encodings, and the two ways back to the texts."""

    def __init__(self, texts: DataFrame, text: str, scratch: Scratch, vocabulary: str = VOCABULARY, frequent: int = FREQUENT):
        self.scratch = scratch
        counts = texts.select(F.explode(cut(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        counted = scratch.keep(counts)
        long = F.octet_length("word") > LONG
        seen = counted.agg(F.count("*").alias("n"), F.count_if(long).alias("long")).first()
        self.n_words = seen["n"]
        # the fold is CPU-bound on few bytes: spread the words over tasks by number, not by size
        spread = min(2000, self.n_words // 8000 + 1)
        conf, shown = texts.sparkSession.conf, "spark.sql.maxPlanStringLength"
        before = conf.get(shown)
        conf.set(shown, "4096")  # the literal rank table needn't be in plan descriptions
        try:
            self.words = scratch.keep(counted.where(~long).repartition(spread).select("word", "n", encode_word(F.col("word"), vocabulary).alias("ids")))
            if seen["long"]:
                self.words = scratch.keep(self.words.unionByName(encode_long(counted.where(long), scratch, vocabulary)))
        finally:
            conf.set(shown, before)
        self.rare = self.n_words > frequent
        self.kept = self.words.orderBy(F.desc("n"), "word").limit(frequent) if self.rare else self.words

    def dictionary(self, value: Column) -> Column:
        """Subquery of one row: maps word -> ``value`` of the frequent words, in CRC-32 buckets."""
        spark = self.words.sparkSession
        filled = self.kept.groupBy(self._bucket(F.col("word")).alias("b")).agg(F.collect_list(F.struct("word", value.alias("v"))).alias("m"))
        all_buckets = spark.range(WORD_BUCKETS).select(F.col("id").cast("int").alias("b")).join(filled, "b", "left")
        return all_buckets.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "m"))), lambda x: F.map_from_entries(x["m"])).alias("d")).scalar()

    @staticmethod
    def _bucket(word: Column) -> Column:
        return F.pmod(F.crc32(word.cast("binary")), F.lit(WORD_BUCKETS)).cast("int")

    def look_up(self, words: Column, dictionary: Column) -> Column:
        """The value of each word of an array; null for a word outside the dictionary."""
        return F.transform(words, lambda w: F.try_element_at(F.get(dictionary, self._bucket(w)), w))

    def _filled(self, docs: DataFrame, key: str, text: str, value: Column) -> DataFrame:
        """``docs`` with ``parts``: the value of each word of the text."""
        looked = docs.withColumn("dictionary", self.dictionary(value)).withColumn("parts", self.look_up(cut(F.col(text)), F.col("dictionary"))).drop("dictionary")
        if not self.rare:
            return looked
        # the corpus is cut and looked up once; keys may be null or repeat, so each row has a number of its own
        looked = self.scratch.keep(looked.withColumn(ROW, F.monotonically_increasing_id()))
        missing = F.exists("parts", lambda p: p.isNull())
        open_ = looked.where(missing)
        gaps = (
            open_.select(ROW, F.posexplode(F.arrays_zip("parts", cut(F.col(text)).alias("words"))).alias("pos", "e"))
            .where("e.parts is null")
            .select(ROW, "pos", F.col("e.words").alias("word"))
            .join(self.words.select("word", value.alias("v")), "word")
            .groupBy(ROW)
            .agg(F.map_from_entries(F.collect_list(F.struct("pos", "v"))).alias("fill"))
        )
        patched = open_.join(gaps, ROW).withColumn("parts", F.transform("parts", lambda p, i: F.coalesce(p, F.try_element_at("fill", i)))).drop("fill", ROW)
        return looked.where(~missing).drop(ROW).unionByName(patched)

    def ids(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``docs`` without the text, with ``ids``."""
        return self._filled(docs, key, text, F.col("ids")).withColumn("ids", F.flatten("parts")).drop("parts", text)

    def sizes(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """``docs`` without the text, with ``n_tokens``: only counts are carried, not ids."""
        total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return self._filled(docs, key, text, F.size("ids")).withColumn("n_tokens", total).drop("parts", text)


def decode_ids(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """Text of a list of ids: the binary pieces are concatenated, then read as UTF-8."""
    pieces = [""] * (max(read_ranks(vocabulary).values()) + 1)
    for piece, rank in read_ranks(vocabulary).items():
        pieces[rank] = base64.b64encode(piece).decode()
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    binary = F.transform(ids, lambda i: F.unbase64(F.get(table, i)))
    return F.decode(F.aggregate(binary, F.lit(b""), lambda a, x: F.concat(a, x)), "UTF-8")
