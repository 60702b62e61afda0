"""Token ids against the public tokenizer; containers against their rules."""

import base64
import random
import time
from pathlib import Path

import pytest
import tiktoken

from newsloom.llm.packing import fill_shard, pack
from newsloom.llm.tokens import VOCABULARY, Encoder, decode_ids, read_ranks
from newsloom.runtime import Scratch

pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="the public vocabulary isn't here")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def reference():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=read_ranks(), special_tokens={})


def texts():
    rng = random.Random(4)
    letters = "aaabcdeæøå é’'\n\t   　 09.,!?«»-😡日本ßЖ́‍\r"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(120)]
    return [None, "", " ", "\n\n  ", "<|endoftext|> er tekst", "it's we'll I'd", "a" * 3000, "ab" * 700, "  x   y ", "Blåbærgrød på 3½ m² №7", *made]


@pytest.mark.parametrize("frequent", [200_000, 15])
def test_ids_equal_the_public_tokenizer(spark, frequent):
    enc, rows = reference(), list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, word string")  # a clashing name
    ids = Encoder(docs, "text", Scratch(spark, "t"), frequent=frequent)
    got = {r["doc_id"]: r["ids"] for r in ids.ids(docs, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t or "") for i, t in rows}
    sizes = {r["doc_id"]: r["n_tokens"] for r in ids.sizes(docs, "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


@pytest.mark.parametrize("frequent", [200_000, 15])
def test_null_and_repeated_keys_are_encoded_each(spark, frequent):
    enc, rows = reference(), [(None if i % 3 == 0 else i // 4, t, i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, i int")
    ids = Encoder(docs, "text", Scratch(spark, "t"), frequent=frequent)
    got = sorted((r["i"], r["doc_id"], r["ids"]) for r in ids.ids(docs, "doc_id", "text").collect())
    assert got == [(i, k, enc.encode_ordinary(t or "")) for k, t, i in rows]
    assert sorted((r["i"], r["n_tokens"]) for r in ids.sizes(docs, "doc_id", "text").collect()) == [(i, len(x)) for i, _, x in got]


def test_long_words_equal_the_public_tokenizer(spark):
    rng = random.Random(8)
    kinds = ["abcdefghijklmnopqrstuvwxyzæøå", "ab", "a", "日本語文字", "eeeeenrst"]
    long = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (170, 900, 4000)] + ["-=" * 600, "x" * 161, "sikkerhedsforanstaltning" * 40]
    docs = spark.createDataFrame(list(enumerate([f"se {x} her" for x in long])), "doc_id bigint, text string")
    got = {r["doc_id"]: r["ids"] for r in Encoder(docs, "text", Scratch(spark, "t")).ids(docs, "doc_id", "text").collect()}
    assert got == {i: reference().encode_ordinary(f"se {x} her") for i, x in enumerate(long)}


def test_a_word_of_100_000_letters(spark):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    began = time.perf_counter()
    got = Encoder(docs, "text", Scratch(spark, "t")).ids(docs, "doc_id", "text").first()["ids"]
    print("took", time.perf_counter() - began)
    assert got == reference().encode_ordinary(text) and time.perf_counter() - began < 60


def test_decoding_gives_the_text_back(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    ids = Encoder(docs, "text", Scratch(spark, "t")).ids(docs, "doc_id", "text")
    assert {r["doc_id"]: r["t"] for r in ids.select("doc_id", decode_ids(ids["ids"]).alias("t")).collect()} == {i: t or "" for i, t in rows}


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert Encoder(docs, "text", Scratch(spark, "t")).ids(docs, "doc_id", "text").isEmpty()


def test_vocabulary_path_is_a_parameter(tmp_path):
    (tmp_path / "v").write_text("\n".join(f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)))
    assert len(read_ranks(str(tmp_path / "v"))) == 256


def check(rows, sizes, capacity):
    """Every item once and whole, divided only above the capacity, no container overfull."""
    used, parts = {}, {}
    for b, k, p, s in rows:
        used[b] = used.get(b, 0) + s
        parts.setdefault(k, []).append((p, s))
    assert {k: sum(s for _, s in v) for k, v in parts.items()} == sizes
    assert all(len(v) == 1 if sizes[k] <= capacity else sorted(p for p, _ in v) == list(range(len(v))) for k, v in parts.items())
    assert max(used.values()) <= capacity
    return sum(used.values()) / (len(used) * capacity)


def test_shard():
    rng = random.Random(2)
    sizes = {i: max(1, int(rng.lognormvariate(5, 1.2))) for i in range(3000)} | {9001: 2048, 9002: 2049, 9003: 10_000, 9004: 1, 9005: 4096}
    rows = list(zip(*fill_shard(list(sizes), list(sizes.values()), 2048), strict=True))
    assert check(rows, sizes, 2048) > 0.97


def test_containers(spark):
    rng = random.Random(3)
    sizes = {i: rng.randrange(1, 900) for i in range(900)} | {5000: 5000}
    df = spark.createDataFrame([*[(i, s, 0) for i, s in sizes.items()], (7001, None, 0), (7002, 0, 0)], "d bigint, n int, container int")
    got = pack(df, "d", "n", 2048, Scratch(spark, "t"), shard_items=300)
    assert check([tuple(r) for r in got.collect()], sizes, 2048) > 0.95
    assert pack(df.limit(0), "d", "n", 2048, Scratch(spark, "t")).isEmpty()
