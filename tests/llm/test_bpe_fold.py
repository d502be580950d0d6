"""The fold of many words at a time against the fold by columns and the heap of pairs."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F

from lumipep.llm import byte_bpe


def some_words() -> list[str]:
    r = random.Random(5)
    letters = ["a", "b", "e", "t", "h", "n", " ", "'s", "é", "日", "\U0001f600", "\x00", "ing", "aaaa"]
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(300)} | {"a" * n for n in range(1, 30)} | {"ab" * 100, "z"})


def test_words_are_folded_many_at_a_time(spark, monkeypatch):
    words, bpe = some_words(), byte_bpe.public_bpe()
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = {w: byte_bpe.encode_long(w.encode(), ranks).tolist() for w in words}
    for most in (1, 1000, 1 << 18):
        monkeypatch.setattr(byte_bpe, "FOLD_BYTES", most)
        _, starts, lengths, flat = byte_bpe.folded_words(pa.array(["cut off", *words])[1:], bpe.pairs, bpe.one)
        assert {w: flat[s : s + n].tolist() for w, s, n in zip(words, starts, lengths, strict=True)} == want
    rows = spark.createDataFrame([(w,) for w in words[::4]], "word string").select("word", bpe.fold(F.col("word")).alias("ids")).collect()
    assert {r["word"]: r["ids"] for r in rows} == {w: want[w] for w in words[::4]}
    assert len(byte_bpe.folded_words(pa.array([], pa.string()), bpe.pairs, bpe.one)[3]) == 0


def test_a_vocabulary_of_bytes_and_few_merges():
    ranks = {bytes([i]): 255 - i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259}
    bpe = byte_bpe.ByteBPE(ranks, ".+")
    words = ["abc", "aabc", "aaa", "bcab", "x", "\xff"]
    _, starts, lengths, flat = byte_bpe.folded_words(pa.array(words), bpe.pairs, bpe.one)
    assert [flat[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == [byte_bpe.encode_long(w.encode(), ranks).tolist() for w in words]
    assert bpe.pairs.of(np.array([ranks[b"a"]]), np.array([ranks[b"z"]])).tolist() == [bpe.pairs.none]


def test_texts_are_read_by_a_plan_without_folds(spark):
    """A fold by columns, and a test of every word by columns, took most of op5's time; their literals were kept with every plan."""
    df = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    plan = byte_bpe.round_trip(df, byte_bpe.public_bpe().learn_words(df))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and len(plan) < 20_000
