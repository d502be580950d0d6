"""Columns with dots and with the operators' own names, rows that repeat an id, words without an end, and keys."""

import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lumipep.llm import byte_bpe, exact_dedup, jaccard_join, language_id, mixing, pii

NAMES = ["n.ch", "_words", "_ids", "_rest", "_row", "_slot", "a`b", "_of_source", "_gone", "token_ids", "c0", "copies"]


@pytest.fixture(scope="module")
def odd(spark):
    texts = ["the cat and the dog " * 9, "the cat and the dog " * 9, None, "", "le chat et le chien dans la rue " * 5, "one two"]
    rows = [(i, t, "en" if i < 4 else "fr", "s", 3, *[i] * len(NAMES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace(chr(96), chr(96) * 2)}` long" for n in NAMES))


def test_names_through_all_stages(spark, odd):
    docs = odd
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, "")
        assert docs.columns == odd.columns, name
        docs = spark.createDataFrame(docs.collect(), odd.schema)
        assert docs.count() > 0, name
    bpe = byte_bpe.public_bpe()
    assert byte_bpe.round_trip(docs, bpe).columns == [*[c for c in odd.columns if c != "token_ids"], "token_ids", "n_tokens", "intact"]
    out = byte_bpe.round_trip(docs, bpe).collect()
    assert all(r["intact"] and r["_words"] == r["n.ch"] == r["a`b"] == r["doc_id"] for r in out)
    rows = byte_bpe.decoded(byte_bpe.encoded(odd, bpe), bpe).collect()
    assert all((r["decoded"] or b"").decode() == (r["text"] or "") and r["_ids"] == r["doc_id"] for r in rows) and len(rows) == 6


def test_names_in_queries(spark, odd):
    assert exact_dedup.exact_dedup(odd).count() == 6 and jaccard_join.jaccard_components(odd).count() == 6
    assert mixing.poisson_mix(odd).columns == [*odd.columns, "copy_no", "n_copies", "shuffle_key"]
    profiles = language_id.fit(odd, "text", "lang", "doc_id")
    got = language_id.predicted(odd, profiles, "text", ["n.ch", "a`b"]).collect()
    assert len(got) == 6 and all(r["n.ch"] == r["a`b"] for r in got)
    assert pii.pseudonymised(odd, key="k").columns == [*odd.columns, "n_found"]


@pytest.mark.parametrize("parts", [1, 4])
def test_rows_that_repeat_an_id_are_one_document(spark, parts):
    a, b = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    rows = [(3, b), (5, a), (5, b), (9, a), (11, "other " + a + " words"), (12, "quite alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).repartition(parts) if parts > 1 else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"], r["component_id"]) for r in jaccard_join.jaccard_components(df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 3), (12, 12)]


def test_repeated_ids_by_brute_force(spark):
    r = random.Random(8)
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "pqrst"]
    rows = []
    for _ in range(60):
        t = r.choice(base).split()
        if r.random() < 0.5:
            t[r.randrange(60)] = "x"
        rows.append((r.randrange(25), " ".join(t)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, _), s in zip(rows, sets, strict=True):
        for (j, _), u in zip(rows, sets, strict=True):
            if 100 * len(s & u) >= 80 * len(s | u):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    want = sorted((i, find(i)) for i, _ in rows)
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        assert sorted((x["doc_id"], x["component_id"]) for x in jaccard_join.jaccard_components(df).collect()) == want


def test_long_words(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ACGT") for _ in range(100_000)), base64.b64encode(r.randbytes(60_000)).decode().replace("+", "").replace("/", "").translate({ord(c): None for c in "0123456789"}), "a" * 30_000, "\u00e9\u65e5" * 400, "w" * 257 + " " + "w" * 256 + " " + "zyx" * 200 + " the end"]
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame(list(enumerate([*texts, *texts])), "doc_id long, text string").repartition(2)
    got = {x["doc_id"]: x["token_ids"] for x in byte_bpe.encoded(df, byte_bpe.public_bpe().learn_words(df)).collect()}
    for i, t in enumerate([*texts, *texts]):
        pieces = [t] if len(t) < 5000 else [t]
        assert got[i] == [x for p in pieces for x in enc.encode_ordinary(p)], i


def test_pseudonyms_need_a_key(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567")], "doc_id long, text string")
    with pytest.raises(ValueError, match="need a key"):
        pii.pseudonymised(df)
    spark.conf.set(pii.KEY_SETTING, "mine")
    try:
        assert pii.pseudonymised(df).first()["text"] == pii.pseudonymised(df, key="mine").first()["text"] != "call 555-123-4567"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert df.select(F.lit(1)).count() == 1
