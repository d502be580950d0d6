"""op12: alignments of whole texts by the libraries' own encoders, without segments."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumipep.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(docs):
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    t = al.Tokenizers(A, B)
    rows, counts = [], Counter()
    for i, text in docs:
        whole = " " + (text or "")
        a, b = t.a.encode(whole, add_special_tokens=False).ids, t.b.encode(text or "", num_threads=1)
        if not text or any(b"".join(of[x] for x in ids) != whole.encode() for of, ids in ((t.bytes_a, a), (t.bytes_b, b))):
            rows.append((i, None, [], a, b))
            continue
        ends = {}
        for side, (of, ids) in enumerate(((t.bytes_a, a), (t.bytes_b, b))):
            at = 0
            for n, x in enumerate(ids):
                at += len(of[x])
                ends.setdefault(at, [None, None])[side] = n
        said, links, last = [], [], (-1, -1)
        for at in sorted(ends):
            x, y = ends[at]
            if x is not None and y is not None:
                said.append(",".join(map(str, a[last[0] + 1 : x + 1])) + "|" + ",".join(map(str, b[last[1] + 1 : y + 1])))
                links.append((a[x], b[y]))
                last = (x, y)
        counts.update(links)
        rows.append((i, ";".join(said), links, a, b))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    full = lambda i, s, links, a, b: (i, len(a), len(b), s.count(";") + 1, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), s)
    return sorted([full(*r) if r[1] is not None else (r[0], 0, 0, 0, 0, 0, 0, None) for r in rows], key=str), counts


def result(df):
    return sorted([tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(5)
    bits = ["the", "naïve", "日本語", " ", "  ", "\n", "\t", " ", "　", " ", "᠎", "’", "…", "'s", "don't", "<|endoftext|>", "<s>", "<0x0A>", "x" * 40, "12345", "!?", "😀", "é", "\x00", "\x1c", "﻿", "Straße", "é", "ﬁ", "word", "Ġ", "a.b", "\x7f", "\x85", "​", "z" * 90]
    out = [(i, "".join(r.choice(bits) + r.choice(["", " ", " ", " "]) for _ in range(r.randrange(1, 30)))) for i in range(150)]
    out += [(900, None), (901, ""), (902, " "), (903, "a▁b word the"), (904, "▁"), (905, "the " * 3000), (906, "ab" * 4000), (907, " x"), (908, "x "), (909, "       "), (1, out[1][1]), (1, out[2][1]), (None, "the word"), (910, "the word▁")]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(*x, "c", 1) for x in docs], "doc_id long, text string, codes string, _row int").repartition(3)


def test_vocabularies_are_verified():
    assert al.Tokenizers(A, B).verified


@pytest.mark.parametrize("most", [al.CACHE_SEGMENTS, 12, 0])
def test_brute(spark, docs, most):
    rows, links = al.align_tokenizers(frame(spark, docs), A, B, most=most)
    want, counts = brute(docs)
    assert result(rows) == want
    if most == 12:
        assert {(r["a"], r["b"]): r["count"] for r in links.collect()} == dict(counts)


def test_without_cuts_and_with_joined_counts(spark, docs, monkeypatch):
    monkeypatch.setattr(al, "are_verified", lambda *_: False)
    monkeypatch.setattr(al, "FEW_PAIRS", 3)
    assert result(al.align_tokenizers(frame(spark, docs), A, B)[0]) == brute(docs)[0]


def test_cuts_are_alike_in_pieces(docs, monkeypatch):
    import numpy as np

    data = np.frombuffer(" ".join(t or "" for _, t in docs).encode(), np.uint8)
    whole = al.cuts(data)
    monkeypatch.setattr(al, "CHUNK", 7)
    assert (al.cuts(data) == whole).all() and len(whole) > 1000


def test_empty(spark, docs):
    rows, links = al.align_tokenizers(frame(spark, docs).limit(0), A, B)
    assert rows.count() == 0 and links.count() == 0
    rows, links = al.align_tokenizers(frame(spark, [(1, None), (2, "")]), A, B)
    assert result(rows) == [(1, 0, 0, 0, 0, 0, 0, None), (2, 0, 0, 0, 0, 0, 0, None)]


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] is not None else "") for r in brute([tuple(r) for r in rows])[0]]
    got = al.QUERIES["op12_token_alignment"](spark, sf_dir).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.filter(F.col("n_a") > 0).count() > 100
