"""op11: windows of benchmark items in documents, against brute force."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lumipep.llm import common, decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for lo in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[lo : lo + n]), set()).add(i)
    sizes = {len(w) for w in wins}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for lo in range(len(w) - n + 1):
                if (x := tuple(w[lo : lo + n])) in wins:
                    hit |= set(range(lo, lo + n))
                    found |= wins[x]
        ids = sorted({str(x) for x in found if x is not None})
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(df):
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(3)
    vocab = ["the", "of", "The", "naïve", "日本", "x1", "a", "b2", "to", "and"] * 3 + [f"w{i}" for i in range(60)]
    say = lambda n: [r.choice(vocab) for _ in range(n)]
    texts = [say(r.choice([1, 2, 4, 5, 7, 9, 10, 11, 30, 45])) for _ in range(25)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items += [(100, None), (101, ""), (102, " -- !"), (3, " ".join(say(14))), (None, " ".join(say(12))), (10, items[4][1]), (200, "the " * 25), (201, items[12][1].upper() + " !")]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(r.randrange(4)):
            t = words(r.choice(items)[1])
            lo = r.randrange(len(t)) if t and r.random() < 0.5 else 0
            parts += [*say(r.randrange(12)), *t[lo : lo + r.choice([3, 10, 15, 60])]]
        docs.append((i, r.choice([" ", ", ", "\n--\t"]).join(parts + say(r.randrange(6)))))
    docs += [(None, None), (500, None), (501, ""), (502, "...!"), (7, docs[7][1]), (7, docs[8][1]), (None, items[8][1]), (503, "the " * 60), (504, ("Ω" * 3 + " ") * 40 + items[20][1] * 2), (505, "q" * 5000 + " " + items[20][1])]
    return docs, items


def tables(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, token string, _row int").repartition(3)
    return d, spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, words string").repartition(2)


def test_brute(spark, cases):
    docs, items = cases
    assert result(dc.contamination(*tables(spark, docs, items))) == brute(docs, items)


def test_windows_of_other_sizes(spark, cases):
    docs, items = cases
    d, b = tables(spark, docs, items)
    assert result(dc.contamination(d, b, window=6, k=2)) == brute(docs, items, 6)


def test_small_bitmap_and_chunks(spark, cases, monkeypatch):
    """A full bitmap and texts cut into many pieces give the same rows."""
    docs, items = cases
    monkeypatch.setattr(dc, "FILTER_BITS", 1 << 16)
    data, offsets = common.text_bytes(__import__("pyarrow").array([t for _, t in docs]))
    whole = dc.scan(data, offsets)
    monkeypatch.setattr(dc, "CHUNK", 64)
    assert all((x == y).all() for x, y in zip(whole, dc.scan(data, offsets), strict=True))
    spans = dc.scan(data, offsets)
    assert [bytes(data[a:b]).lower().decode() for a, b in zip(spans[0], spans[1], strict=True)] == [w for _, t in docs for w in words(t)]


def test_empty(spark, cases):
    docs, items = cases
    d, b = tables(spark, docs, items)
    none = result(dc.contamination(d, b.limit(0)))
    assert none == brute(docs, [])
    assert dc.contamination(d.limit(0), b).count() == 0


def test_spans(spark, cases):
    docs, items = cases
    docs = [r for r in docs if r[0] not in (None, 7)]
    d, b = tables(spark, docs, items)
    text, said = dict(docs), {}
    for r in dc.contaminated_spans(d, b).collect():
        assert words(text[r["doc_id"]])[r["start"] : r["end"]] == r["words"].split(" ")
        said.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert {i: len(s) for i, s in said.items()} == {r[0]: r[2] for r in brute(docs, items) if r[2]}


def test_hot_passage(spark):
    """A passage in every second document goes through the join in parts."""
    passage = " ".join(f"p{i}" for i in range(15))
    d = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("some "), F.lit(passage))).otherwise(F.concat(F.lit("other text "), F.col("id").cast("string"))).alias("text"))
    b = spark.createDataFrame([(1, passage), (2, "not there at all in any of the documents of this")], "item_id long, text string")
    got = dc.contamination(d, b).filter("contaminated")
    assert got.count() == 600 and got.select("n_hit", "n_items").distinct().collect()[0][:] == (15, 1)


def test_spread_join(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    plain = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v").collect()), key=str)
    assert sorted(map(tuple, common.spread_join(left, right, ["k"], ["id"], "left").select("id", "k", "v").collect()), key=str) == plain


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rows = con.sql("SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM (" + dc.SQL["op11_decontamination"] + ")").fetchall()
    assert result(dc.QUERIES["op11_decontamination"](spark, sf_dir)) == sorted(rows, key=str)
