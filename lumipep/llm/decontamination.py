"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of WINDOW consecutive words, a window into its shingles of SHINGLE words. A
document contains a window only if it holds all of its shingles, so one of them, the window's prefix, is enough to
find it by: the one that is rarest in the corpus. A first scan counts the benchmark's shingles in all documents; a
window with a shingle that never occurs is out. A second scan takes the prefixes' occurrences, each with the words
around it, and joins them to the windows; the place of the prefix in its window bounds where the window may start
(not before the text, and with enough words after it), and the words of exactly that window are compared.

Both scans pass shingles by hash through a bitmap of bounded size; what it lets through wrongly, the joins on the
whole hash and the compared words sort out. Nothing else is broadcast; a passage in a third of all documents is
dealt to many tasks (`spread_join`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import schema_of
from .common import in_arrow, spread_join, stage, table, text_bytes

WINDOW, SHINGLE = 10, 5
#: Most bits of the bitmap of shingles: 2 MB packed, 16 MB in a worker. A fuller bitmap only sends more rows to the joins.
FILTER_BITS = 1 << 24
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 20

_BYTES = np.arange(256)
#: Bytes of words: digits, letters and all of other characters.
_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint64) + np.uint64(1)
_BASE, _STEP, _LEN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, np.uint64(0x165667B19E3779F9)
_powers: list[np.ndarray] = []


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the hash's base, and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) <= n:
        rise = lambda base: np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        _powers[:] = [rise(_BASE), rise(pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after the other: start, end and hash of each word, and how many words begin before each text's offset."""
    starts, ends, hashes, lo = [], [], [], 0
    while lo < len(data):
        hi = lo + CHUNK
        while hi < len(data) and not len(gap := np.flatnonzero(~_WORD[data[hi - CHUNK : hi]])):
            hi += CHUNK
        hi = hi - CHUNK + int(gap[-1]) + 1 if hi < len(data) else len(data)
        b = data[lo:hi]
        border = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo
        w = _WORD[b]
        first, last = w.copy(), w.copy()
        first[1:] &= ~w[:-1]
        last[:-1] &= ~w[1:]
        first[border], last[border - 1] = w[border], w[border - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = powers(max(CHUNK, len(b)))
        sums = np.r_[np.uint64(0), np.cumsum(_LOWER[b] * up[: len(b)])]
        hashes.append(mixed((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _LEN))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    joined = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    begin = joined(starts, np.int64)
    return begin, joined(ends, np.int64), joined(hashes, np.uint64), np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, before: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words that lie in one text, and the number of each run's first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, inside = np.full(n, k, np.uint64) * _LEN, np.ones(n, bool)
    for j in range(k):
        h = h * np.uint64(_STEP) + words[j : n + j]
        crossing = before[1:] - j
        if j:
            inside[crossing[(crossing >= 0) & (crossing < n)]] = False
    at = np.flatnonzero(inside)
    return mixed(h[at]), at


def windows_of(items: DataFrame, window: int, k: int, text: str, item_id: str) -> DataFrame:
    """item, words (a window's, joined by spaces), n (how many), shingles (hashes, in order)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            s, e, h, before = scan(data, offsets)
            low = data.tobytes().lower()
            words = [low[x:y].decode() for x, y in zip(s.tolist(), e.tolist(), strict=True)]
            rows = [(i, lo, min(window, before[i + 1] - before[i])) for i in range(b.num_rows) for lo in range(before[i], max(before[i + 1] - window, before[i]) + 1) if before[i + 1] > before[i]]
            by_size = {n: shingles(h, before, n) for n in {min(k, n) for _, _, n in rows}}
            for part in range(0, len(rows), 10_000):
                some = rows[part : part + 10_000]
                hashes = []
                for _, lo, n in some:
                    x, at = by_size[min(k, n)]
                    first = int(np.searchsorted(at, lo))
                    hashes.append(x[first : first + n - min(k, n) + 1].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array([i for i, _, _ in some], pa.int64())), pa.array([" ".join(words[lo : lo + n]) for _, lo, n in some], pa.string()), pa.array([n for _, _, n in some], pa.int32()), pa.array(hashes, pa.list_(pa.int64()))],
                    ["item", "words", "n", "shingles"],
                )

    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    return in_arrow(rows, cut, schema_of(rows, ["item"]) + "words string, n int, shingles array<long>")


def token_filter(tokens: DataFrame) -> tuple[int, np.ndarray]:
    """A bitmap of the top bits of the tokens (column token), set and ORed by the executors: the shift that gives a token's bit, and the bits."""
    n = tokens.count()
    log = max(16, min(FILTER_BITS.bit_length() - 1, (64 * n).bit_length()))
    place = F.shiftrightunsigned("token", 64 - log)
    rows = tokens.select(place.alias("p")).select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    got = rows.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (log - 6), np.int64)
    bits[got["w"].to_numpy()] = got["bits"].to_numpy()
    return 64 - log, np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def shingle_counts(docs: DataFrame, text: str, tokens: DataFrame, sizes: list[int]) -> DataFrame:
    """token, n: how often the tokens, and others of the same bit, occur in all documents."""
    held = docs.sparkSession.sparkContext.broadcast(token_filter(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, bits = held.value
        found: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(found), return_counts=True)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

        for b in batches:
            _, _, h, before = scan(*text_bytes(b.column(0)))
            for k in sizes:
                x, _ = shingles(h, before, k)
                found.append(x[bits[(x >> np.uint64(shift)).astype(np.int64)]])
            if sum(map(len, found)) > CHUNK:
                yield summed()
        if found:
            yield summed()

    return in_arrow(docs.select(F.col(text).alias("text")), count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def marked(docs: DataFrame, text: str, id_col: str, prefixes: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """_row, _id, n_words, hits (array of token, pos, before, context) of each row of docs: where a prefix may stand, and up to `window` words on both sides of it, of which `before` come before it."""
    held = docs.sparkSession.sparkContext.broadcast(token_filter(prefixes.select("token").distinct()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, bits = held.value
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            s, e, h, before = scan(data, offsets)
            hits = []
            for k in sizes:
                x, at = shingles(h, before, k)
                hit = np.flatnonzero(bits[(x >> np.uint64(shift)).astype(np.int64)])
                hits.append((at[hit], x[hit]))
            at, token = np.concatenate([a for a, _ in hits] or [np.zeros(0, np.int64)]), np.concatenate([x for _, x in hits] or [np.zeros(0, np.uint64)])
            order = np.argsort(at, kind="stable")
            at, token = at[order], token[order]
            doc = np.searchsorted(before, at, "right") - 1
            lo, hi = np.maximum(before[doc], at - window), np.minimum(before[doc + 1], at + window)
            words = lambda i, j: b" ".join(bytes(data[s[x] : e[x]]) for x in range(i, j)).lower().decode()
            structs = pa.StructArray.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(at - before[doc]), pa.array((at - lo).astype(np.int32)), pa.array([words(i, j) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)], pa.string())],
                ["token", "pos", "before", "context"],
            )
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)), structs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(before).astype(np.int64)), lists], ["_id", "n_words", "hits"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("text"))
    out = in_arrow(rows, find, schema_of(rows, ["_id"]) + "n_words long, hits array<struct<token: long, pos: long, before: int, context: string>>")
    return stage(out.withColumn("_row", F.monotonically_increasing_id()), "marked")


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: _row, _id, n_words for each row of docs; _row, start, end, words for each occurrence of a window (words `start` to `end` - 1 of the document); item, words for each window of an item."""
    cut = stage(windows_of(items, window, k, item_text, item_id), "windows")
    distinct = stage(cut.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "distinct")
    sizes = sorted(r[0] for r in distinct.select(F.least("n", F.lit(k))).distinct().collect())  # k values at most
    places = stage(distinct.select("words", "n", F.posexplode("shingles").alias("offset", "token")), "places")
    tokens = stage(places.select("token").distinct(), "tokens")
    counts = stage(shingle_counts(docs, text, tokens, sizes).join(tokens, "token", "left_semi"), "counts")
    # The prefix: of a window's shingles the rarest, the first of equals. A shingle that never occurs rules its window out.
    counted = spread_join(places, counts.withColumnRenamed("n", "count"), ["token"], ["words", "offset"], "left")
    rare = counted.groupBy("words", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "token")).alias("p"))
    prefixes = stage(rare.filter("p.count > 0").select("words", "n", "p.offset", "p.token"), "prefixes")
    found = marked(docs, text, id_col, prefixes, sizes, window)
    hits = stage(found.filter("size(hits) > 0").select("_row", "n_words", F.inline("hits")), "hits")
    near = spread_join(hits, prefixes, ["token"], ["_row", "pos"])
    inside = near.filter((F.col("pos") >= F.col("offset")) & (F.col("pos") - F.col("offset") + F.col("n") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("context", " "), F.col("before") - F.col("offset") + 1, F.col("n")), " ")
    spans = inside.filter(there == F.col("words")).select("_row", (F.col("pos") - F.col("offset")).alias("start"), (F.col("pos") - F.col("offset") + F.col("n")).alias("end"), "words")
    return found.select("_row", "_id", "n_words"), stage(spans, "spans"), cut


def contaminated_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each occurrence of an item's window in a document: id, item, start, end (words `start` to `end` - 1), words. Rows of docs that repeat an id have their own."""
    rows, spans, cut = matches(docs, items, window, k, text, id_col, item_id, item_text)
    named = spread_join(spans, cut.select("words", "item").distinct(), ["words"], ["_row", "start"])
    return named.join(rows.select("_row", F.col("_id").alias(id_col)), "_row").select(id_col, F.col("item").alias(item_id), "start", "end", "words")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = SHINGLE, text: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256, contaminated.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. An item of fewer than `window`
    words is one window, an item without words none. A null text has no words; a null id is kept; an item with a null
    id hits words and is not listed; items that repeat an id are listed once; items with the same text are listed
    both. Long texts are read whole; rows of docs that are repeated are judged each. No documents, no rows; no
    items, no hits. Further columns of either table are ignored.
    """
    rows, spans, cut = matches(docs, items, window, k, text, id_col, item_id, item_text)
    # Words covered: each occurrence adds what lies beyond the ends of those before it.
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = spans.select("_row", "start", "end").withColumn("done", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = covered.groupBy("_row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.col("done"))).alias("n_hit"))
    pairs = stage(spans.select("_row", "words").distinct(), "pairs")
    named = spread_join(pairs, cut.select("words", "item").distinct(), ["words"], ["_row"]).filter("item is not null").select("_row", F.col("item").cast("string").alias("item")).distinct()
    listed = named.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    judged = stage(hit.join(listed, "_row", "left"), "judged")
    out = rows.join(judged, "_row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op11_decontamination": r"""
WITH word AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM item WHERE len(w) > 0))),
place AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM word, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, p.n, item_id FROM place p JOIN win USING (n, words)),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hit) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)"""
}
QUERIES = {"op11_decontamination": op11_decontamination}
