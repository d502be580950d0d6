"""Alignment of two tokenizers over a corpus: each distinct segment is tokenised and aligned once.

A text with a space before it is cut into segments before a space that stands after a character that is no white
space. The byte-level tokenizer's pattern has no match over such a place: only its runs of white space hold a space
anywhere but at their beginning. The piece tokenizer has no pattern; but no merge can cross the place if no token
holds one inside, which `verified` looks up in both vocabularies. If one does, texts are not cut, but are segments
of their own. A segment begins with the space that the piece tokenizer adds, and both tokenizers' tokens end at its
end, so the alignment of a text is that of its segments, one after the other. A space that ends a text is no place.

Segments are counted over all texts, then tokenised once each. The counts of linked ids come from the segments and
how often they occur. Texts are put together again from the alignments: those of the CACHE_SEGMENTS most frequent
segments are looked up where the text is read; what is left of a text, each of its rare segments once, is joined to
the alignments and back to the text. So the cache's size changes the speed and never the result.

A text with a segment whose tokens do not give its bytes has no tokens: such texts are found before links are
counted, and their segments are taken out of the counts.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import lists, schema_of
from .common import HOT_PARTS, HOT_ROWS, discard, in_arrow, slices, spread_join, stage, table, text_bytes

CACHE_SEGMENTS = 1 << 19
#: Longer segments are never kept in the cache.
CACHE_BYTES = 64
#: Up to so many pairs of ids (24 bytes each) the counts of links are broadcast; beyond, they are joined.
FEW_PAIRS = 1 << 21
#: Bytes that are searched for places to cut, and segments that are tokenised, at a time.
CHUNK, ROWS = 1 << 22, 4096


def cuts(data: np.ndarray) -> np.ndarray:
    """Places of spaces after a character that is surely no white space; by its last bytes, so that some places after others are left out too."""
    found = []
    for lo in range(0, len(data), CHUNK):
        at = np.flatnonzero(data[lo : lo + CHUNK] == 32) + lo
        b1, b2, b3, b4 = (np.where(at >= i, data[np.maximum(at - i, 0)], 0) for i in (1, 2, 3, 4))
        tail = lambda b: (b >= 0x80) & (b < 0xC0)  # noqa: E731  a character's further byte
        plain = (b1 > 32) & (b1 < 127)
        # All white space beyond ASCII begins with C2, E1, E2, E3 or EF.
        wide = tail(b1) & (((b2 >= 0xC3) & (b2 <= 0xDF)) | (tail(b2) & (((b3 >= 0xE4) & (b3 <= 0xED)) | (tail(b3) & (b4 >= 0xF0)))))
        found.append(at[plain | wide])
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones of Latin-1 for themselves, those from U+0100 on for the others in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """A byte-level tokenizer (A, a file of the tokenizers library) and a piece tokenizer (B, a sentencepiece model), with the bytes of their tokens; None for ids that are not for text."""

    def __init__(self, a: str, b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        vocab, of, sp = self.a.get_vocab(with_added_tokens=False), byte_characters(), self.b
        self.bytes_a: list[bytes | None] = [None] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else None
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
        piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b: list[bytes | None] = [None if special(i) else piece(i) for i in range(sp.get_piece_size())]
        if b"" in self.bytes_a or b"" in self.bytes_b:
            raise ValueError("a token without bytes")

    @property
    def verified(self) -> bool:
        """No token of either vocabulary holds a place at which texts are cut."""
        return not any(len(x := cuts(np.frombuffer(t, np.uint8))) and x[-1] > 0 for t in [*self.bytes_a, *self.bytes_b] if t and b" " in t[1:])

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by A of each segment, and by B of what follows its first character, a space."""
        a = self.a.encode_batch_fast(segments, add_special_tokens=False) if hasattr(self.a, "encode_batch_fast") else self.a.encode_batch(segments, add_special_tokens=False)
        return list(zip([e.ids for e in a], self.b.encode([s[1:] for s in segments], num_threads=1), strict=True))


@lru_cache(maxsize=2)
def loaded(a: str, b: str) -> Tokenizers:
    """One for each worker process."""
    return Tokenizers(a, b)


def groups(a: list[int], b: list[int], bytes_a: list[bytes | None], bytes_b: list[bytes | None]) -> list[tuple[list[int], list[int]]]:
    """The ids of A and of B between places where tokens of both end."""
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    while i < len(a):
        from_i, from_j = i, j
        end_a, i = end_a + len(bytes_a[a[i]]), i + 1
        while end_a != end_b:
            if end_a < end_b:
                end_a, i = end_a + len(bytes_a[a[i]]), i + 1
            else:
                end_b, j = end_b + len(bytes_b[b[j]]), j + 1
        out.append((a[from_i:i], b[from_j:j]))
    return out


def aligned_segments(segments: DataFrame, a: str, b: str) -> DataFrame:
    """seg, n, kept, and of each segment its groups as text (null if the tokens do not give its bytes), n_a and n_b."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded(a, b)
        for batch in slices(batches, ROWS):
            texts = batch.column(0).to_pylist()
            said, n_a, n_b = [], [], []
            for text, (x, y) in zip(texts, t.encode(texts), strict=True):
                raw = text.encode()
                parts_a, parts_b = [t.bytes_a[i] for i in x], [t.bytes_b[i] for i in y]
                good = None not in parts_a and None not in parts_b and b"".join(parts_a) == raw and b"".join(parts_b) == raw
                found = groups(x, y, t.bytes_a, t.bytes_b) if good else []
                said.append(";".join([",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in found]) if good else None)
                n_a.append(len(x) if good else 0)
                n_b.append(len(y) if good else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(n_a, pa.int32()), pa.array(n_b, pa.int32())], ["seg", "n", "kept", "said", "n_a", "n_b"])

    return in_arrow(segments.select("seg", "n", "kept"), align, "seg string, n long, kept boolean, said string, n_a int, n_b int")


def with_space(docs: DataFrame, text: str, *columns) -> DataFrame:
    """The columns, then the text with a space before it; null for a null or empty text."""
    return docs.select(*columns, F.when(F.col(text) != "", F.concat(F.lit(" "), F.col(text))).alias("text"))


def segment_column(texts: pa.Array, cut: bool) -> tuple[pa.Array, np.ndarray]:
    """All segments of a column of texts, and the number of segments before each text (and in all)."""
    data, offsets = text_bytes(texts)
    # A text's last space is no segment: the piece tokenizer adds no space to nothing.
    places = np.setdiff1d(cuts(data), offsets[1:] - 1, assume_unique=True) if cut else np.zeros(0, np.int64)
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], places).astype(np.int32)
    ends = np.append(starts, len(data)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]), np.searchsorted(starts, offsets)


def segment_counts(docs: DataFrame, text: str, cut: bool) -> DataFrame:
    """seg, n: the distinct segments of all texts and how often they occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = segment_column(b.column(0), cut)[0].value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["seg", "n"])

    return in_arrow(with_space(docs, text), count, "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))


def least_count(counted: DataFrame, most: int) -> int:
    """The lowest count from which on there are `most` segments or fewer that may be kept."""
    least, held = 0, 0
    for r in counted.filter(F.octet_length("seg") <= CACHE_BYTES).groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).toLocalIterator():
        held += r["c"]
        if held > most:
            return least or r["n"] + 1
        least = r["n"]
    return least


def packed(codes: np.ndarray) -> bytes:
    """Numbers of 32 bits, compressed: all lowest bytes first, then the next."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()) if len(codes) else b""


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.tobytes(), "<i4") if data else np.zeros(0, np.int32)


def parts_of(docs: DataFrame, text: str, id_col: str, cache: pa.Table, cut: bool) -> DataFrame:
    """_row, _id, codes (the number of each segment in the cache, or -1, -2 ... for those of rest; see `packed`), rest (the other segments, each once), bad (a segment of the cache has no alignment)."""
    held = docs.sparkSession.sparkContext.broadcast(cache)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fails = held.value["seg"].combine_chunks(), ~held.value["good"].to_numpy()
        for batch in batches:
            for b in slices([batch], 1024):
                segments, before = segment_column(b.column(1), cut)
                at = pc.fill_null(pc.index_in(segments, known), -1).to_numpy().copy()
                row = np.repeat(np.arange(b.num_rows), np.diff(before))
                bad = np.bincount(row[(at >= 0) & (fails[at] if len(fails) else False)], minlength=b.num_rows) > 0
                hole = np.flatnonzero(at < 0)
                unknown = segments.take(pa.array(hole)).dictionary_encode()
                distinct = max(1, len(unknown.dictionary))
                pair, inverse = np.unique(row[hole] * distinct + unknown.indices.to_numpy(), return_inverse=True)
                of_row = np.searchsorted(pair // distinct, np.arange(b.num_rows + 1))
                at[hole] = -1 - (inverse - of_row[row[hole]])
                rest = lists(unknown.dictionary.take(pa.array(pair % distinct)), of_row)
                codes = [packed(at[lo:hi]) for lo, hi in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.binary()), rest, pa.array(bad)], ["_id", "codes", "rest", "bad"])

    rows = with_space(docs, text, F.col(id_col).alias("_id"))
    out = in_arrow(rows, code, schema_of(rows, ["_id"]) + "codes binary, rest array<string>, bad boolean")
    return stage(out.withColumn("_row", F.monotonically_increasing_id()), "parts")


def segments_of(parts: DataFrame, cache: pa.Table) -> DataFrame:
    """seg, n: how often segments occur in these rows of `parts_of`."""
    held = parts.sparkSession.sparkContext.broadcast(cache)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value["seg"].combine_chunks()
        for b in slices(batches, 64):
            for codes, rest in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at, n = np.unique(unpacked(codes), return_counts=True)
                segs = pa.concat_arrays([known.take(pa.array(at[at >= 0])), rest.values.take(pa.array(-1 - at[at < 0]))])
                yield pa.RecordBatch.from_arrays([segs, pa.array(np.r_[n[at >= 0], n[at < 0]].astype(np.int64))], ["seg", "n"])

    return in_arrow(parts.select("codes", "rest"), named, "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))


def without_bad(aligned: DataFrame, parts: DataFrame, cache: pa.Table) -> tuple[DataFrame, DataFrame | None]:
    """aligned with `n` as the segments occur in texts that have tokens; and the _row of the texts that have none (None: all have)."""
    failed = aligned.filter("said is null").select("seg")
    if failed.isEmpty():
        return aligned, None
    holes = parts.filter("not bad").select("_row", F.explode("rest").alias("seg"))
    bad = stage(parts.filter("bad").select("_row").unionByName(spread_join(holes, failed, ["seg"], ["_row"]).select("_row")).distinct(), "bad")
    gone = segments_of(parts.join(bad, "_row", "left_semi"), cache).withColumnRenamed("n", "gone")
    left = F.when(F.col("said").isNull(), 0).otherwise(F.col("n") - F.coalesce("gone", F.lit(0))).cast("long")
    return stage(aligned.join(gone, "seg", "left").withColumn("n", left).drop("gone"), "aligned"), bad


def with_links(aligned: DataFrame) -> DataFrame:
    """aligned with the ids that end together, the last of each group: link_a, link_b."""
    last = lambda pattern: F.regexp_extract_all("said", F.lit(pattern), F.lit(1)).cast("array<int>")
    return aligned.withColumns({"link_a": last(r"(\d+)\|"), "link_b": last(r"(\d+)(?:;|$)")})


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (how many links hold these ids linked), best (no other id of A has more with this b)."""
    links = with_links(aligned.filter("n > 0 and said is not null")).select("n", F.inline(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"))))
    pairs = stage(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))  # a row an id of B
    return stage(pairs.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "links")


def valued(rows: DataFrame, links: DataFrame) -> DataFrame:
    """seg, said, n_a, n_b, n_links, n_best, count_sum of segments that have an alignment."""
    rows, keep = with_links(rows), ["seg", "said", "n_a", "n_b"]
    if links.count() > FEW_PAIRS:
        each = rows.select("seg", F.inline(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"))))
        sums = spread_join(each, links, ["a", "b"], ["seg"], "left").groupBy("seg").agg(F.sum(F.coalesce(F.col("best").cast("int"), F.lit(0))).alias("n_best"), F.sum("count").alias("count_sum"))
        n_links = F.size("link_a").alias("n_links")
        return rows.select(*keep, n_links).join(sums, "seg").select(*keep, "n_links", F.col("n_best").cast("int").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"))
    found = links.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "count", "best").toArrow().sort_by("pair")
    held = rows.sparkSession.sparkContext.broadcast([found[c].to_numpy() for c in ("pair", "count", "best")])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = held.value
        for b in batches:
            a_ids, b_ids = b.column(4), b.column(5)
            before = a_ids.offsets.to_numpy().astype(np.int64)
            both = (a_ids.flatten().to_numpy().astype(np.int64) << 32) + b_ids.flatten().to_numpy()
            at = np.minimum(np.searchsorted(pair, both), max(0, len(pair) - 1))
            # A segment that is only in texts without tokens may have links that are not counted.
            there = pair[at] == both if len(pair) else np.zeros(len(both), bool)
            sums = [np.r_[0, np.cumsum(np.where(there, x[at] if len(x) else 0, 0).astype(np.int64))] for x in (best, count)]
            n_best, total = (s[before[1:] - before[0]] - s[before[:-1] - before[0]] for s in sums)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.diff(before).astype(np.int32)), pa.array(n_best.astype(np.int32)), pa.array(total)], [*keep, "n_links", "n_best", "count_sum"])

    return in_arrow(rows.select(*keep, "link_a", "link_b"), add, "seg string, said string, n_a int, n_b int, n_links int, n_best int, count_sum long")


SUMS = ["n_a", "n_b", "n_links", "n_best", "count_sum"]


#: Marks between numbers as further hexadecimal digits, so that text of numbers takes half a byte a character.
_MARKS, _DIGITS = " ,|;", "DABC"
_BACK = bytes.maketrans(_DIGITS.lower().encode(), _MARKS.encode())


def halved(text: Column) -> Column:
    digits = F.translate(text, _MARKS, _DIGITS)
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "F").otherwise("")))


def unhalved(data: bytes) -> bytes:
    return data.hex().encode().rstrip(b"f").translate(_BACK)


#: A text's own row comes after those of its segments.
_LAST = (1 << 31) - 1


def composed(parts: DataFrame, known: DataFrame, others: DataFrame, hot: DataFrame, bad: DataFrame | None, cache: pa.Table) -> DataFrame:
    """_id, n_a, n_b, n_groups, n_links, n_best, count_sum, said (the groups of the whole text; null without tokens). known, others: the values of segments in the cache, and of the rest.

    The values of a text's other segments and the text's own row come to one task in order, as a stream.
    """
    found = known.toArrow().combine_chunks()
    taken = found.take(pc.index_in(cache["seg"].combine_chunks(), found["seg"].combine_chunks()))
    held = parts.sparkSession.sparkContext.broadcast((taken["said"].combine_chunks().cast(pa.binary()), [pc.fill_null(taken[c], 0).to_numpy().astype(np.int64) for c in SUMS]))
    holes = parts.filter("size(rest) > 0").select("_row", F.posexplode("rest").alias("k", "seg"))
    short = others.select("seg", halved(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("n_a", "n_best", "count_sum")], "said")).alias("data"))
    good = parts if bad is None else parts.join(bad, "_row", "left_anti")
    own = good.select("_row", F.lit(_LAST).alias("k"), F.col("codes").alias("data"), "_id")
    none = F.lit(None).cast(own.schema["_id"].dataType).alias("_id")
    rows = spread_join(holes, short, ["seg"], ["_row"], hot=hot).select("_row", "k", "data", none).unionByName(own)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said, sums = held.value[0].to_pylist(), held.value[1]
        row, fills = None, []
        for b in slices(batches, 512):
            at, k, texts, totals = [], b.column(1).to_pylist(), [], []
            for i, (r, x, data) in enumerate(zip(b.column(0).to_pylist(), k, b.column(2).to_pylist(), strict=True)):
                if r != row:
                    row, fills = r, []
                if x != _LAST:
                    n_a, n_best, count_sum, text = unhalved(data).split(b" ", 3)
                    n_links = text.count(b";") + 1
                    fills.append((int(n_a), text.count(b",") + 2 * n_links - int(n_a), n_links, int(n_best), int(count_sum), text))
                    continue
                codes = unpacked(data)
                inside = codes[codes >= 0]
                total = np.array([c[inside].sum() for c in sums])
                if len(inside) < len(codes):
                    total += np.array([f[:-1] for f in fills], np.int64)[-1 - codes[codes < 0]].sum(0)
                    parts_ = [said[c] if c >= 0 else fills[-1 - c][-1] for c in codes.tolist()]
                else:
                    parts_ = [said[c] for c in codes.tolist()]
                at.append(i)
                texts.append(b";".join(parts_).decode() if parts_ else None)
                totals.append(total)
            n = np.array(totals, np.int64).reshape(-1, len(SUMS)).T
            yield pa.RecordBatch.from_arrays(
                [b.column(3).take(pa.array(at, pa.int32())), *[pa.array(n[s]) for s in (0, 1, 2, 2, 3, 4)], pa.array(texts, pa.string())],
                ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "said"],
            )

    ordered = rows.repartition("_row").sortWithinPartitions("_row", "k")
    out = in_arrow(ordered, compose, schema_of(parts, ["_id"]) + "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, said string")
    if bad is None:
        return out
    zeros = [F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return out.unionByName(parts.join(bad, "_row", "left_semi").select("_id", *zeros, F.lit(None).cast("string").alias("said")))


def are_verified(spark: SparkSession, a: str, b: str) -> bool:
    """`Tokenizers.verified`, looked up by an executor: the driver needs no vocabulary."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([loaded(a, b).verified])], ["verified"])

    return spark.range(1, numPartitions=1).mapInArrow(look, "verified boolean").first()["verified"]


def align_tokenizers(docs: DataFrame, a: str, b: str, text: str = "text", id_col: str = "doc_id", most: int = CACHE_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """Two tables. For each row of docs: id, n_a, n_b (tokens), n_groups, n_links, n_best, count_sum, groups; and a, b, count, best for each pair of linked ids.

    groups: the ids of A and B between byte places where tokens of both end, as `a1,a2|b1;a3|b2,b3`; null for a text
    without tokens, which is a null or empty text, and one whose tokens' bytes differ from the space and the text:
    its numbers are 0 and its links are not counted. The pairs that end together are linked: the last of a group.
    n_best: links whose count is the highest of all with their id of B; count_sum: the sum of the links' counts.
    A null id is kept; repeated rows are aligned and counted each; texts of any length are aligned whole; no rows, no
    result. Further columns are ignored. a, b: files that every executor can read.
    """
    cut = are_verified(docs.sparkSession, a, b)
    counted = stage(segment_counts(docs, text, cut), "segments")
    kept = (F.col("n") >= least_count(counted, most)) & (F.octet_length("seg") <= CACHE_BYTES)
    aligned = stage(aligned_segments(counted.withColumn("kept", kept), a, b), "aligned")
    # Frequent ones get small numbers, which are stored short.
    cache = aligned.filter("kept").select("seg", "n", F.col("said").isNotNull().alias("good")).toArrow().sort_by([("n", "descending"), ("seg", "ascending")]).select(["seg", "good"]).combine_chunks()
    total = aligned.agg(F.sum("n")).first()[0] or 0
    discard(counted)
    hot = stage(aligned.filter(~F.col("kept") & (F.col("n") > max(HOT_ROWS, total // HOT_PARTS))).select("seg"), "hot")
    parts = parts_of(docs, text, id_col, cache, cut)
    good, bad = without_bad(aligned, parts, cache)
    links = link_counts(good)
    values = lambda which: valued(good.filter("said is not null").filter(which), links)
    out = composed(parts, values("kept"), values("not kept"), hot, bad, cache)
    return out.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("said").alias("groups")), links


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows, _ = align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op12_token_alignment": op12_token_alignment}
