"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word n-grams. Sets fall into bands by size (powers of
two). In a band the hashes are dealt into a fixed number of parts; two sets that are similar enough differ in
at most d elements, so of the first d + 1 parts that are not empty, at least one is the same in both. Each of
these parts names a tile: (band, part, content). A set also stands in the tiles of every larger band
in which a partner may be. So every pair of similar sets meets in a tile, and unrelated sets hardly ever do.

In a tile, pairs are bounded before they are compared: each set has a bitmap of as many bits as its size,
in which every element flips one bit; the bits in which two bitmaps differ bound the elements in which the sets
differ from below, and so the overlap from above. Only pairs that pass are intersected exactly.

For components (`jaccard_components`) a tile with many copies is not expanded into pairs. Every document is first
compared with one pivot, the smallest id it meets in its tiles; links make components, and what is in one component
already needs no comparing. Tiles in which two components are left go through a pivot of their own, and then all
their pairs of different components are bounded by bitmaps, in blocks of about BLOCK members. The pairs that pass are
not written: a block gives the edges of a forest that connects what they connect. Documents so connected are a group;
a group's sets come together, in blocks too, and its pairs are intersected where they lie, which again gives a forest,
of links between components. So the rows made grow with the members of a block, not with their pairs.
`jaccard_links` goes the same way, but gives every link of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, in_arrow, slices, spread_join, stage, table

#: Members of a tile or group that one task compares with as many others, and bytes of their sets.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Bits an element in the bitmaps of a group's sets: most pairs that do not link need no intersection.
WIDE = 8
#: Sets below this size have a part for each element, as have all sets where they may differ in too large a share of them to fill as many parts.
SINGLE = 64
#: Bytes of text hashed at a time; sets seen in a task, for copies that need no tiles of their own; bits of the filter of ids.
CHUNK, SEEN, FILTER_BITS = 1 << 20, 50_000, 1 << 26
SEED = 7

_TAB = np.random.default_rng(SEED).integers(0, 2**64, (64, 256), np.uint64).ravel()
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.random.default_rng(SEED + 1).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word k-grams; of fewer words, the one hash of them all; of none, nothing."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for t in texts:
        b = (t or "").encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= CHUNK:
            out += _sets(held, k)
            held, size = [], 0
    return out + _sets(held, k)


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    none = np.zeros(0, np.uint64)
    if not texts:
        return []
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # in raw, each text starts one after the last one's end
    blank = _BLANK[raw]
    at = np.flatnonzero(~blank)
    if not len(at):
        return [none] * len(texts)
    first = blank[at - 1]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, len(at)])
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    h = _TAB[((place & 63) << 8) | _LOW[raw[at]]]
    if lengths.max() > 64:
        h = h * _ODD[(place >> 6) & 63]
    words = mix(np.add.reduceat(h, starts) + lengths.astype(np.uint64) * _ODD[0])
    bounds = np.r_[0, np.searchsorted(at[starts], ends, "left")]
    n = len(words) - k + 1
    grams = none
    if n > 0:
        grams = words[:n] * _ODD[1]
        for j in range(1, k):
            grams = mix(grams) + words[j : j + n] * _ODD[1 + j]
        grams = mix(grams)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            few = words[lo:hi]
            x = np.array([hi - lo], np.uint64)
            for w in few:
                x = mix(x * _ODD[40] + w)
            out.append(x)
        else:
            out.append(none)
    return out


@dataclass(frozen=True)
class Rule:
    """Sets a, b link when den * |a & b| >= num * |a | b|."""

    k: int
    num: int
    den: int
    #: Deals the hashes into parts.
    seed: int = 0

    def differ(self, n: int, m: int) -> int:
        """Most elements in which linked sets of these sizes can differ."""
        return (self.den - self.num) * (n + m) // (self.den + self.num)

    def parts_of(self, n: int) -> int:
        return self.differ(n, n * self.den // self.num) + 1

    def bands(self, n: int) -> list[int]:
        """Of its own size and of every larger one that a linked set may have."""
        return list(range(int(n).bit_length(), (int(n) * self.den // self.num).bit_length() + 1))

    def tiles(self, s: np.ndarray) -> np.ndarray | None:
        """Keys of the tiles in which a set stands; None if this seed leaves it too few parts."""
        keys, want, dealt = [], self.parts_of(len(s)), mix(s + _ODD[50] * U(2 * self.seed + 1))
        for band in self.bands(len(s)):
            if 1 << band <= SINGLE or 5 * (self.den - self.num) > 2 * self.num:
                parts, content = dealt, dealt
                if len(parts) > want:
                    parts = content = np.partition(parts, want - 1)[:want]
            else:
                m = self.parts_of(1 << band) * 11 // 10 + 8
                part = ((dealt >> U(32)) * U(m)) >> U(32)
                order = np.argsort(part, kind="stable")
                p = part[order]
                begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
                if len(begin) < want:
                    return None
                content, parts = np.add.reduceat(mix(dealt[order] ^ _ODD[51]), begin)[:want], p[begin][:want]
            keys.append(mix(content * _ODD[52] + parts * _ODD[53] + U(band)))
        return np.concatenate(keys)

    def enough(self, a: int, b: int, both: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def links(self, s: np.ndarray, t: np.ndarray) -> bool:
        """By exact intersection of two sorted arrays."""
        if len(s) > len(t):
            s, t = t, s
        if not len(s):
            return False
        at = np.searchsorted(t, s)
        return self.enough(len(s), len(t), int((t[np.minimum(at, len(t) - 1)] == s).sum()))


def bitmap(s: np.ndarray, wide: int = 1) -> bytes:
    """One bit for each element flipped, in max(64, |s| rounded up to a power of 2) bits, or `wide` (a power of 2) times as many."""
    bits = max(64, wide << max(0, len(s) - 1).bit_length())
    where = (mix(s + _ODD[54]) & U(bits - 1)).astype(np.int64)
    flips = np.bincount(where, minlength=bits).astype(np.uint8) & 1
    return np.packbits(flips, bitorder="little").tobytes()


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words folded to fewer of them: halves that flip each other."""
    while b.shape[-1] > words:
        half = b.shape[-1] // 2
        b = b[..., :half] ^ b[..., half:]
    return b


def differing(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    w = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum())


def signatures(docs: DataFrame, rule: Rule, text: str, id_col: str) -> DataFrame:
    """doc, n, name (64 bits of the whole set), twin (an id of this task with the same set, if one came before), bits, tiles; short: this seed leaves a set too few parts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_())
        for b in slices(batches):
            rows: list[list] = [[] for _ in kinds]
            for i, s in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), rule.k), strict=True):
                twin = name = bits = tiles = None
                if len(s):
                    name = int(mix(s).sum().view(np.int64))
                if len(s) and i is not None:
                    twin = seen.get((len(s), name))
                    if twin is None:
                        if len(seen) < SEEN:
                            seen[len(s), name] = i
                        bits, tiles = bitmap(s), rule.tiles(s)
                short = bits is not None and tiles is None
                for column, v in zip(rows, (i, len(s), name, twin, bits, None if tiles is None else tiles.view(np.int64), short), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc", "n", "name", "twin", "bits", "tiles", "short"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")), make, "doc long, n long, name long, twin long, bits binary, tiles array<long>, short boolean")


def signed_with_tiles(docs: DataFrame, rule: Rule, text: str, id_col: str) -> DataFrame:
    """Written signatures by the first seed that gives every set enough parts: nearly always the first."""
    while True:
        signed = stage(signatures(docs, rule, text, id_col), "signed")
        if signed.filter("short").isEmpty():
            return signed
        rule = replace(rule, seed=rule.seed + 1)


def shared_tiles(signed: DataFrame) -> DataFrame:
    """tile, doc, pivot: the members of the tiles that have two or more, and each tile's smallest id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by tile and doc; the last row of a batch is kept as the context of the next.
        last: tuple | None = None  # tile, doc, pivot, written
        for b in batches:
            t, d = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(t):
                continue
            old = 0
            if last is not None:
                t, d, old = np.r_[last[0], t], np.r_[last[1], d], 1
            new = np.r_[True, t[1:] != t[:-1]]
            begin = np.flatnonzero(new)
            pivot = np.repeat(d[begin], np.diff(np.r_[begin, len(t)]))
            if old and last is not None:
                pivot[: (begin[1] if len(begin) > 1 else len(t))] = last[2]
            many = ~new
            many[:-1] |= ~new[1:]
            write = many.copy()
            if old and last is not None and last[3]:
                write[0] = False
            done = bool(many[-1]) if len(t) > 1 or not old else last[3]
            last = (t[-1], d[-1], pivot[-1], done)
            if write.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[write]) for x in (t, d, pivot)], ["tile", "doc", "pivot"])

    rows = signed.filter("tiles is not null").select(F.explode("tiles").alias("tile"), "doc")
    # Hash partitions by tile: a tile's run lies in one task, which reads it as a stream.
    return in_arrow(rows.repartition("tile").sortWithinPartitions("tile", "doc"), scan, "tile long, doc long, pivot long")


def plausible(pairs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for a link."""
    bits = signed.filter("bits is not null").select("doc", "n", "bits")
    side = lambda c: bits.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least("n_a", "n_b") * rule.den >= F.greatest("n_a", "n_b") * rule.num)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [differing(p, q) <= rule.differ(i, j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_arrow(both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b"), bound, "a long, b long").distinct()


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of FILTER_BITS bits that holds every id of the column `doc`; its size does not depend on them."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    words = ids.select(F.shiftright(bit, 6).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for b in words.toLocalIterator(prefetchPartitions=False):
        out[b["w"]] = b["v"]
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, rule: Rule, text: str, id_col: str) -> DataFrame:
    """doc, s (sorted hashes as bytes) of the documents in `wanted`. Texts of others are passed over where they are read."""
    held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted).view(np.uint8))
    k = rule.k

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in slices(batches, 2048):
            h = b.column(2).to_numpy() % FILTER_BITS
            b = b.filter(pa.array((bits[h >> 3] >> (h & 7)) & 1 == 1))
            ids, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                s = [x.tobytes() for x in shingle_sets(texts[lo : lo + 256], k)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 256), pa.array(s, pa.binary())], ["doc", "s"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    return in_arrow(rows.withColumn("h", F.xxhash64("doc")), make, "doc long, s binary")


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link: exact intersection of the two sorted arrays."""
    side = lambda c: sets.select(F.col("doc").alias(c), F.col("s").alias(f"s_{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [rule.links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_arrow(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "s_b"), check, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """doc, comp (the smallest id reachable) of every document with an edge (a, b). Labels go to neighbours, then labels take their own label, until nothing changes."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("doc")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("doc").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("comp").alias("near"))
        hooked = labels.join(near, "doc").select("doc", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        jump = labels.select(F.col("doc").alias("to"), F.col("comp").alias("next"))
        new = stage(hooked.join(jump, "to").select("doc", F.least("to", "next").alias("comp"), "was"), "labels")
        if new.filter("comp <> was").isEmpty():
            return new.select("doc", "comp")
        labels = new.select("doc", "comp")


def near(n: np.ndarray, bits: list[bytes], rule: Rule, unlike: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Sets that come in order of their sizes n. For each: the places of those after it whose sizes and bitmaps leave room for a link, and in how many bits they differ. Only pairs that differ in each array of `unlike` count; the caller may change these between two steps."""
    last = np.searchsorted(n, n * rule.den // rule.num, "right")
    width = np.array([len(b) // 8 for b in bits])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)  # a run, since larger sets have no narrower bitmaps
        base = int(at[0])
        rows = np.stack([fold(np.frombuffer(b, np.uint64), w) for b in bits[base : last[at[-1]]]])
        for i in at.tolist():
            j = np.arange(i + 1, last[i])
            for x in unlike:
                j = j[x[j] != x[i]]
            if len(j):
                apart = np.bitwise_count(rows[j - base] ^ rows[i - base]).sum(1, dtype=np.int64)
                ok = apart <= (rule.den - rule.num) * (n[j] + n[i]) // (rule.den + rule.num)
                if ok.any():
                    yield i, j[ok], apart[ok]


def in_blocks(rows: DataFrame, key: str, data: str, find: Callable[..., list[tuple[int, int]]]) -> DataFrame:
    """rows: key, doc, comp, n, blocks, data. a, b (a < b) of what `find` gives for every two of a key's blocks, and each block by itself: from docs, comps, n and data, in order of n, and the blocks that the two of a pair must not share, if there are two."""
    # Blocks by a hash of the id, so no task needs all of a key's rows in order; a key of few rows is one block.
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("doc"), "blocks").cast("int")).withColumn("last", (F.col("blocks") - 1).cast("int"))
    # Block i meets the blocks j >= i: (i, j).
    meet = F.explode(F.concat(F.transform(F.sequence(F.col("mine"), F.col("last")), lambda j: F.struct(F.col("mine").alias("i"), j.alias("j"))), F.transform(F.when(F.col("mine") > 0, F.sequence(F.lit(0), F.col("mine") - 1)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.struct(i.alias("i"), F.col("mine").alias("j")))))
    rows = rows.withColumn("meet", meet).select(key, F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "mine", "doc", "comp", "n", data)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            mine, doc, comp, n, values = zip(*held, strict=True)
            return find(np.array(doc), np.array(comp), np.array(n), values, np.array(mine) if at[1] != at[2] else None)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f(p) for p in found], pa.int64()) for f in (min, max)], ["a", "b"])

        for batch in batches:
            for t, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (t, i, j) != at:
                    found += close()
                    at, held = (t, i, j), []
                    if len(found) >= 10_000:
                        yield out()
                        found = []
                held.append(row)
        found += close()
        if found:
            yield out()

    return in_arrow(rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "n", "doc"), scan, "a long, b long").filter("a <> b")


def tile_forest(members: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """members: tile, doc, comp. a, b: edges that connect, in each tile, the documents of different components that sizes and bitmaps leave possible; of two blocks no more than they have members."""
    blocks = members.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    rows = members.join(blocks, "tile").join(signed.filter("bits is not null").select("doc", "n", "bits"), "doc")

    def find(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[bytes], block: np.ndarray | None) -> list[tuple[int, int]]:
        tree, edges = np.unique(doc, return_inverse=True)[1], []
        for i, places, _ in near(n, bits, rule, [comp, tree, *([] if block is None else [block])]):
            for j in places.tolist():
                if tree[i] != tree[j]:
                    edges.append((int(doc[i]), int(doc[j])))
                    tree[tree == tree[j]] = tree[i]
        return edges

    return in_blocks(rows, "tile", "bits", find).distinct()


def tile_links(members: DataFrame, docs: DataFrame, signed: DataFrame, rule: Rule, text: str, id_col: str, every: bool) -> DataFrame | None:
    """members: tile, doc, comp. Links between documents of different components that share a tile, written: every one, or as many as connect what they connect; None if none is plausible."""
    edges = stage(tile_forest(members, signed, rule), "plausible")
    if edges.isEmpty():
        return None
    # What links is in one group: a link is plausible, and the edges connect what is.
    groups = stage(members.join(components(edges).select("doc", F.col("comp").alias("group")), "doc").select("doc", "comp", "group").distinct(), "groups")
    sets = stage(sets_of(docs, groups.select("doc").distinct(), rule, text, id_col), "sets")
    rows = sets.join(groups, "doc").withColumn("n", (F.length("s") / 8).cast("long")).filter("n > 0")
    blocks = rows.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(8 * F.sum("n") / BLOCK_BYTES)).alias("blocks"))

    def find(doc: np.ndarray, comp: np.ndarray, n: np.ndarray, values: list[bytes], block: np.ndarray | None) -> list[tuple[int, int]]:
        sets, links = [np.frombuffer(v, np.uint64) for v in values], []
        for i, places, apart in near(n, [bitmap(s, WIDE) for s in sets], rule, [doc, comp, *([] if block is None else [block])]):
            for j in places[np.argsort(apart, kind="stable")].tolist():
                if comp[i] != comp[j] and rule.links(sets[i], sets[j]):
                    links.append((int(doc[i]), int(doc[j])))
                    if not every:
                        comp[comp == comp[j]] = comp[i]
        return links

    return stage(in_blocks(rows.join(blocks, "group"), "group", "s", find).distinct(), "links")


def linked(pairs: DataFrame, docs: DataFrame, signed: DataFrame, rule: Rule, text: str, id_col: str) -> DataFrame | None:
    """The pairs that link, written; None if none of them is plausible."""
    left = stage(plausible(pairs, signed, rule), "plausible")
    if left.isEmpty():
        return None
    wanted = left.select(F.col("a").alias("doc")).union(left.select("b")).distinct()
    sets = stage(sets_of(docs, wanted, rule, text, id_col), "sets")
    return stage(verified(left, sets, rule), "links")


def repeated_ids(signed: DataFrame) -> DataFrame | None:
    """a, b: links between an id of several rows and the ids that stand for some of them (twins), so that all rows of an id are one document; None if no id has several rows."""
    several = stage(signed.filter("doc is not null and n > 0").groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc"), "repeated")
    if several.isEmpty():
        return None
    return stage(signed.filter("twin <> doc").join(several, "doc").select(F.col("doc").alias("a"), F.col("twin").alias("b")).distinct(), "links")


def jaccard_links(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The whole join, as pairs of class representatives and membership.

    First every link between two different sets, as (a, b) with a < b: the smallest ids of the documents that have
    these sets. Then one row for each row of docs: id, n_shingles, class_id (the smallest id with the same set; the
    own id for an empty set, null for a null id) and n_links (to how many other classes its class links). Copies
    share a class, so they are not expanded; between different sets no link is left out. Sets, links, nulls and
    empty tables are as for `jaccard_components`. The result grows with the number of links.
    """
    rule = Rule(k, num, den)
    signed = signed_with_tiles(docs, rule, text, id_col)
    sets = signed.filter("doc is not null and n > 0")
    classes = stage(sets.groupBy("n", "name").agg(F.min("doc").alias("class")), "classes")
    # A class stands in tiles by any of its documents that have some; their pairs are pairs of classes.
    of_doc = stage(sets.join(classes, ["n", "name"]).select("doc", "class").distinct(), "class_of")
    members = stage(shared_tiles(signed).join(of_doc, "doc").select("tile", "doc", F.col("class").alias("comp")), "tiles")
    one = members.groupBy("tile", "comp").agg(F.min("doc").alias("doc"))
    found = tile_links(stage(one.select("tile", "doc", "comp"), "tiles"), docs, signed, rule, text, id_col, every=True)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "a long, b long")
    of = lambda c: of_doc.select(F.col("doc").alias(c), F.col("class").alias(f"class_{c}"))
    links = found.join(of("a"), "a").join(of("b"), "b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).filter("a <> b").distinct()
    links = stage(links, "class_links")
    number = links.select(F.col("a").alias("class")).union(links.select("b")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    rows = signed.select("doc", "n").join(of_doc, "doc", "left").join(number, "class", "left")
    return links, rows.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("class", "doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id that links lead to, its own included).

    Words are runs of anything but ASCII blanks, A-Z lower-cased. A set is the distinct k-word shingles of the
    whole text; with fewer words, the whole sequence as one; without words, or of a null text, empty and linked
    with nothing. Sets link when den * intersection >= num * union, whatever the number of copies. Rows that
    repeat an id count as one document; a null id is linked with nothing and its component is null. No rows, no
    result; further columns are ignored.
    """
    rule = Rule(k, num, den)
    signed = signed_with_tiles(docs, rule, text, id_col)
    members = stage(shared_tiles(signed), "tiles")
    links = repeated_ids(signed)

    def with_links(found: DataFrame | None) -> DataFrame | None:
        return found if links is None else links if found is None else links.unionByName(found)

    def compared(pairs: DataFrame) -> DataFrame | None:
        return with_links(linked(pairs, docs, signed, rule, text, id_col))

    # One pivot for each document: the smallest id of all its tiles.
    links = compared(members.groupBy(F.col("doc").alias("a")).agg(F.min("pivot").alias("b")).filter("a <> b"))
    own, rows = F.coalesce("comp", F.col("doc")), members
    for last in (False, True):
        comps = components(links) if links is not None else None
        known = rows.select("tile", "doc")
        known = known.join(comps, "doc", "left").select("tile", "doc", own.alias("comp")) if comps is not None else known.withColumn("comp", F.col("doc"))
        known = stage(known, "known")
        spread = known.groupBy("tile").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
        open_tiles = stage(known.join(spread, "tile"), "open")
        if open_tiles.isEmpty():
            break
        rows = open_tiles  # components only grow: a tile that is down to one stays so
        if last:
            links = with_links(tile_links(open_tiles.select("tile", "doc", "comp"), docs, signed, rule, text, id_col, every=False))
        else:
            # The smallest id outside the tile's first component is compared with all other components.
            pivot = open_tiles.filter("comp <> lo").groupBy("tile").agg(F.min_by(F.struct("doc", "comp"), "doc").alias("p"))
            pairs = open_tiles.join(pivot, "tile").filter("comp <> p.comp").select(F.least("doc", "p.doc").alias("a"), F.greatest("doc", "p.doc").alias("b")).distinct()
            links = compared(pairs)
    base = signed.select("doc", "n", F.coalesce("twin", "doc").alias("rep"))
    if links is not None:
        base = base.join(components(links).select(F.col("doc").alias("rep"), "comp"), "rep", "left").select("doc", "n", F.coalesce("comp", "rep").alias("root"))
    else:
        base = base.withColumnRenamed("rep", "root")
    base = stage(base, "roots")
    least = base.filter("root is not null and n > 0").groupBy("root").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    return spread_join(base, least, ["root"], ["doc"], "left").select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def near_deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that stand for their component (the smallest id), with all their columns; others go.

    Rows with a null id, an empty or null text stay; rows that share an id stay or go together; an empty table
    gives an empty one.
    """
    name = fresh(docs, "_gone")
    gone = jaccard_components(docs, k, num, den, text, id_col).filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    return docs.join(stage(gone, "gone"), F.col(id_col) == F.col(name), "left_anti")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


SQL: dict[str, str] = {}
QUERIES = {"op2_jaccard_join": op2_jaccard_join}
