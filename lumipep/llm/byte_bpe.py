"""Byte-level BPE encoding and decoding with a given rank file, in Spark's higher-order functions.

A text is cut by the tokenizer's pattern into words (Java's regular expressions). A word is encoded by a fold over
the array of its bytes: each element holds a piece's id and the rank of the merge with its right neighbour, and each
step joins the leftmost pair of the lowest rank, until no pair merges. The ranks of pairs are a literal of the plan:
an array in which every pair has a place of its own, at the offset of its left id, so a lookup reads one element
instead of scanning a map of 50,000 entries.

Distinct words are folded, not occurrences: the words of all texts are counted, and the CACHE_WORDS most frequent
ones are encoded once by the fold and kept as a table, whose size is bounded by that number and by CACHE_CHARS. The
other words go through the same fold next to their text, each once in a batch of texts and many at a time (`fold_all`:
a step joins the leftmost lowest pair of every word), with the same two arrays of ranks. So the table's size changes
the speed and never the result. Looking words up, folding, putting ids in order and decoding (binary pieces are taken
by id and stand one after the other) are whole Arrow columns at a time, in one Python worker a task; nothing is
shuffled but the counts of words, and the plan that reads the texts has no literal.

The fold of one word takes time with the square of its length. Words of more than LONG_WORD bytes, which no language
has, but encoded data do, are encoded by a heap of pairs over a linked list of pieces instead.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import constant, fresh, give_back, in_arrow, named, slices, stage, table, text_bytes

CACHE_WORDS = 1 << 18
#: Longer words are never kept in the table.
CACHE_CHARS = 32
#: Longer words are not folded.
LONG_WORD = 256
#: Rows whose ids a worker holds at a time, words that it looks up at a time, and bytes of words that it folds at a time.
ROWS, WORDS, FOLD_BYTES = 256, 1 << 19, 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def java_pattern(pattern: str) -> str:
    r"""The pattern for Java's engine: \s has to mean Unicode white space, as it does for the tokenizer."""
    return "(?U)" + pattern


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merges(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """For each token of two bytes or more, the length of the left piece of the merge that makes it: the last step of its own encoding.

    A vocabulary is refused if a token is not made of tokens that rank below it. So a token comes about by one pair
    of pieces only, wherever it stands: what lies inside its edges has gone through the same merges as on its own.
    """
    out = {}
    for token, own in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= own:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out[token] = len(parts[0])
        elif len(parts) > 2:
            raise ValueError(f"token {token!r} is not made by merges that rank below it")
    return out


class PairRanks:
    """The rank of the merge of two ids, by two arrays: `moves` has an offset for each left id, and `places` at offset + right id the left id (from 1) and the rank in one number, or 0. The place tells the right id. In a fold by columns they are literals; numbers are small, since plans print them."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max((r + 1 for r in pairs.values()), default=256).bit_length()
        if self.bits > 20:
            raise ValueError("ranks above 2^20")
        self.none = 1 << self.bits
        rows: dict[int, list[int]] = {}
        for a, b in pairs:
            rows.setdefault(a, []).append(b)
        places, moves, start = np.zeros(4 * len(pairs) + 2 * self.none, np.int64), [0] * self.none, 0
        for a, right in sorted(rows.items(), key=lambda x: -len(x[1])):
            # The first offset at which all places of the row are free; a row finds none before that of a longer one's first.
            at = np.array(right)
            moves[a] = start = next(m for m in range(start if len(right) > 1 else 0, len(places)) if not places[at + m].any()) if len(right) > 1 else int(np.argmax(places[at[0] :] == 0))
            places[at + moves[a]] = [(a + 1 << self.bits) | pairs[a, b] for b in right]
        last = int(np.flatnonzero(places).max(initial=0)) + 1
        self.places, self.moves = places[:last], np.array(moves)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or `none`."""
        at = self.moves[a] + b
        inside = at < len(self.places)
        stands = np.where(inside, self.places[np.where(inside, at, 0)], 0)
        return np.minimum(stands ^ (a + 1 << self.bits), self.none)

    def rank(self, tables: Column, a: Column, b: Column) -> Column:
        """The rank, or `none` if the pair does not merge or b is null."""
        stands = F.get(tables["places"], F.get(tables["moves"], a) + b)
        # Without the left id's own bits: the rank, or a larger number if another pair or none stands there.
        return F.least(stands.bitwiseXOR(F.shiftleft(a + 1, self.bits)), F.lit(self.none))


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = java_pattern(pattern)
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = PairRanks({(ranks[t[:n]], ranks[t[n:]]): ranks[t] for t, n in merges(ranks).items()})
        self.one = np.array([ranks[bytes([i])] for i in range(256)])
        # The same in the order of the top 8 bits of their crc32, which differ for all bytes: Spark has no function that gives a byte's number.
        self.by_crc = [r for _, r in sorted((zlib.crc32(bytes([i])) >> 24, ranks[bytes([i])]) for i in range(256))]
        pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            pieces[r] = b
        self.pieces = pa.array(pieces, pa.binary())
        #: Columns word, ids; Arrow memory on the driver and in the workers.
        self.known: pa.Table | None = None

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(self.pattern), F.lit(0))

    def _fold(self, tables: Column, word: Column) -> Column:
        """Ids of one word. An element of the folded array is rank * 2^bits + id."""
        p, bits = self.pairs, self.pairs.bits
        element = lambda a, b: F.shiftleft(p.rank(tables, a, b), bits).bitwiseOR(a)
        id_of = lambda x: x.bitwiseAND(F.lit(p.none - 1))

        def joined(s: Column, new: Column, at: Column) -> Column:
            here = element(new, id_of(F.get(s, at + 2)))
            before = id_of(F.get(s, at - 1))
            middle = F.when(at > 0, F.array(element(before, new), here)).otherwise(F.array(here))
            return F.concat(F.slice(s, F.lit(1), F.greatest(at - 1, F.lit(0))), middle, F.slice(s, at + 3, F.size(s)))

        def step(s: Column, _: Column) -> Column:
            # The lowest rank and, of equal ones, the leftmost place.
            low = F.array_min(F.transform(s, lambda x, i: F.shiftleft(F.shiftright(x, bits), 31).bitwiseOR(i.cast("long"))))
            return let(low, lambda x: F.when(x < F.lit(p.none << 31), joined(s, F.shiftright(x, 31), x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))).otherwise(s))

        def ids(b: Column) -> Column:
            start = F.zip_with(b, F.slice(b, F.lit(2), F.size(b)), element)
            return F.aggregate(F.slice(b, F.lit(2), F.size(b)), start, step, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

        def of_bytes(b: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.get(tables["bytes"], F.shiftright(F.crc32(F.substring(b, i, F.lit(1))), 24)))

        return F.when(word != "", let(let(F.encode(word, "UTF-8"), of_bytes), ids)).otherwise(F.array().cast("array<int>"))

    def with_tables(self, body) -> Column:
        """body(tables), with the literals in the plan once."""
        literal = lambda x, name: constant(json.dumps(list(map(int, x))), "array<bigint>").alias(name)
        return let(F.struct(literal(self.pairs.places, "places"), literal(self.pairs.moves, "moves"), literal(self.by_crc, "bytes")), body)

    def fold(self, word: Column) -> Column:
        return self.with_tables(lambda t: self._fold(t, word))

    def learn_words(self, df: DataFrame, text: str = "text", most: int = CACHE_WORDS) -> ByteBPE:
        """Count the words of all texts, fold the most frequent ones once and keep their ids: at most `most` entries of at most CACHE_CHARS characters."""
        counted = df.select(F.explode(self.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        counted = stage(counted.filter(F.length("word") <= CACHE_CHARS), "words")
        # The lowest count that leaves at most `most` words, from the number of words of each count: no sort of all words.
        least, held = None, 0
        for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
            held += r["words"]
            if held > most:
                break
            least = r["n"]
        self.known = None
        if least is not None:
            self.known = counted.filter(F.col("n") >= least).select("word", self.fold(F.col("word")).alias("ids")).toArrow().combine_chunks()
        give_back()
        return self

    def with_ids(self, df: DataFrame, text: str, columns: list[str], make, schema: str) -> DataFrame:
        """The rows that make(named columns, ids, pieces) gives for each batch of texts; ids: a list for each text.

        The worker looks the words of some texts up in the table, and folds what is not there, each word once.
        """
        held = df.sparkSession.sparkContext.broadcast((self.known, self.pieces, self.pairs, self.one))
        cut = df.select(*named(columns), self.words(F.col(text)).alias(fresh(df, "_words")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, pieces, pairs, one = held.value
            known = vocabulary(known)
            ranks: dict[bytes, int] = {}  # for long words, if there are any
            for b in batches:
                words = b.columns[-1]
                ends, lo = words.offsets.to_numpy(), 0
                while lo < b.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WORDS, "right")) - 1)
                    flat_words = words.values.slice(ends[lo], ends[hi] - ends[lo])
                    found, of = looked_up(flat_words, known)
                    missing = np.flatnonzero(found < 0)
                    if len(missing):
                        rest = flat_words.take(pa.array(missing)).unique()
                        long = pc.greater(pc.binary_length(rest), LONG_WORD)
                        found, of = looked_up(flat_words, folded_words(rest.filter(pc.invert(long)), pairs, one), found, of)
                        if pc.any(long).as_py():
                            ranks = ranks or {x: i for i, x in enumerate(pieces.to_pylist()) if x is not None}
                            found, of = looked_up(flat_words, encoded_words(rest.filter(long), ranks), found, of)
                    for at in range(lo, hi, ROWS):
                        n = min(ROWS, hi - at)
                        yield make(b.slice(at, n).columns[:-1], ids_of_words(ends[at : at + n + 1].astype(np.int64), found[ends[at] - ends[lo] : ends[at + n] - ends[lo]], *of), pieces)
                    lo = hi

        return in_arrow(cut, run, schema)

    def ids_of(self, text: Column) -> Column:
        """Ids of a text by the fold alone; null counts as empty."""
        return self.with_tables(lambda t: F.flatten(F.transform(self.words(text), lambda w: self._fold(t, w))))


def encode_long(word: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """Ids of a word, as the fold gives them: the pair of the lowest rank is joined first, of equal ones the leftmost. Time grows with n log n."""
    n = len(word)
    ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))  # by the place where a piece begins; n: none
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else n
        if j >= n or ends[j] != end:
            continue  # one of the two has been joined to another since
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : ends[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, ends[after[i]]))
        if before[i] >= 0 and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    return np.array([ranks[word[i : ends[i]]] for i in range(n) if ends[i]], np.int32)


#: Words, and for each the start and length of its run in the last array, which holds ids.
Words = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def vocabulary(known: pa.Table | None) -> Words:
    if known is None or not known.num_rows:
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    words, ids = known.column(0).chunk(0), known.column(1).chunk(0)
    offsets = ids.offsets.to_numpy().astype(np.int64)
    return words, offsets[:-1], np.diff(offsets), ids.values.to_numpy()


def fold_all(word: np.ndarray, ids: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """The fold of many words at once: a step joins the lowest-ranked pair of each word, of equal ones the leftmost, and takes out the words in which no pair merges. word: the number of each id's word, ascending."""

    def ranks_at(i: np.ndarray) -> np.ndarray:
        j = np.minimum(i + 1, len(ids) - 1)
        return np.where((j > i) & (word[i] == word[j]), pairs.of(ids[i], ids[j]), pairs.none)

    done = [(word[:0], ids[:0])]
    ids, rank = ids.copy(), ranks_at(np.arange(len(ids)))
    while len(ids):
        begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        low = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), begin)
        more = low >> 32 < pairs.none
        keep = np.repeat(more, np.diff(np.r_[begin, len(ids)]))
        done.append((word[~keep], ids[~keep]))
        at = low[more] & (1 << 32) - 1
        ids[at], keep[at + 1] = low[more] >> 32, False
        at = np.cumsum(keep)[at] - 1
        word, ids, rank = word[keep], ids[keep], rank[keep]
        for i in (at, at[at > 0] - 1):
            rank[i] = ranks_at(i)
    word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(word, kind="stable")
    return word[order], ids[order]


def folded_words(words: pa.Array, pairs: PairRanks, one: np.ndarray) -> Words:
    """Words and their ids. one: the ids of single bytes."""
    data, ends = text_bytes(words)
    lengths, flat, lo = np.zeros(len(words), np.int64), [np.zeros(0, np.int32)], 0
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + FOLD_BYTES, "right")) - 1)
        word, ids = fold_all(np.repeat(np.arange(lo, hi), np.diff(ends[lo : hi + 1])), one[data[ends[lo] : ends[hi]]], pairs)
        lengths[lo:hi] = np.bincount(word - lo, minlength=hi - lo)
        flat.append(ids.astype(np.int32))
        lo = hi
    return words, np.cumsum(lengths) - lengths, lengths, np.concatenate(flat)


def encoded_words(words: pa.Array, ranks: dict[bytes, int]) -> Words:
    ids = [encode_long(w.encode(), ranks) for w in words.to_pylist()]
    n = np.array([len(x) for x in ids], np.int64)
    return words, np.cumsum(n) - n, n, np.concatenate(ids)


def looked_up(words: pa.Array, more: Words, found: np.ndarray | None = None, of: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """For each word its number among `more`, or, after an earlier call, the number found before and else one behind what was there, and -1 if it is nowhere; and the starts, lengths and ids of all."""
    if found is None or of is None:
        return pc.fill_null(pc.index_in(words, more[0]), -1).to_numpy(), more[1:]
    missing = np.flatnonzero(found < 0)
    at = pc.fill_null(pc.index_in(words.take(pa.array(missing)), more[0]), -1).to_numpy()
    found = found.copy()
    found[missing] = np.where(at < 0, -1, len(of[0]) + at)
    return found, (np.r_[of[0], len(of[2]) + more[1]], np.r_[of[1], more[2]], np.r_[of[2], more[3]])


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each run, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def ids_of_words(ends: np.ndarray, found: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> pa.ListArray:
    """Of each list of words (by their offsets) the ids. found: the words' numbers, whose runs in `flat` start at `starts`."""
    n = lengths[found]
    return lists(pa.array(flat[runs(starts[found], n)]), np.r_[0, np.cumsum(n)][ends - ends[0]])


def schema_of(df: DataFrame, columns: list[str]) -> str:
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c.replace('`', '``')}` {fields[c]}, " for c in columns)


def joined_pieces(ids: pa.ListArray, pieces: pa.Array) -> pa.BinaryArray:
    """For each list of ids their pieces, one after the other. An id without a piece is an error."""
    ends = ids.offsets.to_numpy()
    taken = pieces.take(ids.values.slice(ends[0], ends[-1] - ends[0]))
    if taken.null_count:
        raise ValueError("an id has no piece")
    _, offsets, data = taken.buffers()
    at = np.frombuffer(offsets, np.int32)[taken.offset :][ends - ends[0]] if len(taken) else np.zeros(len(ends), np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(at)), data or pa.py_buffer(b"")])


def encoded(df: DataFrame, bpe: ByteBPE, text: str = "text") -> DataFrame:
    """df with `token_ids` (array<int>), which replaces a column of that name.

    A null or empty text has no ids; a long text is encoded whole; repeated rows are alike; an empty table gives an
    empty one. Other columns may have any names.
    """
    kept = [c for c in df.columns if c != "token_ids"]
    make = lambda columns, ids, _: pa.RecordBatch.from_arrays([*columns, ids], names=[*kept, "token_ids"])
    return bpe.with_ids(df, text, kept, make, schema_of(df, kept) + "token_ids array<int>")


def decoded(df: DataFrame, bpe: ByteBPE, ids: str = "token_ids") -> DataFrame:
    """df with `decoded` (binary), which replaces a column of that name. Null ids give null; no ids, no bytes; an id without a piece is an error."""
    kept, held = [c for c in df.columns if c != "decoded"], df.sparkSession.sparkContext.broadcast(bpe.pieces)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ROWS):
            x = pc.fill_null(b.column(b.num_columns - 1), []) if b.column(b.num_columns - 1).null_count else b.column(b.num_columns - 1)
            out = joined_pieces(x, held.value)
            if b.column(b.num_columns - 1).null_count:
                out = pc.if_else(b.column(b.num_columns - 1).is_valid(), out, None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names=[*kept, "decoded"])

    return in_arrow(df.select(*named(kept), F.col(ids).cast("array<int>").alias(fresh(df, "_ids"))), pieces, schema_of(df, kept) + "decoded binary")


def digest_of_round_trip(df: DataFrame, bpe: ByteBPE, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encode every whole text, then decode the ids by joining their pieces."""

    def digest(columns: list[pa.Array], ids: pa.ListArray, pieces: pa.Array) -> pa.RecordBatch:
        sha = lambda a, skip: pa.array([hashlib.sha256(memoryview(x.as_buffer())[skip:]).hexdigest() for x in a], pa.string())
        numbers = decimals(len(pieces))
        return pa.RecordBatch.from_arrays([*columns, pc.list_value_length(ids).cast(pa.int64()), sha(joined_pieces(ids, numbers), 1), sha(joined_pieces(ids, pieces), 0)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return bpe.with_ids(df, text, [id_col], digest, schema_of(df, [id_col]) + "n_tokens long, ids_sha256 string, decoded_sha256 string")


@lru_cache(1)
def decimals(n: int) -> pa.BinaryArray:
    """Each number below n, with a space before it."""
    return pa.array([b" %d" % i for i in range(n)], pa.binary())


def round_trip(df: DataFrame, bpe: ByteBPE, text: str = "text") -> DataFrame:
    """df with token_ids, n_tokens and `intact`: whether the ids decode to the bytes of the text. Columns of these names are replaced.

    A null or empty text has no ids and is intact; a long text is encoded whole; repeated rows are alike; an empty
    table gives an empty one.
    """
    kept = [c for c in df.columns if c not in ("token_ids", "n_tokens", "intact")]
    at = kept.index(text)

    def check(columns: list[pa.Array], ids: pa.ListArray, pieces: pa.Array) -> pa.RecordBatch:
        ok = pc.equal(joined_pieces(ids, pieces), pc.fill_null(columns[at], "").cast(pa.binary()))
        return pa.RecordBatch.from_arrays([*columns, ids, pc.list_value_length(ids).cast(pa.int64()), ok], names=[*kept, "token_ids", "n_tokens", "intact"])

    return bpe.with_ids(df, text, kept, check, schema_of(df, kept) + "token_ids array<int>, n_tokens long, intact boolean")


def public_bpe(name: str = "byte_bpe_50k.tiktoken") -> ByteBPE:
    import public_tokenizers

    bpe = ByteBPE(read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)
    give_back()
    return bpe


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest_of_round_trip(docs, public_bpe().learn_words(docs))


SQL: dict[str, str] = {}
QUERIES = {"op5_byte_bpe": op5_byte_bpe}
