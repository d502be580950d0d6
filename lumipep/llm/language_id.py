"""Language ID by rank-order profiles.

A profile is a language's most frequent letter n-grams (1 to 3 letters, word edges as blanks), in order of
frequency. A document's own most frequent n-grams are compared to each profile by the out-of-place distance:
the sum of the differences in rank, with the profile's length for an n-gram that it lacks.

Profiles are learned from at most FIT_DOCS documents of each language, those first by the md5 of their id; the
counting is a Spark aggregation. Whole texts are counted when profiles are made and when they are applied.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import first_of_each, fresh, held_out, in_arrow, named, slices, table

FIT_DOCS = 2000
PROFILE = 400
#: Steepness of the score over the distances, which lie in [0, 1].
SHARPNESS = 40.0
MAX_LANGUAGES = 500
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """True for the code points that are letters, over all of Unicode."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


LETTERS = _letters()
#: Bits of a code point; three of them fit in a code.
POINT = 21


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text, repeated as they occur; none if it has no letter."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = LETTERS[c]
    if not is_letter.any():
        return np.zeros(0, np.int64)
    c = np.where(is_letter, c, 32)
    keep = is_letter | np.r_[True, is_letter[:-1]]  # of a run of other characters, the first
    c = np.r_[32, c[keep], 32]
    two = (c[:-1] << POINT) | c[1:]
    three = (two[:-1] << POINT) | c[2:]
    return np.concatenate([c[c != 32], two[two != ((32 << POINT) | 32)], three[c[1:-1] != 32]])


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, in order; ties by code."""
    u, n = np.unique(codes, return_counts=True)
    if len(u) > most:
        least = np.partition(n, len(n) - most)[-most]
        u, n = u[n >= least], n[n >= least]
    return u[np.lexsort((u, -n))][:most]


class Profiles:
    """For each language its ranked codes; distances of a document to all of them at once."""

    def __init__(self, by_language: dict[str, list[int]], length: int = PROFILE):
        self.languages, self.length = sorted(by_language), length
        self.codes = np.unique(np.array([c for v in by_language.values() for c in v], np.int64))
        self.ranks = np.full((len(self.codes), len(self.languages)), -1, np.int64)
        for j, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.codes, by_language[lang]), j] = np.arange(len(by_language[lang]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, top), max(0, len(self.codes) - 1))
        r = np.where((self.codes[at] == top)[:, None], self.ranks[at], -1)
        out = np.where(r < 0, self.length, np.minimum(np.abs(r - np.arange(len(top))[:, None]), self.length))
        return out.sum(0) / (self.length * len(top))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, distance to its profile."""
        codes = grams(text) if text else np.zeros(0, np.int64)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0, 1.0
        d = self.distances(ranked(codes, self.length))
        best = int(np.argmin(d))  # ties: the first language in order
        return self.languages[best], float(1 / np.exp(-SHARPNESS * (d - d[best])).sum()), float(d[best])


def fit(docs: DataFrame, text: str, lang: str, id_col: str, most: int = FIT_DOCS, length: int = PROFILE) -> Profiles:
    """Profiles of every non-null language, from up to `most` documents of each."""
    order = [F.md5(F.col(id_col).cast("string")), F.col(id_col)]
    chosen = first_of_each(docs.filter(F.col(lang).isNotNull()).select(id_col, lang), lang, order, most)
    # At most `most` ids a language: the sample's size is bounded, whatever the corpus holds.
    sample = docs.join(F.broadcast(chosen.select(F.col(id_col).alias("_id")).distinct()), F.col(id_col) == F.col("_id"), "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for language, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, n = np.unique(grams(t or ""), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(u), pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    counted = in_arrow(sample.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), text), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    rows = counted.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= length).orderBy("lang", "r").limit(MAX_LANGUAGES * length + 1).collect()
    if len(rows) > MAX_LANGUAGES * length:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by_language: dict[str, list[int]] = {}
    for r in rows:
        by_language.setdefault(r["lang"], []).append(r["code"])
    return Profiles(by_language, length)


def predicted(docs: DataFrame, profiles: Profiles, text: str, columns: list[str]) -> DataFrame:
    """The named columns, then lang_pred, score, distance.

    Null text, or text without a letter: `und`, score 0, distance 1. Score: share of the best language in
    exp(-SHARPNESS * distance) over all languages, 1 if there is one language alone. Equal distances: the
    first language in alphabetical order. Without any labelled text everything is `und`. Repeated rows are
    predicted alike; further columns are ignored, and one named like an added column is replaced.
    """
    added = [("lang_pred", pa.string()), ("score", pa.float64()), ("distance", pa.float64())]
    plain = docs.select(*named([c for c in columns if c not in dict(added)]), F.col(text).alias(fresh(docs, "_text")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [profiles.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            cols = [pa.array([f[i] for f in found], kind) for i, (_, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*b.schema.names[:-1], *[n for n, _ in added]])

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return in_arrow(plain, score, schema + (", " if schema else "") + "lang_pred string, score double, distance double")


#: A text farther than this from every profile is in no language of theirs.
FARTHEST = 0.95


def accepted(docs: DataFrame, profiles: Profiles, text: str) -> DataFrame:
    """The rows of docs, with their columns, whose text has letters and lies no farther than FARTHEST from some profile; rows with a null text go. Without any profile all rows with a letter stay."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ok = [profiles.predict(t)[2] <= FARTHEST if profiles.languages else bool(t) and len(grams(t)) > 0 for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return in_arrow(docs, keep, docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = fit(docs.filter(~F.col("held_out")), "text", "lang", "doc_id")
    return predicted(docs, profiles, "text", ["doc_id", "held_out"])


SQL: dict[str, str] = {}
QUERIES = {"op8_language_id": op8_language_id}
