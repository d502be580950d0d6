"""Quality by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is compressed with each dictionary, block by block, so that the dictionary matters for all of it. The
difference of the two sizes over the text's own size says which kind of text it is closer to. A logistic curve,
fitted on labelled texts that the dictionaries have not seen, turns the difference into a score.

Dictionaries and curve come from at most FIT_DOCS labelled documents of each class, those first by the md5 of
their id; whole texts are used. Everything else is one pass over the corpus without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import first_of_each, fresh, held_out, in_arrow, slices, table

FIT_DOCS = 1500
DICTIONARY_BYTES = 256 << 10
BLOCK = 4096
#: Bytes of the segments that training picks.
SEGMENT = 256
LEVEL = 6


def _dictionary(texts: list[bytes]) -> bytes:
    """Content that zstandard matches against: the whole texts where they fit, else trained on every block of every text."""
    whole = b"\n".join(texts)
    if len(whole) <= DICTIONARY_BYTES:
        return whole
    blocks = [t[j : j + BLOCK] for t in texts for j in range(0, len(t), BLOCK)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, blocks, k=SEGMENT, d=8).as_bytes()


@dataclass
class Compressor:
    good: bytes
    bad: bytes
    slope: np.ndarray = None
    offset: float = 0.0

    def sizes(self, texts: list[bytes]) -> np.ndarray:
        """For each text: size with the good dictionary, with the bad one, and its own."""
        with_dict = [
            zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), write_content_size=False, write_dict_id=False)
            if d
            else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            for d in (self.good, self.bad)
        ]
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            blocks = [t[j : j + BLOCK] for j in range(0, len(t), BLOCK)]
            out[i] = [*(sum(len(c.compress(b)) for b in blocks) for c in with_dict), len(t)]
        return out

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        """Normalised difference, and the same weighted by how much text stands behind it."""
        n = sizes[:, 2]
        d = (sizes[:, 1] - sizes[:, 0]) / np.maximum(n, 1)
        return np.stack([d, d * np.log1p(n)], 1)

    def calibrate(self, sizes: np.ndarray, labels: np.ndarray) -> None:
        x, y = self.features(sizes), labels.astype(float)
        scale = x.std(0) + 1e-9
        x, w, b = x / scale, np.zeros(x.shape[1]), 0.0
        for _ in range(200):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-(x @ w + b)))
            xb = np.c_[x, np.ones(len(x))]
            g = xb.T @ (p - y) / len(y) + 1e-4 * np.r_[w, 0]
            h = (xb * (p * (1 - p))[:, None]).T @ xb / len(y) + 1e-4 * np.eye(xb.shape[1])
            step = np.linalg.solve(h, g)
            w, b = w - step[:-1], b - step[-1]
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.offset = w / scale, float(b)

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if self.slope is None:
            return np.full(len(sizes), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.features(sizes) @ self.slope + self.offset, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, text: str, id_col: str, label: str = "quality", most: int = FIT_DOCS) -> Compressor:
    """docs: rows that may be learned from. labels: id, label 0 or 1; others and nulls are left out."""
    marked = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
    known = marked.join(docs.select(F.col(id_col).alias("_id")).distinct(), "_id", "left_semi")
    chosen = first_of_each(known, "_y", [F.md5(F.col("_id").cast("string")), F.col("_id")], most)
    # At most 2 * most ids.
    rows = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_n", "_y", F.coalesce(text, F.lit("")).alias("t")).orderBy("_n", "_y", "t").limit(2 * most).collect()
    by = {(y, part): [r["t"].encode() for r in rows if r["_y"] == y and r["_n"] % 2 == part] for y in (0, 1) for part in (0, 1)}
    model = Compressor(_dictionary(by[1, 0]), _dictionary(by[0, 0]))
    seen = by[1, 1] + by[0, 1]
    if by[1, 1] and by[0, 1]:
        model.calibrate(model.sizes(seen), np.r_[np.ones(len(by[1, 1])), np.zeros(len(by[0, 1]))])
    return model


def scored(docs: DataFrame, model: Compressor, text: str, columns: list[str]) -> DataFrame:
    """The named columns, then score and predicted (1 if score >= 0.5, else 0).

    A null or empty text has no difference: its score is the curve's value at 0. Without labels of both classes
    every score is 0.5. Repeated rows score alike; further columns are ignored, and one named like an added
    column is replaced.
    """
    plain = docs.select(*[c for c in columns if c not in ("score", "predicted")], F.coalesce(text, F.lit("")).alias(fresh(docs, "_text")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = model.score(model.sizes([t.encode("utf-8", "surrogatepass") for t in b.column(b.num_columns - 1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=[*b.schema.names[:-1], "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return in_arrow(plain, score, schema + (", " if schema else "") + "score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")), table(spark, sf_dir, "labels"), "text", "doc_id")
    return scored(docs, model, "text", ["doc_id", "held_out"])


SQL: dict[str, str] = {}
QUERIES = {"op7_quality": op7_quality}
