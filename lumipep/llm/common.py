"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import written as stage  # noqa: F401  the operators' written tables

#: White space of the contracts: ASCII blanks only.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Removes the files of a table written by `stage` before the application ends; it must not be read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def constant(values: str, kind: str) -> Column:
    """A foldable constant of a nested type, from its JSON text: Catalyst folds it into one literal."""
    return F.from_json(F.lit(values), kind)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(c: Column) -> Column:
    """crc32 of the id as text, mod 3 equal to 1; false for a null id."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Bytes of an Arrow batch at which it is sent: rows hold whole texts, and Spark's default of 64 MB lies on both sides and as Python objects.
BATCH_BYTES = 8 << 20


def in_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow in batches of about BATCH_BYTES (a setting of the session, which stays set)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    names = df.columns
    # Names with dots, and repeated ones, cannot be told to mapInArrow: columns go by number and get their names back in the task.
    plain = len({n.lower() for n in names}) == len(names) and not any(c in n for n in names for c in ".`")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches if plain else (pa.RecordBatch.from_arrays(b.columns, names=names) for b in batches))
        give_back()

    return (df if plain else df.toDF(*[f"c{i}" for i in range(len(names))])).mapInArrow(run, schema)


def give_back() -> None:
    """Returns free memory to the system at the end of a task: workers live on, and what one keeps free another lacks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what a worker holds as Python objects stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, which may have dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def first_of_each(df: DataFrame, key: str, order: list[Column], most: int, number: str = "_n", salts: int = 64) -> DataFrame:
    """The first `most` rows of each key, numbered from 1. A hot key is ranked in `salts` parts first, so its last task sees salts * most rows at most."""
    salt = fresh(df, "_salt")
    parts = df.withColumn(salt, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    parts = parts.withColumn(number, F.row_number().over(Window.partitionBy(key, salt).orderBy(*order))).filter(F.col(number) <= most)
    return parts.withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(number) <= most).drop(salt)


#: A key is hot when it has more than this part of all rows, and more rows than HOT_ROWS: so at most HOT_PARTS keys are, and their list may be broadcast.
HOT_PARTS, HOT_ROWS = 2048, 256


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 64, hot: DataFrame | None = None) -> DataFrame:
    """left joined with right on keys, where a key may hold any share of left's rows.

    Rows of hot keys are dealt to `salts` parts by the columns in `spread` (which have to differ between them), and
    right's rows of these keys go to every part. The keys' counts come first, unless the caller knows the hot keys (HOT_PARTS
    at most); left and right should be written tables, or little more than a scan of one.
    """
    if hot is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
        total = counts.agg(F.sum("_count")).first()[0] or 0
        hot = stage(counts.filter(F.col("_count") > max(HOT_ROWS, total // HOT_PARTS)).select(*keys), "hot")
    hot = hot.select(*keys, F.lit(True).alias("_hot"))
    if hot.isEmpty():
        return left.join(right, keys, how)
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(parts)).drop("_hot")
    return salted.join(copied, [*keys, "_salt"], how).drop("_salt")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of strings, and the offset of each (and the end); null is empty. No copy unless there are nulls."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]
