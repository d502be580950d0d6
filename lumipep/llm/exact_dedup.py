"""Exact dedup by a tree merge of sorted digest runs.

Every partition makes one run: its digests in order, one row for each digest, with the smallest id and the count.
The runs are then exchanged in rounds, FANOUT partners at a time: in round r a row's slot takes the r-th base-FANOUT
digit of its digest range, so after all rounds each slot holds one range of digests. In each round the rows that a
slot gets from its partners are sorted again by Spark (its external sort stands for a multiway merge of the partners'
runs), and a stream over them keeps, of rows with the same digest, the smallest id and the sum of the counts; the
result is a written table of sorted runs. A
digest only merges with rows of the same byte length and the same independent 64-bit hash, which verifies it at
every level. Copies shrink to one row for each run before anything moves, so a group with a third of all rows costs
no more than any other, and a stream holds one row and one batch, whatever the length of its run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, fresh, in_arrow, named, stage, table

FANOUT = 8
#: What makes two texts the same: digest, and the length and hash that verify it.
SAME = ["_sha", "_bytes", "_check"]


def digests(df: DataFrame, text: str = "text", id_col: str = "doc_id", *more: str) -> DataFrame:
    """SAME and _id of each row, and the columns named in `more`."""
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")
    return df.select(F.col(id_col).alias("_id"), norm.alias("_norm"), *more).select(
        "_id",
        *more,
        F.unhex(F.sha2("_norm", 256)).alias("_sha"),
        F.octet_length("_norm").alias("_bytes"),
        F.xxhash64("_norm").alias("_check"),
    )


def merged(runs: DataFrame) -> DataFrame:
    """_slot, SAME, _keep, _n: the rows of each partition in order, and of those with the same slot and digest one."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: the next batch may go on with its digest
        for b in batches:
            t = (pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])).combine_chunks()
            if not t.num_rows:
                continue
            words = np.frombuffer(t["_sha"].cast(pa.binary(32)).chunk(0).buffers()[1], np.uint64)[: 4 * t.num_rows].reshape(-1, 4)
            new = np.r_[True, (words[1:] != words[:-1]).any(1)]
            for name in ("_slot", "_bytes", "_check"):
                x = t[name].to_numpy()
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            # Rows of a digest come in the order of their ids: the first has the smallest.
            out = t.take(pa.array(first)).set_column(t.num_columns - 1, t.schema.field("_n"), pa.array(np.add.reduceat(t["_n"].to_numpy(), first)))
            yield from out.slice(0, len(first) - 1).combine_chunks().to_batches()
            held = out.slice(len(first) - 1)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    order = [F.col(c) for c in ("_slot", *SAME)]
    return in_arrow(runs.select("_slot", *SAME, "_keep", "_n").sortWithinPartitions(*order, F.col("_keep").asc_nulls_last()), scan, runs.select("_slot", *SAME, "_keep", "_n").schema)


def tree_merge(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """rows: SAME + _id. Gives one row for each distinct text: SAME, _keep (smallest id), _n (its rows)."""
    parts = max(1, rows.rdd.getNumPartitions())
    rounds = 1
    while fanout**rounds < parts:
        rounds += 1
    slots = fanout**rounds
    # The range of a digest: its first 8 hex digits, scaled to the slots.
    scaled = F.floor(F.conv(F.substring(F.hex("_sha"), 1, 8), 16, 10).cast("long") * F.lit(slots) / F.lit(2.0**32)).cast("long")
    runs = rows.select((F.spark_partition_id() % slots).cast("long").alias("_slot"), *SAME, F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_n"))
    runs = stage(merged(runs), "runs")
    for r in range(rounds):
        w = fanout**r
        digit = F.floor(scaled / w).cast("long") % fanout
        here = F.floor(F.col("_slot") / w).cast("long") % fanout
        # Each slot sends every partner its range of digests; what arrives is merged.
        sent = runs.withColumn("_slot", F.col("_slot") + (digit - here) * w)
        runs = stage(merged(sent.repartition(min(slots, parts), "_slot")), "runs")
    return runs.drop("_slot")


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of df: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of ASCII blanks by one space. Null text counts
    as empty. Ties: the smallest id stays; rows that repeat the same id and text all carry kept = true.
    A null id never wins over a number; in a group of null ids alone keep_id is null and all rows are kept.
    `deduplicated` breaks these ties and keeps one row.
    Empty input gives an empty result; other columns of df are ignored; a long text is read whole.
    """
    rows = stage(digests(df, text, id_col), "digests")
    groups = tree_merge(rows).filter("_n > 1")
    g = groups.select(*[F.col(c).alias(f"_g{c}") for c in [*SAME, "_keep", "_n"]])
    # Only groups of copies are joined back; AQE splits the partition of a hot digest.
    joined = rows.join(g, [F.col(c) == F.col(f"_g{c}") for c in SAME], "left")
    keep = F.when(F.col("_g_n").isNull(), F.col("_id")).otherwise(F.col("_g_keep"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_g_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def deduplicated(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Exactly one row of each distinct text, with all its columns: one with the smallest id, of these the first by row number.

    Null ids come after all numbers; in a group of null ids alone one row stays. A null text counts as empty; a
    table read twice gives what it gives once; an empty table gives an empty one.
    """
    row = fresh(df, "_row")
    numbered = stage(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    rows = stage(digests(numbered, text, id_col, row), "digests")
    groups = tree_merge(rows).filter("_n > 1")
    g = groups.select(*[F.col(c).alias(f"_g{c}") for c in [*SAME, "_keep"]])
    copies = stage(rows.join(g, [F.col(c) == F.col(f"_g{c}") for c in SAME]).select(*SAME, row, F.col("_id").eqNullSafe(F.col("_g_keep")).alias("_first")), "copies")
    stays = copies.filter("_first").groupBy(*SAME).agg(F.min(row).alias(row))
    gone = copies.select(row).join(stays.select(row), row, "left_anti")
    return numbered.join(gone, row, "left_anti").select(*named(df.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)"""
}
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
