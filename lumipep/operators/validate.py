"""Checks of inputs: each gives the rows that break it, or their number."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def bad_scores(scores: DataFrame) -> DataFrame:
    return scores.filter(not_finite(F.col("s").cast("double")))


def zero_rows(scores: DataFrame) -> DataFrame:
    """Reads whose scores are all 0."""
    return scores.groupBy("read_id").agg(F.sum(F.abs("s")).alias("t")).filter("t = 0").select("read_id")


def zero_emission(emission: DataFrame) -> DataFrame:
    return emission.filter("p = 0 or p is null")


def unordered_ids(scores: DataFrame, position: str) -> DataFrame:
    """Rows whose flu is not above the one before it in the read."""
    before = F.lag("flu_id").over(Window.partitionBy("read_id").orderBy(position))
    return scores.withColumn("step", F.col("flu_id") - before).filter("step <= 0")


def unseen_proteins(proteins: DataFrame, emission: DataFrame) -> DataFrame:
    return proteins.join(emission.select("protein_id").distinct(), "protein_id", "left_anti")


def extremes(scores: DataFrame) -> DataFrame:
    """max_score, max_flu, not_finite: the highest score and id of a set, and how many scores are null, NaN or infinite."""
    bad = not_finite(F.col("s").cast("double"))
    return scores.agg(F.max(F.when(~bad, F.col("s"))).alias("max_score"), F.max("flu_id").alias("max_flu"), F.count_if(bad).alias("not_finite"))


def unassigned(selection: DataFrame) -> DataFrame:
    return selection.filter("read_id is null or read_id < 0")


def sparsity(wanted: int, held: int) -> int:
    """The scores a read to use: `wanted`, or what the dataset holds, with a warning, if that is fewer."""
    if wanted > held:
        warnings.warn(f"{wanted} scores a read are asked for; the dataset holds {held}", stacklevel=2)
    return min(wanted, held)


def report(scores: DataFrame, emission: DataFrame, proteins: DataFrame) -> DataFrame:
    """check, n: how many rows break each check."""
    found = {"bad_scores": bad_scores(scores), "zero_rows": zero_rows(scores), "zero_emission": zero_emission(emission), "unseen_proteins": unseen_proteins(proteins, emission)}
    out = None
    for name, rows in found.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out
