"""The sparse emission model P(flu | protein) and the weights that come with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import p_observable


def emission_counts(peps: DataFrame) -> DataFrame:
    """protein_id, flu_id, n."""
    return peps.groupBy("protein_id", "flu_id").agg(F.count(F.lit(1)).alias("n"))


def emission_model(counts: DataFrame, dyes: DataFrame, p_miss: float = 0.07) -> DataFrame:
    """protein_id, flu_id, n, n_dyes, w (n times the chance of being seen), p (rows of a protein sum to 1)."""
    w = counts.join(dyes, "flu_id").withColumn("w", F.col("n") * p_observable(F.col("n_dyes"), p_miss))
    return w.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("protein_id"))).select("protein_id", "flu_id", "n", "n_dyes", "w", "p")


def protein_weights(emission: DataFrame) -> DataFrame:
    """protein_id, exp_n: observable flus that one molecule is expected to give."""
    return emission.groupBy("protein_id").agg(F.sum("w").alias("exp_n"))


def share(df: DataFrame, value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Adds value / its sum, within `by` or over all rows. The totals are one row for each `by`."""
    df = df.withColumn("_v", value)
    by = by or []
    total = df.groupBy(*by).agg(F.sum("_v").alias("_t")) if by else df.agg(F.sum("_v").alias("_t"))
    joined = df.join(total, by) if by else df.crossJoin(F.broadcast(total))  # one row
    return joined.withColumn(name, F.col("_v") / F.col("_t")).drop("_v", "_t")


def prior(weights: DataFrame) -> DataFrame:
    """protein_id, exp_n, pi: start of the estimation, every protein equally abundant."""
    return share(weights, F.col("exp_n"), "pi")


def to_abundance(pi: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of reads to share of molecules: divide by exp_n, normalise."""
    return share(pi.drop("exp_n").join(weights.select("protein_id", "exp_n"), "protein_id"), F.col("pi") / F.col("exp_n"), "p_y", by)


def to_read_share(p_y: DataFrame, weights: DataFrame, by: list[str] | None = None) -> DataFrame:
    return share(p_y.drop("exp_n").join(weights.select("protein_id", "exp_n"), "protein_id"), F.col("p_y") * F.col("exp_n"), "pi", by)


def flu_distribution(emission: DataFrame, pi: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, flu_id, p: how often a random read shows each flustring."""
    by = by or []
    mass = emission.join(pi.select(*by, "protein_id", "pi"), "protein_id").groupBy(*by, "flu_id").agg(F.sum(F.col("p") * F.col("pi")).alias("m"))
    return share(mass, F.col("m"), "p", by).select(*by, "flu_id", "p")


def ragged(emission: DataFrame) -> DataFrame:
    """One row for each protein: its entries that are not 0, in order of flu, and their number."""
    return emission.filter("p <> 0").groupBy("protein_id").agg(F.array_sort(F.collect_list(F.struct("flu_id", "p"))).alias("entries"), F.count(F.lit(1)).alias("n_flu"))
