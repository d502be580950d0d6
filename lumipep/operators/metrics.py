"""Errors, accuracies and other figures of estimates, classifiers and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered


def mae(estimate: DataFrame, truth: DataFrame, est: str, true: str, by: list[str] | None = None) -> DataFrame:
    """Mean absolute error over proteins, for each `by` (such as cv)."""
    by = by or []
    joined = estimate.join(truth, [*[c for c in by if c in truth.columns], "protein_id"])
    return joined.groupBy(*by).agg(F.avg(F.abs(F.col(est) - F.col(true))).alias("mae"))


def mean_std(errors: DataFrame, by: list[str], value: str = "mae") -> DataFrame:
    """Mean, sample and population deviation over folds, and half the deviation as an error bar; one fold has no sample deviation."""
    return errors.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.stddev_pop(value).alias("std_pop"), (F.stddev_samp(value) / 2).alias("half_std")
    )


def uniform_mae(truth: DataFrame, by: list[str] | None = None, true: str = "p_y") -> DataFrame:
    """Error of guessing all proteins equally abundant."""
    by = by or []
    n = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    joined = truth.join(F.broadcast(n), by) if by else truth.crossJoin(F.broadcast(n))  # a row a fold
    return joined.groupBy(*by).agg(F.avg(F.abs(1 / F.col("n") - F.col(true))).alias("mae"))


def uniform_mae_closed(n: Column) -> Column:
    """Expected error of that guess when abundances are uniform over the simplex: (2/n)(1-1/n)^n."""
    return (2 / n) * F.pow(1 - 1 / n, n)


def top1(scores: DataFrame) -> DataFrame:
    """read_id, flu_id of the highest score, ties to the lower id."""
    return scores.groupBy("read_id").agg(F.max_by("flu_id", F.struct("s", (-F.col("flu_id")).alias("i"))).alias("flu_id"))


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    return predicted.join(labels, "read_id").agg(F.avg((F.col("flu_id") == F.col("true_flu")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def residual_curve(scores: DataFrame) -> DataFrame:
    """rank, residual: 1 minus the mean mass of the `rank` highest scores of a read; a read with fewer scores keeps its total."""
    w = Window.partitionBy("read_id").orderBy(F.desc("s"), "flu_id")
    ranked = scores.withColumn("rank", F.row_number().over(w))
    reads = scores.select("read_id").distinct().agg(F.count(F.lit(1)).alias("reads"))
    # The mean of running sums is the running sum of each rank's total over all reads.
    by_rank = ranked.groupBy("rank").agg(F.sum("s").alias("s")).crossJoin(F.broadcast(reads))
    run = F.sum("s").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))  # a row for each rank
    return by_rank.select("rank", (1 - run / F.col("reads")).alias("residual"))


def memory_share(kept: DataFrame, n_reads: int, n_flu: int, row_pointer: bool) -> DataFrame:
    """Percent of the dense float32 scores' memory that the sparse form takes: 6 bytes an entry, and 2 a read for forms of uneven rows."""
    extra = 2 * n_reads if row_pointer else 0
    return kept.agg(((F.count(F.lit(1)) * 6 + extra) / F.lit(float(n_reads) * n_flu * 4) * 100).alias("percent"))


def distinct_share(rows: DataFrame, pattern: str, by: list[str] | None = None) -> DataFrame:
    """Distinct patterns over all rows (of each `by`): the accuracy no classifier of these patterns can pass."""
    return rows.groupBy(*(by or [])).agg((F.countDistinct(pattern) / F.count(F.lit(1))).alias("max_accuracy"))


def molecules(abundances: DataFrame, weights: DataFrame, n_reads: float) -> DataFrame:
    """Molecules behind n_reads reads, mean over folds: n_reads / sum of p_y * exp_n."""
    per = abundances.join(weights.select("protein_id", "exp_n"), "protein_id").groupBy("cv").agg((F.lit(float(n_reads)) / F.sum(F.col("p_y") * F.col("exp_n"))).alias("molecules"))
    return per.agg(F.avg("molecules").alias("molecules"))


def expected_reads_share(abundances: DataFrame, weights: DataFrame, n_reads: float, normalised: bool = True) -> DataFrame:
    """Share of (fold, protein) with more than one expected read; without normalisation the molecule count is taken for n_reads."""
    rows = abundances.join(weights.select("protein_id", "exp_n"), "protein_id").withColumn("x", F.col("p_y") * F.col("exp_n"))
    total = rows.groupBy("cv").agg(F.sum("x").alias("t"))
    rows = rows.join(total, "cv").withColumn("reads", F.col("x") * F.lit(float(n_reads)) / (F.col("t") if normalised else F.lit(1.0)))
    return rows.agg(F.avg((F.col("reads") > 1).cast("double")).alias("share"))


def histogram(values: DataFrame, column: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """bin, n over `bins` equal intervals between the smallest and largest value of all groups."""
    ends = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    return values.crossJoin(F.broadcast(ends)).withColumn("bin", at.cast("int")).groupBy(*(by or []), "bin").agg(F.count(F.lit(1)).alias("n"))


def compared(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: mean and largest absolute difference, where it is, and the largest relative one; entries that one side lacks count as 0."""
    x, y = F.coalesce(F.col("_a"), F.lit(0.0)), F.coalesce(F.col("_b"), F.lit(0.0))
    rows = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full").withColumn("d", F.abs(x - y))
    rel = F.col("d") / F.nullif(F.greatest(x, y), F.lit(0.0))
    return rows.agg(F.avg("d").alias("mae"), F.max("d").alias("max_diff"), F.max_by(F.struct(*keys), F.struct("d", *[-F.col(k) for k in keys])).alias("at"), F.max(rel).alias("max_rel")).select("mae", "max_diff", *[F.col(f"at.{k}").alias(k) for k in keys], "max_rel")


def relative_differences(a: DataFrame, b: DataFrame, keys: list[str], value: str, guard: float = 1e-6) -> DataFrame:
    """keys, rel: |a-b| over the larger of the two, 0 where both are below the guard."""
    x, y = F.col("_a"), F.col("_b")
    rows = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return rows.select(*keys, F.when(F.greatest(x, y) < guard, 0.0).otherwise(F.abs(x - y) / F.greatest(x, y)).alias("rel"))


def block_max(counts: DataFrame, order: str, n: str, blocks: int) -> DataFrame:
    """Largest number of elements in one of `blocks` runs of rows of near-equal length, the longer ones first."""
    rows = numbered(counts.select(order, n), [order], "_at")
    size, longer = divmod(rows.count(), blocks)
    at, edge = F.col("_at"), longer * (size + 1)  # rows in the longer blocks
    block = F.when(at < edge, F.floor(at / (size + 1))).otherwise(longer + F.floor((at - edge) / max(1, size)))
    return rows.groupBy(block.alias("block")).agg(F.sum(n).alias("elements")).agg(F.max("elements").alias("max_elements"))


def time_shares(runs: DataFrame, step: str, seconds: str) -> DataFrame:
    """step, mean, total, percent: the mean time of each step over its runs, and its share of all time."""
    sums = runs.groupBy(step).agg(F.avg(seconds).alias("mean"), F.sum(seconds).alias("total"))
    every = sums.agg(F.sum("total").alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(every)).select(step, "mean", "total", (F.col("total") / F.col("_all") * 100).alias("percent"))


def last_epoch(errors: DataFrame, run: str, value: str = "mae") -> DataFrame:
    return errors.groupBy(run).agg(F.max_by(value, "epoch").alias(value), F.max("epoch").alias("epoch"))
