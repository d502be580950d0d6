"""Read scores: sparsification, residuals and synthetic classifiers.

scores: read_id, flu_id, s. A sparsifier keeps some of a read's rows; the mass it leaves is spread evenly
over all flus (residual)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import ramp
from .folds import hashed


def _by_score():
    return Window.partitionBy("read_id").orderBy(F.desc("s"), "flu_id")


def n_best(scores: DataFrame, n: int | None) -> DataFrame:
    """The n highest scores of each read, ties to the lower flu; None keeps all."""
    if n is None:
        return scores
    return scores.withColumn("_r", F.row_number().over(_by_score())).filter(F.col("_r") <= n).drop("_r")


def n_best_in_id_order(scores: DataFrame, n: int) -> DataFrame:
    """n_best as one row for each read: arrays of ids and scores, ascending by id."""
    kept = n_best(scores, n).groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("flu_id", "s"))).alias("e"))
    return kept.select("read_id", F.transform("e", lambda x: x["flu_id"]).alias("flu_ids"), F.transform("e", lambda x: x["s"]).alias("scores"))


def accumulated(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Highest scores up to and with the first whose running sum exceeds the threshold; all, if none does."""
    run = F.sum("s").over(_by_score().rowsBetween(Window.unboundedPreceding, 0))
    return scores.withColumn("_c", run).filter(F.col("_c") - F.col("s") <= threshold).drop("_c")


def above(scores: DataFrame, threshold: float) -> DataFrame:
    """Scores of at least the threshold, and the highest of each read in any case."""
    return scores.withColumn("_r", F.row_number().over(_by_score())).filter((F.col("s") >= threshold) | (F.col("_r") == 1)).drop("_r")


def residual(kept: DataFrame, n_flu: int, clip: bool = True) -> DataFrame:
    """read_id, r: what the kept scores leave of 1, for each flu; never below 0 if clipped."""
    r = (1 - F.sum("s")) / F.lit(float(n_flu))
    return kept.groupBy("read_id").agg((ramp(r) if clip else r).alias("r"))


def with_residual(kept: DataFrame, n_flu: int, clip: bool = True) -> DataFrame:
    """kept with r, as `residual`; over the read's rows, so nothing is joined."""
    r = (1 - F.sum("s").over(Window.partitionBy("read_id"))) / F.lit(float(n_flu))
    return kept.withColumn("r", ramp(r) if clip else r)


def oracle_values(error: float, n_flu: int, n_prot: int | None = None, form: str = "truth plus even") -> tuple[float, float]:
    """An oracle's score on the truth, and what every flu has beside it."""
    e, f = float(error), float(n_flu)
    return {
        "truth plus even": (1 - e, e / f),
        "even, one short": (1 - e - e / f, e / f),
        "others only": (1 - e - e / (f - 1), e / (f - 1)) if f > 1 else (1 - e, 0.0),
        "over proteins": (1 - e, e / float(n_prot or 1)),
    }[form]


def oracle(labels: DataFrame, error: float, n_flu: int, n_prot: int | None = None, form: str = "truth plus even") -> DataFrame:
    """read_id, flu_id, s, r of a classifier that knows the true flu but for an error.

    'truth plus even': 1-e on the truth, e/F on every flu (the default); 'even, one short': the same, but the
    truth has 1-e in all; 'others only': 1-e on the truth, e/(F-1) on the others; 'over proteins': e/n_prot
    added to every protein.
    """
    s, r = oracle_values(error, n_flu, n_prot, form)
    return labels.select("read_id", F.col("true_flu").alias("flu_id"), F.lit(s).alias("s"), F.lit(r).alias("r"))


def head_per_group(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")


def head_with_more(held: DataFrame | None, more: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group after a further part has come: of the part only its own head meets what is held."""
    part = head_per_group(more, by, order, k)
    return part if held is None else head_per_group(held.unionByName(part), by, order, k)


def label_table(spark, n_flu: int, reads_each: int) -> DataFrame:
    """read_id, true_flu of a set with equally many reads of each flu, in runs."""
    return spark.range(n_flu * reads_each).select(F.col("id").alias("read_id"), F.floor(F.col("id") / reads_each).cast("int").alias("true_flu"))


def random_oracle(reads: DataFrame, n_flu: int, sure: float = 0.99, seed: str = "oracle") -> DataFrame:
    """read_id, flu_id, s, r: one score for each read, `sure` on a flu drawn by a hash, and nothing elsewhere."""
    at = F.floor(hashed(F.lit(seed), F.col("read_id")) * n_flu).cast("int")
    return reads.select("read_id", at.alias("flu_id"), F.lit(float(sure)).alias("s"), F.lit(0.0).alias("r"))


def sure_oracle(labels: DataFrame, sure: float = 0.99) -> DataFrame:
    """read_id, flu_id, s, r: one score for each read, `sure` on the truth, and nothing elsewhere."""
    return labels.select("read_id", F.col("true_flu").alias("flu_id"), F.lit(float(sure)).alias("s"), F.lit(0.0).alias("r"))


def random_scores(spark, n_reads: int, n_flu: int, density: float, seed: str = "random") -> DataFrame:
    """read_id, flu_id, s: every entry of a reads x flus matrix is there with chance `density`, by a hash, and uniform in [0, 1)."""
    cell = spark.range(n_reads).select(F.col("id").alias("read_id"), F.explode(F.sequence(F.lit(0), F.lit(n_flu - 1))).alias("flu_id"))
    there = hashed(F.lit(seed), F.lit("there"), F.col("read_id"), F.col("flu_id")) < density
    return cell.filter(there).select("read_id", "flu_id", hashed(F.lit(seed), F.lit("value"), F.col("read_id"), F.col("flu_id")).alias("s"))


def densified(kept: DataFrame, n_flu: int) -> DataFrame:
    """read_id, scores: an array of n_flu scores for each read, 0 where none was kept; of entries for one flu the sum."""
    cells = F.map_from_entries(F.collect_list(F.struct("flu_id", "s")))
    one = kept.groupBy("read_id", "flu_id").agg(F.sum("s").alias("s")).groupBy("read_id").agg(cells.alias("m"))
    return one.select("read_id", F.transform(F.sequence(F.lit(0), F.lit(n_flu - 1)), lambda f: F.coalesce(F.try_element_at("m", f), F.lit(0.0))).alias("scores"))


def linear_scores(spark, n_reads: int, n: int, n_flu: int, mass: float = 0.99) -> DataFrame:
    """Synthetic reads: n scores (2 or more) that fall evenly to 0 and sum to `mass`, on flus that wrap around."""
    step = mass / (n * (n - 1) / 2)
    return spark.range(n_reads).select(F.col("id").alias("read_id"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (n - 1 - j) * step)).alias("j", "s")).select(
        "read_id", F.pmod(F.col("read_id") + F.col("j"), F.lit(n_flu)).cast("int").alias("flu_id"), "s"
    )


def padded_oracle(labels: DataFrame, n: int, n_flu: int) -> DataFrame:
    """Arrays of n ids and scores: the truth with 1, its next n-1 flus (modulo n_flu) with 0; ascending by id."""
    e = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.pmod(F.col("true_flu") + k, F.lit(n_flu)).cast("int").alias("f"), F.when(k == 0, 1.0).otherwise(0.0).alias("s"))))
    return labels.withColumn("e", e).select("read_id", F.transform("e", lambda x: x["f"]).alias("flu_ids"), F.transform("e", lambda x: x["s"]).alias("scores"))
