"""A dataset as flat binary files, for programs that read one array a file.

Ids are positions: proteins and reads are numbered from 0 without gaps. Reading and writing are by ranges of rows
(`flatfile`); offsets of ragged and repeated entries are running sums over range partitions (`numbered`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..operators.scores import n_best
from .flatfile import Column, read_flat, write_flat

#: Names and types of the files. Fixed values.
COMMON = "Common"
N_FLU, FLU, P, EXP_N = ("nFluExpForI.bin", "u4"), ("fluExpIdForI.bin", "u4"), ("probFluExpForI.bin", "f4"), ("expNFluExpGenByI.bin", "f4")
SCORES, SCORE_IDS, SPARSITY, TRUE_IDS = ("TopNScores.bin", "f4"), ("TopNScoresId.bin", "u4"), ("nSparsity.bin", "u4"), ("trueIds.bin", "u4")
FOLD, FOLD_TRUTH = ("CrossVal/ScoreIds{part}.bin", "u4"), ("CrossVal/TrueProtDist{part}.bin", "f4")
ESTIMATES = ("PhatYs.bin", "f4")


def _file(name: str, folder: str, of: tuple[str, str], width: int = 0, part: int | None = None) -> Column:
    path = f"{folder}/{of[0]}"
    return Column(name, path if part is None else path.replace("{part}", str(part)), of[1], width)


def write_emission(emission: DataFrame, weights: DataFrame, folder: str) -> None:
    """emission: protein_id, flu_id, p; weights: protein_id, exp_n of every protein, also of those without an entry."""
    entries = numbered(emission.select("protein_id", "flu_id", "p"), ["protein_id", "flu_id"], "row")
    write_flat(entries, [_file("flu_id", folder, FLU), _file("p", folder, P)])
    n = emission.groupBy("protein_id").agg(F.count(F.lit(1)).alias("n_flu"))
    proteins = weights.select("protein_id", "exp_n").join(n, "protein_id", "left").select(F.col("protein_id").alias("row"), F.coalesce("n_flu", F.lit(0)).alias("n_flu"), "exp_n")
    write_flat(proteins, [_file("n_flu", folder, N_FLU), _file("exp_n", folder, EXP_N)])


def read_emission(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """emission (protein_id, flu_id, p) and weights (protein_id, exp_n)."""
    proteins = read_flat(spark, [_file("n_flu", folder, N_FLU), _file("exp_n", folder, EXP_N)])
    starts = numbered(proteins.filter("n_flu > 0"), ["row"], "_i", F.col("n_flu"), "start").withColumn("start", F.col("start").cast("long"))
    at = starts.select(F.col("row").cast("int").alias("protein_id"), F.explode(F.sequence("start", F.col("start") + F.col("n_flu") - 1)).alias("row"))
    entries = read_flat(spark, [_file("flu_id", folder, FLU), _file("p", folder, P)])
    # Spark takes `at` for as small as the table that it is exploded from, and would broadcast it.
    emission = at.join(entries.hint("merge"), "row").select("protein_id", F.col("flu_id").cast("int").alias("flu_id"), F.col("p").cast("double").alias("p"))
    return emission, proteins.select(F.col("row").cast("int").alias("protein_id"), F.col("exp_n").cast("double").alias("exp_n"))


def write_scores(scores: DataFrame, n: int, folder: str) -> None:
    """Of each read its n highest scores, in order of flu; a read with fewer is filled up with 0 on the lowest flus it does not have."""
    entry = F.array_sort(F.collect_list(F.struct(F.col("flu_id").cast("long").alias("f"), F.col("s").cast("float").alias("s"))))
    held = n_best(scores, n).groupBy("read_id").agg(entry.alias("e"))
    free = F.slice(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), F.transform("e", lambda x: x["f"])), F.lit(1), F.lit(n) - F.size("e"))
    full = F.array_sort(F.concat("e", F.transform(free, lambda f: F.struct(f.alias("f"), F.lit(0.0).cast("float").alias("s")))))
    rows = held.withColumn("e", full).select(F.col("read_id").alias("row"), F.transform("e", lambda x: x["s"]).alias("s"), F.transform("e", lambda x: x["f"]).alias("flu_id"))
    write_flat(rows, [_file("s", folder, SCORES, n), _file("flu_id", folder, SCORE_IDS, n)])
    write_flat(scores.sparkSession.range(1).select(F.col("id").alias("row"), F.lit(n).alias("n")), [_file("n", folder, SPARSITY)])


def read_scores(spark: SparkSession, folder: str, rows: int | None = None) -> DataFrame:
    """read_id, flu_id, s of all reads, or of the first `rows`; both files are read side by side, so nothing is joined. Entries of 0 are left out."""
    n = read_flat(spark, [_file("n", folder, SPARSITY)]).first()["n"]
    both = read_flat(spark, [_file("s", folder, SCORES, n), _file("flu_id", folder, SCORE_IDS, n)], rows)
    flat = both.select(F.col("row").alias("read_id"), F.inline(F.arrays_zip("flu_id", "s"))).filter("s <> 0")
    return flat.select("read_id", F.col("flu_id").cast("int").alias("flu_id"), F.col("s").cast("double").alias("s"))


def write_labels(labels: DataFrame, folder: str) -> None:
    write_flat(labels.select(F.col("read_id").alias("row"), "true_flu"), [_file("true_flu", folder, TRUE_IDS)])


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_flat(spark, [_file("true_flu", folder, TRUE_IDS)]).select(F.col("row").alias("read_id"), F.col("true_flu").cast("int").alias("true_flu"))


def write_folds(cv_reads: DataFrame, cv_truth: DataFrame, folder: str) -> None:
    """cv_reads: cv, read_id[, m]: the ids in order, each as often as it was drawn; cv_truth: cv, protein_id, p_y. A file for each fold."""
    drawn = cv_reads if "m" in cv_reads.columns else cv_reads.withColumn("m", F.lit(1))
    runs = numbered(drawn.select("cv", "read_id", "m"), ["cv", "read_id"], "_i", F.col("m"), "start")
    first = runs.groupBy("cv").agg(F.min("start").alias("first"))  # a row a fold
    own = runs.join(F.broadcast(first), "cv").withColumn("start", (F.col("start") - F.col("first")).cast("long"))
    ids = own.select("cv", "read_id", F.explode(F.sequence("start", F.col("start") + F.col("m") - 1)).alias("row"))
    write_flat(ids, [_file("read_id", folder, FOLD)], by="cv")
    write_flat(cv_truth.select("cv", F.col("protein_id").alias("row"), "p_y"), [_file("p_y", folder, FOLD_TRUTH)], by="cv")


def read_folds(spark: SparkSession, folder: str, folds: int) -> tuple[DataFrame, DataFrame]:
    """cv_reads (cv, read_id, m) and cv_truth (cv, protein_id, p_y) of the first `folds` folds."""
    def every(name: str, of: tuple[str, str]) -> DataFrame:
        parts = [read_flat(spark, [_file(name, folder, of, part=cv)]).withColumn("cv", F.lit(cv)) for cv in range(folds)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    reads = every("read_id", FOLD).groupBy("cv", "read_id").agg(F.count(F.lit(1)).alias("m"))
    return reads, every("p_y", FOLD_TRUTH).select("cv", F.col("row").cast("int").alias("protein_id"), F.col("p_y").cast("double").alias("p_y"))


def write_estimates(p_y: DataFrame, n_prot: int, folder: str) -> None:
    """cv, protein_id, p_y, one array after the other; folds from 0 on, proteins 0 to n_prot - 1 in each."""
    rows = p_y.select((F.col("cv").cast("long") * n_prot + F.col("protein_id")).alias("row"), "p_y")
    write_flat(rows, [_file("p_y", folder, ESTIMATES)])


def read_estimates(spark: SparkSession, path: str, n_prot: int) -> DataFrame:
    rows = read_flat(spark, [Column("p_y", path, ESTIMATES[1])])
    return rows.select(F.floor(F.col("row") / n_prot).cast("int").alias("cv"), (F.col("row") % n_prot).cast("int").alias("protein_id"), F.col("p_y").cast("double").alias("p_y"))


def write_dataset(root: str, classifier: str, emission: DataFrame, weights: DataFrame, scores: DataFrame, n: int, labels: DataFrame, cv_reads: DataFrame, cv_truth: DataFrame) -> None:
    """The whole dataset: what all classifiers share under Common, and the scores and folds of one under its name."""
    write_emission(emission, weights, f"{root}/{COMMON}")
    write_scores(scores, n, f"{root}/{classifier}/{COMMON}")
    write_labels(labels, f"{root}/{classifier}/{COMMON}")
    write_folds(cv_reads, cv_truth, f"{root}/{classifier}")


def read_dataset(spark: SparkSession, root: str, classifier: str, folds: int) -> dict[str, DataFrame]:
    """The tables of `readers.dataset` from flat files. A file that is missing raises."""
    emission, weights = read_emission(spark, f"{root}/{COMMON}")
    reads, truth = read_folds(spark, f"{root}/{classifier}", folds)
    own = f"{root}/{classifier}/{COMMON}"
    return {"emission": emission, "protein": weights, "reads": read_labels(spark, own), "scores": read_scores(spark, own), "cv_reads": reads, "cv_truth": truth}
