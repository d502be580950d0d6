"""A whole run: load a dataset, fit every fold, write errors by epoch, settings and estimates.

    python -m lumipep.run DATASET OUT -e 30 -n 100

The dataset is looked at before anything is fitted. The run's folder appears under OUT when all of it is written. With
--resume FOLDER the tables of finished epochs, and of finished chunks of the next, stay there until then: the same
command goes on after them.
"""

from __future__ import annotations

import argparse
import hashlib
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions.keep import Commit, Kept
from .operators import em, folds, metrics, scores, validate
from .operators.emission import prior, protein_weights, to_abundance
from .sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    epochs: int = 30
    #: Scores a read that are used; None: all.
    n_best: int | None = None
    #: Only folds below this number; None: all.
    folds: int | None = None
    #: Take an oracle with this error in place of the scores.
    oracle_error: float | None = None
    #: Reads a fold, drawn from the fold's own without replacement; None: all.
    subset: int | None = None
    #: What errors are of: PY (abundances) or PI (shares of reads).
    error: str = "PY"
    #: Parts of the reads whose statistics are kept by themselves in a run that can be taken up again.
    chunks: int = 1


def check_dataset(tables: dict[str, DataFrame], settings: Settings) -> None:
    """Raises, before anything is fitted, with all that the dataset lacks for these settings."""
    wanted = {"emission": ["protein_id", "flu_id", "p"], "cv_reads": ["cv", "read_id"], "cv_truth": ["cv", "protein_id", "p_y"]}
    wanted |= {"scores": ["read_id", "flu_id", "s"]} if settings.oracle_error is None else {"reads": ["read_id", "true_flu"]}
    if "protein" not in tables:
        wanted["emission"] = [*wanted["emission"], "w"]
    lacks = [name if name not in tables else f"{name}.{c}" for name, columns in wanted.items() for c in (columns if name in tables else [""]) if name not in tables or c not in tables[name].columns]
    if lacks:
        raise ValueError(f"the dataset lacks {', '.join(dict.fromkeys(lacks))}")
    if settings.error not in ("PY", "PI"):
        raise ValueError(f"errors of {settings.error!r}; known: PY, PI")


class Checks:
    """Counts of faulty rows in what a run reads anyway: no table is read for them."""

    def __init__(self) -> None:
        self._held: dict[str, Observation] = {}

    def on(self, name: str, df: DataFrame, **faults: Column) -> DataFrame:
        self._held[name] = Observation(name)
        return df.observe(self._held[name], F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in faults.items()])

    def found(self) -> dict[str, int]:
        """Table and fault: rows that have it; to be asked for after the fit."""
        return {f"{name}.{k}": n for name, o in self._held.items() for k, n in o.get.items()}


def fitted(tables: dict[str, DataFrame], settings: Settings, keep: Kept | None = None, checks: Checks | None = None) -> tuple[em.Fit, DataFrame]:
    """The fit of every fold of a dataset, and its weights (protein_id, exp_n).

    tables: emission (protein_id, flu_id, p, and w without a table of proteins), protein (protein_id, exp_n), scores
    (read_id, flu_id, s), or reads (read_id, true_flu) for an oracle, cv_reads (cv, read_id[, m]), as
    `readers.dataset` and `interchange.read_dataset` give them.
    """
    check_dataset(tables, settings)
    emission = tables["emission"]
    weights = tables["protein"].select("protein_id", "exp_n") if "protein" in tables else protein_weights(emission)
    n_flu = emission.select("flu_id").distinct().count()
    chosen = tables["cv_reads"] if settings.folds is None else tables["cv_reads"].filter(F.col("cv") < settings.folds)
    if settings.subset is not None:
        chosen = folds.subset_of_folds(chosen, settings.subset)
    numbers, taken = chosen.select("cv").distinct(), chosen.select("read_id")
    if checks is not None:
        # Rows without a flu or with an unusable number would go into the sums unseen.
        emission = checks.on("emission", emission, zero=F.coalesce(F.col("p") == 0, F.lit(True)))
        chosen = checks.on("cv_reads", chosen, unassigned=F.col("read_id").isNull() | (F.col("read_id") < 0))
    if settings.oracle_error is not None:
        rows = em.oracle_of_counts(chosen, tables["reads"], settings.oracle_error, n_flu)
    else:
        kept = tables["scores"]
        if checks is not None:
            kept = checks.on("scores", kept, not_finite=validate.not_finite(F.col("s").cast("double")), zero=F.col("s") == 0)
        # Scores of reads that no fold takes go no further: what is ranked, summed and moved grows with the folds' reads.
        kept = kept.join(taken, "read_id", "left_semi")
        if settings.n_best is not None:
            most = tables["scores"].groupBy("read_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
            kept = scores.n_best(kept, validate.sparsity(settings.n_best, most))
        rows = folds.expand(chosen, scores.with_residual(kept, n_flu))
    start = prior(weights).select("protein_id", "pi").crossJoin(F.broadcast(numbers))  # a row a fold
    return em.fit(rows, emission, start, settings.epochs, keep, settings.chunks), weights


def mark_of(tables: dict[str, DataFrame], settings: Settings) -> str:
    """What a run's kept tables are of: the settings, and the names of the files that the dataset is in."""
    files = sorted(f for name in sorted(tables) for f in tables[name].inputFiles())
    return hashlib.sha256("\n".join([repr(settings), *files]).encode()).hexdigest()


def run(spark: SparkSession, dataset: str, out: str, settings: Settings = Settings(), resume: str | None = None) -> str:
    """Writes a run folder under `out` and gives its path: ErrVsEpochs.csv, RunConfig.txt, Checks.txt and the estimates of each fold."""
    began, tables = time.time(), readers.dataset(spark, dataset)
    check_dataset(tables, settings)
    keep, checks = Kept(spark, resume, mark_of(tables, settings)) if resume else None, Checks()
    with Commit(spark, out) as folder:
        fit, weights = fitted(tables, settings, keep, checks)
        errors = fit.errors(tables["cv_truth"], weights, settings.error).withColumnRenamed("after", "mae")
        sinks.errors_csv(metrics.mean_std(errors, ["epoch"]), f"{folder.hidden}/ErrVsEpochs.csv")
        sinks.estimates(to_abundance(fit.pi, weights, ["cv"]), f"{folder.hidden}/estimates")
        n = fit.pi.select("cv").distinct().count()
        reads = tables["cv_reads"].filter("cv = 0").agg(F.sum("m") if "m" in tables["cv_reads"].columns else F.count(F.lit(1))).first()[0] or 0
        took = time.time() - began
        said = {
            "Nepochs": settings.epochs, "Runtime": round(took, 3), "NSparsity": settings.n_best or "all", "NcrossVal": n, "NsubsetCV": settings.subset or 0,
            "NtotalReads": reads, "Nprot": weights.count(), "Oracle": int(settings.oracle_error is not None), "Oracle Perr": settings.oracle_error or 0.0,
            "Error measured": settings.error, "Dataset": dataset, "Seconds a fold": round(took / max(1, n), 3),
        }
        sinks.config_text(spark, said, f"{folder.hidden}/RunConfig.txt")
        if resume is None:  # epochs that are taken up do not read the tables again
            sinks.config_text(spark, checks.found(), f"{folder.hidden}/Checks.txt")
    if keep is not None:
        keep.files.remove(keep.folder)
    return folder.path


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("dataset")
    p.add_argument("out")
    p.add_argument("-e", "--epochs", type=int, default=30)
    p.add_argument("-n", "--n-best", type=int, help="scores a read that are used")
    p.add_argument("-c", "--folds", type=int)
    p.add_argument("-o", "--oracle-error", type=float, help="an oracle with this error in place of the scores")
    p.add_argument("-s", "--subset", type=int, help="reads a fold")
    p.add_argument("-r", "--error", choices=["PY", "PI"], default="PY")
    p.add_argument("--chunks", type=int, default=1)
    p.add_argument("--resume", help="folder of the tables of finished epochs")
    a = vars(p.parse_args())
    dataset, out, resume = (a.pop(k) for k in ("dataset", "out", "resume"))
    print(run(SparkSession.builder.getOrCreate(), dataset, out, Settings(**a), resume))


if __name__ == "__main__":
    main()
