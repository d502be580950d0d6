"""Runs: taken up again, committed as a whole, and refused where the dataset lacks something; folds as counts."""

import os
from datetime import datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumipep import run as runs
from lumipep.functions.keep import Commit, Kept
from lumipep.operators import em, folds
from lumipep.run import Checks, Settings, fitted, run
from lumipep.sources import readers, sinks


@pytest.fixture(scope="module")
def tables(spark):
    r = np.random.default_rng(5)
    e = [(p, int(f), 1.0 + float(r.random())) for p in range(8) for f in r.choice(20, 5, replace=False)]
    w = spark.createDataFrame(e, "protein_id int, flu_id int, w double")
    total = w.groupBy("protein_id").agg(F.sum("w").alias("t"))
    emission = w.join(total, "protein_id").withColumn("p", F.col("w") / F.col("t")).drop("t")
    scores = spark.createDataFrame([(n, int(f), 0.1 + float(r.random()) / 5) for n in range(120) for f in r.choice(20, 3, replace=False)], "read_id long, flu_id int, s double")
    cv = spark.createDataFrame([(c, n, 1 + (n + c) % 3) for c in range(2) for n in range(120) if (n + c) % 4], "cv int, read_id long, m long")
    truth = spark.createDataFrame([(c, p, 1 / 8) for c in range(2) for p in range(8)], "cv int, protein_id int, p_y double")
    labels = spark.createDataFrame([(n, n % 20) for n in range(120)], "read_id long, true_flu int")
    return {"emission": emission, "scores": scores, "cv_reads": cv, "cv_truth": truth, "reads": labels}


@pytest.fixture(scope="module")
def dataset(tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ds"))
    sinks.dataset(path, **tables)
    return path


def values(df, *by):
    return {tuple(r[c] for c in by): r[df.columns[-1]] for r in df.collect()}


class Lost(Exception):
    pass


@pytest.mark.parametrize("chunks, killed_at", [(1, "state-3"), (3, "statistics-3-1")])
def test_killed_run_goes_on(spark, dataset, tmp_path, monkeypatch, chunks, killed_at):
    """The driver is lost in epoch 3 of 4; the second try makes only what is not there, and the errors are those of a run at one go."""
    settings, made, table = Settings(4, chunks=chunks), [], Kept.table

    def failing(self, name, df):
        if name == killed_at and not made.count("again"):
            raise Lost
        if not self.has(name):
            made.append(name)
        return table(self, name, df)

    monkeypatch.setattr(Kept, "table", failing)
    resume, out = str(tmp_path / "resume"), str(tmp_path / "out")
    with pytest.raises(Lost):
        run(spark, dataset, out, settings, resume)
    assert readers_see(out) == []
    first = list(made)
    made[:] = ["again"]
    folder = run(spark, dataset, out, settings, resume)
    assert "state-2" in first and not set(first) & set(made) and killed_at in made and "state-4" in made
    whole = run(spark, dataset, str(tmp_path / "whole"), Settings(4))
    a, b = (values(readers.run_errors(spark, os.path.dirname(f)).select("epoch", "mean"), "epoch") for f in (folder, whole))
    assert a == pytest.approx(b, abs=1e-9) and sorted(a) == [(1,), (2,), (3,), (4,)]
    assert not os.path.exists(resume)


def readers_see(out):
    return sorted(x for x in os.listdir(out) if not x.startswith(".")) if os.path.isdir(out) else []


def test_other_settings_are_not_taken_up(spark, dataset, tables, tmp_path):
    Kept(spark, str(tmp_path / "k"), "one")
    Kept(spark, str(tmp_path / "k"), "one")
    with pytest.raises(ValueError, match="holds tables of one"):
        Kept(spark, str(tmp_path / "k"), "two")
    d = readers.dataset(spark, dataset)
    assert runs.mark_of(d, Settings(2)) != runs.mark_of(d, Settings(3)) and runs.mark_of(d, Settings(2)) == runs.mark_of(readers.dataset(spark, dataset), Settings(2))


def test_two_runs_in_one_second(spark, tmp_path):
    at = datetime(2025, 2, 3, 4, 5, 6, tzinfo=timezone.utc)
    with Commit(spark, str(tmp_path), at) as a, Commit(spark, str(tmp_path), at) as b:
        for c in (a, b):
            spark.range(3).write.parquet(f"{c.hidden}/x")
        assert readers_see(tmp_path) == []
    with Commit(spark, str(tmp_path), at) as c:
        spark.range(1).write.parquet(f"{c.hidden}/x")
    assert readers_see(tmp_path) == ["03-02-2025_04-05-06", "03-02-2025_04-05-07", "03-02-2025_04-05-08"]
    assert [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == sorted(readers_see(tmp_path), key=os.listdir(tmp_path).index)


def test_a_run_that_fails_between_files_leaves_nothing(spark, dataset, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "config_text", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run(spark, dataset, str(tmp_path / "out"), Settings(1))
    assert readers_see(str(tmp_path / "out")) == [] and not [x for x in os.listdir(tmp_path / "out") if "part" in x]


@pytest.mark.parametrize("gone", ["emission", "scores", "cv_reads", "cv_truth", "reads"])
def test_missing_tables_are_named_before_the_fit(spark, tables, monkeypatch, gone):
    monkeypatch.setattr(em, "fit", lambda *_: pytest.fail("fitted"))
    settings = Settings(1, oracle_error=0.1) if gone == "reads" else Settings(1)
    with pytest.raises(ValueError, match=f"lacks {gone}"):
        fitted({k: v for k, v in tables.items() if k != gone}, settings)
    if gone != "reads":
        column = {"emission": "p", "scores": "s", "cv_reads": "read_id", "cv_truth": "p_y"}[gone]
        with pytest.raises(ValueError, match=rf"lacks {gone}\.{column}"):
            fitted(tables | {gone: tables[gone].drop(column)}, settings)


def test_config_and_checks(spark, tables, tmp_path):
    scores = tables["scores"].withColumn("s", F.when(F.col("read_id") == 7, F.lit(float("nan"))).when(F.col("read_id") == 9, 0.0).otherwise(F.col("s")))
    emission = tables["emission"].withColumn("p", F.when((F.col("protein_id") == 2), 0.0).otherwise(F.col("p")))
    cv = tables["cv_reads"].unionByName(spark.createDataFrame([(0, -1, 1), (1, None, 1)], "cv int, read_id long, m long"))
    checks = Checks()
    fitted(tables | {"scores": scores, "emission": emission, "cv_reads": cv}, Settings(1), checks=checks)
    found = checks.found()
    assert (found["scores.rows"], found["scores.not_finite"], found["scores.zero"]) == (360, 3, 3)
    assert (found["emission.rows"], found["emission.zero"]) == (40, 5) and found["cv_reads.unassigned"] == 2
    path = str(tmp_path / "ds")
    sinks.dataset(path, **tables)
    out = str(tmp_path / "out")
    run(spark, path, out, Settings(2, n_best=2, oracle_error=0.25, subset=30, error="PI"))
    said = {r["key"]: r["value"] for r in readers.run_configs(spark, out).collect()}
    assert {k: said[k] for k in ("Nepochs", "NSparsity", "NcrossVal", "NsubsetCV", "Nprot", "Oracle", "Oracle Perr", "Error measured")} == {
        "Nepochs": "2", "NSparsity": "2", "NcrossVal": "2", "NsubsetCV": "30", "Nprot": "8", "Oracle": "1", "Oracle Perr": "0.25", "Error measured": "PI"}
    assert int(said["NtotalReads"]) == sum(r["m"] for r in tables["cv_reads"].filter("cv = 0").collect()) and float(said["Runtime"]) > 0


def test_oracle_of_counts_is_the_oracle_of_reads(spark, tables):
    from lumipep.operators import scores
    from lumipep.operators.emission import prior, protein_weights

    e, labels = tables["emission"], tables["reads"]
    start = prior(protein_weights(e)).select("protein_id", "pi")
    one = em.fit(scores.oracle(labels, 0.2, 20), e, start, 3)
    counted = em.fit(em.oracle_of_counts(labels.select("read_id"), labels, 0.2, 20).drop("cv"), e, start, 3)
    assert values(one.pi.select("protein_id", "pi"), "protein_id") == pytest.approx(values(counted.pi.select("protein_id", "pi"), "protein_id"))


def test_counts_of_draws(spark):
    """10^8 draws in a few rows: they add up, follow the masses (chi-square), and do not depend on how rows lie."""
    p = [0.0, 0.1, 0.4, 0.0001, 0.4999]
    flu_p = spark.createDataFrame([(i * 300, x) for i, x in enumerate(p)], "flu_id int, p double")
    reads = spark.createDataFrame([(i, 300 * (1 + i % 4)) for i in range(4000)], "read_id long, true_flu int")
    n = 10**8
    got = folds.sampled_counts(flu_p, reads, n, 0)
    m = values(got.select("read_id", "m"), "read_id")
    assert sum(m.values()) == n and set(got.select("cv").distinct().toPandas()["cv"]) == {0}
    by_flu = {k: sum(x for (i,), x in m.items() if 1 + i % 4 == k) for k in (1, 2, 3, 4)}
    assert sum((by_flu[k] - n * p[k]) ** 2 / (n * p[k]) for k in by_flu) < 16.3  # 3 degrees of freedom, 0.1 %
    of = [x for (i,), x in m.items() if i % 4 == 1]
    assert len(of) == 1000 and sum((x - by_flu[2] / 1000) ** 2 / (by_flu[2] / 1000) for x in of) < 1143  # 999, 0.1 %
    again = folds.sampled_counts(flu_p.repartition(4), reads.repartition(5), n, 0)
    assert values(again.select("read_id", "m"), "read_id") == m
    assert values(folds.sampled_counts(flu_p, reads, n, 1).select("read_id", "m"), "read_id") != m
    assert folds.sampled_counts(flu_p, reads.limit(0), n, 0).count() == 0


def test_first_by_hash(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("int").alias("cv"), F.col("id").alias("read_id"), F.md5(F.col("id").cast("string").cast("binary")).alias("h"))
    every = [tuple(r) for r in rows.collect()]
    for n in (1, 17, 600, 999, 1000, 5000):
        want = {x[1] for c in range(3) for x in sorted((x for x in every if x[0] == c), key=lambda x: x[2])[:n]}
        picked = folds.first_by_hash(rows, n)
        assert {r["read_id"] for r in picked.collect()} == want and picked.count() == min(n, 1000) * 3
        assert "Window" not in picked._jdf.queryExecution().optimizedPlan().toString()
    same = rows.withColumn("h", F.lit("ab" * 16))
    assert values(folds.first_by_hash(same, 7).groupBy("cv").count(), "cv") == {(0,): 7, (1,): 7, (2,): 7}
    assert folds.first_by_hash(rows.limit(0), 7).count() == 0
    sub = folds.subset_of_folds(spark.createDataFrame([(0, 1, 5), (0, 2, 1), (1, 3, 2)], "cv int, read_id long, m long"), 4)
    assert values(sub.groupBy("cv").agg(F.sum("m")), "cv") == {(0,): 4, (1,): 2}


def test_weighted_folds(spark, tables):
    from lumipep.operators.emission import protein_weights

    labels = tables["reads"]
    reads, truth = folds.weighted_folds(tables["emission"], protein_weights(tables["emission"]), labels, 1000, 3)
    assert values(reads.groupBy("cv").agg(F.sum("m")), "cv") == {(0,): 1000, (1,): 1000, (2,): 1000}
    assert values(truth.groupBy("cv").agg(F.sum("p_y")), "cv") == pytest.approx({(0,): 1.0, (1,): 1.0, (2,): 1.0})


def test_update_is_made_once(spark, tables):
    """What an epoch gives to the proteins is not made again for its sum."""
    from lumipep.operators.emission import prior, protein_weights

    e = tables["emission"]
    stats = spark.createDataFrame([(0, 1, 2.0, 0.0, 0.0), (0, None, 0.0, 0.5, 1.0)], "cv int, flu_id int, w double, rest double, loglik double")
    pi = prior(protein_weights(e)).select(F.lit(0).alias("cv"), "protein_id", "pi")
    got = em.updated(stats, e, pi)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert got.agg(F.sum("pi")).first()[0] == pytest.approx(1.0)


def test_draws_of_one_file_are_made_in_many_tasks(spark):
    a = folds.random_abundances(spark.range(5).coalesce(1).withColumnRenamed("id", "protein_id"), 3)
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "strategy=broadcast" in plan
    assert values(a.groupBy("cv").agg(F.sum("p_y")), "cv") == pytest.approx({(i,): 1.0 for i in range(3)})


def test_leaves_are_dealt_once(spark, monkeypatch):
    """Ids that lie far apart, in small groups: one level, whatever the ids' size."""
    made, written = [], folds.written
    monkeypatch.setattr(folds, "written", lambda df, label: made.append(label) or written(df, label))
    leaves = spark.range(60).select((F.col("id") % 20).alias("flu"), (F.col("id") * 1_000_003).alias("id"), F.lit(1.0).alias("one"))
    totals = spark.range(20).select(F.col("id").alias("flu"), F.lit(7).alias("m"))
    got = folds.drawn_counts(leaves, totals, ["flu"], "m", "one", "x")
    assert made == ["dealt"] and values(got.groupBy("flu").agg(F.sum("m")), "flu") == {(i,): 7 for i in range(20)}
    assert got.join(leaves, ["flu", "id"], "left_anti").count() == 0
