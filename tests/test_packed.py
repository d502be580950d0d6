"""Epochs and likelihoods over packed parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumipep.operators import em


@pytest.fixture(scope="module")
def problem(spark):
    r = np.random.default_rng(5)
    p = r.random((8, 20)) * (r.random((8, 20)) < 0.4)
    emission = spark.createDataFrame([(i, j, float(p[i, j] / p[i].sum())) for i, j in zip(*map(lambda x: x.tolist(), np.nonzero(p)), strict=True)], "protein_id int, flu_id int, p double")
    scores = spark.createDataFrame([(n, int(f), float(r.random() / 4), 0.01) for n in range(200) for f in r.choice(22, 3, replace=False)], "read_id long, flu_id int, s double, r double")
    return scores, emission, spark.createDataFrame([(i, 1 / 8) for i in range(8)], "protein_id int, pi double")


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_few_jobs_an_epoch(spark, problem):
    scores, emission, start = problem
    n = [jobs(spark, f"epochs-{k}", lambda k=k: em.fit(scores, emission, start, k)) for k in (2, 4)]
    assert n[1] - n[0] <= 2 * 8


def test_parts_lie_one_in_a_partition(spark, problem):
    routed = em.Routed.of(problem[0].withColumns({"cv": F.lit(0), "m": F.lit(1.0)}), ["read_id"])
    at = routed.rows.select("part", F.spark_partition_id().alias("at")).distinct().collect()
    routed.unpersist()
    assert len({r["at"] for r in at}) == len(at) == len({r["part"] for r in at})


def test_packed_equals_joined(spark, problem, monkeypatch):
    """Folds of which one has no reads, proteins that one fold has not, null flus and scores, flus without emission."""
    scores, emission, start = problem
    rows = scores.withColumn("cv", (F.col("read_id") % 2).cast("int")).withColumn("m", F.col("read_id") % 3 + 1)
    more = spark.createDataFrame([(0, 900, None, 0.5, 0.1, 2), (0, 901, 3, None, 0.2, 1), (1, 902, 21, 0.0, 0.0, 1), (7, 903, 2, 0.5, 0.1, 1)], "cv int, read_id long, flu_id int, s double, r double, m long")
    rows = rows.select("cv", "read_id", "flu_id", "s", "r", "m").unionByName(more)
    folds = start.withColumn("cv", F.explode(F.array(*map(F.lit, (0, 1, 4))))).filter("cv <> 1 or protein_id <> 5")
    got = em.fit(rows, emission, folds, 3)
    monkeypatch.setattr(em, "FEW_FLUS", 0)
    want = em.fit(rows, emission, folds, 3)
    a, b = ({(r["cv"], r["protein_id"]): r["pi"] for r in f.pi.collect()} for f in (got, want))
    assert a == pytest.approx(b, abs=1e-12) and len(a) == 23
    assert [tuple(x.values()) for x in got.history] == [pytest.approx(tuple(x.values())) for x in want.history]


def test_no_score_moves_with_its_entries(spark, problem):
    scores, emission, start = problem
    for df in (em.eta(scores, emission), em.responsibilities_of_scores(scores, emission, start)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert not [line for line in plan.splitlines() if "Exchange" in line and "read_id" in line]


def test_pairs_a_few_at_a_time(spark, problem, monkeypatch):
    """Reads are cut between tasks and within them; a read whose flus have no emission has no pair."""
    from lumipep.operators import packed

    scores, emission, _ = problem
    scores = scores.unionByName(spark.createDataFrame([(-7, 500, 0.5, 0.0)], "read_id long, flu_id int, s double, r double"))
    want = {(r["read_id"], r["protein_id"]): r["x"] for r in scores.join(emission, "flu_id").groupBy("read_id", "protein_id").agg((F.sum(F.col("s") * F.col("p")) + F.first("r")).alias("x")).collect()}
    monkeypatch.setattr(packed, "MODEL_ENTRIES", 1)
    rows = em.eta(scores, emission).collect()
    assert {(r["read_id"], r["protein_id"]): r["eta"] for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert em.eta(scores.limit(0), emission).count() == 0 == em.eta(scores, emission.limit(0)).count()
