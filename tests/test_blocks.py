"""Products by blocks, and epochs that move no score."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumipep.operators import blocks, em
from lumipep.operators import emission as emi


def entries(spark, a, names):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], f"{names[0]} long, {names[1]} int, value double").repartition(3)


@pytest.mark.parametrize("sizes", [(512, 1024, 512), (4, 3, 5), (1, 1, 1), (7, 50, 2)])
def test_product(spark, sizes):
    r = np.random.default_rng(1)
    a, b = r.random((23, 17)), r.random((17, 11)) * (r.random((17, 11)) < 0.3)
    got = blocks.product(entries(spark, a, ("row", "mid")), entries(spark, b, ("mid", "col")), *sizes)
    want = a @ b
    rows = got.collect()
    assert {(x["row"], x["col"]) for x in rows} == {(i, j) for i in range(23) for j in np.flatnonzero(b.any(0))} and len(rows) == len({(x["row"], x["col"]) for x in rows})
    assert max(abs(x["value"] - want[x["row"], x["col"]]) for x in rows) < 1e-12


def test_product_of_large_and_negative_ids(spark):
    left = spark.createDataFrame([(-5, -3, 2.0), (10**12, -3, 1.0), (10**12, 4000, 3.0), (-5, -3, 1.0)], "row long, mid long, value double")
    right = spark.createDataFrame([(-3, 7, 1.0), (4000, 7, 10.0), (4000, 10**9, 1.0)], "mid long, col long, value double")
    got = {(r["row"], r["col"]): r["value"] for r in blocks.product(left, right).collect() if r["value"]}
    assert got == {(-5, 7): 3.0, (10**12, 7): 31.0, (10**12, 10**9): 3.0}


def test_empty_product(spark):
    left = spark.createDataFrame([], "row long, mid long, value double")
    assert blocks.product(left, spark.createDataFrame([(1, 2, 3.0)], "mid long, col long, value double")).count() == 0


def test_no_row_for_a_term(spark):
    """The join is of blocks: one row for each pair of blocks, whatever the number of products."""
    a = spark.range(64 * 64).select((F.col("id") % 64).alias("row"), F.floor(F.col("id") / 64).alias("mid"), F.lit(1.0).alias("value"))
    plan = blocks.product(a, a.select("mid", F.col("row").alias("col"), "value"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "MapInArrow" in plan and "collect_list" in plan
    assert not any("Join" in line and "mid" in line for line in plan.splitlines())


def test_results_are_not_moved(spark):
    """What is dealt to tasks are blocks of the inputs; after the product there is no exchange and no sort."""
    a = spark.range(64 * 64).select((F.col("id") % 64).alias("row"), F.floor(F.col("id") / 64).alias("mid"), F.lit(1.0).alias("value"))
    df = blocks.product(a, a.select("mid", F.col("row").alias("col"), "value"), 4, 8, 4)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")
    assert df.count() == 64 * 64 and df.agg(F.sum("value")).first()[0] == 64**3


@pytest.fixture(scope="module")
def problem(spark):
    r = np.random.default_rng(3)
    emission = [(p, int(f), float(r.random() + 0.1)) for p in range(12) for f in r.choice(30, 6, replace=False)]
    e = emi.share(spark.createDataFrame(emission, "protein_id int, flu_id int, w double"), F.col("w"), "p", ["protein_id"]).select("protein_id", "flu_id", "p")
    s = [(n, int(f), float(r.random() / 5)) for n in range(300) for f in r.choice(30, 4, replace=False)]
    scores = spark.createDataFrame(s, "read_id long, flu_id int, s double").withColumns({"r": F.lit(0.01)})
    start = spark.createDataFrame([(p, 1 / 12) for p in range(12)], "protein_id int, pi double")
    return e, scores, start


def close(a, b):
    a, b = ({(r["cv"], r["protein_id"]): r["pi"] for r in f.pi.collect()} for f in (a, b))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


@pytest.mark.parametrize("folds", [False, True])
def test_routed_equals_broadcast(spark, problem, monkeypatch, folds):
    e, s, start = problem
    if folds:
        s = s.withColumn("cv", F.explode(F.array(F.lit(0), F.lit(1)))).filter("cv = 0 or read_id % 3 > 0").withColumn("m", F.col("cv") + 1)
        start = start.withColumn("cv", F.explode(F.array(F.lit(0), F.lit(1))))
    few = em.fit(s, e, start, 3)
    monkeypatch.setattr(em, "FEW_FLUS", 0)
    close(few, em.fit(s, e, start, 3))


def exchanges(df, column):
    """Executed plans of the exchanges above the persisted scores that carry a column."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    return [line for line in final.splitlines() if "Exchange" in line and column in line], final


def test_epochs_move_no_score(spark, problem):
    e, s, start = problem
    rows = s.withColumns({"cv": F.lit(0), "m": F.lit(1.0)}).select("cv", "read_id", "flu_id", "s", "r", "m")
    routed = em.Routed.of(rows, ["read_id"])
    routed.rows.count(), routed.routes.count()
    pi = start.withColumn("cv", F.lit(0)).select("cv", "protein_id", "pi")
    with em.layouts_kept(spark):
        moved, plan = exchanges(em.epoch(routed, e, pi, False, ("read_id",)), "read_id")
    assert not moved, moved
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan.split("InMemoryTableScan")[0], plan
    routed.unpersist()


def test_even_keys(spark):
    keys = em.even_keys(spark, 13)
    got = spark.createDataFrame([(k,) for k in keys], "id long").repartition(13, "id").select("id", F.spark_partition_id().alias("p")).collect()
    assert {r["id"]: r["p"] for r in got} == {k: i for i, k in enumerate(keys)}


def test_likelihoods_by_read(spark, problem):
    """Pairs of reads and proteins against a matrix product; no row for a pair is exchanged."""
    e, scores, start = problem
    s, p = np.zeros((300, 30)), np.zeros((30, 12))
    for r in scores.collect():
        s[r["read_id"], r["flu_id"]] = r["s"]
    for r in e.collect():
        p[r["flu_id"], r["protein_id"]] = r["p"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # reads lie across batches
    try:
        x = s @ p
        df = em.eta(scores, e)
        assert df._jdf.queryExecution().optimizedPlan().toString().lstrip().startswith("MapInArrow")
        got = {(r["read_id"], r["protein_id"]): r["eta"] for r in df.collect()}
        assert got.keys() == set(zip(*np.nonzero(x), strict=True)) and all(abs(v - x[k] - 0.01) < 1e-12 for k, v in got.items())
        d = x.sum(1) / 12 + 0.01
        for r in em.responsibilities_of_scores(scores, e, start).collect():
            n, i = r["read_id"], r["protein_id"]
            assert abs(r["alpha"] - (x[n, i] + 0.01) / 12 / d[n]) < 1e-12 and abs(r["rest"] - 0.01 / d[n]) < 1e-12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
