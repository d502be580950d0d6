"""Operators against NumPy, hand-made fixtures and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumipep.functions.numbering import numbered
from lumipep.functions.sequence import dye_count, dye_track, engineering, flustring, gene_token, peptides
from lumipep.operators import digest as dg
from lumipep.operators import em, folds, metrics, scores, validate
from lumipep.operators import emission as emi


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "seq, trypsin, cnbr, dyes",
    [
        ("MKPARDEK", ["MKPAR", "DEK"], ["M", "KPARDEK"], ["", "00"]),
        ("AK", ["AK"], ["AK"], [""]),
        ("KRRP", ["K", "R", "RP"], ["KRRP"], ["", "", ""]),
        ("MDEACYKG", ["MDEACYK", "G"], ["M", "DEACYKG"], [".00.12", ""]),
        ("", [""], [""], [""]),
    ],
)
def test_digest(spark, seq, trypsin, cnbr, dyes):
    assert one(spark, peptides(F.lit(seq))) == trypsin
    assert one(spark, peptides(F.lit(seq), "cyanogen bromide")) == cnbr
    assert one(spark, F.transform(peptides(F.lit(seq)), lambda p: flustring(p))) == dyes


def test_unknown_protease(spark):
    with pytest.raises(ValueError):
        peptides(F.lit("AK"), "none")


def test_functions(spark):
    assert one(spark, dye_count(F.lit(".00.12"))) == 4
    assert one(spark, dye_count(F.lit(None).cast("string"))) == 0
    assert one(spark, gene_token(F.lit(">ID1 some protein GN=GENE1 X=1"))) == "GENE1"
    assert one(spark, engineering(F.lit(1.5e6), 1)) == "1.5M"
    assert one(spark, engineering(F.lit(2000.0))) == "2K"
    assert one(spark, dye_track(F.lit("0.12"), 3)) == [[1, 1, 1], [0, 1, 1], [0, 1, 1], [0, 0, 1]]


def test_experiment_table(spark):
    prots = spark.createDataFrame([(5, "MKPARDEK"), (7, "AK"), (9, "MDEACYKG")], "protein_id int, sequence string")
    peps = dg.labelled(dg.numbered_peptides(prots))
    assert [r["peptide_id"] for r in peps.orderBy("protein_id", "pos").collect()] == list(range(5))
    cat = dg.flustring_catalog(peps)
    assert {(r["flu_id"], r["flustring"]) for r in cat.collect()} == {(0, "00"), (1, ".00.12")}
    table = dg.experiment_table(peps, cat)
    assert {(r["peptide_id"], r["flu_id"]) for r in table.collect()} == {(1, 0), (3, 1)}
    assert {(r["protein_id"], r["protein_ix"]) for r in dg.reindexed(table).collect()} == {(5, 0), (9, 1)}


def test_numbered(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.col("id") % 5)
    rows = numbered(df, ["id"], "n", F.col("v"), "before").collect()
    assert all(r["n"] == r["id"] for r in rows)
    want = np.r_[0, np.cumsum(np.arange(1000) % 5)][:-1]
    assert all(r["before"] == want[r["id"]] for r in rows)
    assert numbered(df.limit(0), ["id"], "n").count() == 0


TINY = [(0, 0, 0.5), (0, 1, 0.5), (1, 1, 0.5), (1, 2, 0.5)]


@pytest.fixture(scope="module")
def tiny(spark):
    emission = spark.createDataFrame(TINY, "protein_id int, flu_id int, p double")
    rows = spark.createDataFrame([(0, 0, 1.0, 0.0), (1, 1, 1.0, 0.0), (2, 2, 1.0, 0.0), (3, 2, 1.0, 0.0)], "read_id long, flu_id int, s double, r double")
    start = spark.createDataFrame([(0, 0.5), (1, 0.5)], "protein_id int, pi double")
    return rows, emission, start


def pis(df):
    return {r["protein_id"]: r["pi"] for r in df.collect()}


def test_em_by_hand(spark, tiny):
    rows, emission, start = tiny
    got = em.epoch_in_one_plan(rows, emission, start)
    assert pis(got) == pytest.approx({0: 0.375, 1: 0.625})
    fit = em.fit(rows, emission, start, 2)
    assert pis(fit.pi) == pytest.approx({0: 0.34375, 1: 0.65625})
    assert all(h["sum_u"] == pytest.approx(4) for h in fit.history)


def dense_em(s, r, p, pi, epochs):
    """The reads x proteins form."""
    eta = s @ p.T + r[:, None]
    for _ in range(epochs):
        a = eta * pi
        u = (a / a.sum(1, keepdims=True)).sum(0)
        pi = u / u.sum()
    return pi


def test_factored_equals_dense(spark):
    rng = np.random.default_rng(0)
    n, f, k = 60, 12, 5
    p = rng.random((k, f)) * (rng.random((k, f)) < 0.5) + 1e-3
    p[:, f - 1] = 0  # a flu that no protein yields
    p /= p.sum(1, keepdims=True)
    s = rng.random((n, f)) * (rng.random((n, f)) < 0.3)
    s[0] = 0
    s[0, f - 1] = 0.5
    s = s / np.maximum(1.0, s.sum(1, keepdims=True) / 0.9)
    r = np.maximum(0, 1 - s.sum(1)) / f
    pi = np.full(k, 1 / k)
    rows = spark.createDataFrame([(i, j, float(s[i, j]), float(r[i])) for i in range(n) for j in range(f) if s[i, j] or j == i % f], "read_id long, flu_id int, s double, r double")
    emission = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(k) for j in range(f) if p[i, j]], "protein_id int, flu_id int, p double")
    start = spark.createDataFrame([(i, float(pi[i])) for i in range(k)], "protein_id int, pi double")
    fit = em.fit(rows, emission, start, 6)
    want = dense_em(s, r, p, pi, 6)
    assert pis(fit.pi) == pytest.approx(dict(enumerate(want)), abs=1e-12)
    ll = [h["loglik"] for h in fit.history]
    assert all(b >= a - 1e-9 for a, b in zip(ll, ll[1:], strict=False))
    dense = s @ p.T + r[:, None]
    alphas = dense * pi / (dense * pi).sum(1, keepdims=True)
    etas = em.eta(rows, emission)
    got = {(x["read_id"], x["protein_id"]): x["eta"] for x in etas.collect()}
    assert got == pytest.approx({key: dense[key] for key in got})
    shares = em.responsibilities(etas, start).collect()
    assert {(x["read_id"], x["protein_id"]): x["alpha"] for x in shares} == pytest.approx({key: alphas[key] for key in got})
    rest = {x["read_id"]: x["rest"] for x in shares}
    others = [(i, j) for i in rest for j in range(k) if (i, j) not in got]
    assert [rest[i] * pi[j] for i, j in others] == pytest.approx([alphas[key] for key in others])


def test_multiplicity_equals_repeats(spark, tiny):
    rows, emission, start = tiny
    m = rows.filter("read_id <> 3").withColumn("cv", F.lit(0)).withColumn("m", F.when(F.col("read_id") == 2, 2.0).otherwise(1.0))
    assert pis(em.fit(m, emission, start, 3).pi) == pytest.approx(pis(em.fit(rows, emission, start, 3).pi))
    both = rows.withColumn("cv", F.lit(0)).withColumn("m", F.lit(1.0))
    once = em.collapse(both)
    assert once.count() == 3
    assert pis(em.fit(once, emission, start, 3).pi) == pytest.approx(pis(em.fit(rows, emission, start, 3).pi))


def test_read_of_no_likelihood_is_left_out(spark, tiny):
    rows, emission, start = tiny
    lost = rows.unionByName(spark.createDataFrame([(9, 77, 1.0, 0.0)], rows.schema))
    assert pis(em.fit(lost, emission, start, 2).pi) == pytest.approx(pis(em.fit(rows, emission, start, 2).pi))


def test_emission_and_conversions(spark):
    peps = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1)], "protein_id int, flu_id int")
    dyes = spark.createDataFrame([(0, 1), (1, 2)], "flu_id int, n_dyes int")
    e = emi.emission_model(emi.emission_counts(peps), dyes, 0.25)
    got = {(r["protein_id"], r["flu_id"]): r["p"] for r in e.collect()}
    assert got == pytest.approx({(0, 0): 1.5 / 2.4375, (0, 1): 0.9375 / 2.4375, (1, 1): 1.0})
    w = emi.protein_weights(e)
    pi = emi.prior(w)
    back = emi.to_read_share(emi.to_abundance(pi, w).select("protein_id", "p_y"), w)
    assert pis(back) == pytest.approx(pis(pi))
    assert sum(r["p"] for r in emi.flu_distribution(e, pi).collect()) == pytest.approx(1)


def test_sparsifiers(spark):
    rows = [(1, 0, 0.1), (1, 1, 0.4), (1, 2, 0.4), (1, 3, 0.05), (2, 5, 0.2)]
    s = spark.createDataFrame(rows, "read_id long, flu_id int, s double")
    kept = lambda df: {(r["read_id"], r["flu_id"]) for r in df.collect()}
    assert kept(scores.n_best(s, 1)) == {(1, 1), (2, 5)}
    assert kept(scores.n_best(s, None)) == {r[:2] for r in rows}
    assert kept(scores.accumulated(s, 0.5)) == {(1, 1), (1, 2), (2, 5)}
    assert kept(scores.accumulated(s, 0.99)) == {r[:2] for r in rows}
    assert kept(scores.above(s, 0.3)) == {(1, 1), (1, 2), (2, 5)}
    assert {r["read_id"]: r["r"] for r in scores.residual(s, 10).collect()} == pytest.approx({1: 0.005, 2: 0.08})
    assert scores.residual(s.withColumn("s", F.lit(2.0)), 10).agg(F.min("r")).first()[0] == 0
    assert scores.n_best_in_id_order(s, 2).filter("read_id = 1").first()["flu_ids"] == [1, 2]
    curve = {r["rank"]: r["residual"] for r in metrics.residual_curve(s).collect()}
    assert curve[1] == pytest.approx(1 - 0.6 / 2) and curve[4] == pytest.approx(1 - 1.15 / 2)


@pytest.mark.parametrize("form, total", [("truth plus even", 1.0), ("even, one short", 1 - 0.1 / 4), ("others only", 1.0)])
def test_oracles(spark, form, total):
    labels = spark.createDataFrame([(0, 2)], "read_id long, true_flu int")
    r = scores.oracle(labels, 0.1, 4, 3, form).first()
    assert r["s"] + 4 * r["r"] == pytest.approx(total)


def test_padded_oracle_reproduces_the_oracle(spark, tiny):
    _, emission, start = tiny
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "read_id long, true_flu int")
    p = scores.padded_oracle(labels, 3, 3).select("read_id", F.inline(F.arrays_zip(F.col("flu_ids").alias("flu_id"), F.col("scores").alias("s")))).withColumn("r", F.lit(0.0))
    o = scores.oracle(labels, 0.0, 3)
    assert pis(em.fit(p, emission, start, 3).pi) == pytest.approx(pis(em.fit(o, emission, start, 3).pi))


def test_folds(spark):
    prots = spark.range(50).select(F.col("id").cast("int").alias("protein_id"))
    a = folds.random_abundances(prots, 3)
    assert {r["cv"]: round(r["t"], 9) for r in a.groupBy("cv").agg(F.sum("p_y").alias("t")).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}
    flu_p = spark.createDataFrame([(0, 0.2), (1, 0.0), (2, 0.8)], "flu_id int, p double")
    draws = folds.sampled_labels(flu_p, 4000, 0)
    n = {r["true_flu"]: r["count"] for r in draws.groupBy("true_flu").count().collect()}
    assert sum(n.values()) == 4000 and 1 not in n and abs(n[2] - 3200) < 150
    reads = spark.createDataFrame([(i, 0 if i < 3 else 2) for i in range(10)], "read_id long, true_flu int")
    assert folds.sampled_reads(draws, reads, 0).agg(F.sum("m")).first()[0] == 4000
    sub = folds.subsets(reads, 2, 4)
    assert {r["cv"]: r["count"] for r in sub.groupBy("cv").count().collect()} == {0: 4, 1: 4}


def test_metrics(spark):
    est = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 0, 0.9), (1, 1, 0.1)], "cv int, protein_id int, e double")
    true = spark.createDataFrame([(0, 0.7), (1, 0.3)], "protein_id int, t double")
    m = metrics.mae(est, true, "e", "t", ["cv"])
    assert {r["cv"]: r["mae"] for r in m.collect()} == pytest.approx({0: 0.2, 1: 0.2})
    assert metrics.mean_std(m.filter("cv = 0"), []).first()["std"] is None
    assert one(spark, metrics.uniform_mae_closed(F.lit(5))) == pytest.approx(0.131072)
    h = metrics.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "x double"), "x", 2)
    assert {r["bin"]: r["n"] for r in h.collect()} == {0: 1, 1: 2}
    d = metrics.compared(est.filter("cv = 0"), est.filter("cv = 1"), ["protein_id"], "e").first()
    assert d["max_diff"] == pytest.approx(0.4) and d["protein_id"] == 0


def test_checks(spark, tiny):
    rows, emission, _ = tiny
    prots = spark.createDataFrame([(0,), (1,), (2,)], "protein_id int")
    bad = rows.unionByName(spark.createDataFrame([(4, 0, math.nan, 0.0), (5, 1, 0.0, 0.0)], rows.schema))
    got = {r["check"]: r["n"] for r in validate.report(bad, emission, prots).collect()}
    assert got == {"bad_scores": 1, "zero_rows": 1, "zero_emission": 0, "unseen_proteins": 1}
    with pytest.warns(UserWarning, match="holds 5"):
        assert validate.sparsity(10, 5) == 5


def test_first_flustrings(spark):
    """As the first row of each protein of the whole table, without a row for a peptide."""
    from lumipep.operators import digest as dg

    p = spark.createDataFrame([(3, "GGKMDEK"), (5, ""), (7, "GGK"), (9, "AKPDRCCK"), (11, "YK")], "protein_id int, sequence string")
    every = dg.labelled(dg.numbered_peptides(p)).filter("flustring <> ''").select("protein_id", "flustring", "peptide_id")
    want = sorted(tuple(r) for r in dg.first_rows(every, "protein_id", "peptide_id").select("protein_id", "flustring", "peptide_id").collect())
    first = dg.first_flustrings(p)
    assert sorted(tuple(r) for r in first.collect()) == want and len(want) == 3
    assert [r[0] for r in dg.observable(p).orderBy("protein_id").collect()] == [r[0] for r in want]
    assert "Generate" not in first._jdf.queryExecution().optimizedPlan().toString()


def test_labelled_peptides_are_labelled_once(spark):
    """Flustrings made before a peptide is a row are the same, and a filter on them does not make them again."""
    from lumipep.functions.sequence import sequence_of

    texts = ["MKPARDEK", "AK", "KRRP", "MDEACYKG", "", "d e-c.Y\nk", None]
    prots = spark.createDataFrame(list(enumerate(texts)), "protein_id long, text string").select("protein_id", sequence_of(F.col("text")).alias("sequence"))
    one, two = dg.labelled_peptides(prots), dg.labelled(dg.numbered_peptides(prots))
    assert sorted(map(tuple, one.collect())) == sorted(tuple(r) for r in two.select(*one.columns).collect())
    plan = one.filter("flustring <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^DECY]") == 1
    assert {r["flustring"] for r in dg.experiment_table(one, dg.flustring_catalog(one)).collect()} == {"00", ".00.12", "0012"}
