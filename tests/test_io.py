"""Readers and writers: round trips and the odd inputs."""

import numpy as np
import pytest

from lumipep.operators import digest as dg
from lumipep.sources import readers, sinks
from lumipep.streaming import accumulate, updated

FASTA = ">ID1 first GN=GENE1 X=1\nMDEACYKG\nKRRP\n>ID2 second GN=GENE2 X=1\nMKPARDEK"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("end", ["", "\n"])
def test_fasta(spark, tmp_path, end):
    (tmp_path / "p.fasta").write_text(FASTA + end)
    p = readers.fasta(spark, str(tmp_path / "p.fasta"))
    assert rows(p, "protein_id", "gene", "sequence") == [(0, "GENE1", "MDEACYKGKRRP"), (1, "GENE2", "MKPARDEK")]
    assert rows(readers.proteins_of_genes(p, ["GENE2"]), "protein_id", "gene") == [(0, "GENE2")]
    gone = spark.createDataFrame([(0,)], "protein_id int")
    assert rows(readers.without_ordinals(p, gone), "index") == [(0,)]
    assert readers.sample_proteins(p, 1).count() == 1


def test_experiment_csv(spark, tmp_path):
    prots = spark.createDataFrame([(0, "MKPARDEK"), (1, "MDEACYKG")], "protein_id int, sequence string")
    peps = dg.labelled(dg.numbered_peptides(prots))
    table = dg.experiment_table(peps, dg.flustring_catalog(peps))
    sinks.experiment_csv(table, str(tmp_path / "t"))
    back = readers.experiment_csv(spark, str(tmp_path / "t"))
    assert rows(back, "peptide_id", "flustring") == rows(table, "peptide_id", "flustring")
    sinks.dye_sequences(dg.flustring_catalog(peps), str(tmp_path / "d"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "d").glob("part*")))
    assert text.splitlines() == ["3", "2", "00\t1\t0", "21.00.\t1\t1"]


def test_binary(spark, tmp_path):
    np.array([[0.5, 0.3], [0.9, 0.05]], "<f4").tofile(tmp_path / "s.bin")
    np.array([[1, 4], [0, 7]], "<u4").tofile(tmp_path / "i.bin")
    s = readers.scores_binary(spark, str(tmp_path / "s.bin"), str(tmp_path / "i.bin"), 2)
    assert rows(s, "read_id", "flu_id") == [(0, 1), (0, 4), (1, 0), (1, 7)]
    with pytest.raises(Exception, match="no whole rows"):
        readers.flat_binary(spark, str(tmp_path / "s.bin"), "f4", 3).count()


def test_csv_vectors(spark, tmp_path):
    for name, values in (("n", [2, 1]), ("f", [0, 3, 3]), ("p", [0.25, 0.75, 1.0])):
        (tmp_path / f"{name}.csv").write_text("".join(f"{v}\n" for v in values))
    e = readers.emission_csv(spark, *(str(tmp_path / f"{n}.csv") for n in "nfp"))
    assert rows(e, "protein_id", "flu_id", "p") == [(0, 0, 0.25), (0, 3, 0.75), (1, 3, 1.0)]


def test_simulation_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("flu_i,pro_i,n_dyes_all_ch\n0,1,0\n1,1,3\n2,0,1\n")
    assert rows(readers.simulation_csv(spark, str(tmp_path / "s.csv")), "protein_id", "flu_id", "n_dyes") == [(0, 0, 3)]


def test_radiometries(spark, tmp_path):
    df = spark.createDataFrame([(0, 4, [1.0, 2.0]), (1, 5, [3.0, 4.0])], "read_id long, true_flu int, signal array<double>")
    sinks.radiometries_tsv(df, str(tmp_path / "r"), 2, 1)
    sinks.true_ids_tsv(df, str(tmp_path / "t"))
    back = readers.radiometries(spark, str(tmp_path / "r"), str(tmp_path / "t"))
    assert rows(back, "read_id", "true_flu", "signal") == rows(df, "read_id", "true_flu", "signal")


def test_runs(spark, tmp_path):
    for name, body in (("01-02-2025_03-04-05", "1,0.5,-nan\n2,0.25,-nan\n"), ("02-02-2025_03-04-05", "1,0.5,0.1\n2,0.2,0.1\n"), ("Old", "1,9,9\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "ErrVsEpochs.csv").write_text("Epoch,Error mean,Error std\n" + body)
        (tmp_path / name / "RunConfig.txt").write_text(f"Oracle error: {0.1 if name[:2] == '01' else 0.05}\n")
    e, c = readers.run_errors(spark, str(tmp_path)), readers.run_configs(spark, str(tmp_path))
    assert e.count() == 4 and e.filter("std is null").count() == 2
    got = readers.runs_by(e, c, "Oracle error").collect()
    assert [(r["setting"], r["mean"]) for r in got] == [(0.05, 0.2), (0.1, 0.25)]
    assert readers.config_value(c, "missing").filter("value is null").count() == 2
    assert e.select(readers.run_time(e["run"]).alias("t")).filter("t is null").count() == 0
    sinks.errors_csv(e.filter("run like '01%'"), str(tmp_path / "out"))
    assert "-nan" in "".join(f.read_text() for f in (tmp_path / "out").glob("part*"))


def test_dataset_and_config(spark, tmp_path):
    cv = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5)], "cv int, protein_id int, p_y double")
    sinks.dataset(str(tmp_path / "d"), cv_truth=cv)
    assert spark.read.parquet(str(tmp_path / "d/cv_truth")).filter("cv = 1").count() == 1
    sinks.config_text(spark, {"Epochs": 3, "Folds": 2}, str(tmp_path / "c"))
    assert "Epochs: 3" in "".join(f.read_text() for f in (tmp_path / "c").glob("part*"))


def test_stream_adds_up(spark, tmp_path):
    """Statistics of micro-batches give the same epoch as all reads at once."""
    from lumipep.operators import em

    emission = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 0.5), (1, 2, 0.5)], "protein_id int, flu_id int, p double")
    scores = spark.createDataFrame([(0, i, f, 1.0, 0.0, 1.0, True) for i, f in enumerate([0, 1, 2, 2])], "cv int, read_id long, flu_id int, s double, r double, m double, first boolean")
    for i in range(4):
        scores.filter(f"read_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    pi = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "cv int, protein_id int, pi double")
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = accumulate(stream, emission, pi, str(tmp_path / "w"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    stats = spark.read.parquet(str(tmp_path / "w"))
    got = {r["protein_id"]: r["pi"] for r in updated(stats, emission, pi).collect()}
    want = {r["protein_id"]: r["pi"] for r in em.fit(scores.drop("first"), emission, pi, 1).pi.collect()}
    assert got == pytest.approx(want)


def _dealt(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, "read_id long, flu_id int, s double, n int").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("read_id long, flu_id int, s double, n int").option("maxFilesPerTrigger", 1).parquet(path)


def test_reads_over_several_batches(spark, tmp_path):
    """Each read's rows come in three micro-batches, the last of some in a second run of the stream; the epoch is that of all reads at once."""
    from pyspark.sql import functions as F

    from lumipep.operators import em
    from lumipep.operators.scores import with_residual
    from lumipep.streaming import statistics_of

    emission = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5), (1, 1, 0.5), (1, 2, 0.5)], "protein_id int, flu_id int, p double")
    every = [(i, f, 0.1 + (i * 7 + f * 3) % 5 / 20, 3) for i in range(40) for f in range(3)] + [(99, 1, 0.5, 1)]
    parts = [[r for r in every if (r[0] + r[1]) % 3 == k] for k in range(3)]
    pi = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.5)], "cv int, protein_id int, pi double")
    run = lambda stream: accumulate(stream, emission, pi, str(tmp_path / "w"), str(tmp_path / "cp"), 3).awaitTermination()
    run(_dealt(spark, str(tmp_path / "in"), parts[:2]))
    early = spark.read.parquet(str(tmp_path / "w")).filter("w > 0").count()
    run(_dealt(spark, str(tmp_path / "in"), parts[2:]))  # open reads have waited in the checkpoint
    stats = statistics_of(spark, str(tmp_path / "w"))
    got = {r["protein_id"]: r["pi"] for r in updated(stats, emission, pi).collect()}
    scores = with_residual(spark.createDataFrame([r[:3] for r in every], "read_id long, flu_id int, s double"), 3)
    want = {r["protein_id"]: r["pi"] for r in em.fit(scores, emission, pi.drop("cv"), 1).pi.collect()}
    assert got == pytest.approx(want) and early <= 1
    assert stats.agg(F.sum("loglik")).first()[0] == pytest.approx(em.fit(scores, emission, pi.drop("cv"), 1).history[0]["loglik"])


def test_too_many_rows_of_a_read_raise(spark, tmp_path):
    emission = spark.createDataFrame([(0, 0, 1.0)], "protein_id int, flu_id int, p double")
    pi = spark.createDataFrame([(0, 0, 1.0)], "cv int, protein_id int, pi double")
    stream = _dealt(spark, str(tmp_path / "in"), [[(1, 0, 0.5, 2)], [(1, 1, 0.5, 2), (1, 2, 0.5, 2)]])
    with pytest.raises(Exception, match="read 1: 3 scores where its rows say 2"):
        accumulate(stream, emission, pi, str(tmp_path / "w"), str(tmp_path / "cp"), 3).awaitTermination()


def test_numbers_in_parts(spark, tmp_path):
    """A column in parts of any lengths is numbered in order of the parts' names."""
    for name, values in (("part-00000", [0]), ("part-00001", range(1, 500)), ("part-00002", [500, 501])):
        (tmp_path / "n").mkdir(exist_ok=True)
        (tmp_path / "n" / name).write_text("".join(f"{v}\n" for v in values))
    assert rows(readers.numbers_csv(spark, str(tmp_path / "n"), "int"), "at", "value") == [(i, i) for i in range(502)]


def test_entries_are_not_broadcast(spark, tmp_path):
    """Rows exploded from a short table of counts are many: neither form of the emission joins them by a broadcast."""
    from lumipep.sources import interchange

    for name, values in (("n", [2, 1]), ("f", [0, 3, 3]), ("p", [0.25, 0.75, 1.0])):
        (tmp_path / f"{name}.csv").write_text("".join(f"{v}\n" for v in values))
    csv = readers.emission_csv(spark, *(str(tmp_path / f"{n}.csv") for n in "nfp"))
    entries = spark.createDataFrame([(0, 0, 0.25), (0, 3, 0.75), (1, 3, 1.0)], "protein_id int, flu_id int, p double")
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "protein_id int, exp_n double")
    interchange.write_emission(entries, weights, str(tmp_path / "flat"))
    flat = interchange.read_emission(spark, str(tmp_path / "flat"))[0]
    for df in (csv, flat):
        assert rows(df, "protein_id", "flu_id", "p") == [(0, 0, 0.25), (0, 3, 0.75), (1, 3, 1.0)]
        joins = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
        assert sum("strategy=merge" in x for x in joins) == (2 if df is csv else 1)


def test_lines_in_many_tasks(spark, tmp_path):
    """A long text is written by more than one task, and read back line by line."""
    df = spark.range(20000).selectExpr("id as read_id", "cast(id % 7 as int) as true_flu", "array(id / 2.0D) as signal")
    sinks.radiometries_tsv(df, str(tmp_path / "r"), 1, 1)
    sinks.true_ids_tsv(df, str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.radiometries_tsv(df, str(tmp_path / "r"), 1, 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(list((tmp_path / "r").glob("part*"))) > 1
    back = readers.radiometries(spark, str(tmp_path / "r"), str(tmp_path / "t"))
    assert rows(back, "read_id", "true_flu", "signal") == rows(df, "read_id", "true_flu", "signal")
