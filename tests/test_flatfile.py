"""Flat binary files: byte layout, ranges of rows, files side by side, and what must not be left behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumipep.operators import em
from lumipep.operators.emission import prior
from lumipep.run import Settings, fitted
from lumipep.sources import interchange, readers
from lumipep.sources.flatfile import Column, read_flat, write_flat


def values(n, width=3):
    return np.arange(n * width, dtype="<f4").reshape(n, width) / 7


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    values(10_000).tofile(tmp_path / "v.bin")
    df = read_flat(spark, [Column("v", str(tmp_path / "v.bin"), "f4", 3)], part_bytes=10_000)
    assert df.rdd.getNumPartitions() >= 4
    got = df.select("row", F.spark_partition_id().alias("p"), "v").orderBy("row").collect()
    assert [r["row"] for r in got] == list(range(10_000)) and len({r["p"] for r in got}) == 13
    assert (np.array([r["v"] for r in got], "<f4") == values(10_000)).all()


def test_prefix_reads_only_its_bytes(spark, tmp_path):
    """Beyond the first rows the file is not there at all."""
    values(100).tofile(tmp_path / "v.bin")
    os.truncate(tmp_path / "v.bin", 1 << 33)  # 8 GB, most of it a hole
    df = read_flat(spark, [Column("v", f"file://{tmp_path}/v.bin", "f4", 4)], rows=75)
    assert df.rdd.getNumPartitions() == 1 and df.count() == 75
    assert read_flat(spark, [Column("v", str(tmp_path / "v.bin"), "f4", 4)]).rdd.getNumPartitions() == 128


def test_written_in_place(spark, tmp_path):
    rows = spark.range(5000).select((4999 - F.col("id")).alias("row"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: (4999 - F.col("id")) * 3 + j).alias("v"), (F.col("id") * -2).alias("i"))
    write_flat(rows.repartition(7), [Column("v", str(tmp_path / "d/v.bin"), "u4", 3), Column("i", str(tmp_path / "d/i.bin"), "i8")])
    assert (np.fromfile(tmp_path / "d/v.bin", "<u4") == np.arange(15_000)).all()
    assert (np.fromfile(tmp_path / "d/i.bin", "<i8") == -2 * np.arange(5000)[::-1]).all()
    assert sorted(os.listdir(tmp_path / "d")) == ["i.bin", "v.bin"]


@pytest.mark.parametrize("row", ["id + 1", "id div 2", "id * 2"])
def test_gaps_and_repeats_of_rows_raise(spark, tmp_path, row):
    np.zeros(3, "<f8").tofile(tmp_path / "v.bin")
    with pytest.raises(Exception, match="not numbered 0 to"):
        write_flat(spark.range(10).select(F.expr(row).alias("row"), F.lit(1.0).alias("v")), [Column("v", str(tmp_path / "v.bin"), "f8")])
    assert os.listdir(tmp_path) == ["v.bin"] and os.path.getsize(tmp_path / "v.bin") == 24  # the old file, and no other


@pytest.mark.parametrize("bad, says", [("null", "null has no form"), ("-1", "do not fit"), ("5000000000", "do not fit")])
def test_values_without_a_form_raise(spark, tmp_path, bad, says):
    with pytest.raises(Exception, match=says):
        write_flat(spark.range(3).select(F.col("id").alias("row"), F.expr(f"if(id = 1, {bad}, id)").alias("v")), [Column("v", str(tmp_path / "v.bin"), "u4")])
    assert os.listdir(tmp_path) == []


def test_files_that_do_not_fit(spark, tmp_path):
    values(4).tofile(tmp_path / "a.bin")
    values(5).tofile(tmp_path / "b.bin")
    a, b = (Column(n, str(tmp_path / f"{n}.bin"), "f4", 3) for n in "ab")
    with pytest.raises(Exception, match="differ in rows"):
        read_flat(spark, [a, b]).count()
    with pytest.raises(Exception, match="no whole rows"):
        readers.flat_binary(spark, a.path, "f4", 5).count()
    with pytest.raises(Exception, match="No such file|Failed to open"):
        readers.flat_binary(spark, str(tmp_path / "none.bin"), "f4", 5).count()


def test_empty(spark, tmp_path):
    c = Column("v", str(tmp_path / "v.bin"), "f4")
    write_flat(spark.range(0).select(F.col("id").alias("row"), F.lit(1.0).alias("v")), [c])
    assert os.path.getsize(tmp_path / "v.bin") == 0 and read_flat(spark, [c]).count() == 0


def test_dataset(spark, tmp_path):
    """Written, looked at byte by byte, read back, and fitted like the tables it came from."""
    e = spark.createDataFrame([(0, 0, 0.5, 1.0), (0, 3, 0.5, 1.0), (2, 3, 0.25, 0.5), (2, 1, 0.75, 1.5)], "protein_id int, flu_id int, p double, w double")
    w = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 2.0)], "protein_id int, exp_n double")  # protein 1 has no entry
    s = spark.createDataFrame([(0, 3, 0.5), (0, 0, 0.25), (1, 1, 0.75), (2, 3, 0.5), (2, 1, 0.25), (2, 0, 0.125)], "read_id long, flu_id int, s double")
    labels = spark.createDataFrame([(0, 3), (1, 1), (2, 3)], "read_id long, true_flu int")
    cv = spark.createDataFrame([(0, 2, 2), (0, 0, 1), (1, 1, 3)], "cv int, read_id long, m long")
    truth = spark.createDataFrame([(c, p, x) for c in (0, 1) for p, x in enumerate([0.5, 0.25, 0.25])], "cv int, protein_id int, p_y double")
    root = str(tmp_path / "ds")
    interchange.write_dataset(root, "forest", e, w, s, 2, labels, cv, truth)
    at = lambda name, kind: np.fromfile(f"{root}/{name}", kind).tolist()
    assert at("Common/nFluExpForI.bin", "<u4") == [2, 0, 2] and at("Common/fluExpIdForI.bin", "<u4") == [0, 3, 1, 3]
    assert at("Common/probFluExpForI.bin", "<f4") == [0.5, 0.5, 0.75, 0.25] and at("Common/expNFluExpGenByI.bin", "<f4") == [2, 1, 2]
    assert at("forest/Common/TopNScoresId.bin", "<u4") == [0, 3, 0, 1, 1, 3] and at("forest/Common/TopNScores.bin", "<f4") == [0.25, 0.5, 0, 0.75, 0.25, 0.5]
    assert at("forest/Common/nSparsity.bin", "<u4") == [2] and at("forest/Common/trueIds.bin", "<u4") == [3, 1, 3]
    assert at("forest/CrossVal/ScoreIds0.bin", "<u4") == [0, 2, 2] and at("forest/CrossVal/ScoreIds1.bin", "<u4") == [1, 1, 1]
    assert at("forest/CrossVal/TrueProtDist1.bin", "<f4") == [0.5, 0.25, 0.25]
    back = interchange.read_dataset(spark, root, "forest", 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back["emission"]) == rows(e.drop("w")) and rows(back["protein"]) == rows(w) and rows(back["reads"]) == rows(labels)
    assert rows(back["cv_reads"]) == rows(cv) and rows(back["cv_truth"]) == rows(truth)
    assert rows(back["scores"]) == rows(s.filter("not (read_id = 2 and flu_id = 0)"))
    tables = {"emission": e, "protein": w, "scores": back["scores"], "cv_reads": cv, "cv_truth": truth}
    a, b = (sorted(map(tuple, fitted(t, Settings(3))[0].pi.collect())) for t in (back, tables))
    assert len(a) == 6 and [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-14)
    p_y = spark.createDataFrame([(c, p, (c + 1) / 8 + p / 4) for c in range(2) for p in range(3)], "cv int, protein_id int, p_y double")
    interchange.write_estimates(p_y, 3, root)
    assert at("PhatYs.bin", "<f4") == [0.125, 0.375, 0.625, 0.25, 0.5, 0.75]
    assert rows(interchange.read_estimates(spark, f"{root}/PhatYs.bin", 3)) == rows(p_y)


def test_prior_of_flat_weights(spark, tmp_path):
    w = spark.createDataFrame([(0, 1.0), (1, 3.0)], "protein_id int, exp_n double")
    interchange.write_emission(spark.createDataFrame([(0, 0, 1.0)], "protein_id int, flu_id int, p double"), w, str(tmp_path))
    assert [r["pi"] for r in prior(interchange.read_emission(spark, str(tmp_path))[1]).orderBy("protein_id").collect()] == [0.25, 0.75]
    assert em.FEW_FLUS > 0
