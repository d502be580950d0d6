"""Registered queries of sources and sinks: a table's columns are written in a format and read back; the SQL is the table itself."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import in_file_order, numbered
from ..functions.scratch import shared_dir
from ..functions.sequence import three_digits
from ..operators import digest as dg
from ..operators import scores, validate
from ..operators import emission as emi
from ..run import Settings, run
from ..sources import interchange, readers, sinks
from .catalog import _AFTER, _FLU, _ORACLE_EM, _PI_OF_TRUTH, ERROR, FOLD_EPOCHS, N_FOLDS, SQL, _flus, _subset, query, r9
from .recast import Tables, em_sql, with_cte


def place(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/lumipep-{name}-{uuid.uuid4().hex}"


# FASTA and headers ---------------------------------------------------------------------------------------------

_LETTERS = "translate(p_partkey::VARCHAR, '0123456789', 'ADEFGHIKLM')"
_FASTA = f"fa AS (SELECT (row_number() OVER (ORDER BY p_partkey) - 1)::INTEGER AS protein_id, 'part ' || p_partkey || ' GN=G' || p_partkey % 50 || ' X=1' AS header, 'G' || p_partkey % 50 AS gene, {_LETTERS} || 'K' || {_LETTERS} AS sequence FROM part)"


def _fasta(t: Tables) -> DataFrame:
    """Parts as records of two lines, with line breaks inside the sequence."""
    path = place(t, "fasta")
    letters = F.translate(F.col("p_partkey").cast("string"), "0123456789", "ADEFGHIKLM")
    text = F.concat(F.lit(">part "), "p_partkey", F.lit(" GN=G"), F.col("p_partkey") % 50, F.lit(" X=1\n"), letters, F.lit("K\n"), letters)
    t.read("part").orderBy("p_partkey").coalesce(1).select(text.alias("value")).write.text(path)
    return readers.fasta(t.spark, path)


@query(f"WITH {_FASTA} SELECT * FROM fa")
def fasta_scan(t: Tables) -> DataFrame:
    return _fasta(t)


@query(f"WITH {_FASTA} SELECT protein_id, sequence FROM fa ORDER BY md5('0-' || protein_id), protein_id LIMIT 100")
def fasta_sample(t: Tables) -> DataFrame:
    return readers.sample_proteins(_fasta(t), 100).select("protein_id", "sequence")


@query(f"WITH {_FASTA} SELECT (row_number() OVER (ORDER BY protein_id) - 1)::INTEGER AS protein_id, header, gene, sequence FROM fa WHERE gene IN ('G3', 'G7', 'G49')")
def fasta_of_genes(t: Tables) -> DataFrame:
    return readers.proteins_of_genes(_fasta(t), ["G3", "G7", "G49"])


@query("SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::INTEGER AS index, s_name AS description FROM supplier")
def descriptions_round_trip(t: Tables) -> DataFrame:
    path = place(t, "descriptions")
    s = t.read("supplier").select(F.col("s_suppkey").cast("int").alias("protein_id"), F.col("s_name").alias("header"))
    sinks.descriptions_csv(readers.without_ordinals(s, s.limit(0).select("protein_id")), path)
    return t.spark.read.schema("index int, description string").csv(path, header=True)


# CSV -----------------------------------------------------------------------------------------------------------


@query(_FLU + "\nSELECT peptide_id::INTEGER AS peptide_id, peptide, protein_id::INTEGER AS protein_id, flu_id::INTEGER AS flu_id, flus.flustring FROM flus JOIN cat ON cat.flustring = flus.flustring")
def experiment_csv_round_trip(t: Tables) -> DataFrame:
    peps, path = _flus(t), place(t, "experiment")
    sinks.experiment_csv(dg.experiment_table(peps, dg.flustring_catalog(peps)), path)
    return readers.experiment_csv(t.spark, path)


@query("SELECT l_suppkey::INTEGER AS protein_id, l_partkey::INTEGER AS flu_id, l_linenumber::INTEGER AS n_dyes FROM lineitem")
def simulation_csv_scan(t: Tables) -> DataFrame:
    path = place(t, "simulation")
    rows = t.read("lineitem").select((F.col("l_partkey") + 1).alias("flu_i"), (F.col("l_suppkey") + 1).alias("pro_i"), F.col("l_linenumber").alias("n_dyes_all_ch"))
    null = t.spark.createDataFrame([(0, 3, 1), (3, 0, 0)], "flu_i long, pro_i long, n_dyes_all_ch int")  # the null flustring and the null protein
    rows.unionByName(null).write.csv(path, header=True)
    return readers.simulation_csv(t.spark, path)


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS at, o_totalprice AS value FROM orders")
def numbers_csv_scan(t: Tables) -> DataFrame:
    path = place(t, "numbers")
    t.read("orders").orderBy("o_orderkey").select("o_totalprice").write.csv(path)
    return readers.numbers_csv(t.spark, path)


@query(with_cte("emission") + "\nSELECT (dense_rank() OVER (ORDER BY protein_id) - 1)::INTEGER AS protein_id, flu_id, round(p, 9) AS p FROM emission")
def emission_csv_round_trip(t: Tables) -> DataFrame:
    e, paths = t.emission(), [place(t, x) for x in ("counts", "flus", "ps")]
    for rows, path in zip((e.groupBy("protein_id").agg(F.count(F.lit(1)).alias("n")).orderBy("protein_id").select("n"), e.orderBy("protein_id", "flu_id").select("flu_id"), e.orderBy("protein_id", "flu_id").select("p")), paths, strict=True):
        rows.write.csv(path)
    return readers.emission_csv(t.spark, *paths).select("protein_id", "flu_id", r9("p").alias("p"))


# TSV -----------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS read_id, l_partkey::INTEGER AS true_flu, [l_quantity, l_discount, l_tax] AS signal FROM lineitem")
def radiometries_round_trip(t: Tables) -> DataFrame:
    signal, ids = place(t, "signal"), place(t, "ids")
    rows = numbered(t.read("lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"], "read_id")
    rows = rows.select("read_id", F.col("l_partkey").cast("int").alias("true_flu"), F.array("l_quantity", "l_discount", "l_tax").alias("signal"))
    sinks.radiometries_tsv(rows, signal, 1, 3)
    sinks.true_ids_tsv(rows, ids)
    return readers.radiometries(t.spark, signal, ids)


@query(_FLU + "\nSELECT flu_id + 2 AS line, reverse(flustring) || chr(9) || '1' || chr(9) || flu_id AS value FROM cat UNION ALL SELECT 0, '3' UNION ALL SELECT 1, count(*)::VARCHAR FROM cat")
def dye_sequences_lines(t: Tables) -> DataFrame:
    path = place(t, "dyes")
    sinks.dye_sequences(dg.flustring_catalog(_flus(t)), path)
    return in_file_order(t.spark.read.text(path), "line").select("line", "value")


# Runs ----------------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT '0' || (n_regionkey + 1) || '-02-2025_03-04-05' AS run, n_nationkey // 5 + 1 AS epoch, avg(n_nationkey / 32.0::DOUBLE) AS mean, CASE WHEN n_regionkey = 0 THEN NULL ELSE avg(n_nationkey / 64.0::DOUBLE) END AS std FROM nation GROUP BY n_regionkey, n_nationkey // 5)"


def _runs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A run folder for each region, with the errors and the settings of that run."""
    root = place(t, "runs")
    n = t.read("nation").withColumns({"run": F.concat(F.lit("0"), F.col("n_regionkey") + 1, F.lit("-02-2025_03-04-05")), "epoch": (F.floor(F.col("n_nationkey") / 5) + 1).cast("int")})
    rows = n.groupBy("run", "n_regionkey", "epoch").agg(F.avg(F.col("n_nationkey") / 32).alias("mean"), F.avg(F.col("n_nationkey") / 64).alias("std"))
    rows = rows.withColumn("std", F.when(F.col("n_regionkey") != 0, F.col("std")))
    for r in t.read("region").collect():  # a few folders
        run = f"0{r['r_regionkey'] + 1}-02-2025_03-04-05"
        sinks.errors_csv(rows.filter(F.col("run") == run), f"{root}/{run}/ErrVsEpochs.csv")
        sinks.config_text(t.spark, {"Oracle error": (r["r_regionkey"] + 1) / 20, "Name": r["r_name"]}, f"{root}/{run}/RunConfig.txt")
    return readers.run_errors(t.spark, root), readers.run_configs(t.spark, root)


@query(f"WITH {_RUNS} SELECT run, epoch::INTEGER AS epoch, round(mean, 9) AS mean, round(std, 9) AS std FROM runs")
def run_errors_round_trip(t: Tables) -> DataFrame:
    return _runs(t)[0].select("run", "epoch", r9("mean").alias("mean"), r9("std").alias("std"))


@query("SELECT '0' || (r_regionkey + 1) || '-02-2025_03-04-05' AS run, r_name AS value FROM region")
def run_config_value(t: Tables) -> DataFrame:
    return readers.config_value(_runs(t)[1], "Name")


@query(f"WITH {_RUNS} SELECT run, round((substr(run, 2, 1)::DOUBLE) / 20, 9) AS setting, max(epoch)::INTEGER AS epochs, round(arg_max(mean, epoch), 9) AS mean FROM runs GROUP BY run")
def runs_by_setting(t: Tables) -> DataFrame:
    return readers.runs_by(*_runs(t), "Oracle error").select("run", r9("setting").alias("setting"), "epochs", r9("mean").alias("mean"))


# Datasets ------------------------------------------------------------------------------------------------------

_SCORES = with_cte("scores")


@query(with_cte("scores", "emission", "truth") + "\nSELECT (SELECT count(*) FROM emission) AS emission, (SELECT round(sum(p), 6) FROM emission) AS p, (SELECT count(*) FROM scores) AS scores, (SELECT round(sum(s), 6) FROM scores) AS s, (SELECT count(*) FROM truth) * 2 AS truths")
def dataset_round_trip(t: Tables) -> DataFrame:
    path = place(t, "dataset")
    truth = t.truth().withColumn("cv", F.explode(F.array(F.lit(0), F.lit(1))))
    sinks.dataset(path, emission=t.emission(), scores=t.scores(), cv_truth=truth)
    d = readers.dataset(t.spark, path)
    n = F.count(F.lit(1))
    one = d["emission"].agg(n.alias("emission"), F.round(F.sum("p"), 6).alias("p")).crossJoin(d["scores"].agg(n.alias("scores"), F.round(F.sum("s"), 6).alias("s")))
    return one.crossJoin(d["cv_truth"].agg(n.alias("truths")))  # three rows of one


@query(SQL["em_cv_errors"])
def run_of_a_dataset(t: Tables) -> DataFrame:
    """The whole run: a dataset in a folder, fitted by fold, and its errors as they are read back from the run's folder."""
    path, out = place(t, "dataset"), place(t, "runs")
    truth = t.truth().withColumn("cv", F.explode(F.sequence(F.lit(0), F.lit(N_FOLDS - 1))))
    sinks.dataset(path, emission=t.emission(), scores=t.scores(), cv_reads=_subset(t), cv_truth=truth)
    run(t.spark, path, out, Settings(FOLD_EPOCHS))
    return readers.run_errors(t.spark, out).select("epoch", r9("mean").alias("mean"), r9("std").alias("std"))


def _run_with(t: Tables, settings: Settings) -> DataFrame:
    """Errors of a run over a dataset of one fold, all reads, as they are read back from its folder."""
    path, out = place(t, "dataset"), place(t, "runs")
    every = t.labels().select(F.lit(0).alias("cv"), "read_id")
    sinks.dataset(path, emission=t.emission(), scores=t.scores(), reads=t.labels(), cv_reads=every, cv_truth=t.truth().withColumn("cv", F.lit(0)))
    run(t.spark, path, out, settings)
    return readers.run_errors(t.spark, out).select("epoch", F.round("mean", 7).alias("mean"))  # ten digits are written


_RUN_PY = " UNION ALL ".join(f"SELECT epoch, round(mae, 7) AS mean FROM ({_AFTER.format(e=e, cv=0, pi=f'pi{e}')})" for e in (1, 2))


@query(with_cte("labels", "nf", "prior", "truth") + f",\n{_ORACLE_EM},\n" + em_sql(2, rows="om") + "\n" + _RUN_PY)
def run_with_an_oracle(t: Tables) -> DataFrame:
    return _run_with(t, Settings(2, oracle_error=ERROR))


@query(with_cte("em", "prior", "weights", "truth") + f",\n{_PI_OF_TRUTH},\n" + em_sql(2) + "\n" + " UNION ALL ".join(f"SELECT {e}::INTEGER AS epoch, round(avg(abs(x.pi - pit.pi)), 7) AS mean FROM pi{e} x JOIN pit ON pit.protein_id = x.protein_id" for e in (1, 2)))
def run_with_errors_of_shares(t: Tables) -> DataFrame:
    return _run_with(t, Settings(2, error="PI"))


@query(with_cte("em", "prior", "truth") + """,
chosen AS (SELECT read_id FROM (SELECT DISTINCT l_orderkey AS read_id FROM lineitem) ORDER BY md5('subset-0-' || read_id || '-1') LIMIT 3000),
sm AS (SELECT em.* FROM em JOIN chosen ON chosen.read_id = em.read_id),
""" + em_sql(2, rows="sm") + "\n" + _RUN_PY)
def run_with_a_subset(t: Tables) -> DataFrame:
    return _run_with(t, Settings(2, subset=3000))


@query(with_cte("truth") + "\nSELECT cv::INTEGER AS cv, protein_id, round(p_y, 9) AS p_y FROM truth, (SELECT unnest([0, 1, 2]) AS cv)")
def estimates_round_trip(t: Tables) -> DataFrame:
    path = place(t, "estimates")
    sinks.estimates(t.truth().withColumn("cv", F.explode(F.array(*map(F.lit, range(3))))), path)
    return readers.estimates_of_folds(t.spark, path).select("cv", "protein_id", r9("p_y").alias("p_y"))


@query("SELECT o_orderpriority AS setting, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def sweep_archive_round_trip(t: Tables) -> DataFrame:
    path = place(t, "sweep")
    sinks.sweep(t.read("orders").select(F.col("o_orderpriority").alias("setting"), "o_totalprice"), path, "setting")
    return readers.sweep(t.spark, path).groupBy("setting").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_TOP = "r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY s DESC, flu_id) AS k FROM scores)"


def _shards(t: Tables, cap: int | None = None) -> str:
    path = place(t, "shards")
    e = F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("neg"), "flu_id")))
    rows = t.scores().groupBy("read_id").agg(e.alias("e")).select("read_id", F.transform("e", lambda x: -x["neg"]).alias("scores"), F.transform("e", lambda x: x["flu_id"]).alias("flu_ids"))
    if cap:
        sinks.capped_scores(rows, path, cap)
    else:
        rows.write.parquet(f"{path}/a")
    return path


@query(_SCORES + f",\n{_TOP}\nSELECT read_id, flu_id, round(s, 9) AS s FROM r WHERE k <= 2")
def score_shards_scan(t: Tables) -> DataFrame:
    return readers.shards(t.spark, _shards(t), 2).select("read_id", "flu_id", r9("s").alias("s"))


@query(_SCORES + f",\n{_TOP}\nSELECT read_id, flu_id, round(s, 9) AS s FROM r WHERE k <= 3")
def capped_scores_round_trip(t: Tables) -> DataFrame:
    return readers.shards(t.spark, _shards(t, 3)).select("read_id", "flu_id", r9("s").alias("s"))


@query(with_cte("dense") + "\nSELECT read_id, flu_id, round(s, 9) AS s FROM dense WHERE read_id < 100")
def dense_scores_of_first_reads(t: Tables) -> DataFrame:
    rows = t.dense().groupBy("read_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("flu_id", "s"))), lambda x: x["s"]).alias("a"))
    return readers.dense_scores(rows, "read_id", F.col("a"), 100).select("read_id", "flu_id", r9("s").alias("s"))


@query(with_cte("labels") + ",\nb AS (SELECT o_orderkey AS read_id, o_custkey % 7 - 1 AS g FROM orders)\nSELECT read_id FROM b WHERE g < 0")
def unassigned_reads(t: Tables) -> DataFrame:
    rows = t.read("orders").select(F.when(F.col("o_custkey") % 7 == 0, -1).otherwise(F.col("o_orderkey")).alias("read_id"), F.col("o_orderkey").alias("of"))
    return validate.unassigned(rows).select(F.col("of").alias("read_id"))


# Synthetic sets and dense forms --------------------------------------------------------------------------------


@query("SELECT range AS read_id, (range // 40)::INTEGER AS true_flu FROM range(20000)")
def label_table(t: Tables) -> DataFrame:
    return scores.label_table(t.spark, 500, 40)


@query(with_cte("labels") + "\nSELECT read_id, true_flu AS flu_id, 0.99::DOUBLE AS s, 0.0::DOUBLE AS r FROM labels_")
def oracle_sure(t: Tables) -> DataFrame:
    return scores.sure_oracle(t.labels())


def _u(kind: str) -> str:
    return f"('0x' || substr(md5('random-{kind}-' || read_id || '-' || flu_id), 1, 13))::BIGINT::DOUBLE / pow(2, 52)"


@query(f"SELECT read_id, flu_id::INTEGER AS flu_id, round({_u('value')}, 12) AS s FROM (SELECT range AS read_id FROM range(300)), (SELECT range AS flu_id FROM range(200)) WHERE {_u('there')} < 0.05::DOUBLE")
def random_scores(t: Tables) -> DataFrame:
    return scores.random_scores(t.spark, 300, 200, 0.05).select("read_id", "flu_id", F.round("s", 12).alias("s"))


@query("SELECT l_orderkey AS read_id, list_transform(range(0, 7), lambda k: coalesce(list_sum(list_filter(list(struct_pack(n := l_linenumber, q := l_quantity)), lambda x: x.n - 1 = k).apply(lambda x: x.q)), 0.0)::DOUBLE) AS scores FROM lineitem GROUP BY l_orderkey")
def densified_scores(t: Tables) -> DataFrame:
    rows = t.read("lineitem").select(F.col("l_orderkey").alias("read_id"), (F.col("l_linenumber") - 1).alias("flu_id"), F.col("l_quantity").alias("s"))
    return scores.densified(rows, 7)


@query(with_cte("scores") + "\nSELECT round(max(s), 9) AS max_score, max(flu_id) AS max_flu, 0::BIGINT AS not_finite FROM scores")
def score_extremes(t: Tables) -> DataFrame:
    return validate.extremes(t.scores()).select(r9("max_score").alias("max_score"), "max_flu", "not_finite")


_FIXED = "CASE WHEN y < 9.995 THEN printf('%.2f', y) WHEN y < 99.95 THEN printf('%.1f', y) ELSE printf('%.0f', y) END"


@query(f"SELECT o_orderkey, CASE WHEN unit = '' THEN x::VARCHAR WHEN contains(f, '.') THEN rtrim(rtrim(f, '0'), '.') || unit ELSE f || unit END AS text FROM (SELECT o_orderkey, x, unit, {_FIXED} AS f FROM (SELECT o_orderkey, x, CASE WHEN x >= 1e9 THEN x / 1e9 WHEN x >= 1e6 THEN x / 1e6 WHEN x >= 1e3 THEN x / 1e3 ELSE x END AS y, CASE WHEN x >= 1e9 THEN 'B' WHEN x >= 1e6 THEN 'M' WHEN x >= 1e3 THEN 'K' ELSE '' END AS unit FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 7 THEN o_orderkey % 1000 + 0.125 ELSE floor(o_totalprice) * power(10, o_orderkey % 7) + 0.137 END AS x FROM orders)))")
def three_digit_notation(t: Tables) -> DataFrame:
    return t.read("orders").select("o_orderkey", three_digits(F.when(F.col("o_orderkey") % 8 == 7, F.col("o_orderkey") % 1000 + 0.125).otherwise(F.floor("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 7) + 0.137)).alias("text"))


@query(with_cte("emission") + "\nSELECT protein_id, count(*) AS n_flu FROM emission WHERE p <> 0 GROUP BY protein_id")
def ragged_sizes(t: Tables) -> DataFrame:
    return emi.ragged(t.emission()).select("protein_id", F.size("entries").cast("long").alias("n_flu"))


# Flat binary files ---------------------------------------------------------------------------------------------

#: Proteins and reads by their position in the order of their ids.
_PLACES = "pl AS (SELECT protein_id, (row_number() OVER (ORDER BY protein_id) - 1)::INTEGER AS protein FROM (SELECT DISTINCT protein_id FROM emission)),\nrl AS (SELECT read_id, row_number() OVER (ORDER BY read_id) - 1 AS read FROM (SELECT DISTINCT l_orderkey AS read_id FROM lineitem))"


def _placed(rows: DataFrame, of: DataFrame, key: str) -> DataFrame:
    """rows with `key` as its position among the keys of `of`."""
    places = numbered(of.select(key).distinct(), [key], "place")
    return rows.join(places, key).drop(key).withColumnRenamed("place", key)


@query(with_cte("emission") + f",\n{_PLACES}\nSELECT protein AS protein_id, flu_id, round(p::FLOAT::DOUBLE, 6) AS p FROM emission JOIN pl USING (protein_id)")
def emission_binary_round_trip(t: Tables) -> DataFrame:
    """Four arrays: entries of each protein, their flus and probabilities in a row, and the weights."""
    path = place(t, "flat")
    interchange.write_emission(_placed(t.emission(), t.emission(), "protein_id"), _placed(t.weights(), t.emission(), "protein_id"), path)
    return interchange.read_emission(t.spark, path)[0].select("protein_id", "flu_id", F.round("p", 6).alias("p"))


@query(with_cte("emission", "weights") + f",\n{_PLACES}\nSELECT protein AS protein_id, round(exp_n::FLOAT::DOUBLE, 4) AS exp_n FROM weights JOIN pl USING (protein_id)")
def weights_binary_round_trip(t: Tables) -> DataFrame:
    path = place(t, "flat")
    interchange.write_emission(_placed(t.emission(), t.emission(), "protein_id"), _placed(t.weights(), t.emission(), "protein_id"), path)
    return interchange.read_emission(t.spark, path)[1].select("protein_id", F.round("exp_n", 4).alias("exp_n"))


def _flat_scores(t: Tables, n: int) -> str:
    path = place(t, "flat")
    interchange.write_scores(_placed(t.scores(), t.scores(), "read_id"), n, path)
    return path


_FLAT_TOP = with_cte("emission", "scores") + f",\n{_PLACES},\n{_TOP}\nSELECT read AS read_id, flu_id, round(s::FLOAT::DOUBLE, 6) AS s FROM r JOIN rl USING (read_id) WHERE k <= 4"


@query(_FLAT_TOP)
def scores_binary_round_trip(t: Tables) -> DataFrame:
    """Two arrays side by side, four entries a read; reads with fewer are filled up with 0, which is left out again."""
    return interchange.read_scores(t.spark, _flat_scores(t, 4)).select("read_id", "flu_id", F.round("s", 6).alias("s"))


@query(_FLAT_TOP + " AND read < 100")
def scores_binary_of_first_reads(t: Tables) -> DataFrame:
    """Only the bytes of the first 100 reads are read."""
    return interchange.read_scores(t.spark, _flat_scores(t, 4), 100).select("read_id", "flu_id", F.round("s", 6).alias("s"))


@query(with_cte("emission", "labels") + f",\n{_PLACES}\nSELECT read AS read_id, true_flu FROM labels_ JOIN rl USING (read_id)")
def labels_binary_round_trip(t: Tables) -> DataFrame:
    path = place(t, "flat")
    interchange.write_labels(_placed(t.labels(), t.labels(), "read_id"), path)
    return interchange.read_labels(t.spark, path)


@query("SELECT (l_linenumber - 1)::INTEGER AS cv, l_partkey AS read_id, count(*) AS m FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL")
def folds_binary_round_trip(t: Tables) -> DataFrame:
    """Three folds, a file each: ids in order, each as often as it was drawn."""
    path = place(t, "flat")
    drawn = t.read("lineitem").filter("l_linenumber <= 3").groupBy((F.col("l_linenumber") - 1).cast("int").alias("cv"), F.col("l_partkey").alias("read_id")).agg(F.count(F.lit(1)).alias("m"))
    truth = _placed(t.truth(), t.truth(), "protein_id").withColumn("cv", F.explode(F.array(*map(F.lit, range(3)))))
    interchange.write_folds(drawn, truth, path)
    return interchange.read_folds(t.spark, path, 3)[0]


@query(with_cte("truth") + ",\npl AS (SELECT protein_id, (row_number() OVER (ORDER BY protein_id) - 1)::INTEGER AS protein FROM truth)\nSELECT cv::INTEGER AS cv, protein AS protein_id, round((p_y * (cv + 1))::FLOAT::DOUBLE, 7) AS p_y FROM truth JOIN pl USING (protein_id), (SELECT unnest([0, 1, 2]) AS cv)")
def estimates_binary_round_trip(t: Tables) -> DataFrame:
    path, p = place(t, "flat"), _placed(t.truth(), t.truth(), "protein_id")
    n = p.count()
    interchange.write_estimates(p.withColumn("cv", F.explode(F.array(*map(F.lit, range(3))))).withColumn("p_y", F.col("p_y") * (F.col("cv") + 1)), n, path)
    return interchange.read_estimates(t.spark, f"{path}/{interchange.ESTIMATES[0]}", n).select("cv", "protein_id", F.round("p_y", 7).alias("p_y"))


@query(with_cte("labels", "nf") + "\nSELECT read_id, least(floor(('0x' || substr(md5('oracle-' || read_id), 1, 13))::BIGINT::DOUBLE / pow(2, 52) * f), f - 1)::INTEGER AS flu_id, 0.99::DOUBLE AS s, 0.0::DOUBLE AS r FROM labels_, nf")
def oracle_random(t: Tables) -> DataFrame:
    """One sure score for each read, on a flu drawn at random."""
    return scores.random_oracle(t.labels(), t.n_flu())


@query("SELECT s_suppkey::INTEGER AS number, s_name AS description FROM supplier")
def fixture_csv_without_header(t: Tables) -> DataFrame:
    path = place(t, "fixture")
    sinks.descriptions_csv(t.read("supplier").select("s_suppkey", "s_name"), path, header=False)
    return t.spark.read.schema("number int, description string").csv(path)
