"""Readers. Paths may be anything that Spark reads; schemas are explicit."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbering import in_file_order, numbered
from ..functions.sequence import gene_token
from .flatfile import PART_BYTES, read_flat
from .flatfile import Column as FlatColumn

EXPERIMENT = "`Peptide Id` int, `Peptide String` string, `Original Protein Id` int, `Flustring Id` int, `Flustring` string"
SIMULATION = "flu_i int, pro_i int, n_dyes_all_ch int"
CONFIG_KEY = r"^([^:]+):\s*(.*)$"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """protein_id (from 0, in file order), header, gene, sequence. Nothing is cut off, with or without a final newline; blank lines are skipped."""
    raw = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = raw.withColumn("value", F.regexp_replace("value", r"^\s*>|\r", "")).filter("trim(value) <> ''")
    parts = F.split("value", "\n", 2)
    out = rows.select("file", "at", F.get(parts, F.lit(0)).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("sequence"))
    out = numbered(out, ["file", "at"], "protein_id")
    return out.select(F.col("protein_id").cast("int").alias("protein_id"), "header", gene_token(F.col("header")).alias("gene"), "sequence")


def sample_proteins(proteins: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """n proteins without replacement: those first by md5(seed-id)."""
    return proteins.orderBy(F.md5(F.concat_ws("-", F.lit(seed), F.col("protein_id").cast("string")).cast("binary")), "protein_id").limit(n)


def proteins_of_genes(proteins: DataFrame, genes: list[str]) -> DataFrame:
    """Records of these genes, numbered anew from 0."""
    return numbered(proteins.filter(F.col("gene").isin(list(genes))), ["protein_id"], "new_id").select(F.col("new_id").cast("int").alias("protein_id"), "header", "gene", "sequence")


def without_ordinals(proteins: DataFrame, gone: DataFrame) -> DataFrame:
    """Headers whose ordinal is not in `gone` (protein_id), numbered anew from 0."""
    return numbered(proteins.join(gone, "protein_id", "left_anti"), ["protein_id"], "new_id").select(F.col("new_id").cast("int").alias("index"), F.col("header").alias("description"))


def experiment_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(EXPERIMENT).csv(path, header=True)
    return raw.toDF("peptide_id", "peptide", "protein_id", "flu_id", "flustring").fillna("", ["flustring"])


def simulation_csv(spark: SparkSession, path: str) -> DataFrame:
    """protein_id, flu_id from 0, n_dyes; rows of the null protein or the null flustring (0 in the file) are left out."""
    raw = spark.read.schema(SIMULATION).csv(path, header=True).filter("pro_i > 0 and flu_i > 0")
    return raw.select((F.col("pro_i") - 1).alias("protein_id"), (F.col("flu_i") - 1).alias("flu_id"), F.col("n_dyes_all_ch").alias("n_dyes"))


def numbers_csv(spark: SparkSession, path: str, kind: str = "double") -> DataFrame:
    """at, value: one column without header, in file order; of a folder of files in order of their names."""
    return in_file_order(spark.read.schema(f"value {kind}").csv(path), "at").select("at", "value")


def emission_csv(spark: SparkSession, counts: str, flus: str, ps: str) -> DataFrame:
    """protein_id, flu_id, p from three columns of numbers: entries of each protein, and all ids and probabilities in a row."""
    ends = numbered(numbers_csv(spark, counts, "int").withColumnRenamed("at", "protein_id").filter("value > 0"), ["protein_id"], "_i", F.col("value"), "start")
    at = ends.select(F.col("protein_id").cast("int").alias("protein_id"), F.explode(F.sequence(F.col("start").cast("long"), F.col("start").cast("long") + F.col("value") - 1)).alias("at"))
    both = numbers_csv(spark, flus, "int").withColumnRenamed("value", "flu_id").join(numbers_csv(spark, ps).withColumnRenamed("value", "p").hint("merge"), "at")
    # Spark takes `at` for as small as the table that it is exploded from, and would broadcast it.
    return at.join(both.hint("merge"), "at").select("protein_id", "flu_id", "p")


def flat_binary(spark: SparkSession, path: str, dtype: str, width: int = 1, rows: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """row, values (array of `width`) of a file of fixed-size little-endian numbers ('f4', 'f8', 'u4', 'i4', 'i8'); of the first `rows` rows, if given. Any number of tasks reads one file."""
    return read_flat(spark, [FlatColumn("values", path, dtype, width)], rows, part_bytes)


def scores_binary(spark: SparkSession, scores: str, ids: str, n: int, rows: int | None = None) -> DataFrame:
    """read_id, flu_id, s of two parallel files with n entries a read, read side by side."""
    both = read_flat(spark, [FlatColumn("s", scores, "f4", n), FlatColumn("flu_id", ids, "u4", n)], rows)
    flat = both.select(F.col("row").alias("read_id"), F.inline(F.arrays_zip("flu_id", "s")))
    return flat.select("read_id", F.col("flu_id").cast("int").alias("flu_id"), F.col("s").cast("double").alias("s"))


def dense_scores(rows: DataFrame, read_id: str, values: Column, first: int | None = None) -> DataFrame:
    """read_id, flu_id, s of an array column; `first` keeps only reads below that number."""
    rows = rows if first is None else rows.filter(F.col(read_id) < first)
    return rows.select(F.col(read_id).alias("read_id"), F.posexplode(values).alias("flu_id", "s"))


def shards(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """All score shards (Parquet) under a folder: read_id, scores and ids in descending order of score; of each the first n."""
    rows = spark.read.schema("read_id long, scores array<double>, flu_ids array<int>").option("recursiveFileLookup", "true").parquet(path)
    cut = (lambda c: F.slice(c, 1, n)) if n else F.col
    return rows.select("read_id", F.inline(F.arrays_zip(cut("flu_ids").alias("flu_id"), cut("scores").alias("s"))))


def dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dataset folder that are there, by name; entries of the emission that are 0 raise a warning and are left out."""
    out = {}
    for name in ("emission", "protein", "reads", "scores", "cv_reads", "cv_truth"):
        try:
            out[name] = spark.read.parquet(f"{path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    if "emission" in out and not (zero := out["emission"].filter("p = 0")).isEmpty():
        warnings.warn(f"{zero.count()} entries of the emission are 0", stacklevel=2)
        out["emission"] = out["emission"].filter("p <> 0")
    return out


def estimates_of_folds(spark: SparkSession, path: str) -> DataFrame:
    """cv, protein_id, p_y as written by `sinks.estimates`."""
    return spark.read.parquet(path).select("cv", "protein_id", "p_y")


def sweep(spark: SparkSession, path: str) -> DataFrame:
    """A sweep as written by `sinks.sweep`, with its setting as a column."""
    return spark.read.parquet(path)


def tsv_rows(spark: SparkSession, path: str, header_rows: int) -> DataFrame:
    """row (from 0, after the header), values (array<double>) of a tab-separated file, or of one in parts, in order of their names."""
    n = in_file_order(spark.read.text(path), "row").filter(F.col("row") >= header_rows)
    return n.select((F.col("row") - header_rows).alias("row"), F.transform(F.split("value", "\t"), lambda x: x.cast("double")).alias("values"))


def radiometries(spark: SparkSession, signal: str, true_ids: str) -> DataFrame:
    """read_id, true_flu, signal: two files side by side, line by line."""
    s, t = tsv_rows(spark, signal, 3), tsv_rows(spark, true_ids, 1)
    return s.select("row", F.col("values").alias("signal")).join(t.select("row", F.get("values", F.lit(0)).cast("int").alias("true_flu")).hint("merge"), "row").select(F.col("row").alias("read_id"), "true_flu", "signal")


def _run(path: Column) -> Column:
    """The run folder of a file, which may be a folder of parts itself."""
    return F.regexp_extract(path, r"([^/]+)/(?:ErrVsEpochs\.csv|RunConfig\.txt)(?:/[^/]+)?$", 1)


def run_errors(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, mean, std of every ErrVsEpochs.csv in folders below `path` whose name begins with a digit; '-nan' is null."""
    raw = spark.read.schema("epoch int, mean double, std string").csv(f"{path}/*/ErrVsEpochs.csv", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.withColumn("run", _run(F.col("_metadata.file_path"))).filter(F.col("run").rlike(r"^\d"))
    std = F.expr("try_cast(std as double)")
    return named.select("run", "epoch", "mean", F.when(F.isnan(std), None).otherwise(std).alias("std"))


def run_configs(spark: SparkSession, path: str) -> DataFrame:
    """run, key, value of every RunConfig.txt in folders below `path` whose name begins with a digit."""
    raw = spark.read.text(f"{path}/*/RunConfig.txt").withColumn("run", _run(F.col("_metadata.file_path"))).filter(F.col("run").rlike(r"^\d"))
    return raw.filter(F.col("value").rlike(CONFIG_KEY)).select("run", F.trim(F.regexp_extract("value", CONFIG_KEY, 1)).alias("key"), F.trim(F.regexp_extract("value", CONFIG_KEY, 2)).alias("value"))


def config_value(configs: DataFrame, key: str) -> DataFrame:
    """run, value: null where a run does not state the key."""
    runs = configs.select("run").distinct()
    return runs.join(configs.filter(F.col("key") == key).select("run", "value"), "run", "left")


def runs_by(errors: DataFrame, configs: DataFrame, key: str) -> DataFrame:
    """Runs with a numeric setting, their last error and deviation, in order of the setting."""
    last = errors.groupBy("run").agg(F.max_by(F.struct("mean", "std"), "epoch").alias("e"), F.max("epoch").alias("epochs"))
    number = F.expr(r"try_cast(regexp_extract(value, '[-+0-9.eE]+', 0) as double)")
    return last.join(config_value(configs, key), "run").select("run", number.alias("setting"), "epochs", F.col("e.mean").alias("mean"), (F.col("e.std") / 2).alias("half_std")).orderBy("setting", "run")


def run_time(run: Column) -> Column:
    return F.try_to_timestamp(run, F.lit("dd-MM-yyyy_HH-mm-ss"))


def estimates(spark: SparkSession, path: str, n_prot: int) -> DataFrame:
    """cv, protein_id, p_y of a flat float32 file with a row for each fold."""
    return flat_binary(spark, path, "f4", n_prot).select(F.col("row").cast("int").alias("cv"), F.posexplode("values").alias("protein_id", "p_y"))


def rank_by(df: DataFrame, column: str) -> DataFrame:
    """df with rank: 1, 2 ... in the order of a column."""
    return numbered(df, [column], "_at").withColumn("rank", (F.col("_at") + 1).cast("int")).drop("_at")
