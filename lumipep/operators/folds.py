"""Cross-validation folds: true abundances, weighted samples of reads, subsets.

Everything is drawn from hashes of (seed, fold, id), so folds can be made again and no task depends on another."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import numbered
from ..functions.scratch import written
from .emission import flu_distribution, to_read_share


def hashed(*parts) -> Column:
    """Uniform in [0, 1), from 52 bits of the md5 of the parts joined by '-'."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def random_abundances(proteins: DataFrame, n_folds: int, seed: str = "abundance") -> DataFrame:
    """cv, protein_id, p_y: uniform over the simplex, as normalised exponential draws."""
    # Ids are dealt to tasks first: a file of them is short, but their draws are many.
    ids = proteins.select("protein_id").repartition(int(proteins.sparkSession.conf.get("spark.sql.shuffle.partitions")), "protein_id")
    rows = ids.withColumn("cv", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn("x", -F.log(1 - hashed(F.lit(seed), F.col("cv"), F.col("protein_id"))))
    # The sums, a row a fold, go to the draws, which are made again and not moved.
    total = F.broadcast(rows.groupBy("cv").agg(F.sum("x").alias("total")))
    return rows.join(total, "cv").select("cv", "protein_id", (F.col("x") / F.col("total")).alias("p_y"))


def sampled_labels(flu_p: DataFrame, n: int, cv: int, seed: str = "label") -> DataFrame:
    """draw, true_flu: n draws from flu_p (flu_id, p), by inversion of its running sums.

    Draws and running sums meet in equal-width buckets of [0, 1), so this is an equi-join, not a range join."""
    spark = flu_p.sparkSession
    runs = numbered(flu_p, ["flu_id"], "_i", F.col("p"), "lo").withColumn("hi", F.col("lo") + F.col("p"))
    buckets = 1024
    at = lambda x: F.least(F.floor(x * buckets), F.lit(buckets - 1)).cast("int")
    spans = runs.withColumn("b", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    draws = spark.range(n).select(F.col("id").alias("draw"), hashed(F.lit(seed), F.lit(cv), F.col("id")).alias("x")).withColumn("b", at(F.col("x")))
    hit = draws.join(spans, "b").filter("x >= lo and x < hi").select("draw", F.col("flu_id").alias("true_flu"))
    # Rounding can leave the running sum just below 1: such a draw takes the last flu.
    last = runs.agg(F.max_by("flu_id", "lo").alias("last"))
    return draws.select("draw").join(hit, "draw", "left").crossJoin(F.broadcast(last)).select("draw", F.coalesce("true_flu", "last").alias("true_flu"))


def sampled_reads(draws: DataFrame, reads: DataFrame, cv: int, seed: str = "read") -> DataFrame:
    """cv, read_id, m: for each drawn label one of its reads, with replacement; repeats become a multiplicity."""
    nth = reads.withColumn("nth", F.row_number().over(Window.partitionBy("true_flu").orderBy("read_id")) - 1)
    size = reads.groupBy("true_flu").agg(F.count(F.lit(1)).alias("size"))
    want = draws.join(size, "true_flu").withColumn("nth", F.floor(hashed(F.lit(seed), F.lit(cv), F.col("draw")) * F.col("size")).cast("int"))
    return want.join(nth, ["true_flu", "nth"]).groupBy("read_id").agg(F.count(F.lit(1)).alias("m")).select(F.lit(cv).alias("cv"), "read_id", "m")


#: Leaves, on an average, of a node among which draws are dealt at once.
CHILDREN = 256


def drawn_counts(leaves: DataFrame, totals: DataFrame, by: list[str], n_col: str, mass: str, seed: str, runs: list[str] | None = None) -> DataFrame:
    """by, runs, id, m: how often each leaf is drawn when each group's draws fall to its leaves in proportion to their mass.

    leaves: by, id, mass; totals: by, runs, n_col, where `runs` tell apart draws from the same leaves. Draws are never
    made one by one. A group of up to CHILDREN leaves deals its number to them by a multinomial whose generator is
    seeded with the group; a larger one deals it to buckets of its ids first, which are drawn the same way. So the
    counts are the same however rows lie, those of a group add up to its number, and a leaf is moved once for its bucket.
    """
    runs = runs or []
    leaves = leaves.select(*by, F.col("id").cast("long").alias("id"), F.col(mass).cast("double").alias("mass")).filter("mass > 0")
    held = totals.select(*by, *runs, F.col(n_col).cast("long").alias("m")).filter("m > 0")
    sizes = leaves.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= CHILDREN:
        return _dealt(leaves, held, by, runs, seed)
    many = sizes.filter(F.col("size") > CHILDREN)
    met = leaves.join(many, by, "left") if by else leaves.crossJoin(F.broadcast(many))
    place = F.pmod(F.xxhash64("id"), F.ceil(F.coalesce("size", F.lit(1)) / CHILDREN))
    placed = written(met.select(*by, place.alias("_bucket"), "id", "mass"), "leaves")
    buckets = placed.groupBy(*by, F.col("_bucket").alias("id")).agg(F.sum("mass").alias("mass"))
    among = drawn_counts(buckets, held, by, "m", "mass", f"{seed}-of", runs).withColumnRenamed("id", "_bucket")
    return _dealt(placed, among, [*by, "_bucket"], runs, seed).drop("_bucket")


def _dealt(leaves: DataFrame, totals: DataFrame, by: list[str], runs: list[str], seed: str) -> DataFrame:
    """One level of `drawn_counts`: a group is one row, in which its leaves stand in order."""
    pair = F.sort_array(F.collect_list(F.struct("id", "mass")))
    groups = leaves.groupBy(*by).agg(pair.alias("x")).select(*by, F.col("x.id").alias("ids"), F.col("x.mass").alias("mass"))
    keys = [*by, *runs]
    met = (totals.join(groups, by) if by else totals.crossJoin(groups)).select(*keys, "m", "ids", "mass")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, mass = b.columns[-2:]
            size, n, p = pc.list_value_length(ids).to_numpy(), b.column(len(keys)).to_numpy(), mass.flatten().to_numpy()
            drawn, names, at = np.zeros(len(p), np.int64), zip(*[c.to_pylist() for c in b.columns[: len(keys)]], strict=True) if keys else [()], 0
            for name, k, m in zip(names, size, n, strict=True):
                rng = np.random.default_rng(int.from_bytes(hashlib.md5("-".join(map(str, [seed, *name])).encode()).digest(), "little"))
                drawn[at : at + k] = rng.multinomial(m, p[at : at + k] / p[at : at + k].sum())
                at += k
            some = pa.array(np.flatnonzero(drawn))
            row = pa.array(np.repeat(np.arange(len(size)), size)).take(some)
            yield pa.RecordBatch.from_arrays([*[c.take(row) for c in b.columns[: len(keys)]], ids.flatten().take(some), pa.array(drawn).take(some)], [*keys, "id", "m"])

    kinds = "".join(f"{c} {met.schema[c].dataType.simpleString()}, " for c in keys)
    return written(met.mapInArrow(dealt, f"{kinds}id long, m long"), "dealt")


def sampled_folds(flu_p: DataFrame, reads: DataFrame, n: int, seed: str = "fold") -> DataFrame:
    """cv, read_id, m: for each fold n reads with replacement, the flu of each by flu_p (cv, flu_id, p) and then one of the flu's reads. Flus without a read are not drawn. Counts throughout: the work does not grow with n."""
    some = flu_p.join(reads.select(F.col("true_flu").alias("flu_id")).distinct(), "flu_id", "left_semi")
    some = written(some.select("cv", F.col("flu_id").cast("long").alias("id"), "p"), "flus")
    total = some.select("cv").distinct().withColumn("n", F.lit(n).cast("long"))
    flus = drawn_counts(some, total, ["cv"], "n", "p", f"{seed}-flu").select("cv", F.col("id").alias("flu"), "m")
    leaves = reads.select(F.col("true_flu").cast("long").alias("flu"), F.col("read_id").alias("id"), F.lit(1.0).alias("one"))
    return drawn_counts(leaves, flus, ["flu"], "m", "one", f"{seed}-read", ["cv"]).select("cv", F.col("id").alias("read_id"), "m")


def sampled_counts(flu_p: DataFrame, reads: DataFrame, n: int, cv: int, seed: str = "fold") -> DataFrame:
    """cv, read_id, m of one fold. flu_p: flu_id, p."""
    return sampled_folds(flu_p.withColumn("cv", F.lit(cv)), reads, n, seed)


def weighted_folds(emission: DataFrame, weights: DataFrame, reads: DataFrame, n: int, n_folds: int, seed: str = "abundance") -> tuple[DataFrame, DataFrame]:
    """cv_reads (cv, read_id, m) and cv_truth (cv, protein_id, p_y) of a whole cross-validation: random abundances, and n reads of a sample with them, for each fold. reads are read three times: a table."""
    truth = written(random_abundances(weights, n_folds, seed), "truth")
    flus = flu_distribution(emission, to_read_share(truth, weights, ["cv"]), ["cv"])
    return sampled_folds(flus, reads, n), truth


#: Hexadecimal digits of a hash by which rows are counted at a time.
DIGITS = 4


def first_by_hash(rows: DataFrame, n: int) -> DataFrame:
    """Of each cv the n rows first by h (hexadecimal text), all if there are fewer; of rows with the same h any.

    The n-th hash of a fold is found from counts by the next DIGITS digits below the digits already known, one short
    table a level; no fold is sorted or ranked. What is collected is one row a fold.
    """
    spark, length = rows.sparkSession, 0
    at = spark.createDataFrame([(r["cv"], "", n) for r in rows.select("cv").distinct().collect()], "cv int, prefix string, need long")
    while True:
        here = rows.join(F.broadcast(at), "cv").filter(F.substring("h", 1, length) == F.col("prefix")) if length else rows.join(F.broadcast(at), "cv")
        bins = here.groupBy("cv", "prefix", "need", F.substring("h", length + 1, DIGITS).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        up_to = F.sum("c").over(Window.partitionBy("cv").orderBy("bin"))  # 16^DIGITS rows a fold at most
        found = {r["cv"]: r for r in bins.withColumn("up_to", up_to).filter((F.col("up_to") >= F.col("need")) & (F.col("up_to") - F.col("c") < F.col("need"))).collect()}
        length += DIGITS
        # A fold without such a bin has fewer than n rows: all of them come before "g".
        state = [(r["cv"], (f := found.get(r["cv"])) and f["prefix"] + f["bin"] or "g", f["need"] - (f["up_to"] - f["c"]) if f else 0, f["c"] if f else 0) for r in at.collect()]
        at = spark.createDataFrame([x[:3] for x in state], "cv int, prefix string, need long")
        exact = all(need in (0, c) for _, _, need, c in state)
        if exact or length >= 32:
            break
    met, mine = rows.join(F.broadcast(at), "cv"), F.substring("h", 1, length)
    out = met.filter((mine < F.col("prefix")) | ((mine == F.col("prefix")) & F.lit(exact)))
    if not exact:  # rows that share a whole hash, some of which are one too many
        tied = met.filter(mine == F.col("prefix")).withColumn("_r", F.row_number().over(Window.partitionBy("cv").orderBy("h")))
        out = out.unionByName(tied.filter(F.col("_r") <= F.col("need")).drop("_r"))
    return out.drop("prefix", "need")


def subsets(reads: DataFrame, n_folds: int, n: int) -> DataFrame:
    """cv, read_id: of each fold the n reads first by md5(cv-read_id), without replacement."""
    every = reads.select("read_id").withColumn("cv", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    return first_by_hash(every.withColumn("h", F.md5(F.concat_ws("-", F.col("cv").cast("string"), F.col("read_id").cast("string")).cast("binary"))), n).select("cv", "read_id")


def subset_of_folds(cv_reads: DataFrame, n: int, seed: str = "subset") -> DataFrame:
    """cv, read_id, m: n of each fold's draws (cv, read_id[, m]), without replacement; a read that was drawn m times counts as m draws."""
    m = F.col("m") if "m" in cv_reads.columns else F.lit(1)
    draws = cv_reads.select(F.col("cv").cast("int").alias("cv"), "read_id", F.explode(F.sequence(F.lit(1), m.cast("int"))).alias("j"))
    h = F.md5(F.concat_ws("-", F.lit(seed), F.col("cv").cast("string"), F.col("read_id").cast("string"), F.col("j").cast("string")).cast("binary"))
    return first_by_hash(draws.withColumn("h", h), n).groupBy("cv", "read_id").agg(F.count(F.lit(1)).alias("m"))


def expand(selection: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores of the selected reads, by fold, with their multiplicity."""
    rows = selection if "m" in selection.columns else selection.withColumn("m", F.lit(1).cast("long"))
    return rows.join(scores, "read_id")
