"""Expectation-maximisation of protein abundances, as two sparse aggregations an epoch.

With g_f = sum_I pi_I P(f|I), a read's likelihood is d_n = sum_f s_nf g_f + r_n, and the update is
u_I = pi_I (sum_f P(f|I) w_f + R), with w_f = sum_n m_n s_nf / d_n and R = sum_n m_n r_n / d_n. The reads x
proteins matrix is never made; an epoch costs the scores' rows plus the emission's rows.

Scores are partitioned and sorted once by read and persisted, so that d_n is a window and no epoch moves or sorts a
score. Where the flus are few (FEW_FLUS, counted before) g is broadcast. Where they are not, each partition of reads
is sent g of the flus that its reads score: a table of routes, (partition, flu), made once, takes the place of scores
in the exchange. The emission is laid out by flu once, so that no epoch moves it as long as pi can be sent to it. Sums over reads are made within a partition before they move, in both cases. Each epoch's statistics
and estimate are written tables: nothing of the size of the proteins goes through the driver, and a lost executor
costs one epoch at most. `fit` runs over packed parts (`packed.Packed`) where it need not keep statistics of flus.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keep import Kept
from ..functions.numbering import even_keys
from ..functions.scratch import written
from .blocks import product
from .emission import share, to_abundance, to_read_share
from .packed import Packed, by_read
from .scores import oracle_values

#: Up to so many rows (flus or proteins x folds, some 24 bytes each) g and pi are broadcast; beyond, they are joined.
FEW_FLUS = 1 << 20
#: Up to so many proteins x folds their shares are broadcast as an array of 8 bytes each, and epochs are packed.
PACKED_PROTEINS = 1 << 23


@dataclass
class Fit:
    """The estimates before the first epoch and after each (cv, protein_id, pi; u after an epoch), and each epoch's statistics, as written tables. Packed epochs keep the statistics of reads only: w is 0."""

    states: list[DataFrame]
    statistics: list[DataFrame] = field(default_factory=list)

    @property
    def pi(self) -> DataFrame:
        """cv, protein_id, pi of the last epoch."""
        return self.states[-1].select("cv", "protein_id", "pi")

    def by_epoch(self) -> DataFrame:
        """cv, epoch (0: before the first), protein_id, pi."""
        return reduce(DataFrame.unionByName, [s.select("cv", F.lit(i).alias("epoch"), "protein_id", "pi") for i, s in enumerate(self.states)])

    def history_frame(self) -> DataFrame:
        """cv, epoch, loglik (under the estimate before that epoch), sum_u."""
        logs = [w.groupBy("cv").agg(F.sum("loglik").alias("loglik")).withColumn("epoch", F.lit(i)) for i, w in enumerate(self.statistics)]
        sums = [s.groupBy("cv").agg(F.sum("u").alias("sum_u")).withColumn("epoch", F.lit(i)) for i, s in enumerate(self.states[1:])]
        both = reduce(DataFrame.unionByName, logs).join(reduce(DataFrame.unionByName, sums), ["cv", "epoch"])
        return both.select("cv", "epoch", "loglik", "sum_u")

    @property
    def history(self) -> list[dict]:
        return [r.asDict() for r in self.history_frame().orderBy("epoch", "cv").collect()]

    def errors(self, truth: DataFrame, weights: DataFrame, of: str = "PY") -> DataFrame:
        """cv, epoch (from 1), before, after: mean absolute error before and after each epoch, of the abundances ("PY") or of the shares of reads ("PI"). truth: [cv,] protein_id, p_y; weights: protein_id, exp_n."""
        if of == "PY":
            p_y = to_abundance(self.by_epoch(), weights, ["cv", "epoch"]).select("cv", "epoch", "protein_id", "p_y")
            true = truth.withColumnRenamed("p_y", "true")
        elif of == "PI":
            p_y = self.by_epoch().withColumnRenamed("pi", "p_y")
            true = to_read_share(truth, weights, ["cv"] if "cv" in truth.columns else None).drop("p_y").withColumnRenamed("pi", "true")
        else:
            raise ValueError(f"errors of {of!r}; known: PY, PI")
        both = p_y.join(true.select(*[c for c in ("cv", "protein_id", "true") if c in true.columns]), [c for c in ("cv", "protein_id") if c in true.columns])
        mae = written(both.groupBy("cv", "epoch").agg(F.avg(F.abs(F.col("p_y") - F.col("true"))).alias("after")), "errors")
        before = mae.select("cv", (F.col("epoch") + 1).alias("epoch"), F.col("after").alias("before"))
        return mae.join(before, ["cv", "epoch"]).select("cv", "epoch", "before", "after")


def _with_fold(df: DataFrame) -> DataFrame:
    return df if "cv" in df.columns else df.withColumn("cv", F.lit(0))


def oracle_of_counts(selection: DataFrame, labels: DataFrame, error: float, n_flu: int, n_prot: int | None = None, form: str = "truth plus even") -> DataFrame:
    """cv, read_id, flu_id, s, r, m of the oracle's reads, one for each label of a fold with the number of its reads: labels are counted, so no read is made, moved or compared.

    selection: [cv,] read_id [, m]; labels: read_id, true_flu. The estimate is that of the reads one by one.
    """
    rows = selection.join(labels, "read_id")
    m = F.sum("m") if "m" in selection.columns else F.count(F.lit(1))
    counts = _with_fold(rows).groupBy("cv", "true_flu").agg(m.cast("double").alias("m"))
    s, r = oracle_values(error, n_flu, n_prot, form)
    return counts.select("cv", F.col("true_flu").cast("long").alias("read_id"), F.col("true_flu").alias("flu_id"), F.lit(s).alias("s"), F.lit(r).alias("r"), "m")


def collapse(scores: DataFrame) -> DataFrame:
    """Reads with the same scores become one with a multiplicity. scores: cv, read_id, flu_id, s, r, m."""
    e = F.array_sort(F.collect_list(F.struct("flu_id", "s")))
    rows = scores.groupBy("cv", "read_id").agg(e.alias("e"), F.first("r").alias("r"), F.first("m").alias("m"))
    once = rows.groupBy("cv", "e", "r").agg(F.min("read_id").alias("read_id"), F.sum("m").alias("m"))
    return once.select("cv", "read_id", "r", "m", F.inline("e"))


@contextmanager
def layouts_kept(spark: SparkSession) -> Iterator[None]:
    """Joins keep the layout of inputs that are partitioned alike by some of the join's columns; Spark deals them anew by all columns otherwise."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Routed:
    """Scores by partitions of reads (column `part`), and the routes: part, cv, flu_id of all flus that a partition's reads score, laid out by flu."""

    rows: DataFrame
    routes: DataFrame

    @classmethod
    def of(cls, rows: DataFrame, reads: list[str]) -> Routed:
        """rows: cv, read_id, flu_id, s, r, m; reads: the columns that tell reads apart. Both tables are persisted."""
        spark = rows.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        keys = F.array(*[F.lit(k).cast("long") for k in even_keys(spark, n)])  # a long's hash is not that of an int
        placed = rows.withColumn("part", F.get(keys, F.pmod(F.hash("read_id"), F.lit(n)))).repartition(n, "part")
        first = F.row_number().over(Window.partitionBy("part", *reads).orderBy("flu_id")) == 1
        held = placed.withColumn("first", first).persist(StorageLevel.MEMORY_AND_DISK)
        routes = held.select("part", "cv", "flu_id").distinct().repartition(n, "flu_id").persist(StorageLevel.MEMORY_AND_DISK)
        return cls(held, routes)

    def with_g(self, g: DataFrame) -> DataFrame:
        """The scores with their flu's g. What moves is g, once for each partition that needs it."""
        n = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = self.routes.join(g, ["cv", "flu_id"]).repartition(n, "part")
        # The hash table is of what was sent, so the scores keep their order.
        return self.rows.join(sent.hint("shuffle_hash"), ["part", "cv", "flu_id"], "left")

    def unpersist(self) -> None:
        self.routes.unpersist()
        self.rows.unpersist()


def epoch(scores: DataFrame | Routed, emission: DataFrame, pi: DataFrame, few_flus: bool = False, reads: tuple[str, ...] = ("cv", "read_id")) -> DataFrame:
    """cv, flu_id, w, and under flu_id null R (rest) and the log-likelihood under pi (loglik): sums over reads, so those of parts add up.

    scores: cv, read_id, flu_id, s, r, m, first (true on one row of each read), or the same by partitions; reads: the
    columns that tell reads apart. Reads whose likelihood is 0 take no part.
    """
    g = emission.join(pi, "protein_id").groupBy("cv", "flu_id").agg(F.sum(F.col("pi") * F.col("p")).alias("g"))
    routed = isinstance(scores, Routed)
    by = ["part", *reads] if routed else reads
    # Left: a flu without emission adds nothing, but its read keeps its residual.
    with_g = scores.with_g(g) if routed else scores.join(F.broadcast(g) if few_flus else g, ["cv", "flu_id"], "left")
    part = F.sum(F.col("s") * F.coalesce("g", F.lit(0.0))).over(Window.partitionBy(*by))
    d = with_g.withColumn("d", part + F.col("r")).filter("d > 0")
    # A read's own terms are added up under no flu, so that a partition sends them once and not with each of its flus.
    zero, none = F.lit(0.0), F.lit(None).cast(d.schema["flu_id"].dataType)
    of_flu = F.struct(F.col("flu_id").alias("flu_id"), (F.col("m") * F.col("s") / F.col("d")).alias("w"), zero.alias("rest"), zero.alias("loglik"))
    of_read = F.struct(none.alias("flu_id"), zero.alias("w"), (F.col("m") * F.col("r") / F.col("d")).alias("rest"), (F.col("m") * F.log("d")).alias("loglik"))
    terms = d.select("cv", F.inline(F.when(F.col("first"), F.array(of_flu, of_read)).otherwise(F.array(of_flu))))
    return terms.groupBy("cv", "flu_id").agg(*[F.sum(c).alias(c) for c in ("w", "rest", "loglik")])


def _by_flu(df: DataFrame) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "flu_id")


def unscaled(statistics: DataFrame, emission: DataFrame, pi: DataFrame, few_flus: bool = False) -> DataFrame:
    """cv, protein_id, u, before: what falls to each protein in the epoch with these statistics, and pi before it. few_flus: w is sent to the emission, which nothing moves then; rows of one flu add up there."""
    w = statistics.filter("flu_id is not null").select("cv", "flu_id", "w")
    if few_flus:
        w = F.broadcast(w)
    else:  # laid out by flu, as `fit` keeps the emission
        w = _by_flu(w).groupBy("cv", "flu_id").agg(F.sum("w").alias("w"))
    rest = statistics.filter("flu_id is null").groupBy("cv").agg(F.sum("rest").alias("rest"))
    x = emission.select("protein_id", "flu_id", "p").join(w, "flu_id").groupBy("cv", "protein_id").agg(F.sum(F.col("p") * F.col("w")).alias("x"))
    some = F.coalesce("x", F.lit(0.0)) + F.coalesce("rest", F.lit(0.0))
    u = pi.select("cv", "protein_id", "pi").join(x, ["cv", "protein_id"], "left").join(F.broadcast(rest), "cv", "left")  # a row a fold
    return u.select("cv", "protein_id", (F.col("pi") * some).alias("u"), F.col("pi").alias("before"))


def scaled(u: DataFrame) -> DataFrame:
    """cv, protein_id, u, pi of `unscaled`, which is read twice: a written table, or its work is done twice. A fold without a usable read keeps its estimate."""
    sums = u.groupBy("cv").agg(F.sum("u").alias("total"))
    return u.join(F.broadcast(sums), "cv").select("cv", "protein_id", "u", F.when(F.col("total") > 0, F.col("u") / F.col("total")).otherwise(F.col("before")).alias("pi"))


def updated(statistics: DataFrame, emission: DataFrame, pi: DataFrame) -> DataFrame:
    """cv, protein_id, u, pi after the epoch with these statistics."""
    return scaled(written(unscaled(statistics, emission, pi), "update"))


def fit(scores: DataFrame, emission: DataFrame, start: DataFrame, epochs: int, keep: Kept | None = None, chunks: int = 1) -> Fit:
    """scores: [cv,] read_id, flu_id, s, r [, m]; emission: protein_id, flu_id, p; start: [cv,] protein_id, pi.

    With `keep` every epoch's tables stay in its folder, the statistics of each of `chunks` parts of the reads by
    themselves; a fit of the same inputs goes on after the last table that was written whole.
    """
    reads = ["cv", "read_id"] if "cv" in scores.columns else ["read_id"]  # a constant column would be folded away, and with it the order
    rows = _with_fold(scores)
    rows = rows if "m" in rows.columns else rows.withColumn("m", F.lit(1.0))
    rows = rows.select("cv", F.col("read_id"), "flu_id", "s", "r", F.col("m").cast("double").alias("m"))
    save = (lambda name, df: written(df, name.split("-")[0])) if keep is None else keep.table
    out = Fit([save("state-0", _with_fold(start).select("cv", "protein_id", "pi"))])
    folds = 1 if reads == ["read_id"] else out.pi.select("cv").distinct().count()
    proteins = out.pi.count()
    whole_ids = all(df.schema["flu_id"].dataType.typeName() in ("byte", "short", "integer", "long") for df in (rows, emission))
    if keep is None and chunks == 1 and whole_ids and 0 < proteins <= PACKED_PROTEINS * min(FEW_FLUS, 1):
        return _fit_packed(out, rows, reads, emission.select("protein_id", "flu_id", "p"), epochs)
    model = _by_flu(emission.select("protein_id", "flu_id", "p")).persist(StorageLevel.MEMORY_AND_DISK)
    few_proteins = proteins <= FEW_FLUS
    few = model.count() * folds <= FEW_FLUS or model.select("flu_id").distinct().count() * folds <= FEW_FLUS
    if few:
        first = F.row_number().over(Window.partitionBy(*reads).orderBy("flu_id")) == 1
        held: DataFrame | Routed = rows.withColumn("first", first).persist(StorageLevel.MEMORY_AND_DISK)
    else:
        held = Routed.of(rows, reads)
    with nullcontext() if few else layouts_kept(scores.sparkSession):
        for k in range(1, epochs + 1):
            pi = out.pi
            # Sent to the emission, which keeps its layout by flu.
            sent = F.broadcast(pi) if few_proteins else pi
            parts = [save(f"statistics-{k}-{c}", epoch(_chunk(held, c, chunks), model, sent, few, tuple(reads))) for c in range(chunks)]
            out.statistics.append(reduce(DataFrame.unionByName, parts))
            out.states.append(scaled(save(f"state-{k}", unscaled(out.statistics[-1], model, pi, few and chunks == 1))))
    held.unpersist()
    model.unpersist()
    return out


def _fit_packed(out: Fit, rows: DataFrame, reads: list[str], emission: DataFrame, epochs: int) -> Fit:
    """The rest of `fit` by packed parts: an epoch is one written table."""
    packed = Packed(rows, reads, emission, out.pi)
    state = packed.first()
    for k in range(1, epochs + 1):
        state = written(packed.epoch(state, k > 1), f"state-{k}")
        out.statistics.append(packed.statistics(state))
        out.states.append(scaled(packed.update(state)))
    packed.unpersist()
    return out


def _chunk(held: DataFrame | Routed, c: int, chunks: int) -> DataFrame | Routed:
    """The reads of one of `chunks` parts, by hash."""
    if chunks == 1:
        return held
    mine = F.pmod(F.xxhash64("read_id"), F.lit(chunks)) == c
    return Routed(held.rows.filter(mine), held.routes) if isinstance(held, Routed) else held.filter(mine)


def epoch_in_one_plan(scores: DataFrame, emission: DataFrame, pi: DataFrame) -> DataFrame:
    """One epoch without the driver: protein_id, pi. scores: read_id, flu_id, s, r. At most three of these in a row; `fit` loops."""
    first = F.row_number().over(Window.partitionBy("cv", "read_id").orderBy("flu_id")) == 1
    rows = _with_fold(scores).withColumn("m", F.lit(1.0)).withColumn("first", first)
    emission = emission.select("protein_id", "flu_id", "p")
    w = epoch(rows, emission, _with_fold(pi))
    rest = w.agg(F.sum("rest").alias("rest"))
    got = emission.join(w.select("flu_id", "w"), "flu_id").groupBy("protein_id").agg(F.sum(F.col("p") * F.col("w")).alias("x"))
    u = pi.join(got, "protein_id", "left").crossJoin(F.broadcast(rest)).withColumn("u", F.col("pi") * (F.coalesce("x", F.lit(0.0)) + F.col("rest")))
    return share(u.drop("pi"), F.col("u"), "pi").select("protein_id", "u", "pi")


def eta(scores: DataFrame, emission: DataFrame, one_score: bool = False) -> DataFrame:
    """read_id, protein_id, eta, r: likelihood of each read under each protein that shares a flu with it, residual included. Under all other proteins it is r.

    Ids are integers; emission has one entry for a protein and flu. one_score: every read has one score, as an
    oracle's do, so a pair is one term and nothing is moved or added up after the join.
    """
    if one_score:
        shared = scores.join(emission.select("flu_id", "protein_id", "p"), "flu_id")
        return shared.select("read_id", "protein_id", (F.col("s") * F.col("p") + F.col("r")).alias("eta"), "r")
    return by_read(scores, emission, [], lambda _, x, r: [x + r, r], "eta double, r double")


def responsibilities(etas: DataFrame, pi: DataFrame) -> DataFrame:
    """read_id, protein_id, alpha, rest: share of the read that falls to the protein; to a protein that shares no flu with it falls rest * pi. pi sums to 1."""
    joint = etas.join(pi.select("protein_id", "pi"), "protein_id")
    d = F.sum((F.col("eta") - F.col("r")) * F.col("pi")).over(Window.partitionBy("read_id")) + F.col("r")
    return joint.withColumn("d", d).select("read_id", "protein_id", (F.col("eta") * F.col("pi") / F.col("d")).alias("alpha"), (F.col("r") / F.col("d")).alias("rest"))


def responsibilities_of_scores(scores: DataFrame, emission: DataFrame, pi: DataFrame) -> DataFrame:
    """The same as `responsibilities` of `eta`, made where a read's pairs are made: no row for a pair moves."""

    def shares(read: np.ndarray, x: np.ndarray, pi: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
        d = np.bincount(read, x * pi)[read] + r
        return [(x + r) * pi / d, r / d]

    model = emission.select("protein_id", "flu_id", "p").join(pi.select("protein_id", "pi"), "protein_id")
    return by_read(scores, model, ["pi"], shares, "alpha double, rest double")


def dense_eta(scores: DataFrame, emission: DataFrame) -> DataFrame:
    """read_id, protein_id, eta of reads with a score for every flu (read_id, flu_id, s): the product of two matrices, by blocks."""
    left = scores.select(F.col("read_id").alias("row"), F.col("flu_id").alias("mid"), F.col("s").alias("value"))
    right = emission.select(F.col("flu_id").alias("mid"), F.col("protein_id").alias("col"), F.col("p").alias("value"))
    return product(left, right).select(F.col("row").alias("read_id"), F.col("col").cast(emission.schema["protein_id"].dataType).alias("protein_id"), F.col("value").alias("eta"))
