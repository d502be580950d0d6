"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (its share of the weights) * (rows wanted) / (its rows). Each document
draws its number of copies by inverting the Poisson distribution of that mean at a uniform number hashed
from (seed, id), so a run can be repeated, and no task needs to know about any other. A mean above MAX_RATE is
split into equal parts below it, each drawn from its own hash: their sum has the Poisson distribution of the
whole mean. Copies are then shuffled globally by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, named, table

SEED = "mix-1"
#: Target weight of a source with n rows: n ** TEMPERATURE.
TEMPERATURE = 0.7
#: Largest rate that one table of probabilities inverts; a larger one is the sum of independent draws of at most this rate.
MAX_RATE = 200.0
#: Up to so many sources (at most some 4 kB each) their rates are broadcast; beyond, they are joined by source.
BROADCAST_SOURCES = 8192


def uniform(*parts) -> Column:
    """In [0, 1), from 52 bits of the md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2 ... copies, as far as they differ from 1."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("t"))

    def step(acc, k):
        p = acc["p"] * rate / k
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["t"], F.array(c)).alias("t"))

    return F.aggregate(steps, start, step, lambda acc: acc["t"])


def poisson_mix(
    df: DataFrame,
    source: str = "source",
    id_col: str = "doc_id",
    weights: DataFrame | None = None,
    rows_wanted: float | None = None,
    seed: str = SEED,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """df's columns, then copy_no (0-based), n_copies, shuffle_key; in the order of shuffle_key over the whole result.

    weights: (source, weight), any positive scale; a source that is not listed there gets none. Without it
    a source of n rows weighs n ** temperature. rows_wanted: expected rows of the result; default the rows of df.
    Null sources are one source. A document with a null or empty text is replicated as any other. Equal ids
    of one source draw equal numbers of copies. Columns of df with the names that are added are replaced; other
    names do not matter. Weights of a source that is listed more than once add up. No rows, or no positive weight,
    give an empty result. Any rate is drawn.
    """
    df = df.drop("copy_no", "n_copies", "shuffle_key")
    counts = df.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_rows"))
    if weights is None:
        rated = counts.withColumn("_weight", F.pow("_rows", F.lit(temperature)))
    else:
        w = weights.select(F.col(weights.columns[0]).alias("_w_source"), F.col(weights.columns[1]).cast("double").alias("_weight")).groupBy("_w_source").agg(F.sum("_weight").alias("_weight"))
        rated = counts.join(w, F.col("_source").eqNullSafe(F.col("_w_source")), "left").drop("_w_source").fillna(0.0, ["_weight"])
    totals = rated.agg(F.sum("_weight").alias("_weights"), F.sum("_rows").alias("_all"), F.count(F.lit(1)).alias("_sources")).first()
    if not totals["_weights"]:
        return df.withColumns({"copy_no": F.lit(0), "n_copies": F.lit(0), "shuffle_key": F.lit("")}).limit(0)
    wanted = float(rows_wanted if rows_wanted is not None else totals["_all"])
    rate = F.col("_weight") / F.lit(totals["_weights"]) * F.lit(wanted) / F.col("_rows")
    rated = rated.select("_source", rate.alias("_rate")).withColumn("_draws", F.greatest(F.lit(1), F.ceil(F.col("_rate") / MAX_RATE)).cast("int"))
    of = fresh(df, "_of_source")
    rated = rated.select(F.struct("_source", "_draws", poisson_table(F.col("_rate") / F.col("_draws")).alias("_table")).alias(of))
    rated = F.broadcast(rated) if totals["_sources"] <= BROADCAST_SOURCES else rated
    drawn = df.join(rated, F.col(source).eqNullSafe(F.col(f"{of}._source")), "left")
    below = lambda *more: F.size(F.filter(F.col(f"{of}._table"), lambda c: c <= uniform(F.lit(seed), F.col(id_col), *more)))
    first = F.get(F.transform(F.array(uniform(F.lit(seed), F.col(id_col))), lambda u: F.size(F.filter(F.col(f"{of}._table"), lambda c: c <= u))), F.lit(0))
    # The first draw is by the document's own number; the further ones of a large rate are hashed with theirs.
    more = F.aggregate(F.sequence(F.lit(2), F.col(f"{of}._draws")), F.lit(0), lambda acc, j: acc + below(j))
    n = (first + F.when(F.col(f"{of}._draws") > 1, more).otherwise(0)).cast("int")
    copies = drawn.withColumn("n_copies", n).filter("n_copies > 0").drop(of)
    copies = copies.withColumn("copy_no", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    key = F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy_no").cast("string")).cast("binary"))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key").select(*named(df.columns), "copy_no", "n_copies", "shuffle_key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson_mix(table(spark, sf_dir, "documents"))


SQL = {
    "op3_mixing": f"""
WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n, {TEMPERATURE}) / (SELECT sum(pow(n, {TEMPERATURE})) FROM c) * (SELECT sum(n) FROM c) / n AS rate FROM c),
p AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM r, (SELECT unnest(range(0, 200))::DOUBLE AS k)),
t AS (SELECT source, list(cdf) AS cdfs FROM p GROUP BY source),
u AS (SELECT d.*, len(list_filter(t.cdfs, lambda x: x <= ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / pow(2, 52)))::INTEGER AS n_copies
      FROM documents d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
e AS (SELECT *, unnest(range(0, n_copies))::INTEGER AS copy_no FROM u WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy_no, n_copies,
       md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy_no::VARCHAR) AS shuffle_key FROM e"""
}
QUERIES = {"op3_mixing": op3_mixing}
