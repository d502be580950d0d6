"""The driver's tables as peptides, reads, scores and abundances; the same bindings as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..functions.sequence import sequence_of
from ..operators.emission import emission_counts, emission_model, prior, protein_weights, share
from ..operators.scores import with_residual

P_MISS = 0.07
MASS = 0.9


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._emission: DataFrame | None = None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def peptides(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").cast("int").alias("protein_id"), F.col("l_partkey").cast("int").alias("flu_id"))

    def dyes(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").cast("int").alias("flu_id"), (F.col("p_size") % 5 + 1).cast("int").alias("n_dyes"))

    def emission(self) -> DataFrame:
        """Written once for all that a query makes of it."""
        if self._emission is None:
            self._emission = written(emission_model(emission_counts(self.peptides()), self.dyes(), P_MISS), "emission")
        return self._emission

    def weights(self) -> DataFrame:
        return protein_weights(self.emission())

    def prior(self) -> DataFrame:
        return prior(self.weights())

    def n_flu(self) -> int:
        return self.peptides().select(F.countDistinct("flu_id")).first()[0]

    def scores(self) -> DataFrame:
        # By read at once: the sums and the windows over a read need no exchange of their own.
        q = self.read("lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("read_id"), F.col("l_partkey").cast("int").alias("flu_id")).agg(F.sum("l_quantity").alias("q"))
        return q.withColumn("s", F.lit(MASS) * F.col("q") / F.sum("q").over(Window.partitionBy("read_id"))).select("read_id", "flu_id", "s")

    def labels(self) -> DataFrame:
        one = F.min_by(F.col("l_partkey").cast("int"), F.struct("l_linenumber", "l_partkey"))
        return self.read("lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(one.alias("true_flu"))

    def em_rows(self, kept: DataFrame | None = None) -> DataFrame:
        kept = self.scores() if kept is None else kept
        return with_residual(kept, self.n_flu())

    def truth(self) -> DataFrame:
        s = self.read("supplier").select(F.col("s_suppkey").cast("int").alias("protein_id"), "s_acctbal")
        low = s.agg(F.min("s_acctbal").alias("low"))
        return share(s.crossJoin(F.broadcast(low)), F.col("s_acctbal") - F.col("low") + 1, "p_y").select("protein_id", "p_y")

    def proteins(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("protein_id"), sequence_of(F.col("text")).alias("sequence"))

    def dense(self) -> DataFrame:
        """read_id, flu_id, s from the embeddings: absolute components, normalised."""
        e = self.read("embeddings").select(F.col("vec_id").alias("read_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("a"))
        total = F.aggregate("a", F.lit(0.0), lambda acc, x: acc + x)
        return e.withColumn("t", total).select("read_id", F.posexplode(F.transform("a", lambda x: x / F.col("t"))).alias("flu_id", "s"))


#: Common table expressions of the same bindings.
CTE = {
    "pep": "pep AS (SELECT l_suppkey::INTEGER AS protein_id, l_partkey::INTEGER AS flu_id FROM lineitem)",
    "dyes": "dyes AS (SELECT p_partkey::INTEGER AS flu_id, (p_size % 5 + 1)::INTEGER AS n_dyes FROM part)",
    "cnt": "cnt AS (SELECT protein_id, flu_id, count(*) AS n FROM pep GROUP BY ALL)",
    "emw": f"emw AS (SELECT protein_id, cnt.flu_id, n, n_dyes, n * (1 - pow({P_MISS}::DOUBLE, n_dyes)) AS w FROM cnt JOIN dyes ON dyes.flu_id = cnt.flu_id)",
    "emission": "emission AS (SELECT *, w / sum(w) OVER (PARTITION BY protein_id) AS p FROM emw)",
    "weights": "weights AS (SELECT protein_id, sum(w) AS exp_n FROM emission GROUP BY protein_id)",
    "prior": "prior AS (SELECT protein_id, exp_n, exp_n / sum(exp_n) OVER () AS pi FROM weights)",
    "nf": "nf AS (SELECT count(DISTINCT flu_id)::DOUBLE AS f FROM pep)",
    "raw": "raw AS (SELECT l_orderkey AS read_id, l_partkey::INTEGER AS flu_id, sum(l_quantity) AS q FROM lineitem GROUP BY ALL)",
    "scores": f"scores AS (SELECT read_id, flu_id, {MASS}::DOUBLE * q / sum(q) OVER (PARTITION BY read_id) AS s FROM raw)",
    "ranked": "ranked AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY s DESC, flu_id) AS r FROM scores)",
    "resid": "resid AS (SELECT read_id, greatest(0.0::DOUBLE, (1 - sum(s)) / (SELECT f FROM nf)) AS r FROM scores GROUP BY read_id)",
    "em": "em AS (SELECT scores.read_id, flu_id, s, r FROM scores JOIN resid ON resid.read_id = scores.read_id)",
    "labels": "labels_ AS (SELECT l_orderkey AS read_id, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey)::INTEGER AS true_flu FROM lineitem GROUP BY l_orderkey)",
    "truth": "truth AS (SELECT s_suppkey::INTEGER AS protein_id, (s_acctbal - lo + 1) / sum(s_acctbal - lo + 1) OVER () AS p_y FROM (SELECT *, min(s_acctbal) OVER () AS lo FROM supplier))",
    "prot": "prot AS (SELECT doc_id AS protein_id, upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')) AS sequence FROM documents)",
    "dense": """abs_ AS (SELECT vec_id AS read_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings),
dense AS (SELECT read_id, unnest(range(0, len(a)))::INTEGER AS flu_id, unnest(list_transform(a, lambda x: x / list_sum(a))) AS s FROM abs_)""",
}
_NEEDS = {
    "cnt": ["pep"], "emw": ["cnt", "dyes"], "emission": ["emw"], "weights": ["emission"], "prior": ["weights"], "nf": ["pep"], "scores": ["raw"],
    "ranked": ["scores"], "resid": ["scores", "nf"], "em": ["scores", "resid"],
}


def with_cte(*names: str) -> str:
    """WITH clause of the named expressions and of all that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(CTE[n] for n in order)


def em_sql(epochs: int, start: str = "prior", rows: str = "em", suffix: str = "") -> str:
    """Expressions pi1 ... pi<epochs> (protein_id, u, pi), d1 ... (reads and their likelihoods before each epoch), after `start` and `rows`; names end in `suffix`."""
    out, last = [], start
    for k in range(1, epochs + 1):
        i = f"{k}{suffix}"
        out.append(f"""g{i} AS MATERIALIZED (SELECT flu_id, sum(pi * p) AS g FROM emission e JOIN {last} x ON x.protein_id = e.protein_id GROUP BY flu_id),
d{i} AS MATERIALIZED (SELECT e.read_id, any_value(e.r) AS r, sum(e.s * coalesce(g, 0)) + any_value(e.r) AS d FROM {rows} e LEFT JOIN g{i} g ON g.flu_id = e.flu_id GROUP BY e.read_id),
w{i} AS MATERIALIZED (SELECT e.flu_id, sum(e.s / d) AS wt FROM {rows} e JOIN d{i} d ON d.read_id = e.read_id WHERE d > 0 GROUP BY e.flu_id),
u{i} AS MATERIALIZED (SELECT x.protein_id, pi * (coalesce(t, 0) + (SELECT sum(r / d) FROM d{i} WHERE d > 0)) AS u FROM {last} x
  LEFT JOIN (SELECT protein_id, sum(p * wt) AS t FROM emission e JOIN w{i} w ON w.flu_id = e.flu_id GROUP BY protein_id) q ON q.protein_id = x.protein_id),
pi{i} AS MATERIALIZED (SELECT protein_id, u, u / sum(u) OVER () AS pi FROM u{i})""")
        last = f"pi{i}"
    return ",\n".join(out)
