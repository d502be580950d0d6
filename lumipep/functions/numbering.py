"""Row numbers and running sums over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import written

_LOCAL = (1 << 33) - 1


def numbered(df: DataFrame, order: list, name: str, total: Column | None = None, running: str = "running") -> DataFrame:
    """df with `name`: 0, 1, 2 ... in the given order; with `total`, also the sum of total over the rows before (`running`).

    Rows are sorted in range partitions; each partition's count (and sum) goes to the driver, one row each,
    and comes back as the partition's offset.
    """
    sums = total if total is not None else F.lit(0)
    rows = written(df.withColumn("_total", sums.cast("double" if total is not None else "long")).orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}), "numbered")
    offsets, n, s = [], 0, 0 if total is None else 0.0
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_total").alias("s")).orderBy("_part").collect():
        offsets.append((r["_part"], n, s))
        n, s = n + r["n"], s + r["s"]
    kind = "_part int, _n long, _s " + ("double" if total is not None else "long")
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, kind)), "_part").withColumn(name, F.col("_n") + F.col("_mid").bitwiseAND(F.lit(_LOCAL)))
    if total is not None:
        from pyspark.sql import Window

        before = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn(running, F.col("_s") + F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
    return placed.drop("_part", "_mid", "_n", "_s", "_total")


def in_file_order(df: DataFrame, name: str) -> DataFrame:
    """df, rows just as a reader gives them, with `name`: 0, 1, 2 ... through its files in order of their paths, and from each file's start to its end.

    Spark deals blocks of files to tasks by their length, but reads a block from start to end. So nothing is sorted: a
    row's number is its place in its block and the rows of the blocks before, of which one row each goes to the driver.
    """
    rows = written(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid")), "read")
    offsets, n = [], 0
    for r in rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("n"), F.min("_mid").alias("first")).orderBy("_file", "_block").collect():
        offsets.append((r["_file"], r["_block"], n - r["first"]))
        n += r["n"]
    placed = rows.join(F.broadcast(rows.sparkSession.createDataFrame(offsets, "_file string, _block long, _n long")), ["_file", "_block"])
    return placed.withColumn(name, F.col("_n") + F.col("_mid")).drop("_file", "_block", "_mid", "_n")


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n numbers that hash partitioning sends to n partitions, one to each, in order."""
    ids = spark.range(0, n * 64, numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("at")).groupBy("at").agg(F.min("id").alias("id"))
    held = {r["at"]: r["id"] for r in ids.collect()}
    if len(held) < n:  # with 64 numbers a partition one is left out once in 10^27 cases
        raise ValueError(f"no number for each of {n} partitions")
    return [held[i] for i in range(n)]
