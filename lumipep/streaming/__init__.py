"""The additive statistics of an epoch over a stream of scores."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.em import epoch, updated  # noqa: F401  updated: after the statistics of all batches
from ..operators.scores import with_residual

#: The state store that keeps lists under a key; a setting of the session that runs the stream.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
HELD, WHOLE = "read_id long, flu_id int, s double, n long", "read_id long, flu_id int, s double"
#: Keys of the state. More of them are smaller, and take more calls.
BUCKETS = 256


class OpenReads(StatefulProcessor):
    """Holds scores of reads, those of one bucket under one key, until as many of a read have come as its rows say there are; then gives all of them at once and forgets the read."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        names = ["read_id", "flu_id", "s", "n"]
        before = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=names)
        every = pd.concat([before, *(r[names] for r in rows)], ignore_index=True)
        of_read = every.groupby("read_id")["n"]
        have, least, most = (of_read.transform(f) for f in ("size", "min", "max"))
        if (wrong := (least != most) | (have > least)).any():
            at = wrong.idxmax()
            raise ValueError(f"read {every['read_id'][at]}: {have[at]} scores where its rows say {least[at]} to {most[at]}")
        done = have == most
        rest = every[~done]
        if len(rest):
            self.held.put([(int(i), int(f), float(x), int(n)) for i, f, x, n in rest.itertuples(index=False, name=None)])
        else:
            self.held.clear()
        if done.any():
            yield every[done][names[:3]].astype({"read_id": "int64", "flu_id": "int32", "s": "float64"})

    def close(self) -> None:
        pass


def whole_reads(stream: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """read_id, flu_id, s: the scores of a stream (read_id, flu_id, s, n), where n is how many scores the read has in all, each read in one micro-batch whatever the files its rows come in.

    Only reads that are not complete stay in the state, dealt over the cluster in `buckets` and kept by the
    checkpoint; a bucket's open reads are held by a task as a whole, so there should be enough of them. A read that
    never gets its last row stays there, and takes no part; more rows than n, or two values of n, raise.
    """
    stream.sparkSession.conf.set(*STORE)
    kept = stream.select(F.col("read_id").cast("long").alias("read_id"), F.col("flu_id").cast("int").alias("flu_id"), F.col("s").cast("double").alias("s"), F.col("n").cast("long").alias("n"))
    rows = kept.withColumn("bucket", F.pmod(F.xxhash64("read_id"), F.lit(buckets)))
    return rows.groupBy("bucket").transformWithStateInPandas(OpenReads(), outputStructType=WHOLE, outputMode="Append", timeMode="None")


def partial_statistics(scores: DataFrame, emission: DataFrame, pi: DataFrame) -> DataFrame:
    """cv, flu_id, w, rest, loglik of one batch of reads; sums over batches are those of all reads, as long as the rows of a read are in one batch."""
    return epoch(scores, emission, pi)


def accumulate(stream: DataFrame, emission: DataFrame, pi: DataFrame, path: str, checkpoint: str, n_flu: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """A streaming query that writes each micro-batch's statistics under its batch id, so that a batch that is repeated replaces itself.

    stream: rows as `epoch` takes them, a read's in one file; or, with n_flu, bare scores with their number (as
    `whole_reads` takes them), which may come in any files: the read's residual is made when it is complete. Open
    reads are held in `buckets`, of which there should be more for a longer stream.
    """
    source = stream if n_flu is None else whole_reads(stream, buckets)

    def one(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if n_flu is not None:
            first = F.row_number().over(Window.partitionBy("read_id").orderBy("flu_id")) == 1
            rows = with_residual(batch, n_flu).withColumns({"cv": F.lit(0), "m": F.lit(1.0), "first": first})
        partial_statistics(rows, emission, pi).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statistics_of(spark: SparkSession, path: str) -> DataFrame:
    """What `accumulate` has written: the statistics of all batches, ready for `updated`."""
    return spark.read.parquet(path).drop("batch")
