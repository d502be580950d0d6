"""Folders that commit as a whole, and tables of a computation that can be taken up again."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession


class Files:
    """The file system of a path, by Spark's own access to it."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def claim(self, path: str) -> bool:
        """Makes an empty file; false if there is one: of two that try only one gets it."""
        try:
            return self._fs.createNewFile(self._path(path))
        except Exception as e:  # some file systems raise where others say false
            if self.exists(path):
                return False
            raise e

    def rename(self, old: str, new: str) -> bool:
        return self._fs.rename(self._path(old), self._path(new))

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Kept:
    """Tables under names in a folder: one that is there whole (with Spark's mark of success) is read instead of made.

    `mark` tells what the tables are of; a folder with another mark raises, so nothing is taken up that belongs to
    other inputs or settings.
    """

    def __init__(self, spark: SparkSession, folder: str, mark: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)
        at = f"{self.folder}/mark"
        if self.files.exists(f"{at}/_SUCCESS"):
            held = spark.read.text(at, wholetext=True).first()[0].strip()
            if held != mark:
                raise ValueError(f"{folder} holds tables of {held}, not of {mark}")
        else:
            spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(at)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        """df as the table of this name: written, unless it is there."""
        path = f"{self.folder}/{name}"
        if not self.files.exists(f"{path}/_SUCCESS"):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def has(self, name: str) -> bool:
        return self.files.exists(f"{self.folder}/{name}/_SUCCESS")


class Commit:
    """A folder under `root` that gets its name, the time, when all of it is written. Of two runs in one second the later takes the next; an error leaves nothing."""

    FORMAT = "%d-%m-%Y_%H-%M-%S"

    def __init__(self, spark: SparkSession, root: str, at: datetime | None = None):
        self.root, self.files, self.at = root.rstrip("/"), Files(spark, root), at or datetime.now(timezone.utc)

    def __enter__(self) -> Commit:
        while True:
            self.name = self.at.strftime(self.FORMAT)
            self._claim = f"{self.root}/.claim-{self.name}"
            if not self.files.exists(f"{self.root}/{self.name}") and self.files.claim(self._claim):
                break
            self.at += timedelta(seconds=1)
        self.path, self.hidden = f"{self.root}/{self.name}", f"{self.root}/.part-{self.name}-{uuid.uuid4().hex}"
        return self

    def __exit__(self, kind, error, trace) -> None:
        try:
            if kind is None and not self.files.rename(self.hidden, self.path):
                raise OSError(f"{self.hidden} could not be renamed to {self.path}")
            if kind is not None:
                self.files.remove(self.hidden)
        finally:
            self.files.remove(self._claim)
