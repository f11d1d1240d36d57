"""Where stored keys are: a fingerprint of each key by day, to find the days of a batch's keys without
opening the days.

A fingerprint is a 64-bit hash. Sorted ones are stored as differences: with a million keys a day a
fingerprint takes 6 bytes (measured), a random id 36. The index may say too much (a hash that two
keys share, a key that has left its day), which costs a look into a day; it never says too little, since
fingerprints are added before their rows are and are not taken away until the index is rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class KeyIndex:
    """Fingerprints of ``key`` below ``path``, in a folder per ``day``. ``complete`` is a path that
    exists once all stored rows are in the index."""

    spark: SparkSession
    path: str
    complete: str
    key: str
    day: str

    def read(self) -> DataFrame:
        return self.spark.read.schema(f"fingerprint bigint, {self.day} date").parquet(self.path)

    def ready(self) -> bool:
        folder, files = self._folder(self.complete)
        return files.exists(folder)

    def build(self, stored: DataFrame) -> None:
        """Index all stored rows anew. Cut off, it leaves no index behind that is taken for one."""
        self.distrust()
        self._write(self._fingerprints(stored), "overwrite")
        folder, files = self._folder(self.complete)
        files.mkdirs(folder)

    def distrust(self) -> None:
        """From now on there is no index, until the next ``build``."""
        folder, files = self._folder(self.complete)
        files.delete(folder, True)

    def add(self, rows: DataFrame, of_days: Column) -> None:
        """Index rows that are about to be stored. ``of_days`` is true of their days: only what the
        index has of these is read."""
        present = self.read().where(of_days).alias("p")
        new = self._fingerprints(rows).alias("n")
        same = (F.col("n.fingerprint") == F.col("p.fingerprint")) & F.col(f"n.{self.day}").eqNullSafe(
            F.col(f"p.{self.day}"))
        self._write(new.join(present, same, "left_anti"), "append")

    def days_of(self, rows: DataFrame, among: Column) -> set:
        """Of the days for which ``among`` is true, those that may hold keys of ``rows``. The keys are
        the build side; one value per day reaches the driver."""
        wanted = rows.select(F.xxhash64(self.key).alias("fingerprint")).distinct()
        found = self.read().where(among).join(wanted, "fingerprint", "left_semi")
        return {row[0] for row in found.select(self.day).distinct().collect()}

    def _fingerprints(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.xxhash64(self.key).alias("fingerprint"), self.day).distinct()

    def _write(self, fingerprints: DataFrame, mode: str) -> None:
        # Few files per day, each sorted, so that neighbours differ by little.
        fingerprints.hint("rebalance", self.day).sortWithinPartitions(
            self.day, "fingerprint"
        ).write.mode(mode).partitionBy(self.day).options(**{
            "partitionOverwriteMode": "static",
            "parquet.writer.version": "v2", "parquet.enable.dictionary": "false",
        }).parquet(self.path)

    def _folder(self, path: str) -> tuple:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
