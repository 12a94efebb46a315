"""A table in folders by id range, and archiving as verified drops of folders.

The folder of a row is its storage partition (operators.retention). What is archived is
copied, the copy is verified, and only then are folders dropped: rows that stay are never
rewritten. A mark says that a partition's copy was verified; a run that was stopped goes on
from the marks, so a folder that was dropped in part is never copied again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.operators.retention import storage_partition
from gleanbox.sources.files import exists, names, remove, touch

FOLDER = "partition_id"


@dataclass(frozen=True)
class IdPartitions:
    """A table under ``base`` with a folder for each ``size`` ids."""

    base: str
    size: int

    def append(self, rows: DataFrame) -> None:
        placed = rows.withColumn(FOLDER, storage_partition(F.col("id"), self.size))
        placed.repartition(FOLDER).write.mode("append").partitionBy(FOLDER).parquet(self.base)

    def folder(self, number: int) -> str:
        return f"{self.base}/{FOLDER}={number}"

    def numbers(self, spark: SparkSession) -> list[int]:
        """The partitions that have a folder."""
        return sorted(int(n.partition("=")[2]) for n in names(spark, self.base) if n.startswith(f"{FOLDER}="))

    def read(self, spark: SparkSession, numbers: list[int] | None = None) -> DataFrame:
        """The table, or the folders of some partitions alone."""
        if numbers is None:
            return spark.read.parquet(self.base)
        return spark.read.option("basePath", self.base).parquet(*[self.folder(n) for n in numbers])


def _sums(table: DataFrame) -> dict[int, tuple]:
    """Per partition: rows, and a sum of row hashes; one row a partition reaches the driver."""
    hashed = F.xxhash64(*[c for c in sorted(table.columns) if c != FOLDER]).cast("decimal(20,0)")
    return {r[FOLDER]: (r["n"], r["h"]) for r in table.groupBy(FOLDER).agg(F.count(F.lit(1)).alias("n"), F.sum(hashed).alias("h")).collect()}


def verified_backup(spark: SparkSession, table: IdPartitions, numbers: list[int], backup: str) -> None:
    """Copy partitions to ``backup`` in one job, compare the copies with their folders, and mark them as verified."""
    left = [n for n in numbers if not exists(spark, f"{backup}/verified/{n}")]
    there = [n for n in left if exists(spark, table.folder(n))]
    if there:
        rows = table.read(spark, there)
        path = f"{backup}/rows"
        for n in there:  # what a run that was stopped has left
            remove(spark, f"{path}/{FOLDER}={n}")
        rows.repartition(FOLDER).write.mode("append").option("compression", "gzip").partitionBy(FOLDER).parquet(path)
        own, copied = _sums(rows), _sums(spark.read.option("basePath", path).parquet(*[f"{path}/{FOLDER}={n}" for n in there]))
        if wrong := sorted(n for n in there if own.get(n) != copied.get(n)):
            raise RuntimeError(f"the copies of partitions {wrong} are not what was copied; nothing was dropped")
        for n in there:
            touch(spark, f"{backup}/verified/{n}")


def archive_partitions(spark: SparkSession, messages: IdPartitions, skipped: IdPartitions, metadata: IdPartitions, archived: DataFrame, backup: str, read_mode: str = "DEFAULT", partition_mode: str = "DEFAULT") -> list[int]:
    """Drop the message partitions of ``archived`` (partition_no), and what they make superfluous.

    Partitions of skipped ids and metadata that end no later than an archived one go too;
    metadata stays where either mode is OUTBOUND. Returns the partitions dropped.
    """
    numbers = sorted(r["partition_no"] for r in archived.select("partition_no").distinct().collect())  # one row a partition
    verified_backup(spark, messages, numbers, backup)
    for n in numbers:
        remove(spark, messages.folder(n))
    last = numbers[-1] if numbers else -1
    companions = [skipped] if any(m.startswith("OUTBOUND") for m in (read_mode, partition_mode)) else [skipped, metadata]
    for table in companions:
        for n in table.numbers(spark):
            if n <= last:
                remove(spark, table.folder(n))
    return numbers
