"""Polling a table by id: which ids a batch reads, and reading only those.

A poll's offset is the last id it has read. The range of each batch is written before the
batch is read, so a batch that runs again reads the same ids, and a poll that is started again
goes on behind the last range. Ranges are bounded by ``width`` ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gleanbox.sources.files import exists
from gleanbox.sources.outbox import read_jdbc

RANGE = "lo long, hi long, top long"
#: Rows of (spark, lo, hi): lo < id <= hi, where None is no bound.
Table = Callable[[SparkSession, int | None, int | None], DataFrame]


def within(table: DataFrame, lo: int | None, hi: int | None) -> DataFrame:
    """Rows with lo < id <= hi, as filters that reach the scan."""
    for bound in ([F.col("id") > lo] if lo is not None else []) + ([F.col("id") <= hi] if hi is not None else []):
        table = table.filter(bound)
    return table


def parquet_table(path: str) -> Table:
    return lambda spark, lo, hi: within(spark.read.parquet(path), lo, hi)


def jdbc_table(url: str, table: str, partitions: int, **options: str) -> Table:
    """A database's table; a range is read in ``partitions`` parts of equal width, by their own queries."""

    def read(spark: SparkSession, lo: int | None, hi: int | None) -> DataFrame:
        if lo is None or hi is None or hi - lo < partitions:
            return within(spark.read.format("jdbc").options(url=url, dbtable=table, **options).load(), lo, hi)
        return within(read_jdbc(spark, url, table, lo + 1, hi + 1, partitions, **options), lo, hi)

    return read


@dataclass(frozen=True)
class IdPoll:
    """The ranges of a poll, one for each batch, under ``base``; the first begins behind ``after``."""

    table: Table
    base: str
    width: int = 10_000
    after: int = -1

    def path(self, batch: int) -> str:
        return f"{self.base}/v={batch}"

    def recorded(self, spark: SparkSession, batch: int) -> tuple[int, int, int] | None:
        if batch < 0 or not exists(spark, f"{self.path(batch)}/_SUCCESS"):
            return None
        return tuple(spark.read.schema(RANGE).parquet(self.path(batch)).first())

    def range_of(self, spark: SparkSession, batch: int) -> tuple[int, int]:
        """(lo, hi) of a batch: it reads lo < id <= hi. Nothing is new if they are equal.

        The table's end is looked for only once all up to the end known before was read, so
        catching up costs no scan of the rest for each batch. Where ids are missing for more
        than a range, the next one begins at the next id there is.
        """
        if known := self.recorded(spark, batch):
            return known[:2]
        before = self.recorded(spark, batch - 1)
        lo, top = (before[1], before[2]) if before else (self.after, self.after)
        if lo >= top:
            top = max(lo, self._of(spark, F.max("id"), lo, None) or lo)
        hi = min(lo + self.width, top)
        if hi < top and self._of(spark, F.min("id"), lo, hi) is None:
            hi = min(self._of(spark, F.min("id"), hi, top) - 1 + self.width, top)
        spark.createDataFrame([(lo, hi, top)], RANGE).coalesce(1).write.mode("overwrite").parquet(self.path(batch))
        return lo, hi

    def _of(self, spark: SparkSession, end, lo: int, hi: int | None) -> int | None:
        return self.table(spark, lo, hi).agg(end.alias("id")).first()["id"]  # one row

    def rows(self, spark: SparkSession, batch: int) -> DataFrame:
        return self.table(spark, *self.range_of(spark, batch))

    def stream(self, spark: SparkSession, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 1) -> DataStreamWriter:
        """Polls every so many seconds, and hands each batch's rows to ``handle``, without rows too.

        The clock is a stream of ticks, whose checkpoint counts the batches.
        """
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def batch_of(_: DataFrame, batch: int) -> None:
            handle(self.rows(spark, batch), batch)

        return ticks.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(batch_of)
