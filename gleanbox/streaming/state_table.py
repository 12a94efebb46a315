"""A keyed table that changes batch by batch: change files, merged on reading, compacted now and then."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.sources.files import exists, remove


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, known as such when a query is planned, so that joins with it fall away."""
    columns = [c.split() for c in schema.split(", ")]
    return spark.sql("select " + ", ".join(f"cast(null as {t}) as {c}" for c, t in columns) + " where false")


@dataclass(frozen=True)
class StateTable:
    """Versions of a table under ``base``, one for each batch, numbered from 0.

    A batch writes the rows it changes and the keys that go (``_gone``): work in proportion to
    them. A version is the last snapshot before it and the changes since: of a key the latest
    row counts. Changes are few beside a snapshot, so a reader joins them with a broadcast
    where Spark finds them small and the snapshot is not shuffled. Every ``every`` batches
    the merged table is written as a snapshot, in ``buckets`` folders by key, and what was
    before the snapshot of the cycle before is removed. Paths depend on the batch's number
    alone, so a batch that runs again writes the same, and what the version before it needs
    stays until the next cycle has ended.
    """

    base: str
    schema: str
    key: str
    every: int = 10
    buckets: int = 8

    def snapshot_of(self, version: int) -> int:
        """The last version, up to this one, that has a snapshot; -1 for the empty table."""
        return (version + 1) // self.every * self.every - 1

    def changes_path(self, version: int) -> str:
        return f"{self.base}/changes/v={version}"

    def snapshot_path(self, version: int) -> str:
        return f"{self.base}/snapshot/v={version}"

    @property
    def columns(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _merged(self, spark: SparkSession, start: int, version: int, keys: DataFrame | None = None) -> DataFrame:
        """The snapshot ``start`` with the changes up to ``version``."""
        known, rest = f"{self.schema}, _gone boolean", [c for c in self.columns if c != self.key]
        changes = nothing(spark, f"{known}, _v int")
        for v in range(start + 1, version + 1):
            changes = changes.unionByName(spark.read.schema(known).parquet(self.changes_path(v)).withColumn("_v", F.lit(v)))
        old = nothing(spark, f"{self.schema}, _bucket int")
        if start >= 0:
            old = spark.read.schema(f"{self.schema}, _bucket int").parquet(self.snapshot_path(start))
        if keys is not None:
            wanted = self._with_bucket(keys.select(self.key).distinct())
            old, changes = old.join(wanted, ["_bucket", self.key], "left_semi"), changes.join(wanted, self.key, "left_semi")
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest, "_gone"), "_v").alias("_x"))
        fresh = last.filter("not _x._gone").select(self.key, "_x.*")
        return old.select(*self.columns).join(last.select(self.key), self.key, "left_anti").unionByName(fresh.select(*self.columns)).select(*self.columns)

    def read(self, spark: SparkSession, version: int, keys: DataFrame | None = None) -> DataFrame:
        """The table as the batch ``version`` left it; with ``keys`` only those keys' rows."""
        return self._merged(spark, self.snapshot_of(version), version, keys)

    def write(self, changes: DataFrame, version: int) -> None:
        """Write a batch's changes, one row a key, and the snapshot if it is time for one."""
        spark = changes.sparkSession
        gone = F.coalesce(F.col("_gone"), F.lit(False)) if "_gone" in changes.columns else F.lit(False)
        changes.select(*self.columns, gone.alias("_gone")).write.mode("overwrite").parquet(self.changes_path(version))
        if self.snapshot_of(version) == version:
            merged = self._merged(spark, self.snapshot_of(version - 1), version)
            self._with_bucket(merged).repartition(self.buckets, "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self.snapshot_path(version))
            self._remove_before(spark, version - self.every)

    def _remove_before(self, spark: SparkSession, snapshot: int) -> None:
        """Removes what no version from ``snapshot`` on needs."""
        for v in range(max(0, snapshot - self.every), snapshot + 1):
            remove(spark, self.changes_path(v))
        if snapshot - self.every >= 0 and exists(spark, self.snapshot_path(snapshot - self.every)):
            remove(spark, self.snapshot_path(snapshot - self.every))
