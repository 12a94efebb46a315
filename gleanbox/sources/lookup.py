"""Finding messages by message_id without reading the whole message table.

An index says in which files a message_id stands. It is built from the id column alone, for
new files only, and is itself in folders by key, so a look-up reads the folders of its keys
and then opens the files that hold them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.sources.files import names

#: As the index stands on disk: the hash of a key, and the file's path.
ENTRY = "key long, file string"


@dataclass(frozen=True)
class FileIndex:
    """An index under ``base`` over the Parquet files of ``table``, in ``buckets`` folders.

    Keys are 64-bit hashes: two ids of one hash cost a file opened in vain and nothing else.
    A null id is in no file.
    """

    table: str
    base: str
    column: str = "message_id"
    buckets: int = 64

    def _bucket(self, key: Column) -> Column:
        return F.pmod(key, F.lit(self.buckets)).cast("int")

    def entries(self, spark: SparkSession) -> DataFrame:
        if not any(n.startswith("bucket=") for n in names(spark, self.base)):
            return spark.createDataFrame([], f"{ENTRY}, bucket int")
        return spark.read.schema(f"{ENTRY}, bucket int").parquet(self.base)

    def refresh(self, spark: SparkSession) -> int:
        """Index the files that are not in it yet, and tell how many these were.

        Files are not changed once written. Entries of a file that is gone are passed over by
        ``find``. One path a file reaches the driver.
        """
        every = set(spark.read.parquet(self.table).inputFiles())
        known = {r["file"] for r in self.entries(spark).select("file").distinct().collect()}
        new = sorted(every - known)
        if new:
            rows = spark.read.parquet(*new).select(F.xxhash64(self.column).alias("key"), F.input_file_name().alias("file"), F.col(self.column).isNotNull().alias("named"))
            entries = rows.filter("named").select("key", "file").distinct().withColumn("bucket", self._bucket(F.col("key")))
            # a file without ids is known too
            marks = spark.createDataFrame([(None, f, 0) for f in new], f"{ENTRY}, bucket int")
            entries.unionByName(marks).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.base)
        return len(new)

    def files(self, wanted: DataFrame) -> list[str]:
        """The files that hold a wanted id, as far as these are indexed."""
        spark = wanted.sparkSession
        keys = wanted.filter(F.col(self.column).isNotNull()).select(F.xxhash64(self.column).alias("key")).distinct().withColumn("bucket", self._bucket(F.col("key")))
        folders = [r["bucket"] for r in keys.select("bucket").distinct().collect()]  # at most a number a folder
        there = self.entries(spark).filter(F.col("bucket").isin(folders)).join(keys, ["bucket", "key"], "left_semi")
        return sorted(r["file"] for r in there.select("file").distinct().collect())

    def find(self, wanted: DataFrame) -> DataFrame:
        """Rows of the table with a wanted id, from the files that hold one."""
        spark = wanted.sparkSession
        table = spark.read.parquet(self.table)
        there = set(table.inputFiles())
        some = [f for f in self.files(wanted) if f in there]
        if not some:
            return table.limit(0)
        return spark.read.schema(table.schema).parquet(*some).join(wanted.select(self.column), self.column, "left_semi").select(*table.columns)
