"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many slim rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; every query reads its inputs through Spark, whatever store they are in."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only a local master, which has no other machines, gets a folder of its own if that is unset.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        told = tempfile.mkdtemp(prefix="gleanbox-")
        spark.sparkContext.setCheckpointDir(told)
    return f"{told.rstrip('/')}/gleanbox-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a materialized table of which nothing will be read any more."""
    spark, root = df.sparkSession, shared_dir(df.sparkSession)
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"/{root.rpartition('/')[2]}/" in file:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_materialized(spark: SparkSession) -> None:
    """Delete what materialize() wrote in this application; call it when results have been consumed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``row``, a struct of all columns, and the named ones beside it.

    Whatever the caller's columns are called, helper columns can't clash with them; a
    final select("row.*") gives them back.
    """
    return docs.select(F.struct("*").alias("row"), *columns)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", each: Column | None = None) -> DataFrame:
    """Join with a broadcast only if the counted small side is within BROADCAST_ROWS.

    ``each`` says for how many slim rows a row counts, if it holds an array. The small side
    should have been materialized, since it is counted here.
    """
    rows = small.limit(BROADCAST_ROWS + 1).agg(F.sum(F.lit(1) if each is None else F.greatest(each, F.lit(1)))).first()[0] or 0
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id never gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(1)).cast("int")


# letters in lower case, digits and bytes beyond ASCII stay; all else parts words
_ALNUM = bytes(ord(chr(c).lower()) if c < 0x80 and chr(c).isalnum() else (c if c >= 0x80 else 0x20) for c in range(256))


def alnum_words(text: str) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and everything beyond ASCII."""
    return text.encode().translate(_ALNUM).split()
