"""Reading and writing outbox tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.functions.envelope import transaction_id
from gleanbox.schemas import LEGACY, OUTBOX, conform


def read_jdbc(spark: SparkSession, url: str, table: str, lower: int, upper: int, partitions: int, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of id."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn="id", lowerBound=str(lower), upperBound=str(upper), numPartitions=str(partitions), **options)
    return reader.load()


def outbox_projection(messages: DataFrame) -> DataFrame:
    return conform(messages, OUTBOX)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    return outbox_projection(spark.read.parquet(path))


def shard_merge(shards: list[DataFrame], count: int | None = None) -> DataFrame:
    """Metadata rows of several shards: one for each id (the least by value), by id, the first ``count``."""
    rows = shards[0]
    for shard in shards[1:]:
        rows = rows.unionByName(shard)
    others = [c for c in rows.columns if c != "id"]
    merged = rows.groupBy("id").agg(F.min(F.struct(*others)).alias("x")).select("id", "x.*")
    return merged if count is None else merged.orderBy("id").limit(count)


def new_outbox_rows(messages: DataFrame, as_of: Column) -> DataFrame:
    """Client messages as outbox rows; created_at is the time of writing, txn_id the transaction."""
    renamed = messages.withColumn("transaction_id", F.col("txn_id")) if "txn_id" in messages.columns else messages
    return conform(renamed.drop("created_at").withColumn("created_at", as_of), {k: v for k, v in OUTBOX.items() if k != "id"})


def append_messages(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def metadata_rows(messages: DataFrame, written: DataFrame) -> DataFrame:
    """(id, message_id) of the messages just written, for the metadata table."""
    return messages.select("id", "message_id").join(written.select("message_id"), "message_id", "left_semi").select("id", "message_id")


def metadata_rows_with_shard(messages: DataFrame, written: DataFrame, shard_keys: DataFrame) -> DataFrame:
    """The same with the shard_key of each message_id, null if there is none."""
    return metadata_rows(messages, written).join(shard_keys.select("message_id", "shard_key"), "message_id", "left").select("id", "message_id", "shard_key")


def legacy_projection(messages: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the older one-table layout; times of the message, else of writing."""
    own = messages.columns
    filled = messages.withColumns({
        "created_at": F.coalesce(F.col("created_at") if "created_at" in own else F.lit(None), as_of),
        "updated_at": F.coalesce(F.col("updated_at") if "updated_at" in own else F.lit(None), as_of),
        "txn_id": F.coalesce(F.col("txn_id") if "txn_id" in own else F.lit(None).cast("string"), transaction_id(F.col("message_id"))),
        "context": F.coalesce(F.col("context") if "context" in own else F.lit(None).cast("string"), F.lit("")),
        "relayed": F.coalesce(F.col("relayed") if "relayed" in own else F.lit(None).cast("boolean"), F.lit(False)),
        "retries": F.coalesce(F.col("retries") if "retries" in own else F.lit(None).cast("int"), F.lit(0)),
    })
    return conform(filled, LEGACY)


def write_layouts(messages: DataFrame, as_of: Column, outbox_path: str | None = None, legacy_path: str | None = None) -> None:
    """Write one or both layouts; the older one for a single database, the outbox for several."""
    rows = messages.persist() if outbox_path and legacy_path else messages
    if legacy_path:
        append_messages(legacy_projection(rows, as_of), legacy_path)
    if outbox_path:
        append_messages(new_outbox_rows(rows, as_of), outbox_path)
    rows.unpersist()


def find_message(messages: DataFrame, message_id: str) -> DataFrame:
    return outbox_projection(messages.filter(F.col("message_id") == message_id))


def backup_range(messages: DataFrame, start: int, end: int, path: str) -> int:
    """Copy rows of an id range to compressed files; the count is verified before anything is dropped."""
    rows = messages.filter(F.col("id").between(start, end))
    rows.write.mode("overwrite").option("compression", "gzip").parquet(path)
    kept, expected = messages.sparkSession.read.parquet(path).count(), rows.count()
    if kept != expected:
        raise RuntimeError(f"backup holds {kept} of {expected} rows")
    return kept


Answer = tuple[int | None, str | None, str | None]


def answers_of(send: Callable[[pd.DataFrame], object], part: pd.DataFrame) -> list[Answer]:
    """(status_code, error, body) of each row that a user's sender was given.

    ``send`` returns status codes, or a frame with status_code and, where known, error and
    body. If it raises on several rows, they are handed to it one by one, so that only those
    it raises on count as 500; such a row may be sent twice.
    """
    try:
        told = send(part)
    except Exception as failure:  # a sender's failure is a delivery failure
        if len(part) == 1:
            return [(500, None, str(failure))]
        return [a for k in range(len(part)) for a in answers_of(send, part.iloc[k : k + 1])]
    frame = told if isinstance(told, pd.DataFrame) else pd.DataFrame({"status_code": list(told)})
    if len(frame) != len(part):
        raise ValueError(f"the sender answered {len(frame)} of {len(part)} messages")
    pick = lambda c: [None if pd.isna(x) else x for x in frame[c]] if c in frame else [None] * len(frame)
    return [(None if code is None else int(code), error, body) for code, error, body in zip(pick("status_code"), pick("error"), pick("body"), strict=True)]


def deliver(requests: DataFrame, send: Callable[[pd.DataFrame], object], slice_rows: int = 100) -> DataFrame:
    """(id, message_id, status_code) of requests handed to a user's sender in slices, in no order.

    For messages that have none, such as forced ones; sources.ordered keeps the order of
    groups. Delivery is at least once.
    """

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for k in range(0, len(pdf), slice_rows):
                part = pdf.iloc[k : k + slice_rows]
                yield pd.DataFrame({"id": part["id"], "message_id": part["message_id"], "status_code": pd.array([a[0] for a in answers_of(send, part)], dtype="Int32")})

    return requests.mapInPandas(batches, "id bigint, message_id string, status_code int")


def keyed_requests(requests: DataFrame) -> DataFrame:
    """(key, value) for a broker: rows of a sequencing key have one key and come from one task, by id.

    Rows without a key need no order, and are spread over all tasks.
    """
    spread = F.when(F.col("sequencing_key").isNull(), F.xxhash64("id")).otherwise(F.xxhash64(F.col("sequencing_key").cast("string")))
    dealt = requests.repartition(spread).sortWithinPartitions("sequencing_key", "id")
    return dealt.select(F.col("sequencing_key").cast("string").alias("key"), F.col("message").cast("string").alias("value"))


def to_kafka(requests: DataFrame, servers: str, topic: str, format: str = "kafka") -> None:
    """Write requests to a broker; its one partition for a key keeps the order in which a task writes them."""
    keyed_requests(requests).write.mode("append").format(format).option("kafka.bootstrap.servers", servers).option("topic", topic).save()
