"""Retention of id-range partitions.

Two keys, never mixed: rules see a partition as [bound - size + 1, bound], while the row
whose id is a bound is stored in the partition after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.functions.times import whole_hours


def rule_partition(id_: Column, size: int) -> Column:
    return F.floor((id_ - 1) / size).cast("bigint")


def storage_partition(id_: Column, size: int) -> Column:
    return F.floor(id_ / size).cast("bigint")


def partition_stats(messages: DataFrame, size: int) -> DataFrame:
    """Per rule partition: bounds, rows, and created_at of the row with the largest id."""
    stats = messages.groupBy(rule_partition(F.col("id"), size).alias("partition_no")).agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("created_at", "id").alias("last_created_at"))
    return stats.select("partition_no", (F.col("partition_no") * size + 1).alias("start_id"), ((F.col("partition_no") + 1) * size).alias("end_id"), "n_rows", "last_created_at")


def sidelined_partitions(sidelined: DataFrame, messages: DataFrame, size: int) -> DataFrame:
    """Partitions that hold a message of a sidelined row, whatever its status."""
    found = messages.select("message_id", "id").join(sidelined.select("message_id"), "message_id", "left_semi")
    return found.select(rule_partition(F.col("id"), size).alias("partition_no")).distinct()


def skipped_partitions(skipped: DataFrame, messages: DataFrame, size: int) -> DataFrame:
    """Partitions that hold a message of a skipped id that is NEW or PROCESSING."""
    live = skipped.filter(F.col("status").isin("NEW", "PROCESSING")).select(F.col("message_seq_id").alias("id"))
    return messages.select("id").join(live, "id", "left_semi").select(rule_partition(F.col("id"), size).alias("partition_no")).distinct()


def archivable_partitions(messages: DataFrame, sidelined: DataFrame, checkpoints: DataFrame, as_of: Column, keep_hours: int, size: int) -> DataFrame:
    """Partitions that can go: old, below the last id, without pending and sidelined messages.

    From the oldest on, up to the first that is too young or reaches the last id. Pending
    means that some checkpointed message lies below the partition's end; its start plays no
    part. The window runs over one row per partition.
    """
    stats = partition_stats(messages, size)
    named = checkpoints.filter("message_id is not null").select("message_id").distinct()
    least = messages.join(named, "message_id", "left_semi").agg(F.min("id").alias("least_id"))
    top = messages.agg(F.max("id").alias("top_id"))
    flags = sidelined_partitions(sidelined, messages, size).withColumn("sidelined", F.lit(True))
    rows = stats.join(flags, "partition_no", "left").crossJoin(F.broadcast(least)).crossJoin(F.broadcast(top))  # one row each
    young = (whole_hours(as_of, F.col("last_created_at")) < keep_hours) | (F.col("end_id") >= F.col("top_id"))
    stopped = F.max(young.cast("int")).over(Window.orderBy("start_id"))
    pending = F.coalesce(F.col("least_id") < F.col("end_id"), F.lit(False))
    rows = rows.withColumns({"_stopped": stopped, "_pending": pending})
    return rows.filter((F.col("_stopped") == 0) & ~F.col("_pending") & F.col("sidelined").isNull()).select("partition_no", "start_id", "end_id", "n_rows", "last_created_at")


def retained_rows(table: DataFrame, archived: DataFrame, size: int, mode: str = "DEFAULT", is_metadata: bool = False) -> DataFrame:
    """Skipped-id or metadata rows that stay when message partitions go.

    Partitions with an end up to an archived end go too. Metadata stays as it is in
    OUTBOUND_READER mode.
    """
    if is_metadata and mode == "OUTBOUND_READER":
        return table
    last = archived.agg(F.max("end_id").alias("_gone"))
    kept = table.crossJoin(F.broadcast(last))  # one row
    end = (rule_partition(F.col("id"), size) + 1) * size
    return kept.filter(F.col("_gone").isNull() | (end > F.col("_gone"))).select(*table.columns)


def partition_plan(messages: DataFrame, last_end: int, size: int, extra: int) -> DataFrame:
    """end_id of the partitions to create, so that ``extra`` are spare, less one as relays do.

    An empty message table needs none. Division truncates.
    """
    used_end = (F.floor(F.max("id") / size) + 1) * size - 1
    empty = ((F.lit(last_end) - used_end) / size).cast("bigint")
    needed = messages.agg((F.lit(extra) - empty - 1).cast("bigint").alias("n")).filter("n > 0")
    return needed.select(F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("k")).select((F.col("k") * size + last_end).alias("end_id"))
