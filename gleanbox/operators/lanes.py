"""Lanes of ordered delivery, their checkpoints, and replay between checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.functions.hashing import bucket, is_ungrouped, lane_name, sequencing_key, spread_key
from gleanbox.operators.gaps import BLOCK


def with_bucket(messages: DataFrame, lanes: int, algorithm: str = "java") -> DataFrame:
    """Adds the lane number. Hashing is per character, so each group's key is hashed once.

    Messages without a group have a key of their own and are hashed where they stand; blank
    groups, whose key is the blank text itself, are too.
    """
    group = F.col("group_id")
    groups = messages.select("group_id").filter(~is_ungrouped(group)).distinct()
    groups = groups.select(group.alias("_key"), bucket(group, lanes, algorithm).alias("_bucket"))
    joined = messages.withColumn("_key", spread_key(group, F.col("message_id"))).join(groups, "_key", "left")
    own = bucket(sequencing_key(group, F.col("message_id")), lanes, algorithm)
    return joined.withColumn("bucket", F.when(is_ungrouped(group), own).otherwise(F.col("_bucket"))).select(*messages.columns, "bucket")


def lane_checkpoints(processed: DataFrame, relay: str = "default", old: DataFrame | None = None) -> DataFrame:
    """(process_id, message_id) of each lane's last processed row (bucket, id, message_id).

    With the old checkpoints only lanes whose message changed are given.
    """
    new = processed.groupBy("bucket").agg(F.max_by("message_id", "id").alias("message_id"))
    new = new.select(lane_name(relay, F.col("bucket")).alias("process_id"), "message_id")
    if old is None:
        return new
    same = new["process_id"].eqNullSafe(old["process_id"]) & new["message_id"].eqNullSafe(old["message_id"])
    return new.join(old, same, "left_anti")


def checkpoint_positions(checkpoints: DataFrame, table: DataFrame) -> DataFrame:
    """(process_id, id): each checkpoint's message in metadata or messages, its last row."""
    named = checkpoints.filter("message_id is not null").select("process_id", "message_id")
    return table.select("message_id", "id").join(named, "message_id").groupBy("process_id").agg(F.max("id").alias("id"))


def resume_offset(checkpoints: DataFrame, table: DataFrame) -> DataFrame:
    """The smallest checkpointed id and its created_at; id 0 if there is none."""
    named = checkpoints.filter("message_id is not null").select("message_id").distinct()
    found = table.join(named, "message_id", "left_semi").agg(F.min(F.struct("id", "created_at")).alias("x"))
    return found.select(F.coalesce("x.id", F.lit(0)).cast("bigint").alias("id"), "x.created_at")


def replay_set(positions: DataFrame, messages: DataFrame, lanes: int, relay: str = "default") -> DataFrame:
    """Rows to send again after a restart: ids from the smallest checkpoint up to the largest.

    A row goes out if its lane has no checkpoint or its id lies beyond it. The largest
    checkpoint itself is left to normal reading. One position a lane: a bounded table.
    """
    ends = positions.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if ends["lo"] is None:
        return with_bucket(messages, lanes).limit(0)
    window = messages.filter((F.col("id") >= ends["lo"]) & (F.col("id") < ends["hi"]))
    placed = with_bucket(window, lanes).withColumn("process_id", lane_name(relay, F.col("bucket")))
    own = placed.join(F.broadcast(positions.withColumnRenamed("id", "checkpoint")), "process_id", "left")
    return own.filter(F.col("checkpoint").isNull() | (F.col("id") > F.col("checkpoint"))).drop("checkpoint", "process_id")


def stale_checkpoints(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Checkpoints of lanes that are no longer wanted."""
    return checkpoints.join(wanted.select("process_id"), "process_id", "left_anti")


def new_lanes(checkpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted lanes that have no checkpoint row yet."""
    return wanted.select("process_id").distinct().join(checkpoints, "process_id", "left_anti")


def group_order(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds group_seq, a message's place in its group. Ungrouped messages have no order.

    Places are counted within blocks of ids; what a group has in the blocks before comes from
    a table of one row per group and block. So a group of very many messages is spread.
    """
    grouped = messages.filter(~is_ungrouped(F.col("group_id"))).withColumn("_block", F.floor(F.col("id") / block))
    counts = grouped.groupBy("group_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("group_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("group_id", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("group_id", "_block").orderBy("id"))
    return grouped.join(counts, ["group_id", "_block"]).withColumn("group_seq", (F.col("_before") + place).cast("bigint")).select(*messages.columns, "group_seq")
