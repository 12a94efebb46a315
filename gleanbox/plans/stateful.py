"""Jobs that keep files or state of their own, as queries: each runs as it does in operation, and is read back.

What they write goes to new folders in the shared one (sources.scratch).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F

from gleanbox.operators import relay, state
from gleanbox.plans import queries
from gleanbox.plans.registry import ORACLES, query
from gleanbox.sources.lookup import FileIndex
from gleanbox.sources.polling import IdPoll, parquet_table
from gleanbox.sources.scratch import scratch_folder
from gleanbox.streaming import pairing
from gleanbox.streaming.relay_stream import Relay
from gleanbox.streaming.state_table import StateTable

FILE_ROWS = 10_000
POLLS = 8
CHANGE_BATCHES = 4
CYCLES = 2


def _written(table, name):
    """A table as files in order of id, as an outbox grows."""
    path = scratch_folder(table.sparkSession, name)
    table.repartitionByRange("id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return path


@query("messages sidelined_messages", "select id, message_id, group_id, message from messages where message_id in (select message_id from sidelined_messages)")
def indexed_lookup(c, messages, sidelined):
    """Messages of the sidelined rows, found through the index of files."""
    path = _written(messages, "messages")
    index = FileIndex(path, scratch_folder(c.spark, "index"))
    index.refresh(c.spark)
    return index.find(sidelined.select("message_id")).select("id", "message_id", "group_id", "message")


@query(
    "message_meta_data",
    f"select id, message_id, id // ((select max(id) from message_meta_data) // {POLLS} + 1) as batch from message_meta_data",
)
def polled_ranges(c, metadata):
    """Metadata as a poll by id reads it, with the batch that read each row; the ranges are read back from what the poll recorded."""
    path = _written(metadata, "metadata")
    width = (metadata.agg(F.max("id")).first()[0] or 0) // POLLS + 1
    poll = IdPoll(parquet_table(path), scratch_folder(c.spark, "polls"), width)
    for batch in range(POLLS + 1):
        lo, hi = poll.range_of(c.spark, batch)
        if lo == hi:
            break
    if not batch:
        return metadata.limit(0).select("id", "message_id", F.lit(0).cast("long").alias("batch"))
    ranges = c.spark.read.parquet(*[poll.path(b) for b in range(batch)]).withColumn("batch", F.regexp_extract(F.input_file_name(), r"/v=(\d+)/", 1).cast("long"))
    rows = c.spark.read.parquet(path)
    return rows.join(F.broadcast(ranges), (rows.id > F.col("lo")) & (rows.id <= F.col("hi"))).select("id", "message_id", "batch")  # a row a batch


@query("messages responses sidelined_groups sidelined_messages", None)
def sidelined_versions(c, messages, responses, groups, sidelined):
    """The sidelined table after several batches of changes, kept as change files and snapshots."""
    schema = "id bigint, group_id string, message_id string, status string, created_at timestamp, updated_at timestamp, http_status_code int, sideline_reason_code string, retries int, details string"
    own = sidelined.schema["created_at"].dataType.simpleString()
    table = StateTable(scratch_folder(c.spark, "sidelined"), schema.replace("timestamp", own), "message_id", every=2, buckets=4)
    table.write(sidelined, 0)
    outcome = relay.relay_outcome(messages, responses, groups).filter("outcome = 'SIDELINED'")
    path = scratch_folder(c.spark, "outcome")
    outcome.select("message_id", "group_id", "id", F.lit("SIDELINED").alias("status"), F.col("reason").alias("sideline_reason_code"), "http_status_code", "retries", "details").write.parquet(path)
    for k in range(CHANGE_BATCHES):
        changes = c.spark.read.parquet(path).filter(F.col("id") % CHANGE_BATCHES == k)
        known = table.read(c.spark, k, keys=changes)
        table.write(state.sideline_changes(known, changes, c.as_of), k + 1)
    return table.read(c.spark, CHANGE_BATCHES)


ORACLES["sidelined_versions"] = ORACLES["sideline_upsert"]


@query(
    "message_meta_data messages",
    """select 'JOINED' as outcome, d.id as app_sequence_id, m.id, m.message_id, m.message, m.group_id from message_meta_data d join messages m on d.message_id = m.message_id
    union all select 'NO_PAYLOAD', d.id, null, d.message_id, null, null from message_meta_data d where d.message_id not in (select message_id from messages) and epoch_ms(d.created_at) <= (
      select epoch_ms(max(t)) - 1800000 from (select max(created_at) as t from message_meta_data union all select max(created_at) from messages) x)
    union all select 'NO_METADATA', null, m.id, m.message_id, m.message, m.group_id from messages m where m.message_id not in (select message_id from message_meta_data) and epoch_ms(m.created_at) <= (
      select epoch_ms(max(t)) - 1800000 from (select max(created_at) as t from message_meta_data union all select max(created_at) from messages) x)""",
)
def paired_streams(c, metadata, messages):
    """Metadata and payload as two streams: joined, or told to have come alone."""
    spark = c.spark

    def stream(table, name):
        path = _written(table.withColumn("created_at", F.col("created_at").cast("timestamp")), name)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    pairs = pairing.Pairs(scratch_folder(spark, "paired"))
    rows = pairing.both(stream(metadata, "metadata"), stream(messages.select("id", "message_id", "message", "group_id", "created_at"), "payload"))
    rows.writeStream.foreachBatch(pairs.handle).option("checkpointLocation", scratch_folder(spark, "paired-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return pairs.told(spark).drop("created_at")


def _answers_in_payload(part: pd.DataFrame) -> pd.DataFrame:
    """A sender whose messages say what is to be answered."""
    return pd.DataFrame([json.loads(m) for m in part["message"]], columns=["status_code", "error", "body"])


@query(
    "messages responses",
    f"""select id, message_id, group_id, reason, http_status_code, retries, details from (
      with sidelined_groups as (select cast(null as varchar) as group_id where false) select * from {queries._OUTCOME_SQL} o) z where outcome = 'SIDELINED'""",
)
def relay_cycles(c, messages, responses):
    """What a running relay has sidelined after some cycles over the table, fed by a poll and sending in order."""
    spark = c.spark
    told = messages.select("id", "message_id", "group_id", "created_at").join(responses.select("id", "status_code", "error", "body"), "id", "left")
    answer = F.to_json(F.struct(F.coalesce("status_code", F.lit(500)).alias("status_code"), "error", "body"))
    path = _written(told.select("id", "message_id", "group_id", F.col("created_at").cast("timestamp").alias("created_at"), answer.alias("message")), "answers")
    width = (messages.agg(F.max("id")).first()[0] or 0) // CYCLES + 1
    poll = IdPoll(parquet_table(path), scratch_folder(spark, "cycles"), width)
    relay_ = Relay(scratch_folder(spark, "relay"), _answers_in_payload, lanes=8, cycle_rows=width, now=c.as_of)
    last = -1
    for cycle in range(CYCLES + 1):
        lo, hi = poll.range_of(spark, cycle)
        if lo == hi:
            break
        relay_.handle(poll.rows(spark, cycle), cycle)
        last = cycle
    rows = relay_.state(spark, "sidelined", last)
    return rows.select("id", "message_id", "group_id", F.col("sideline_reason_code").alias("reason"), "http_status_code", "retries", "details")
