"""Batches of messages to deliver, from metadata and payload tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_message(df: DataFrame) -> DataFrame:
    """One row for each message_id: the one with the largest id, as later rows overwrite earlier ones.

    Ids are picked first, from two columns; payloads are shuffled once, by message_id, which
    is how batches are joined too.
    """
    last = df.groupBy("message_id").agg(F.max("id").alias("_last"))
    return df.join(last, "message_id").filter(F.col("id") == F.col("_last")).select(*df.columns)


def metadata_batch(metadata: DataFrame, start: int, count: int, before: Column | None = None) -> DataFrame:
    """Rows with start <= id < start + count; with ``before`` only those created earlier (strictly)."""
    out = metadata.filter(F.col("id").between(start, start + count - 1))
    return out if before is None else out.filter(F.col("created_at") < before)


def message_range(messages: DataFrame, start: int, batch: int, closed: bool = True) -> DataFrame:
    """Rows with start <= id <= start + batch: one id more than the batch says, as relays read them."""
    return messages.filter(F.col("id").between(start, start + batch if closed else start + batch - 1))


def by_sequence(messages: DataFrame, wanted: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows whose id is wanted, by id. The wanted ids' range prunes the scan first."""
    ends = wanted.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    if ends["lo"] is None:
        return messages.limit(0)
    out = messages.filter(F.col("id").between(ends["lo"], ends["hi"])).join(wanted.select("id"), "id", "left_semi")
    return out if limit is None else out.orderBy("id").limit(limit)


def by_message_id(messages: DataFrame, wanted: DataFrame) -> DataFrame:
    """The last row of each wanted message_id."""
    return last_by_message(messages.join(wanted.select("message_id"), "message_id", "left_semi"))


def ids_by_message_id(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, created_at) of all rows with a wanted message_id."""
    return table.join(wanted.select("message_id"), "message_id", "left_semi").select("id", "created_at")


def next_offset(metadata: DataFrame, offset: int, before: Column | None = None) -> DataFrame:
    """The smallest id at or after the offset, with its created_at; nulls if there is none."""
    out = metadata.filter(F.col("id") >= offset)
    if before is not None:
        out = out.filter(F.col("created_at") < before)
    return out.agg(F.min(F.struct("id", "created_at")).alias("x")).select("x.id", "x.created_at")


def batch_default(metadata: DataFrame, messages: DataFrame) -> DataFrame:
    """Metadata with payload by message_id; app_sequence_id is the metadata's id. Last rows win."""
    own = last_by_message(metadata).select("message_id", F.col("id").alias("app_sequence_id"))
    return own.join(last_by_message(messages), "message_id")


def batch_sequence(metadata: DataFrame, messages: DataFrame) -> DataFrame:
    """Metadata with payload by id."""
    return metadata.select("id").join(messages, "id").withColumn("app_sequence_id", F.col("id"))


def batch_outbound(messages: DataFrame) -> DataFrame:
    """Payload rows alone."""
    return messages.withColumn("app_sequence_id", F.col("id"))


def missing_payload(metadata: DataFrame, messages: DataFrame, on: str = "message_id") -> DataFrame:
    """Metadata rows without a message, by message_id or by id."""
    return metadata.join(messages.select(on), on, "left_anti")


def claimed_unsidelined(sidelined: DataFrame, limit: int) -> DataFrame:
    """The first released rows by id. All of them go to PROCESSING, with payload or not."""
    return sidelined.filter(F.col("status") == "UNSIDELINED").orderBy("id").limit(limit).select("id", "message_id")


def unsidelined_batch(claimed: DataFrame, messages: DataFrame) -> DataFrame:
    return by_message_id(messages, claimed)


def is_eligible(last_message_time: Column, minutes: int) -> Column:
    since = last_message_time - F.make_interval(mins=F.lit(minutes))
    return (F.col("status") == "NEW") & (F.col("created_at") > since)


def eligible_skipped(skipped: DataFrame, last_message_time: Column, minutes: int) -> DataFrame:
    """NEW skipped ids created within so many minutes (strictly) before the last message's time."""
    return skipped.filter(is_eligible(last_message_time, minutes))


def skipped_recovery(eligible: DataFrame, metadata: DataFrame, messages: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """(rows to deliver, ids to mark as PROCESSING) for skipped ids that metadata now has.

    The first ``count`` found by id are taken; those without payload are marked all the same.
    """
    found = metadata.join(eligible.select("id"), "id", "left_semi").orderBy("id").limit(count)
    return batch_default(found, messages), found.select("id")


def skipped_recovery_outbound(eligible: DataFrame, messages: DataFrame, count: int) -> DataFrame:
    """Skipped ids that the message table now has; only these are marked."""
    return batch_outbound(messages.join(eligible.select("id"), "id", "left_semi").orderBy("id").limit(count))


def forced_resend(messages: DataFrame, wanted: DataFrame, batch_size: int, parallelism: int) -> DataFrame:
    """Messages of the distinct wanted ids; none at all if they are too many or one is unknown."""
    ids = wanted.select("message_id").distinct()
    known = ids.join(messages.select("message_id").distinct().withColumn("found", F.lit(True)), "message_id", "left")
    gate = known.agg((F.count(F.lit(1)) <= batch_size // parallelism).alias("fits"), F.coalesce(F.bool_and(F.coalesce("found", F.lit(False))), F.lit(True)).alias("all"))
    rows = by_message_id(messages, ids)
    return rows.join(F.broadcast(gate.filter("fits and `all`")), F.lit(True), "left_semi")  # the gate is one row


def work_queue(control: DataFrame, unsidelined: DataFrame, skipped: DataFrame, new: DataFrame, batch: int) -> DataFrame:
    """The work of one cycle: control tasks, released, skipped, then new messages, each the first ``batch`` by id.

    A kind that fills the batch ends the cycle: later kinds wait for the next one.
    """
    kinds = [("CONTROL", control), ("UNSIDELINED", unsidelined), ("SKIPPED", skipped), ("NEW", new)]
    out = full = None
    for rank, (kind, df) in enumerate(kinds):
        own = df.select(F.col("id").cast("bigint").alias("id")).orderBy("id").limit(batch)
        tagged = own.select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), "id")
        if full is not None:
            tagged = tagged.join(F.broadcast(full.groupBy().agg(F.bool_or("full").alias("full")).filter("not full")), F.lit(True), "left_semi")  # one row
        filled = own.agg((F.count(F.lit(1)) >= batch).alias("full"))
        out, full = (tagged, filled) if out is None else (out.unionByName(tagged), full.unionByName(filled))
    return out


def payload_gate(messages: DataFrame, allowed: int | None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): payloads longer than allowed are rejected, if a length is set."""
    if allowed is None:
        return messages, messages.limit(0)
    long = F.coalesce(F.length("message") > allowed, F.lit(False))
    return messages.filter(~long), messages.filter(long)
