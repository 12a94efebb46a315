"""What becomes of messages when they are sent: relayed, sidelined, or ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbox.functions.hashing import is_ungrouped, spread_key

MAX_RETRIES = 5


def is_failure(status: Column) -> Column:
    """No 2xx status. A message without a response met a sender error, which counts as 500."""
    return F.floor(F.coalesce(status, F.lit(500)) / 100) != 2


def is_ignored(status: Column, ignore_4xx: bool, ignore_non_4xx: bool) -> Column:
    """Failures that a relay is told to pass over: 4xx and others apart."""
    four = F.floor(F.coalesce(status, F.lit(500)) / 100) == 4
    return is_failure(status) & ((four & F.lit(ignore_4xx)) | (~four & F.lit(ignore_non_4xx)))


def answers(responses: DataFrame) -> DataFrame:
    """id, status_code, error and body of responses; the last two are null where not given.

    An error is told by the relay itself: the message never became a request.
    """
    have = {c.lower() for c in responses.columns}
    more = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("error", "body")]
    return responses.select("id", "status_code", *more)


def relay_outcome(messages: DataFrame, responses: DataFrame, sidelined_groups: DataFrame, ignore_4xx: bool = False, ignore_non_4xx: bool = False) -> DataFrame:
    """id, message_id, group_id, outcome, reason, http_status_code, retries, details of new messages.

    Ungrouped messages stand alone. In a group, ids ascend: up to the first failure messages
    are relayed, the failure is sidelined, and what follows is sidelined unsent. A group that
    is sidelined already has all its messages sidelined. Ignored failures leave their group
    open. An error of the relay itself is a failure that can't be ignored, with code 0, no
    retries and the error as details. The first failures are few rows, gathered with a partial aggregate and joined back,
    so a group with very many messages is not brought into one task.
    """
    told = answers(responses).withColumnsRenamed({"status_code": "_status", "error": "_error", "body": "_body"})
    sent = messages.join(told, "id", "left")
    own, code = F.col("_error").isNotNull(), F.coalesce("_status", F.lit(500))
    sent = sent.withColumns({"_code": F.when(own, 0).otherwise(code), "_alone": is_ungrouped(F.col("group_id")), "_failed": own | is_failure(F.col("_status")), "_ignored": ~own & is_ignored(F.col("_status"), ignore_4xx, ignore_non_4xx)})
    bad = sent.filter("_failed and not _ignored and not _alone")
    first = bad.groupBy("group_id").agg(F.min("id").alias("fail_id"))
    closed = sidelined_groups.select("group_id").distinct().withColumn("fail_id", F.lit(-1).cast("bigint"))
    # a group that was sidelined before counts as failed before its first message
    stop = first.unionByName(closed).groupBy("group_id").agg(F.min("fail_id").alias("fail_id"))
    stop = stop.withColumnRenamed("group_id", "_key")
    joined = sent.withColumn("_key", spread_key(F.col("group_id"), F.col("message_id"))).join(stop, "_key", "left").withColumn("_stop", F.col("fail_id"))
    held = F.col("_stop").isNotNull() & (F.col("id") > F.col("_stop"))
    outcome = F.when(held, "SIDELINED").when(F.col("_ignored"), "IGNORED").when(F.col("_failed"), "SIDELINED").otherwise("RELAYED")
    real, own = ~held & F.col("_failed") & ~F.col("_ignored"), F.col("_error").isNotNull()
    reason = F.when(held, "GROUP_SIDELINED").when(real & own, "RELAYER_ERROR").when(real, "HTTP_ERROR")
    return joined.select(
        "id",
        "message_id",
        "group_id",
        outcome.alias("outcome"),
        reason.alias("reason"),
        F.when(real, F.col("_code")).when(held, F.lit(0)).cast("int").alias("http_status_code"),
        F.when(real & ~own, F.lit(MAX_RETRIES)).when(held | real, F.lit(0)).cast("int").alias("retries"),
        F.when(held, "").when(real, F.coalesce("_error", "_body", F.lit(""))).alias("details"),
    )


def skipped_left(skipped: DataFrame, outcome: DataFrame) -> DataFrame:
    """Skipped rows after their delivery: relayed, sidelined or held back, a row is deleted.

    An ignored failure keeps it.
    """
    done = outcome.filter("outcome <> 'IGNORED'").select("id")
    return skipped.join(done, "id", "left_anti")


def unsidelined_left(sidelined: DataFrame, outcome: DataFrame) -> DataFrame:
    """Sidelined rows after released ones were delivered, by the outcome of their groups' drain.

    Relayed rows are deleted, the last one of a group too; a failed one is SIDELINED again
    with its code and retries; one that is held back gets what its group's state says: it
    stays UNSIDELINED for the group's order, or is SIDELINED with its group. An ignored one
    stays as it is.
    """
    status = F.col("status") if "status" in outcome.columns else F.lit("SIDELINED")
    result = outcome.select("message_id", "outcome", status.alias("_status"), F.col("reason").alias("_reason"), F.col("http_status_code").alias("_code"), F.col("retries").alias("_retries"))
    joined = sidelined.join(result, "message_id", "left").filter(F.coalesce(F.col("outcome") != "RELAYED", F.lit(True)))
    again = F.coalesce(F.col("outcome").isin("SIDELINED", "HELD"), F.lit(False))
    pick = lambda new, old: F.when(again, F.col(new)).otherwise(F.col(old))
    changed = {"status": pick("_status", "status"), "sideline_reason_code": pick("_reason", "sideline_reason_code"), "http_status_code": pick("_code", "http_status_code"), "retries": pick("_retries", "retries")}
    return joined.withColumns(changed).select(*sidelined.columns)


def forced_status(forced: DataFrame, responses: DataFrame) -> DataFrame:
    """message_id and destination_response_status of a forced re-send: 200, the HTTP code, or 500."""
    joined = forced.join(responses.select("id", "status_code"), "id", "left")
    code = F.when(~is_failure(F.col("status_code")), F.lit(200)).otherwise(F.coalesce("status_code", F.lit(500)))
    return joined.select("message_id", code.cast("int").alias("destination_response_status"))
