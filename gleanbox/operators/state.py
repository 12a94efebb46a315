"""Changes of the state tables, each a function of the table and its changes to a new table.

A ``..._changes`` function gives only the rows that change, in the form of the table, for
streaming.state_table; the function beside it gives the whole new table: the rows that stay,
by an anti-join on the changes, and those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changed(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the changes: they replace the rows of their keys or are added; _gone ones go."""
    new = changes.filter("not _gone") if "_gone" in changes.columns else changes
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def sideline_changes(sidelined: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """The rows of ``changes`` as they will stand in the table: known ones keep group, id and created_at.

    ``changes``: message_id, group_id, id, status, sideline_reason_code, http_status_code,
    retries and, if both tables have it, details.
    """
    told = [c for c in ("status", "sideline_reason_code", "http_status_code", "retries", "details") if c in changes.columns and c in sidelined.columns]
    new = changes.select("message_id", *[F.col(c).alias(f"_{c}") for c in ("id", "group_id", *told)])
    joined = new.join(sidelined.withColumn("_old", F.lit(True)), "message_id", "left")
    old = F.col("_old").isNotNull()
    kept = {c: F.when(old, F.col(c)).otherwise(F.col(f"_{c}")) for c in ("id", "group_id")}
    times = {"created_at": F.when(old, F.col("created_at")).otherwise(as_of), "updated_at": as_of}
    return joined.withColumns({c: F.col(f"_{c}") for c in told} | kept | times).select(*sidelined.columns)


def sideline_upsert(sidelined: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Update rows by message_id, keeping group and created_at, or insert them."""
    return changed(sidelined, sideline_changes(sidelined, changes, as_of), "message_id")


def sidelined_groups_after(groups: DataFrame, changes: DataFrame) -> DataFrame:
    """Groups, with those of real sidelines added; holds for order alone add none."""
    real = changes.filter("sideline_reason_code <> 'GROUP_SEQ_MAINTENANCE' and group_id is not null").select("group_id").distinct()
    return groups.unionByName(real.join(groups, "group_id", "left_anti"), allowMissingColumns=True)


def _flagged(sidelined: DataFrame, on: str, wanted: DataFrame) -> DataFrame:
    """Adds _hit, true where the key is wanted. Rows with a null key are spread over the tasks."""
    flag = wanted.filter(F.col(on).isNotNull()).select(F.col(on).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    key = F.coalesce(F.col(on), F.concat(F.lit("\x00"), F.col("message_id")))
    return sidelined.withColumn("_key", key).join(flag, "_key", "left").drop("_key")


def _released(sidelined: DataFrame, on: str, wanted: DataFrame) -> DataFrame:
    flagged = _flagged(sidelined, on, wanted)
    return flagged.withColumn("status", F.when(F.col("_hit"), "UNSIDELINED").otherwise(F.col("status"))).select(*sidelined.columns)


def release_groups(sidelined: DataFrame, groups: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with those of the wanted groups UNSIDELINED, groups without the wanted ones)."""
    return _released(sidelined, "group_id", wanted), groups.join(wanted.select("group_id"), "group_id", "left_anti")


def release_messages(sidelined: DataFrame, wanted: DataFrame) -> DataFrame:
    return _released(sidelined, "message_id", wanted)


def release_ungrouped(sidelined: DataFrame, since: Column, until: Column) -> DataFrame:
    """Rows without a group, last changed in the period (ends included), are UNSIDELINED."""
    hit = F.col("group_id").isNull() & F.col("updated_at").between(since, until)
    return sidelined.withColumn("status", F.when(hit, "UNSIDELINED").otherwise(F.col("status")))


def groups_between(sidelined: DataFrame, since: Column, until: Column) -> DataFrame:
    """Distinct groups, null included, of rows last changed in the period."""
    return sidelined.filter(F.col("updated_at").between(since, until)).select("group_id").distinct()


def release_period(as_of: Column, since: Column | None = None, until: Column | None = None) -> tuple[Column, Column]:
    """The period of a release request: what isn't told is a year before ``as_of`` and a year after."""
    year = F.expr("interval 1 year")
    return (as_of - year if since is None else since), (as_of + year if until is None else until)


def release_tasks(sidelined: DataFrame, since: Column, until: Column) -> DataFrame:
    """A NEW task to release each group of the period, and one for all ungrouped messages."""
    groups = groups_between(sidelined, since, until).filter("group_id is not null")
    tasks = groups.select(F.lit("UNSIDELINE_GROUP").alias("task_type"), "group_id")
    one = sidelined.sparkSession.range(1).select(F.lit("UNSIDELINE_ALL_UNGROUPED").alias("task_type"), F.lit(None).cast("string").alias("group_id"))
    return tasks.unionByName(one).select("task_type", "group_id", F.lit("NEW").alias("status"), since.alias("from_date"), until.alias("to_date"))


def claim_control_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    return tasks.filter("status = 'NEW'").orderBy("id").limit(limit)


def merged_periods(tasks: DataFrame) -> DataFrame:
    """(from_date, to_date) of the tasks' periods, ends included, those that meet made one.

    A period without both ends, or that ends before it begins, holds nothing. The window runs
    over claimed tasks, which are a read batch.
    """
    own = tasks.filter("from_date <= to_date").select("from_date", "to_date").distinct()
    order = Window.orderBy("from_date", "to_date")
    reach = F.max("to_date").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = own.withColumn("_new", F.coalesce((F.col("from_date") > reach).cast("int"), F.lit(1)))
    runs = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy("_run").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")).drop("_run")


def released_by(sidelined: DataFrame, tasks: DataFrame) -> DataFrame:
    """message_id of the sidelined rows that claimed tasks release: groups, single messages, ungrouped rows of periods.

    Claimed tasks are a read batch, and so are their periods, which stand in one row.
    """
    of = lambda kind, key: tasks.filter((F.col("task_type") == kind) & F.col(key).isNotNull()).select(key).distinct()
    own = sidelined.select("message_id", "group_id", "updated_at")
    grouped = own.filter("group_id is not null").join(of("UNSIDELINE_GROUP", "group_id"), "group_id", "left_semi").select("message_id")
    single = own.join(of("UNSIDELINE_MESSAGE", "message_id"), "message_id", "left_semi").select("message_id")
    periods = merged_periods(tasks.filter("task_type = 'UNSIDELINE_ALL_UNGROUPED'")).agg(F.collect_list(F.struct("from_date", "to_date")).alias("_periods"))
    within = F.exists("_periods", lambda p: F.col("updated_at").between(p["from_date"], p["to_date"]))
    alone = own.filter("group_id is null").crossJoin(F.broadcast(periods)).filter(within).select("message_id")  # one row
    return grouped.unionByName(single).unionByName(alone).distinct()


def apply_control_tasks(sidelined: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sidelined rows after the claimed tasks: those that they release are UNSIDELINED."""
    return _released(sidelined, "message_id", released_by(sidelined, tasks))


def finished_tasks(tasks: DataFrame, failed_types: list[str]) -> DataFrame:
    """Claimed tasks after they ran: DONE, or FAILED where the type could not be carried out."""
    return tasks.withColumn("status", F.when(F.col("task_type").isin(failed_types), "FAILED").otherwise("DONE"))


def purge_control_tasks(tasks: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Tasks without those DONE and last changed before the day ``days`` ago."""
    old = (F.col("status") == "DONE") & (F.col("updated_at") < F.date_sub(as_of.cast("date"), days))
    return tasks.filter(~F.coalesce(old, F.lit(False)))


def reset_processing(sidelined: DataFrame, groups: DataFrame) -> DataFrame:
    """What was being processed at a restart is open again.

    With sidelined groups: rows of other groups in PROCESSING, and every row without a group
    whatever its status, become UNSIDELINED; PROCESSING rows of those groups SIDELINED.
    Without any sidelined group: PROCESSING becomes UNSIDELINED.
    """
    some = groups.agg((F.count(F.lit(1)) > 0).alias("_some"))
    joined = _flagged(sidelined, "group_id", groups).crossJoin(F.broadcast(some))  # some is one row
    busy = F.col("status") == "PROCESSING"
    with_groups = F.when(F.col("group_id").isNull(), "UNSIDELINED").when(busy & F.col("_hit"), "SIDELINED").when(busy, "UNSIDELINED")
    changed = F.when(F.col("_some"), with_groups).otherwise(F.when(busy, "UNSIDELINED"))
    return joined.withColumn("status", F.coalesce(changed, F.col("status"))).select(*sidelined.columns)


def reset_to_new(table: DataFrame) -> DataFrame:
    """Skipped ids and control tasks: PROCESSING becomes NEW."""
    return table.withColumn("status", F.when(F.col("status") == "PROCESSING", "NEW").otherwise(F.col("status")))


def skipped_changes(skipped: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Rows of the new skipped ids: NEW, or if they are there with the status and created_at that they have."""
    joined = new.select("id").distinct().join(skipped.withColumn("_old", F.lit(True)), "id", "left")
    old = F.col("_old").isNotNull()
    columns = {
        "message_seq_id": F.coalesce("message_seq_id", "id"),
        "status": F.when(old, F.col("status")).otherwise("NEW"),
        "retry_count": F.coalesce("retry_count", F.lit(0)),
        "created_at": F.when(old, F.col("created_at")).otherwise(as_of),
        "updated_at": as_of,
    }
    return joined.withColumns(columns).select(*skipped.columns)


def skipped_upsert(skipped: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New skipped ids as NEW rows; ids that are there keep status and created_at."""
    return changed(skipped, skipped_changes(skipped, new, as_of), "id")


def checkpoint_changes(checkpoints: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Lanes as they will stand: each with its new message_id, null if nothing was processed."""
    return changes.select("process_id", "message_id", as_of.cast(checkpoints.schema["updated_at"].dataType).alias("updated_at")).select(*checkpoints.columns)


def checkpoint_upsert(checkpoints: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """Each lane's message_id; lanes that are new are inserted, with null if nothing was processed."""
    return changed(checkpoints, checkpoint_changes(checkpoints, changes, as_of), "process_id")
