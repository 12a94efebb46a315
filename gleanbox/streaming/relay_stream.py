"""Continuous relay as Structured Streaming jobs over the outbox.

New rows arrive as files (or from a change feed); a micro-batch stands for a read batch, and
checkpointLocation for the resume offset: delivery is at least once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from gleanbox.functions.hashing import is_ungrouped
from gleanbox.operators import drain, gaps, lanes, state
from gleanbox.sources import ordered
from gleanbox.sources.files import exists, names, remove, touch
from gleanbox.streaming.state_table import StateTable, nothing

#: How long a missing id is waited for, and how long metrics wait for late rows.
LATE = "30 minutes"
#: Rows that a relay gets: messages (NEW), and control tasks (CONTROL), whose columns the others leave null.
INPUT = "kind string, id long, message_id string, message string, group_id string, created_at timestamp, task_type string, from_date timestamp, to_date timestamp"
#: Tables that a relay keeps between micro-batches as changes, with their keys.
STATE = {
    "sidelined": ("id long, group_id string, message_id string, status string, created_at timestamp, updated_at timestamp, http_status_code int, sideline_reason_code string, retries int, details string", "message_id"),
    "groups": ("group_id string, status string, last_id long", "group_id"),
    "skipped": ("start_id long, end_id long, status string, created_at timestamp", "start_id"),
    "checkpoints": ("process_id string, message_id string, updated_at timestamp", "process_id"),
    "tasks": ("id long, task_type string, status string, updated_at timestamp", "id"),
}
#: Tables of which each batch writes a whole version: rows held for the next batch, and how far new ids were read.
WHOLE = {"held": INPUT, "position": "id long, created_at timestamp"}
#: What a batch writes so that it is computed once.
STEPS = ("began", "reset", "ready", "claimed", "released", "unsidelined", "new", "late", "work")
#: Control tasks that a relay can't carry out.
UNKNOWN_TASKS = {"MANAGE_PARTITION"}


def input_rows(rows: DataFrame) -> DataFrame:
    """Rows with the columns of ``INPUT``; without a kind they are new messages."""
    have = {c.lower() for c in rows.columns}
    pairs = [c.split() for c in INPUT.split(", ")]
    picked = [(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in pairs]
    return rows.select(*picked).withColumn("kind", F.coalesce("kind", F.lit("NEW")))


def relay_input(messages: DataFrame, control_tasks: DataFrame | None = None) -> DataFrame:
    """One stream of new messages and new control tasks for a relay."""
    rows = input_rows(messages)
    if control_tasks is None:
        return rows
    return rows.unionByName(input_rows(control_tasks.withColumn("kind", F.lit("CONTROL"))))


def read_outbox(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 1) -> DataFrame:
    """New outbox files; ``files_per_trigger`` bounds a batch as a relay's batch size does."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class GroupState(StatefulProcessor):
    """A group's (status, last sidelined id), kept for as long as the group is not open.

    A sidelined group waits for its release, however long; a released one drains, and its
    state goes with its last message. If that message never comes, the state of a released
    group goes ``RELEASED_MS`` after its last change. A group's rows of a micro-batch are
    handled in order of kind and id, so they are held together: a micro-batch bounds them
    (maxFilesPerTrigger).
    """

    RELEASED_MS = 30 * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        kept = StructType([StructField("status", StringType()), StructField("last_id", LongType()), StructField("until", LongType())])
        self.handle = handle
        self.state = handle.getValueState("group", kept)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pieces = [drain.as_rows(pdf) for pdf in rows]
        before = self.state.get() if self.state.exists() else None
        status, last, done = drain.drain_group(before[0] if before else None, before[1] if before else None, [r for p in pieces for r in p])
        if status is None:
            if before:
                self.state.clear()
        else:
            self._keep(status, last, timerValues)
        columns = [c.split()[0] for c in drain.RESULT.split(", ")]
        out = pd.DataFrame([(key[0], *x) for x in done], columns=columns, dtype=object)
        yield out.astype({c: "Int64" for c in ("id", "http_status_code", "retries")})

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        if isinstance(row["status"], str):
            self._keep(row["status"], int(row["last_id"]), timerValues)

    def _keep(self, status: str, last: int | None, timerValues) -> None:
        until = None
        if status != "SIDELINED":
            until = timerValues.getCurrentProcessingTimeInMs() + self.RELEASED_MS
            self.handle.registerTimer(until)
        self.state.update((status, last, until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # a group that was sidelined again, or changed since, has no timer or a later one
        if self.state.exists() and self.state.get()[2] == expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def group_outcomes(work: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Outcomes of streamed grouped work (group_id, id, message_id, kind, kind_rank, code, failed, ignored).

    Needs the RocksDB state store. ``groups`` (group_id, status, last_id) is the state to
    start from.
    """
    grouped = work.filter(~is_ungrouped(F.col("group_id"))).groupBy("group_id")
    start = groups.groupBy("group_id") if groups is not None else None
    return grouped.transformWithStateInPandas(GroupState(), outputStructType=_schema(work.sparkSession, drain.RESULT), outputMode="append", timeMode="processingTime", initialState=start)


def _schema(spark: SparkSession, text: str) -> StructType:
    return StructType.fromDDL(text) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], text).schema


def relay_batches(messages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Hand each micro-batch to a relay function, which joins metadata, sends and writes states."""
    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(handle)


def ripe(batch: DataFrame, now: Column, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(rows old enough to be read, rows to hold back) of a micro-batch at time ``now``.

    A row without a time is read at once, and so is every row where nothing is to be held back.
    """
    if not seconds:
        return batch, batch.limit(0)
    old = F.coalesce(F.col("created_at") < now - F.make_interval(secs=F.lit(float(seconds))), F.lit(True))
    return batch.filter(old), batch.filter(~old)


BLOCKS = 4096
FEW_ROWS = 10_000


def first_by_id(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by id, without all of them in one task.

    If there are no more, all. Else counts by blocks of ids tell the block in which the n-th row
    stands, blocks within it a smaller one, until it has few rows or one id; only these are sorted.
    """
    if n <= 0:
        return rows.limit(0)
    ends = rows.agg(F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("every")).first()  # one row
    if ends["every"] <= n:
        return rows
    if ends["every"] > ends["n"]:
        return rows.orderBy("id").limit(n)  # rows without an id, which none has that a relay gets
    lo, hi, before, inside = ends["lo"], ends["hi"], 0, ends["n"]
    while inside > FEW_ROWS and hi > lo:
        width = (hi - lo) // BLOCKS + 1
        blocks = rows.filter(F.col("id").between(lo, hi)).groupBy(F.floor((F.col("id") - lo) / width).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n")).orderBy("block").collect()  # BLOCKS rows
        for block in blocks:
            if before + block["n"] >= n:
                break
            before += block["n"]
        lo, inside = lo + block["block"] * width, block["n"]
        hi = min(lo + width - 1, hi)
    return rows.filter(F.col("id") < lo).unionByName(rows.filter(F.col("id").between(lo, hi)).orderBy("id").limit(n - before))


@dataclass
class Relay:
    """A continuous relay: ``handle`` is the function of a foreachBatch or of a poll.

    A micro-batch is a cycle: control tasks, then released messages, then ids that were
    missing, then new messages, each the first ``cycle_rows`` by id. A kind that fills the
    cycle ends it; what is left of the rows that came with it is held for the next. Groups
    keep their state (status, last sidelined id) from batch to batch, for as long as they
    aren't open. Delivery is in the order of groups (sources.ordered): nothing behind a
    failure, or held back by a group's state, reaches ``send``.

    Rows have the columns of ``INPUT``; kind is NEW or CONTROL, and an id is the sequence's:
    the metadata's where messages come from streaming.pairing. ``payloads`` gives the rows of
    the message table with the wanted message_ids, for released messages. Rows younger than
    ``delay_seconds`` are held and read again. Missing ids are waited for ``late_minutes``
    before the last message's time; what turns up later is given up, and told in ``expired``.

    A batch reads the state that the one before left under ``base`` and writes its changes,
    so a batch that runs again gives the same: its time is written first, and answers are
    kept lane by lane, so that lanes which were done before a stop aren't sent again, however
    uneven they were. Rows of a lane in work are; delivery is at least once.
    """

    base: str
    send: Callable[[pd.DataFrame], object]
    payloads: Callable[[DataFrame], DataFrame] | None = None
    lanes: int = 53
    delay_seconds: int = 0
    late_minutes: int = 30
    cycle_rows: int = 10_000
    name: str = "default"
    now: Column | None = None
    ignore_4xx: bool = False
    ignore_non_4xx: bool = False
    compact_every: int = 10
    _restarted: bool = field(default=False, repr=False)

    def path(self, table: str, batch: int) -> str:
        return f"{self.base}/{table}/v={batch}"

    def table(self, name: str) -> StateTable:
        schema, key = STATE[name]
        return StateTable(f"{self.base}/{name}", schema, key, self.compact_every)

    def state(self, spark: SparkSession, name: str, batch: int) -> DataFrame:
        """A state table as a batch left it."""
        return self.table(name).read(spark, batch)

    def told(self, spark: SparkSession, name: str, batch: int) -> DataFrame:
        """What a batch told: outcome, responses, expired."""
        return spark.read.parquet(self.path(name, batch))

    def done(self, spark: SparkSession) -> int:
        """The last batch that is complete, -1 if there is none: the version for readers."""
        return max([int(v[2:]) for v in names(spark, f"{self.base}/done")], default=-1)

    def _keep(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(table, batch))
        return rows.sparkSession.read.schema(rows.schema).parquet(self.path(table, batch))

    def _once(self, table: str, batch: int, rows: DataFrame) -> DataFrame:
        """A step of the batch, as it was when the batch first came to it."""
        if exists(rows.sparkSession, f"{self.path(table, batch)}/_SUCCESS"):
            return rows.sparkSession.read.schema(rows.schema).parquet(self.path(table, batch))
        return self._keep(table, batch, rows)

    def _small(self, spark: SparkSession, table: str, batch: int) -> DataFrame:
        """A table of which each batch writes a whole version."""
        return spark.read.schema(WHOLE[table]).parquet(self.path(table, batch)) if batch >= 0 else nothing(spark, WHOLE[table])

    def _time(self, spark: SparkSession, batch: int) -> Column:
        """The batch's time: told, or the time at which it first began."""
        if not exists(spark, f"{self.path('began', batch)}/_SUCCESS"):
            now = F.current_timestamp() if self.now is None else self.now
            self._keep("began", batch, spark.range(1).select(now.cast("timestamp").alias("at")))
        return F.lit(spark.read.parquet(self.path("began", batch)).first()["at"])

    def _answers(self, work: DataFrame, groups: DataFrame, batch: int) -> DataFrame:
        """Sends what no finished lane of this batch has sent before, and gives all answers.

        Each task commits the answers of its lanes as it ends, so those of finished lanes are
        there if the batch is stopped before the others end.
        """
        spark, path = work.sparkSession, self.path("responses", batch)
        if not exists(spark, f"{path}/_SUCCESS"):
            known = [n for n in names(spark, path) if n.startswith("part-")]
            left = work if not known else work.join(spark.read.schema(ordered.SENT).parquet(*[f"{path}/{n}" for n in known]).select("id", "kind"), ["id", "kind"], "left_anti")
            answers = ordered.deliver_in_order(left, self.send, groups, self.lanes, ignore_4xx=self.ignore_4xx, ignore_non_4xx=self.ignore_non_4xx)
            answers.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
        return spark.read.schema(ordered.SENT).parquet(path)

    def _released(self, sidelined: DataFrame, fresh: DataFrame) -> DataFrame:
        """The first released rows by id: those that were, and those that this cycle's tasks release."""
        open_ = sidelined.filter("status = 'UNSIDELINED'").select("id", "message_id", "group_id")
        more = sidelined.join(fresh, "message_id", "left_semi").select("id", "message_id", "group_id")
        return first_by_id(open_.unionByName(more).dropDuplicates(["message_id"]), self.cycle_rows)

    def handle(self, rows: DataFrame, batch: int) -> None:
        """One cycle. State tables are merged once and kept for the cycle."""
        spark = rows.sparkSession
        self._remove_old(spark, batch)
        old = {name: self.state(spark, name, batch - 1).persist() for name in ("sidelined", "groups", "skipped", "checkpoints")}
        try:
            self._cycle(rows, batch, old)
        finally:
            for table in old.values():
                table.unpersist()
        touch(spark, f"{self.base}/done/v={batch}")

    def _cycle(self, rows: DataFrame, batch: int, old: dict[str, DataFrame]) -> None:
        spark = rows.sparkSession
        now = self._time(spark, batch)
        sidelined = old["sidelined"]
        fixes = nothing(spark, STATE["sidelined"][0])
        if not self._restarted:  # what was in work when the relay stopped is open again
            fixes = state.reset_processing(sidelined.filter("status = 'PROCESSING' or group_id is null"), old["groups"].filter("status = 'SIDELINED'"))
            self._restarted = True
        fixes = self._once("reset", batch, fixes)
        sidelined = state.changed(sidelined, fixes, "message_id")
        ready, young = ripe(input_rows(rows).unionByName(self._small(spark, "held", batch - 1)), now, self.delay_seconds)
        ready, young = ready.unionByName(young.filter("kind <> 'NEW'")), young.filter("kind = 'NEW'")  # only messages wait
        ready = self._once("ready", batch, ready.dropDuplicates(["kind", "id"]))
        # control tasks
        tasks = self._once("claimed", batch, first_by_id(ready.filter("kind = 'CONTROL'"), self.cycle_rows))
        n_tasks = tasks.count()
        if not n_tasks:
            tasks = nothing(spark, INPUT)
        fresh = self._once("released", batch, state.released_by(sidelined, tasks))
        freed = tasks.filter("task_type = 'UNSIDELINE_GROUP' and group_id is not null").select("group_id").distinct()
        groups = old["groups"].join(freed.withColumn("_free", F.lit(True)), "group_id", "left").withColumn("status", F.when(F.col("_free"), "UNSIDELINED").otherwise(F.col("status"))).drop("_free")
        # released messages
        full = n_tasks >= self.cycle_rows
        claimed = self._once("unsidelined", batch, self._released(sidelined, fresh) if not full else nothing(spark, "id long, message_id string, group_id string"))
        n_claimed = claimed.count()
        if not n_claimed:
            claimed = nothing(spark, "id long, message_id string, group_id string")
        found = self.payloads(claimed.select("message_id")) if self.payloads else nothing(spark, "message_id string, message string, created_at timestamp")
        again = claimed.join(found.select("message_id", "message", "created_at").dropDuplicates(["message_id"]), "message_id").withColumn("kind_rank", F.lit(1))
        # ids that were missing, and new messages
        full = full or n_claimed >= self.cycle_rows
        at = self._small(spark, "position", batch - 1).first()  # one row
        last_id, last_time = (at["id"], at["created_at"]) if at else (None, None)
        messages = ready.filter("kind = 'NEW'")
        behind = messages.limit(0) if last_id is None else messages.filter(F.col("id") <= last_id)
        ahead = messages if last_id is None else messages.filter(F.col("id") > last_id)
        take_late, take_new = (0, 0) if full else (self.cycle_rows, self.cycle_rows)
        late = first_by_id(behind, take_late)
        n_late = late.count()
        if not n_late:
            late = nothing(spark, INPUT)
        if n_late >= self.cycle_rows:
            take_new = 0
        new = self._once("new", batch, first_by_id(ahead, take_new))
        left = messages.join(late.unionByName(new).select("id"), "id", "left_anti").unionByName(ready.filter("kind = 'CONTROL'").join(tasks.select("id"), "id", "left_anti"))
        self._keep("held", batch, young.unionByName(left))
        ends = new.agg(F.max(F.struct("id", "created_at")).alias("x")).first()["x"]  # one row
        time = ends["created_at"] if ends else last_time
        opened = gaps.intervals_of(batch_gaps(new, last_id), F.lit(time).cast("timestamp"))
        changes, expired, in_time = gaps.interval_changes(old["skipped"], late.select("id"), opened, None if last_time is None else F.lit(last_time), self.late_minutes)
        self._keep("expired", batch, expired)
        in_time = self._once("late", batch, in_time) if n_late else in_time
        # delivery
        kinds = {"SKIPPED": (2, late.join(in_time, "id", "left_semi")), "NEW": (3, new)}
        columns = ["group_id", "id", "message_id", "message", "created_at"]
        work = again.select(*columns, F.lit("UNSIDELINED").alias("kind"), "kind_rank")
        for kind, (rank, some) in kinds.items():
            work = work.unionByName(some.select(*columns, F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank")))
        work = self._once("work", batch, work)
        answers = self._answers(work, groups, batch)
        graded = drain.with_responses(work, answers.filter("sent").select("id", "status_code", "error", "body"), self.ignore_4xx, self.ignore_non_4xx)
        outcomes, after = drain.cycle_outcomes(graded, groups)
        details = F.when(F.col("outcome") == "SIDELINED", F.coalesce("error", "body", F.lit(""))).when(F.col("outcome") == "HELD", F.lit("")).alias("details")
        outcomes = self._keep("outcome", batch, outcomes.join(answers.select("id", "kind", "error", "body"), ["id", "kind"], "left").select(*outcomes.columns, details))
        # what changes
        told = outcomes.filter("outcome in ('SIDELINED', 'HELD')").withColumn("sideline_reason_code", F.col("reason"))
        rows_told = state.sideline_changes(sidelined, told, now).withColumn("_gone", F.lit(False))
        delivered = claimed.join(outcomes.filter("kind = 'UNSIDELINED' and outcome = 'RELAYED'"), "message_id", "left_semi").select("message_id")
        gone = sidelined.join(delivered, "message_id", "left_semi").withColumn("_gone", F.lit(True))
        # claimed, but without payload or an ignored failure: in work until a restart; released, but not claimed yet: open
        rest = sidelined.join(told.select("message_id").unionByName(delivered), "message_id", "left_anti")
        waiting = rest.join(claimed, "message_id", "left_semi").withColumn("status", F.lit("PROCESSING"))
        unclaimed = rest.join(fresh, "message_id", "left_semi").join(claimed, "message_id", "left_anti").withColumn("status", F.lit("UNSIDELINED"))
        moved = waiting.unionByName(unclaimed).withColumns({"updated_at": now, "_gone": F.lit(False)})
        every = rows_told.unionByName(gone).unionByName(moved)
        fixed = fixes.join(every, "message_id", "left_anti").withColumn("_gone", F.lit(False))
        self.table("sidelined").write(every.unionByName(fixed), batch)
        touched = freed.unionByName(work.filter(~is_ungrouped(F.col("group_id"))).select("group_id")).distinct()
        stays = after.join(touched, "group_id", "left_semi").withColumn("_gone", F.lit(False))
        ended = old["groups"].join(touched, "group_id", "left_semi").join(stays, "group_id", "left_anti").withColumn("_gone", F.lit(True))
        self.table("groups").write(stays.unionByName(ended), batch)
        self.table("skipped").write(changes, batch)
        finished = state.finished_tasks(tasks, sorted(UNKNOWN_TASKS)).select("id", "task_type", "status", now.alias("updated_at"))
        self.table("tasks").write(finished, batch)
        done = new.join(outcomes.filter("kind = 'NEW' and outcome <> 'IGNORED'").select("id"), "id", "left_semi")
        lanes_moved = lanes.lane_checkpoints(lanes.with_bucket(done, self.lanes), self.name, old["checkpoints"])
        self.table("checkpoints").write(state.checkpoint_changes(old["checkpoints"], lanes_moved, now), batch)
        position = (ends["id"], ends["created_at"]) if ends else (last_id, last_time)
        self._keep("position", batch, spark.createDataFrame([position] if position[0] is not None else [], WHOLE["position"]))

    def _remove_old(self, spark: SparkSession, batch: int) -> None:
        """What the batch before the last one wrote for itself alone; what it told stays."""
        for table in (*WHOLE, *STEPS):
            remove(spark, self.path(table, batch - 2))
        if exists(spark, f"{self.base}/done/v={batch - 1}"):
            remove(spark, f"{self.base}/done/v={batch - 2}")


def changed_checkpoints(batch: DataFrame, old: DataFrame, lanes_n: int, relay: str = "default") -> DataFrame:
    """Checkpoints of the lanes that moved in a micro-batch."""
    return lanes.lane_checkpoints(lanes.with_bucket(batch, lanes_n), relay, old)


def batch_gaps(batch: DataFrame, last_id: int | None) -> DataFrame:
    """Gaps that a micro-batch opens behind the last id of the batches before."""
    return gaps.sequence_gaps(batch.select("id"), None if last_id is None else last_id + 1)


def metrics(rows: DataFrame, width: str = "4 seconds", late: str = LATE) -> DataFrame:
    """Counts, failures and lag per tumbling window of a delivery stream (created_at, code, lag_ms)."""
    windowed = rows.withWatermark("created_at", late).groupBy(F.window("created_at", width))
    figures = windowed.agg(F.count(F.lit(1)).alias("n_sent"), F.sum((F.floor(F.col("code") / 100) != 2).cast("bigint")).alias("n_failed"), F.max("lag_ms").alias("max_lag_ms"))
    return figures.select(F.col("window.start").alias("window_start"), "n_sent", "n_failed", "max_lag_ms")
