"""Metadata and payload of a message as two streams, joined when both are there.

Either may come first, and in another micro-batch. A metadata row whose payload doesn't come
in time is told, and so is a payload without metadata, whose transaction was never committed.

``paired`` keeps a message's state by its key and handles message after message in Python,
milliseconds each: for streams of a few hundred messages a second. ``Pairs`` handles a
micro-batch as joins and aggregates, whatever its size, and keeps what waits as change files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleanbox.sources.files import remove
from gleanbox.streaming.state_table import StateTable

PAIRED = "outcome string, app_sequence_id bigint, id bigint, message_id string, message string, group_id string, created_at timestamp"
_HALVES = "app_sequence_id long, meta_at timestamp, id long, message string, group_id string, until timestamp, joined boolean"


class Pairing(StatefulProcessor):
    """What is known of a message: its metadata's id and time, its payload, and whether they were joined.

    Kept until event time is beyond the later of both by the time that is waited; till then a
    joined message is remembered, so that rows which come twice are not joined again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("halves", _HALVES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        meta, at, id_, message, group, until, joined = known or (None, None, None, None, None, None, False)
        before = until
        for pdf in rows:
            for own, its_id, text, of, when in pdf[["is_metadata", "id", "message", "group_id", "created_at"]].itertuples(index=False, name=None):
                when = pd.Timestamp(when).to_pydatetime()
                until = when if until is None or when > until else until
                # of several rows of a message the one with the largest id counts
                if own and (meta is None or its_id > meta):
                    meta, at = int(its_id), when
                elif not own and (id_ is None or its_id > id_):
                    id_, message, group = int(its_id), text if isinstance(text, str) else None, of if isinstance(of, str) else None
        if until != before:
            self.handle.registerTimer(_millis(until))
        if not joined and meta is not None and id_ is not None:
            joined = True
            yield _told("JOINED", meta, id_, key[0], message, group, at)
            message = None  # the payload has gone on; only its ids are remembered
        self.state.update((meta, at, id_, message, group, until, joined))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            meta, at, id_, message, group, until, joined = self.state.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= _millis(until):
                self.state.clear()
                if not joined:
                    yield _told("NO_PAYLOAD" if id_ is None else "NO_METADATA", meta, id_, key[0], message, group, at if id_ is None else until)

    def close(self) -> None:
        pass


def _millis(t) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def _told(*row) -> pd.DataFrame:
    out = pd.DataFrame([row], columns=[c.split()[0] for c in PAIRED.split(", ")], dtype=object)
    return out.astype({"app_sequence_id": "Int64", "id": "Int64", "created_at": "datetime64[us]"})


def both(metadata: DataFrame, messages: DataFrame) -> DataFrame:
    """Rows of the two streams as one; those without message_id or time can't be paired."""
    own = metadata.select(F.lit(True).alias("is_metadata"), "id", "message_id", F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("group_id"), "created_at")
    rows = own.unionByName(messages.select(F.lit(False).alias("is_metadata"), "id", "message_id", "message", "group_id", "created_at"))
    return rows.filter("message_id is not null and created_at is not null")


def paired(metadata: DataFrame, messages: DataFrame, wait: str = "30 minutes") -> DataFrame:
    """Streams of metadata (id, message_id, created_at) and messages (and message, group_id) -> joined messages.

    ``outcome`` is JOINED, once for each message, or NO_PAYLOAD and NO_METADATA for what came
    alone and was waited for until another row was ``wait`` later. Rows that come later than
    that are late and dropped. Needs the RocksDB state store.
    """
    keyed = both(metadata, messages).withWatermark("created_at", wait).groupBy("message_id")
    return keyed.transformWithStateInPandas(Pairing(), outputStructType=PAIRED, outputMode="append", timeMode="eventTime")


_WAITING = "message_id string, app_sequence_id bigint, meta_at timestamp, id bigint, message string, group_id string, until timestamp, joined boolean"
_TOLD = f"outcome string, {_WAITING}, known boolean, ended boolean"


@dataclass(frozen=True)
class Pairs:
    """Pairing as the function of a foreachBatch over the rows of ``both``, with the rules of ``paired``.

    What is known of a message is a row of a state table under ``base``, kept until event time
    is ``wait_seconds`` beyond the later of its two; event time is taken up at the end of each
    batch, and what is over by then is told in it. Of rows with one id the largest by value
    counts. A batch reads the state that the one before left and writes the messages that it
    changed, so one that runs again writes the same. All rows of a message meet in one
    shuffle, which also has the state.
    """

    base: str
    wait_seconds: int = 1800
    every: int = 10

    def path(self, table: str, batch: int) -> str:
        return f"{self.base}/{table}/v={batch}"

    @property
    def waiting(self) -> StateTable:
        return StateTable(f"{self.base}/waiting", _WAITING, "message_id", self.every)

    def told(self, spark: SparkSession) -> DataFrame:
        """What all batches told, as rows of ``PAIRED``."""
        at = F.when(F.col("outcome") == "NO_METADATA", F.col("until")).otherwise(F.col("meta_at")).alias("created_at")
        rows = spark.read.schema(_TOLD).parquet(f"{self.base}/told").filter("outcome is not null")
        return rows.select("outcome", "app_sequence_id", "id", "message_id", "message", "group_id", at)

    def handle(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        over = None
        if batch > 0:
            over = spark.read.schema("over bigint").parquet(self.path("position", batch - 1)).first()["over"]  # one row
        if over is not None:
            rows = rows.filter(F.unix_millis("created_at") > over)
        last = rows.agg(F.max(F.unix_millis("created_at")).alias("ms")).first()["ms"]  # one row
        if last is not None:
            over = max(last - 1000 * self.wait_seconds, last - 1000 * self.wait_seconds if over is None else over)
        # new rows and what is known, each as halves; an id's known half goes before a new one
        meta = F.when(F.col("is_metadata"), F.struct("id", F.lit(False).alias("known"), F.col("created_at").alias("at")))
        payload = F.when(~F.col("is_metadata"), F.struct("id", F.lit(False).alias("known"), "message", "group_id"))
        fresh = rows.select("message_id", meta.alias("meta"), payload.alias("payload"), F.col("created_at").alias("until"), F.lit(False).alias("joined"), F.lit(False).alias("known"))
        known = self.waiting.read(spark, batch - 1)
        meta = F.when(F.col("meta_at").isNotNull(), F.struct(F.col("app_sequence_id").alias("id"), F.lit(True).alias("known"), F.col("meta_at").alias("at")))
        payload = F.when(F.col("joined") | F.col("meta_at").isNull(), F.struct("id", F.lit(True).alias("known"), "message", "group_id"))
        known = known.select("message_id", meta.alias("meta"), payload.alias("payload"), "until", "joined", F.lit(True).alias("known"))
        largest = [F.max(c).alias(c) for c in ("meta", "payload", "until", "joined", "known")]
        merged = fresh.unionByName(known).groupBy("message_id").agg(*largest, F.max(~F.col("known")).alias("touched"))
        ended = F.coalesce(F.unix_millis("until") <= F.lit(over).cast("bigint"), F.lit(False))
        whole = F.col("meta").isNotNull() & F.col("payload").isNotNull()
        outcome = F.when(~F.col("joined") & whole, "JOINED").when(ended & ~F.col("joined"), F.when(F.col("payload").isNull(), "NO_PAYLOAD").otherwise("NO_METADATA"))
        changed = merged.withColumn("ended", ended).filter("touched or ended").select(
            outcome.alias("outcome"), "message_id", F.col("meta.id").alias("app_sequence_id"), F.col("meta.at").alias("meta_at"), F.col("payload.id").alias("id"),
            "payload.message", "payload.group_id", "until", (F.col("joined") | whole).alias("joined"), "known", "ended",
        )
        changed.write.mode("overwrite").parquet(self.path("told", batch))
        # a payload that has gone on isn't kept, only its ids; what came and ended in this batch never waits
        kept = spark.read.schema(_TOLD).parquet(self.path("told", batch)).filter("known or not ended")
        self.waiting.write(kept.withColumns({"message": F.when(~F.col("joined"), F.col("message")), "_gone": F.col("ended")}), batch)
        spark.createDataFrame([(over,)], "over bigint").coalesce(1).write.mode("overwrite").parquet(self.path("position", batch))
        remove(spark, self.path("position", batch - 2))
