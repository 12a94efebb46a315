"""Draining groups whose messages were sidelined: an order-dependent rule with state per group.

A group's state is (status, last sidelined id). A message with a smaller id is sent; one with
a larger id is held back and becomes the last; the last one itself is sent and the group is
forgotten. A group without state is open. Every real sideline makes its message the last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbox.functions.hashing import is_ungrouped
from gleanbox.operators.relay import MAX_RETRIES, answers, is_failure, is_ignored

RESULT = "group_id string, id bigint, message_id string, kind string, outcome string, reason string, http_status_code int, retries int, status string"
#: The code of an error of the relay itself, which no response has.
RELAYER = -1

ROW = ["kind_rank", "id", "message_id", "kind", "code", "failed", "ignored"]
Row = tuple[int, int, str, str, int, bool, bool]
Outcome = tuple[int, str, str, str, str | None, int | None, int | None, str | None]


def drain_group(status: str | None, last_id: int | None, rows: list[Row]) -> tuple[str | None, int | None, list[Outcome]]:
    """New state and an outcome for each row, which are handled in order of kind and id."""
    out: list[Outcome] = []
    for _, id_, message, kind, code, failed, ignored in sorted(rows, key=lambda r: r[:2]):
        last = -1 if last_id is None else last_id
        if status is not None and id_ > last:
            open_ = status != "SIDELINED"
            reason, held = ("GROUP_SEQ_MAINTENANCE", "UNSIDELINED") if open_ else ("GROUP_SIDELINED", "SIDELINED")
            last_id = id_
            out.append((id_, message, kind, "HELD", reason, 0, 0, held))
        elif failed and ignored:
            out.append((id_, message, kind, "IGNORED", None, None, None, None))
        elif failed:
            status, last_id = "SIDELINED", id_
            own = code == RELAYER
            retries = MAX_RETRIES if not own or kind == "UNSIDELINED" else 0
            out.append((id_, message, kind, "SIDELINED", "RELAYER_ERROR" if own else "HTTP_ERROR", 0 if own else code, retries, "SIDELINED"))
        else:
            if status is not None and id_ == last:
                status, last_id = None, None
            out.append((id_, message, kind, "RELAYED", None, None, None, None))
    return status, last_id, out


def as_rows(pdf: pd.DataFrame) -> list[Row]:
    return list(pdf[ROW].itertuples(index=False, name=None))


def with_responses(work: DataFrame, responses: DataFrame, ignore_4xx: bool = False, ignore_non_4xx: bool = False) -> DataFrame:
    """work (group_id, id, message_id, kind, kind_rank) with code, failed and ignored."""
    sent = work.join(answers(responses), "id", "left")
    own = F.col("error").isNotNull()
    code = F.when(own, RELAYER).otherwise(F.coalesce("status_code", F.lit(500)))
    return sent.select("group_id", "id", "message_id", "kind", "kind_rank", code.alias("code"), (own | is_failure(F.col("status_code"))).alias("failed"), (~own & is_ignored(F.col("status_code"), ignore_4xx, ignore_non_4xx)).alias("ignored"))


def group_drain(work: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new state) of grouped work, given each group's state (group_id, status, last_id).

    Within a kind ids ascend (an id stands in it once), so a group's rows of a kind are sent
    up to one id, ``stop``, and held beyond it. Stop follows from four figures: the kind's
    first real failure, its largest id, the state that the kind before left, and whether that
    state's last id is among the ids sent. All are aggregates that combine before the
    shuffle; only the few kinds of a group are handled one after the other, so a group of
    very many messages is not brought into one task. ``drain_group`` is the same rule row by row.
    """
    grouped = work.filter(~is_ungrouped(F.col("group_id")))
    slim = grouped.select("group_id", "kind_rank", "id", "failed", "ignored")
    kinds = slim.groupBy("group_id", "kind_rank").agg(F.min(F.when(F.col("failed") & ~F.col("ignored"), F.col("id"))).alias("fail_id"), F.max("id").alias("top_id"))
    begun = state.select("group_id", F.col("status").alias("_status"), F.col("last_id").cast("bigint").alias("_last"))
    groups = kinds.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("kind_rank", "fail_id", "top_id"))).alias("steps")).join(begun, "group_id", "left")
    # groups without state and failures are open throughout
    groups = groups.filter(F.col("_status").isNotNull() | F.exists("steps", lambda kind: kind["fail_id"].isNotNull()))
    # a last id is the state's or an earlier kind's largest: few candidates for each group
    lasts = groups.select("group_id", F.explode(F.array_compact(F.concat(F.transform("steps", lambda kind: kind["top_id"]), F.array("_last")))).alias("id")).distinct()
    sent = slim.filter("not failed").join(lasts, ["group_id", "id"], "left_semi").groupBy("group_id").agg(F.collect_set(F.struct("kind_rank", "id")).alias("sent"))
    ends = groups.join(sent, "group_id", "left").withColumn("end", F.aggregate("steps", _begin(F.col("_status"), F.col("_last")), lambda before, kind: _after(before, kind, F.col("sent"))))
    stops = ends.select("group_id", F.explode("end.stops").alias("x")).select("group_id", "x.kind_rank", "x.stop", "x.held_as")
    rows = grouped.join(stops, ["group_id", "kind_rank"], "left")
    held = F.coalesce(F.col("id") > F.col("stop"), F.lit(False))
    ignored = ~held & F.col("failed") & F.col("ignored")
    real = ~held & F.col("failed") & ~F.col("ignored")
    own = F.col("code") == RELAYER
    retries = F.when(~own | (F.col("kind") == "UNSIDELINED"), F.lit(MAX_RETRIES)).otherwise(F.lit(0))
    outcomes = rows.select(
        "group_id",
        "id",
        "message_id",
        "kind",
        F.when(held, "HELD").when(ignored, "IGNORED").when(real, "SIDELINED").otherwise("RELAYED").alias("outcome"),
        F.when(held & (F.col("held_as") == "SIDELINED"), "GROUP_SIDELINED").when(held, "GROUP_SEQ_MAINTENANCE").when(real & own, "RELAYER_ERROR").when(real, "HTTP_ERROR").alias("reason"),
        F.when(held, F.lit(0)).when(real & own, F.lit(0)).when(real, F.col("code")).cast("int").alias("http_status_code"),
        F.when(held, F.lit(0)).when(real, retries).cast("int").alias("retries"),
        F.when(held, F.col("held_as")).when(real, "SIDELINED").alias("status"),
    )
    after = ends.select("group_id", F.col("end.status").alias("status"), F.col("end.last_id").alias("last_id")).filter("status is not null")
    untouched = state.join(ends.select("group_id"), "group_id", "left_anti").select("group_id", "status", "last_id")
    return outcomes, after.unionByName(untouched)


def cycle_outcomes(work: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, new state) of all work of a cycle, as of with_responses; ungrouped messages stand alone."""
    grouped, after = group_drain(work, state)
    alone = work.filter(is_ungrouped(F.col("group_id")))
    ignored, real, own = F.col("failed") & F.col("ignored"), F.col("failed") & ~F.col("ignored"), F.col("code") == RELAYER
    retries = F.when(~own | (F.col("kind") == "UNSIDELINED"), F.lit(MAX_RETRIES)).otherwise(F.lit(0))
    outcomes = alone.select(
        "group_id",
        "id",
        "message_id",
        "kind",
        F.when(ignored, "IGNORED").when(real, "SIDELINED").otherwise("RELAYED").alias("outcome"),
        F.when(real & own, "RELAYER_ERROR").when(real, "HTTP_ERROR").alias("reason"),
        F.when(real & own, F.lit(0)).when(real, F.col("code")).cast("int").alias("http_status_code"),
        F.when(real, retries).cast("int").alias("retries"),
        F.when(real, "SIDELINED").alias("status"),
    )
    return grouped.unionByName(outcomes), after


def _begin(status: Column, last_id: Column, stops: Column | None = None) -> Column:
    """A group's state and the stops of its kinds so far (kind_rank, stop, held_as)."""
    none = F.array().cast("array<struct<kind_rank:int,stop:bigint,held_as:string>>")
    return F.struct(status.cast("string").alias("status"), last_id.cast("bigint").alias("last_id"), (none if stops is None else stops).alias("stops"))


def _after(before: Column, kind: Column, sent: Column) -> Column:
    """The state after a kind: one that opens the group, or never closed it, stops at the first failure."""
    last = F.coalesce(before["last_id"], F.lit(-1).cast("bigint"))
    opened = before["status"].isNull() | F.coalesce(kind["fail_id"] <= last, F.lit(False)) | F.coalesce(F.exists(sent, lambda x: (x["kind_rank"] == kind["kind_rank"]) & (x["id"] == last)), F.lit(False))
    stop = F.when(opened, kind["fail_id"]).otherwise(last).cast("bigint")
    held_as = F.when(opened | (before["status"] == "SIDELINED"), "SIDELINED").otherwise("UNSIDELINED")
    status = F.when(~opened, before["status"]).when(kind["fail_id"].isNotNull(), "SIDELINED")
    last_id = F.when(~opened, F.greatest(before["last_id"], kind["top_id"])).when(kind["fail_id"].isNotNull(), kind["top_id"])
    here = F.struct(kind["kind_rank"].cast("int").alias("kind_rank"), stop.alias("stop"), held_as.alias("held_as"))
    return _begin(status, last_id, F.concat(before["stops"], F.array(here)))
