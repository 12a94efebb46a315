"""Delivery in the order of each group, which stops where a group stops.

Messages of a group go to one task, in order of kind and id, and each is sent after the
answer to the one before is known. What a group's state or a failure holds back never reaches
the sender.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.functions.hashing import spread_key
from gleanbox.sources.outbox import answers_of

SENT = "id bigint, message_id string, kind string, kind_rank int, sent boolean, status_code int, error string, body string"
_NAMES = [c.split()[0] for c in SENT.split(", ")]
_OWN = ["_key", "_status", "_last"]


class _Run:
    """The rows of one group in a batch: the next row's place, and the group's state so far."""

    __slots__ = ("at", "end", "last", "status")

    def __init__(self, at: int, end: int, status: str | None, last: int | None):
        self.at, self.end, self.status, self.last = at, end, status, last

    def pass_held(self, ids: np.ndarray) -> bool:
        """Goes to the next row that is to be sent; false at the end."""
        while self.at < self.end and self.status is not None and ids[self.at] > (-1 if self.last is None else self.last):
            self.last = int(ids[self.at])
            self.at += 1
        return self.at < self.end

    def answered(self, id_: int, failed: bool, ignored: bool) -> None:
        if failed and not ignored:
            self.status, self.last = "SIDELINED", id_
        elif not failed and self.status is not None and id_ == self.last:
            self.status = self.last = None
        self.at += 1


def _is_failure(code: int | None, error: str | None, ignore_4xx: bool, ignore_non_4xx: bool) -> tuple[bool, bool]:
    """(failed, ignored) of one answer, by the rules of operators.relay."""
    code = 500 if code is None else code
    failed = error is not None or code // 100 != 2
    return failed, failed and error is None and (ignore_4xx if code // 100 == 4 else ignore_non_4xx)


def deliver_in_order(
    work: DataFrame, send: Callable[[pd.DataFrame], object], state: DataFrame, partitions: int | None = None, slice_rows: int = 100, ignore_4xx: bool = False, ignore_non_4xx: bool = False
) -> DataFrame:
    """What was sent of ``work`` (group_id, id, message_id, kind, kind_rank and what the sender needs), and the answers.

    ``state`` (group_id, status, last_id) tells which groups are not open. By the rule of
    operators.drain a message of such a group is sent up to its last id; a real failure closes
    its group. ``send`` gets a slice of rows and returns their status codes, or a frame with
    status_code and, where known, error and body. No slice has two rows of one group, so a
    slice takes the next row of many groups, and a large group goes one by one while others
    end. A row without a group is on its own. Unsent rows have no code.

    Rows are dealt out by group and sorted on disk if need be; a task holds one Arrow batch of
    them and the state of the one group that goes on in the next batch, so a group may be of
    any size. Write the result before using it twice: reading it sends.
    """
    told = state.select(F.col("group_id").alias("_key"), F.col("status").alias("_status"), F.col("last_id").cast("bigint").alias("_last"))
    keyed = work.withColumn("_key", spread_key(F.col("group_id"), F.col("message_id"))).join(told, "_key", "left")
    dealt = keyed.repartition(partitions, "_key") if partitions else keyed.repartition("_key")
    columns = work.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        going = (None, None, None)
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.reset_index(drop=True)
            keys, ids = pdf["_key"].to_numpy(), pdf["id"].to_numpy()
            begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            runs = []
            for at, end in zip(begins, np.r_[begins[1:], len(pdf)], strict=True):
                status, last = pdf.at[at, "_status"], pdf.at[at, "_last"]
                own = (status, int(last)) if isinstance(status, str) and not pd.isna(last) else (status if isinstance(status, str) else None, None)
                runs.append(_Run(int(at), int(end), *(going[1:] if keys[at] == going[0] else own)))
            sent, answers = np.zeros(len(pdf), dtype=bool), [(None, None, None)] * len(pdf)
            live, requests = runs, pdf[columns]
            while live := [r for r in live if r.pass_held(ids)]:
                for k in range(0, len(live), slice_rows):
                    some = live[k : k + slice_rows]
                    places = [r.at for r in some]
                    for r, at, answer in zip(some, places, answers_of(send, requests.iloc[places]), strict=True):
                        sent[at], answers[at] = True, answer
                        r.answered(int(ids[at]), *_is_failure(answer[0], answer[1], ignore_4xx, ignore_non_4xx))
            going = (keys[-1], runs[-1].status, runs[-1].last)
            codes, errors, bodies = (list(x) for x in zip(*answers, strict=True))
            out = pdf[["id", "message_id", "kind", "kind_rank"]].assign(sent=sent, status_code=pd.array(codes, dtype="Int32"), error=pd.Series(errors, dtype=object), body=pd.Series(bodies, dtype=object))
            yield out[_NAMES]

    return dealt.sortWithinPartitions("_key", "kind_rank", "id").select(*columns, *_OWN).mapInPandas(run, SENT)
