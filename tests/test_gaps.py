"""Gaps as intervals, against sets of ids."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanbox.operators import gaps as G

ROW = "start_id long, end_id long, status string, created_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def expanded(rows):
    return {i for r in rows for i in range(r["start_id"], r["end_id"])}


def ids_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@pytest.mark.parametrize("seed", range(3))
def test_intervals_against_sets(spark, seed):
    r = random.Random(seed)
    block, top = r.choice([1, 3, 10, 1000]), 300
    cuts = sorted(r.sample(range(top), 2 * r.choice([1, 5, 20])))
    intervals = [(a, b, "NEW", T0 + dt.timedelta(minutes=a)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    table = spark.createDataFrame(intervals, ROW)
    arrived = sorted({r.randrange(-3, top + 5) for _ in range(r.choice([1, 20, 200]))} | {r.choice(cuts)})
    want = {(i, a) for i in arrived for a, b, *_ in intervals if a <= i < b}
    found = G.located(table, ids_of(spark, arrived + arrived[:2]), block)
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    left = G.split_intervals(table, spark.createDataFrame(sorted(want), "id long, start_id long"), block).collect()
    touched = {a for _, a in want}
    assert expanded(left) == {i for a, b, *_ in intervals if a in touched for i in range(a, b)} - set(arrived)
    pieces = sorted((x["start_id"], x["end_id"]) for x in left)
    assert all(a < b for a, b in pieces) and all(p[1] < q[0] for p, q in zip(pieces, pieces[1:], strict=False))
    of = {i: t for a, b, _, t in intervals for i in range(a, b)}
    assert all(x["created_at"] == of[x["start_id"]] for x in left)


@pytest.mark.parametrize("seed", [1])
def test_changes_over_many_batches_equal_expanded_ids(spark, seed):
    """Ids arrive late, gaps open and expire: the table of intervals is always the set of ids waited for."""
    r = random.Random(seed)
    table, waiting, last = {}, {}, 0
    for k in range(4):
        now, new_last = T0 + dt.timedelta(minutes=20 * k), last + r.randrange(20, 60)
        fresh = sorted({new_last} | set(r.sample(range(last + 1, new_last), 5)))
        arrived = sorted(r.sample(sorted(waiting), len(waiting) // 3)) if waiting else []
        frame = spark.createDataFrame(list(table.values()), ROW)
        opened = G.intervals_of(G.sequence_gaps(ids_of(spark, fresh), last + 1, block=7), F.lit(now))
        changes, expired, late = G.interval_changes(frame, ids_of(spark, [*arrived, -5, 10**6]), opened, F.lit(now), 30)
        rows, gone, met = changes.collect(), expired.collect(), {x["id"] for x in late.collect()}
        old = {i for i, t in waiting.items() if not t > now - dt.timedelta(minutes=30)}
        assert expanded(gone) == old and met == set(arrived) - old
        assert len(rows) == len({x["start_id"] for x in rows})
        for x in rows:
            table.pop(x["start_id"], None)
            if not x["_gone"]:
                table[x["start_id"]] = (x["start_id"], x["end_id"], x["status"], x["created_at"])
        waiting = {i: t for i, t in waiting.items() if i not in old and i not in met} | {i: now for i in range(last + 1, new_last) if i not in fresh}
        assert {i: t for a, b, _, t in table.values() for i in range(a, b)} == waiting
        last = new_last


def test_a_long_gap_is_one_row(spark):
    found = G.sequence_gaps(ids_of(spark, [1, 1_000_000_002]))
    table = G.intervals_of(found, F.lit(T0))
    assert [(x["start_id"], x["end_id"]) for x in table.collect()] == [(2, 1_000_000_002)]
    late = G.located(table, ids_of(spark, [1, 2, 500_000_000, 1_000_000_001, 1_000_000_002]))
    assert sorted(x["id"] for x in late.collect()) == [2, 500_000_000, 1_000_000_001]
    left = G.split_intervals(table, late).collect()
    assert sorted((x["start_id"], x["end_id"]) for x in left) == [(3, 500_000_000), (500_000_001, 1_000_000_001)]
    # expanded on demand, in pieces over many tasks
    ids = G.skipped_ids(found)
    assert ids.agg(F.count("id"), F.min("id"), F.max("id")).first() == (1_000_000_000, 2, 1_000_000_001)
    sizes = spark.createDataFrame([(5, 5), (7, 8), (1, 4)], "gap_start long, gap_end long")
    assert sorted(x["id"] for x in G.skipped_ids(sizes).collect()) == [1, 2, 3, 7]
