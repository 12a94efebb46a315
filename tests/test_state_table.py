"""Change files merged on reading, and polling by id."""

import os
import random
import time

import pytest

from gleanbox.sources.polling import IdPoll, jdbc_table, parquet_table
from gleanbox.streaming.state_table import StateTable

SCHEMA = "k string, n int, t string"
CHANGE = SCHEMA + ", _gone boolean"


@pytest.mark.parametrize("every", [2])
def test_versions_against_a_dict(spark, tmp_path, every):
    r = random.Random(every)
    table, now, versions = StateTable(str(tmp_path), SCHEMA, "k", every, buckets=2), {}, []
    for v in range(6):
        keys = r.sample("abcdefgh", r.choice([0, 1, 4]))
        changes = [(k, v, None if r.random() < 0.3 else f"t{v}", r.random() < 0.3) for k in keys]
        frame = spark.createDataFrame(changes, CHANGE)
        table.write(frame, v)
        if r.random() < 0.5:
            table.write(frame, v)  # a batch that runs again
        now = {k: x for k, x in now.items() if k not in keys} | {k: (n, t) for k, n, t, gone in changes if not gone}
        versions.append(now)
        read = lambda w, keys=None: {x["k"]: (x["n"], x["t"]) for x in table.read(spark, w, keys).collect()}
        assert read(v) == now
        if v:
            assert read(v - 1) == versions[v - 1]  # what a batch that runs again reads
        some = spark.createDataFrame([("a",), ("c",), ("a",), ("zz",)], "k string")
        assert read(v, some) == {k: x for k, x in now.items() if k in "ac"}
    assert StateTable(str(tmp_path / "new"), SCHEMA, "k").read(spark, -1).count() == 0
    left = os.listdir(tmp_path / "changes")
    assert len(left) <= 2 * every and len(os.listdir(tmp_path / "snapshot")) <= 2


def test_a_batch_writes_its_changes_alone(spark, tmp_path):
    table = StateTable(str(tmp_path), SCHEMA, "k", every=4)
    table.write(spark.range(20_000).selectExpr("concat('k', id) as k", "1 as n", "repeat('x', 40) as t"), 0)
    table.write(spark.createDataFrame([("k7", 2, "y")], SCHEMA), 1)
    size = lambda v: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(table.changes_path(v)) for f in fs)
    assert size(1) < size(0) / 10
    assert table.read(spark, 1).filter("k = 'k7'").first()["n"] == 2 and table.read(spark, 1).count() == 20_000


def drained(spark, poll, n):
    return [sorted(r["id"] for r in poll.rows(spark, k).collect()) for k in range(n)]


def test_poll_of_parquet(spark, tmp_path):
    path = str(tmp_path / "t")
    write = lambda ids: spark.createDataFrame([(i, f"m{i}") for i in ids], "id long, message_id string").coalesce(1).write.mode("append").parquet(path)
    write([1, 2, 3, 5, 8])
    poll = IdPoll(parquet_table(path), str(tmp_path / "ranges"), width=3, after=0)
    assert drained(spark, poll, 4) == [[1, 2, 3], [5], [8], []]
    write([9, 10, 10_000_000, 10_000_001])
    again = IdPoll(parquet_table(path), str(tmp_path / "ranges"), width=3, after=0)  # started again: goes on behind the last range
    assert [sorted(r["id"] for r in again.rows(spark, k).collect()) for k in (4, 5, 6)] == [[9, 10], [10_000_000, 10_000_001], []]
    assert again.range_of(spark, 1) == (3, 6) and again.range_of(spark, 4)[0] == 8  # and reads a known batch as before
    write([6])  # a late row is not in a range that was read: gaps tell of it
    assert [r["id"] for r in again.rows(spark, 1).collect()] == [5, 6]
    plan = again.rows(spark, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id," in plan and "LessThanOrEqual(id," in plan  # the scan gets the range
    assert IdPoll(parquet_table(path), str(tmp_path / "other"), width=100).range_of(spark, 0) == (-1, 99)


def test_poll_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "id long").write.parquet(str(tmp_path / "t"))
    poll = IdPoll(parquet_table(str(tmp_path / "t")), str(tmp_path / "ranges"))
    assert poll.range_of(spark, 0) == (-1, -1) and poll.rows(spark, 0).count() == 0


def test_poll_of_a_database(spark, tmp_path):
    """Over JDBC each part of a range is a query of its own; Spark brings Derby along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"m{i}") for i in range(1, 51) if i != 20], "id long, message_id string")
    rows.coalesce(1).write.format("jdbc").options(url=url, dbtable="messages", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    poll = IdPoll(jdbc_table(url, "messages", 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver"), str(tmp_path / "ranges"), width=20, after=0)
    assert drained(spark, poll, 4) == [[i for i in range(1, 21) if i != 20], list(range(21, 41)), list(range(41, 51)), []]
    assert poll.rows(spark, 1).rdd.getNumPartitions() == 4
    plan = poll.rows(spark, 1)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ID,20)" in plan.upper().replace("GREATERTHAN", "GreaterThan")


def test_stream_of_a_poll_resumes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1, 26).write.parquet(path)
    seen = []

    def handle(rows, batch):
        seen.append((batch, sorted(r["id"] for r in rows.collect())))

    for upto in (2, 3):
        poll = IdPoll(parquet_table(path), str(tmp_path / "ranges"), width=10, after=0)
        query = poll.stream(spark, handle, str(tmp_path / "cp"), seconds=0).start()
        while len({i for _, ids in seen for i in ids}) < 10 * upto - 5 * (upto == 3) and query.isActive:
            time.sleep(0.1)
        query.stop()
    by_batch = dict(seen)
    assert sorted(i for ids in by_batch.values() for i in ids) == list(range(1, 26))
