"""The rules on small rows."""

import datetime as dt

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanbox.functions import envelope, hashing, routing
from gleanbox.operators import assemble, drain, gaps, health, lanes, relay, retention, state
from gleanbox.schemas import read_mode
from gleanbox.sources import outbox

NOW = dt.datetime(2024, 5, 1, 12, 0)


def minutes_ago(n):
    return NOW - dt.timedelta(minutes=n)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_skipped_window_is_strict(spark):
    rows = spark.createDataFrame([(2, "NEW", NOW), (1001, "NEW", minutes_ago(40)), (2001, "NEW", minutes_ago(25)), (5, "NEW", minutes_ago(30)), (6, "PROCESSING", NOW)], "id long, status string, created_at timestamp")
    assert ids(assemble.eligible_skipped(rows, F.lit(NOW), 30)) == [2, 2001]


def test_sidelined_partitions_count_any_status(spark):
    messages = spark.createDataFrame([(10, "10"), (1001, "1001"), (2001, "2001")], "id long, message_id string")
    sidelined = spark.createDataFrame([("10", "SIDELINED"), ("1001", "UNSIDELINED"), ("2001", "PROCESSING")], "message_id string, status string")
    assert ids(retention.sidelined_partitions(sidelined, messages, 1000), "partition_no") == [0, 1, 2]
    assert ids(retention.sidelined_partitions(sidelined, messages, 9), "partition_no") == [1, 111, 222]


def test_bounds_belong_to_two_partitions(spark):
    row = spark.range(1).select(retention.rule_partition(F.lit(1000), 1000).alias("rule"), retention.storage_partition(F.lit(1000), 1000).alias("stored")).first()
    assert (row["rule"], row["stored"]) == (0, 1)


def test_partition_plan_creates_one_less(spark):
    messages = spark.createDataFrame([(55,)], "id long")
    assert ids(retention.partition_plan(messages, 94, 10, 5), "end_id") == [104]
    assert retention.partition_plan(messages.limit(0), 94, 10, 5).count() == 0


@pytest.mark.parametrize("hours_old, keep, expected", [(1, 1, 1), (24, 24, 1), (1, 2, 0)])
def test_archive_age(spark, hours_old, keep, expected):
    then = NOW - dt.timedelta(hours=hours_old)
    messages = spark.createDataFrame([(1, "a", then), (100_000, "b", then), (100_001, "c", NOW)], "id long, message_id string, created_at timestamp")
    none = spark.createDataFrame([], "message_id string")
    got = retention.archivable_partitions(messages, none, none.withColumn("process_id", F.lit("p")), F.lit(NOW), keep, 100_000)
    assert got.count() == expected


def test_metadata_stays_in_outbound_mode(spark):
    table, archived = spark.range(1, 20), spark.createDataFrame([(10,)], "end_id long")
    assert retention.retained_rows(table, archived, 10, "OUTBOUND_READER", is_metadata=True).count() == 19
    assert ids(retention.retained_rows(table, archived, 10, is_metadata=True)) == list(range(11, 20))


def test_drain_before_and_after_the_boundary():
    before = drain.drain_group("SIDELINED", 3, [(3, 1, "m1", "NEW", 200, False, False)])
    assert before[2][0][3] == "RELAYED" and before[:2] == ("SIDELINED", 3)
    after = drain.drain_group("SIDELINED", 3, [(3, 5, "m5", "NEW", 200, False, False)])
    assert after[2][0][3:5] == ("HELD", "GROUP_SIDELINED") and after[:2] == ("SIDELINED", 5)
    last = drain.drain_group("UNSIDELINED", 3, [(1, 3, "m3", "UNSIDELINED", 200, False, False), (3, 4, "m4", "NEW", 200, False, False)])
    assert [x[3] for x in last[2]] == ["RELAYED", "RELAYED"] and last[:2] == (None, None)


def simulated(state_, rows):
    """The rule as a loop over one group, written apart from the operator."""
    groups, out = dict(state_), {}
    for _, id_, _, _, code, failed, ignored in sorted(rows):
        status, last = groups.get("g", (None, -1))
        if status is None or id_ < last or id_ == last:
            if not failed:
                out[id_] = "RELAYED"
                if status is not None and id_ == last:
                    del groups["g"]
            elif ignored:
                out[id_] = "IGNORED"
            else:
                out[id_] = f"SIDELINED {code}"
                groups["g"] = ("SIDELINED", id_)
        else:
            out[id_] = "HELD"
            groups["g"] = (status, id_)
    return out, groups.get("g")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 9), st.sampled_from([200, 404, 500]), st.booleans()), unique_by=lambda r: r[1]), st.sampled_from([None, ("SIDELINED", 4), ("UNSIDELINED", 6), ("UNSIDELINED", -1)]))
def test_drain_equals_a_plain_loop(rows, start):
    made = [(k, i, f"m{i}", "NEW", c, c != 200, c != 200 and ign) for k, i, c, ign in rows]
    status, last, out = drain.drain_group(*(start or (None, None)), made)
    expected, end = simulated({"g": start} if start else {}, made)
    assert {x[0]: x[3] + (f" {x[5]}" if x[3] == "SIDELINED" else "") for x in out} == expected
    assert ((status, last) if status is not None else None) == end


def test_drained_groups_equal_the_rule_row_by_row(spark):
    import random

    rng = random.Random(5)
    starts = [None, ("SIDELINED", 6), ("UNSIDELINED", 6), ("UNSIDELINED", -1), ("SIDELINED", 12), ("UNSIDELINED", None)]
    work, state_, expected, ends = [], [], set(), {}
    for n in range(300):
        group, start = f"g{n}", starts[n % len(starts)]
        picked = rng.sample(range(1, 13), rng.choice([0, 1, 3, 6, 12]))
        rows = []
        for i in picked:
            code = rng.choice([200, 200, 200, 404, drain.RELAYER])
            failed = code != 200
            rows.append((rng.choice([1, 2, 3]), i, f"m{i}", None, code, failed, failed and code == 404 and rng.random() < 0.5))
        rows = [(k, i, m, ["UNSIDELINED", "SKIPPED", "NEW"][k - 1], c, f, g) for k, i, m, _, c, f, g in rows]
        if start:
            state_.append((group, *start))
        status, last, out = drain.drain_group(*(start or (None, None)), rows)
        expected |= {(group, *x) for x in out}
        if status is not None:
            ends[group] = (status, last)
        work += [(group, *r) for r in rows]
    work += [(None, 3, 1, "x", "NEW", 500, True, False), (" ", 3, 2, "y", "NEW", 200, False, False)]
    df = spark.createDataFrame(work, "group_id string, kind_rank int, id long, message_id string, kind string, code int, failed boolean, ignored boolean")
    got, after = drain.group_drain(df, spark.createDataFrame(state_, "group_id string, status string, last_id long"))
    rows = got.collect()
    assert len(rows) == len(expected) and {tuple(r) for r in rows} == expected
    assert {r["group_id"]: (r["status"], r["last_id"]) for r in after.collect()} == ends
    empty = drain.group_drain(df.limit(0), after.limit(0))
    assert [x.count() for x in empty] == [0, 0]


def test_relay_outcome_of_groups(spark):
    rows = [(1, "a", "g", 200), (2, "b", "g", 404), (3, "c", "g", 200), (4, "d", None, 500), (5, "e", " ", 200), (6, "f", "h", 200), (7, "x", "k", None)]
    messages = spark.createDataFrame([(i, m, g) for i, m, g, _ in rows], "id long, message_id string, group_id string")
    responses = spark.createDataFrame([(i, c) for i, _, _, c in rows if c], "id long, status_code int")
    groups = spark.createDataFrame([("h",)], "group_id string")
    got = {r["id"]: (r["outcome"], r["reason"], r["http_status_code"], r["retries"]) for r in relay.relay_outcome(messages, responses, groups).collect()}
    assert got == {
        1: ("RELAYED", None, None, None),
        2: ("SIDELINED", "HTTP_ERROR", 404, 5),
        3: ("SIDELINED", "GROUP_SIDELINED", 0, 0),
        4: ("SIDELINED", "HTTP_ERROR", 500, 5),
        5: ("RELAYED", None, None, None),
        6: ("SIDELINED", "GROUP_SIDELINED", 0, 0),
        7: ("SIDELINED", "HTTP_ERROR", 500, 5),
    }
    open_ = relay.relay_outcome(messages, responses, groups, ignore_4xx=True)
    assert {r["id"]: r["outcome"] for r in open_.filter("group_id = 'g'").collect()} == {1: "RELAYED", 2: "IGNORED", 3: "RELAYED"}


def test_release_ungrouped_and_reset(spark):
    rows = spark.createDataFrame([("a", None, "SIDELINED", minutes_ago(5)), ("b", None, "SIDELINED", minutes_ago(500)), ("c", "g", "PROCESSING", NOW), ("d", "h", "PROCESSING", NOW)], "message_id string, group_id string, status string, updated_at timestamp")
    got = {r["message_id"]: r["status"] for r in state.release_ungrouped(rows, F.lit(minutes_ago(60)), F.lit(NOW)).collect()}
    assert got == {"a": "UNSIDELINED", "b": "SIDELINED", "c": "PROCESSING", "d": "PROCESSING"}
    groups = spark.createDataFrame([("g",)], "group_id string")
    got = {r["message_id"]: r["status"] for r in state.reset_processing(rows, groups).collect()}
    assert got == {"a": "UNSIDELINED", "b": "UNSIDELINED", "c": "SIDELINED", "d": "UNSIDELINED"}
    got = {r["message_id"]: r["status"] for r in state.reset_processing(rows, groups.limit(0)).collect()}
    assert got == {"a": "SIDELINED", "b": "SIDELINED", "c": "UNSIDELINED", "d": "UNSIDELINED"}


def test_purge(spark):
    tasks = spark.createDataFrame([(1, "DONE", dt.datetime(2018, 1, 1)), (2, "NEW", dt.datetime(2018, 1, 1)), (3, "DONE", NOW)], "id long, status string, updated_at timestamp")
    assert ids(state.purge_control_tasks(tasks, F.lit(NOW), 10)) == [2, 3]


def java_hash(s):
    h = 0
    units = s.encode("utf-16-le")
    for k in range(0, len(units), 2):
        h = (h * 31 + units[k] + 256 * units[k + 1]) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_hashes(spark):
    import hashlib

    texts = ["", "a", "G12", "polygenelubricants", "ünïcode", "日本", "🙂x", " "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for r in df.select("t", hashing.java_hash(F.col("t")).alias("j"), hashing.md5_hash(F.col("t")).alias("m"), hashing.bucket(F.col("t"), 7).alias("b")).collect():
        t = r["t"] or ""
        assert r["j"] == java_hash(t)
        assert r["m"] == int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "little", signed=True)
        assert r["b"] == (0 if r["j"] == -(2**31) else abs(r["j"]) % 7)


def test_gaps(spark):
    got = gaps.sequence_gaps(spark.createDataFrame([(i,) for i in (5, 6, 9, 20, 21, 35)], "id long"), block=10)
    assert sorted(map(tuple, got.collect())) == [(7, 9), (10, 20), (22, 35)]
    first = gaps.sequence_gaps(spark.createDataFrame([(5,)], "id long"), start=3)
    assert [tuple(r) for r in first.collect()] == [(3, 5)]
    assert ids(gaps.skipped_ids(first)) == [3, 4]


def test_forced_resend_is_all_or_nothing(spark):
    messages = spark.createDataFrame([(1, "a"), (2, "b"), (7, "a")], "id long, message_id string")
    want = lambda *x: spark.createDataFrame([(v,) for v in x], "message_id string")
    assert ids(assemble.forced_resend(messages, want("a", "b", "a"), 20, 10)) == [2, 7]
    assert ids(assemble.forced_resend(messages, want("a", "z"), 20, 10)) == []
    assert ids(assemble.forced_resend(messages, want("a", "b"), 10, 10)) == []


def test_headers_and_urls(spark):
    df = spark.createDataFrame([('{"a":"2","b":"3"}',), (None,), ("{}",)], "h string")
    defaults = F.create_map(F.lit("a"), F.lit("1"))
    assert [r[0] for r in df.select(envelope.request_headers(defaults, F.col("h"))).collect()] == [{"a": "2", "b": "3"}, {"a": "1"}, {"a": "1"}]
    bad = spark.createDataFrame([("TOPIC", "n", '{"event":"e"}'), ("topic", "n", "no"), ("queue", "n", '{"event":"e"}')], "t string, n string, p string")
    event, topic = envelope.topic_headers(F.col("t"), F.col("n"), F.col("p"))
    assert [tuple(r) for r in bad.select(event, topic).collect()] == [("e", "n"), (None, None), (None, None)]


@pytest.mark.parametrize("day, week", [("2024-01-01", "202401"), ("2023-12-31", "202301"), ("2022-01-01", "202201"), ("2022-01-02", "202202"), ("2024-12-28", "202452"), ("2024-12-29", "202401")])
def test_us_week(spark, day, week):
    assert spark.range(1).select(routing.shard_by_time(F.lit(day).cast("date"), "w")).first()[0] == f"w_{week}"


def test_lag_and_modes(spark):
    rows = spark.createDataFrame([(0, 1, 100), (0, 2, 50), (1, 3, 70)], "bucket int, id long, lag_ms long")
    assert tuple(health.delivery_lag(rows, 7).first()) == (70, 17)
    assert tuple(health.delivery_lag(rows.limit(0), 7).first()) == (None, None)
    assert read_mode("?") == "DEFAULT" and read_mode("OUTBOUND_READER") == "OUTBOUND_READER"


def test_lane_checkpoints_only_if_changed(spark):
    done = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 3, "c")], "bucket int, id long, message_id string")
    old = spark.createDataFrame([("Processor_default_SP_0", "b")], "process_id string, message_id string")
    assert [tuple(r) for r in lanes.lane_checkpoints(done, old=old).collect()] == [("Processor_default_SP_1", "c")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "t1", minutes_ago(9)), (2, "b", None, None)], "id long, message_id string, txn_id string, created_at timestamp")
    outbox.write_layouts(rows, F.lit(NOW), str(tmp_path / "new"), str(tmp_path / "old"))
    new = {r["message_id"]: r for r in spark.read.parquet(str(tmp_path / "new")).collect()}
    assert new["a"]["transaction_id"] == "t1" and {r["created_at"] for r in new.values()} == {NOW}
    old = {r["message_id"]: r for r in spark.read.parquet(str(tmp_path / "old")).collect()}
    assert old["a"]["created_at"] == minutes_ago(9) and old["b"]["created_at"] == NOW and old["b"]["txn_id"] == "TXN-b"
    assert outbox.backup_range(rows, 1, 1, str(tmp_path / "backup")) == 1


def test_deliver(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, message_id string")
    sent = outbox.deliver(rows, lambda pdf: pd.Series([200 if m == "a" else 404 for m in pdf["message_id"]]))
    assert {r["id"]: r["status_code"] for r in sent.collect()} == {1: 200, 2: 404}

    def fails(pdf):
        raise OSError("no route")

    assert {r["status_code"] for r in outbox.deliver(rows, fails).collect()} == {500}


def test_read_jdbc_by_id_ranges(spark, tmp_path):
    # Spark brings this database; it lives in the memory of the local JVM
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, driver = "jdbc:derby:memory:outbox;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = spark.range(1, 101).select("id", F.concat(F.lit("m"), "id").alias("message_id"), F.when(F.col("id") % 7 == 0, None).otherwise("{}").alias("message"))
    rows.write.format("jdbc").options(url=url, dbtable="outbox", driver=driver).save()
    found = outbox.read_jdbc(spark, url, "outbox", 1, 80, 4, driver=driver)
    # ids beyond the bounds are read too; the bounds only part the ranges
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    assert found.filter("id between 5 and 7").count() == 3


def test_requests_are_keyed_by_their_sequence(spark):
    rows = spark.createDataFrame([(1, "g", "a"), (2, "g", None), (3, "x", "")], "id long, sequencing_key string, message string")
    got = [tuple(r) for r in outbox.keyed_requests(rows).collect()]
    assert [r for r in got if r[0] == "g"] == [("g", "a"), ("g", None)] and [r for r in got if r[0] != "g"] == [("x", "")]


def test_message_ids_of_what_they_stand_for(spark):
    rows = spark.createDataFrame([("a", "b"), ("ab", ""), ("a", "b"), (None, "ab")], "x string, y string")
    got = [r[0] for r in rows.select(envelope.business_id(F.col("x"), F.col("y"))).collect()]
    assert got[0] == got[2] and len(set(got)) == 3


def test_periods_of_tasks_are_merged(spark):
    at = minutes_ago
    rows = [(at(90), at(80)), (at(85), at(70)), (at(70), at(60)), (at(50), at(40)), (at(48), at(45)), (at(10), at(20)), (None, at(1)), (at(90), at(80))]
    got = state.merged_periods(spark.createDataFrame(rows, "from_date timestamp, to_date timestamp")).collect()
    assert sorted(tuple(r) for r in got) == [(at(90), at(60)), (at(50), at(40))]
