"""Metadata and payload that come apart, over several micro-batches."""

import datetime as dt

from gleanbox.streaming import pairing

T0 = dt.datetime(2024, 1, 1)
META, PAYLOAD = "id long, message_id string, created_at timestamp", "id long, message_id string, message string, group_id string, created_at timestamp"


def test_pairs_over_batches(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [
        # (metadata (id, minutes), payload (id, message id, minutes))
        ([(1, "a", 1), (2, "b", 2), (3, "never", 3)], [(11, "a", 1), (12, "orphan", 2)]),
        ([(4, "late", 20)], [(13, "b", 22), (14, "a", 23), (15, "c", 24)]),  # b's payload comes now; a's comes again
        ([(5, "c", 25), (9, "c", 26)], []),  # the last metadata row counts
        ([(6, "d", 60)], [(16, "d", 60)]),  # 'never' and 'orphan' are over
        ([(7, "e", 62)], [(17, "e", 62), (18, "never", 3)]),  # too late by now
        ([(8, "f", 200)], [(19, "f", 200)]),
        ([(10, "g", 300)], [(20, "g", 300)]),
    ]
    for k in range(len(batches)):
        meta, payload = batches[k]
        spark.createDataFrame([(i, m, at(x)) for i, m, x in meta], META).coalesce(1).write.mode("append").parquet(str(tmp_path / "meta"))
        spark.createDataFrame([(i, m, f"p{i}", "g", at(x)) for i, m, x in payload], PAYLOAD).coalesce(1).write.mode("append").parquet(str(tmp_path / "payload"))
        rows = pairing.paired(spark.readStream.schema(META).parquet(str(tmp_path / "meta")), spark.readStream.schema(PAYLOAD).parquet(str(tmp_path / "payload")))
        query = rows.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        sizes = [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    joined = sorted((r["message_id"], r["app_sequence_id"], r["id"], r["message"]) for r in got if r["outcome"] == "JOINED")
    assert joined == [("a", 1, 11, "p11"), ("b", 2, 13, "p13"), ("c", 9, 15, "p15"), ("d", 6, 16, "p16"), ("e", 7, 17, "p17"), ("f", 8, 19, "p19"), ("g", 10, 20, "p20")]
    assert sorted((r["outcome"], r["message_id"], r["app_sequence_id"]) for r in got if r["outcome"] != "JOINED") == [("NO_METADATA", "orphan", None), ("NO_PAYLOAD", "late", 4), ("NO_PAYLOAD", "never", 3)]
    # all but the last messages are forgotten
    assert sizes[-1] <= 2


def test_pairs_of_batches(spark, tmp_path):
    """The batches of the test above, each handled twice, as after a stop; a payload's text isn't kept once it has gone on."""
    at = lambda m: T0 + dt.timedelta(minutes=m)
    batches = [
        ([(1, "a", 1), (2, "b", 2), (3, "never", 3)], [(11, "a", 1), (12, "orphan", 2)]),
        ([(4, "late", 20)], [(13, "b", 22), (14, "a", 23), (15, "c", 24)]),
        ([(5, "c", 25), (9, "c", 26)], []),
        ([], []),
        ([(6, "d", 60)], [(16, "d", 60)]),
        ([(7, "e", 62)], [(17, "e", 62), (18, "never", 3)]),
        ([(8, "f", 200), (21, None, 200)], [(19, "f", 200)]),
        ([(10, "g", 300)], [(20, "g", 300)]),
    ]
    for every in (2, 10):
        pairs = pairing.Pairs(str(tmp_path / f"every-{every}"), every=every)
        for k, (meta, payload) in enumerate(batches):
            meta = spark.createDataFrame([(i, m, at(x)) for i, m, x in meta], META)
            payload = spark.createDataFrame([(i, m, f"p{i}", "g", at(x)) for i, m, x in payload], PAYLOAD)
            for _ in range(2):
                pairs.handle(pairing.both(meta, payload), k)
            if k == 1:
                assert {(r["message_id"], r["joined"], r["message"]) for r in pairs.waiting.read(spark, k).collect()} == {("a", True, None), ("b", True, None), ("never", False, None), ("orphan", False, "p12"), ("late", False, None), ("c", False, "p15")}
        got = pairs.told(spark)
        assert got.schema.simpleString() == spark.createDataFrame([], pairing.PAIRED).schema.simpleString()
        got = sorted((r["outcome"], r["message_id"], r["app_sequence_id"], r["id"], r["message"], r["created_at"]) for r in got.collect())
        joined = [("a", 1, 11, 1), ("b", 2, 13, 2), ("c", 9, 15, 26), ("d", 6, 16, 60), ("e", 7, 17, 62), ("f", 8, 19, 200), ("g", 10, 20, 300)]
        alone = [("NO_METADATA", "orphan", None, 12, "p12", at(2)), ("NO_PAYLOAD", "late", 4, None, None, at(20)), ("NO_PAYLOAD", "never", 3, None, None, at(3))]
        assert got == [("JOINED", m, s, i, f"p{i}", at(x)) for m, s, i, x in joined] + alone
        assert {r["message_id"] for r in pairs.waiting.read(spark, len(batches) - 1).collect()} == {"g"}


def test_paired_streams_handles_no_message_on_its_own(spark, monkeypatch):
    """Keyed state in Python takes milliseconds a message: 254 s for the 100,000 events of sf0.1."""
    from gleanbox.plans import stateful  # noqa: F401
    from gleanbox.plans.registry import QUERIES

    monkeypatch.setattr(pairing, "paired", None)
    assert QUERIES["paired_streams"](spark, "/root/testdata/sf0.001").groupBy("outcome").count().count() == 3
