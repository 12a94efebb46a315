"""The ordered sender: what it is called with, and what it tells."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gleanbox.operators import drain
from gleanbox.sources import ordered, outbox

WORK = "group_id string, id long, message_id string, kind string, kind_rank int, message string"
STATE = "group_id string, status string, last_id long"


def recording(folder, codes):
    """A sender that writes each call to a file of its worker, and answers from ``codes``."""

    def send(part):
        with open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}.json", "w") as f:
            json.dump([[g if isinstance(g, str) else None, int(i)] for g, i in zip(part["group_id"], part["id"], strict=True)], f)
        return [codes.get(int(i), 200) for i in part["id"]]

    return send


def calls(folder):
    return [json.load(open(f"{folder}/{f}")) for f in os.listdir(folder)]


def work_of(spark, rows):
    kinds = {1: "UNSIDELINED", 2: "SKIPPED", 3: "NEW"}
    return spark.createDataFrame([(g, i, f"m{i}", kinds[k], k, f"{{{i}}}") for g, i, k in rows], WORK)


def test_nothing_behind_a_failure_is_sent(spark, tmp_path):
    """The group of four messages whose second fails: only two reach the sender."""
    send = recording(str(tmp_path), {2: 500})
    got = ordered.deliver_in_order(work_of(spark, [("G", i, 3) for i in (1, 2, 3, 4)]), send, spark.createDataFrame([], STATE)).collect()
    assert sorted(x for c in calls(tmp_path) for x in c) == [["G", 1], ["G", 2]]
    assert {r["id"]: (r["sent"], r["status_code"]) for r in got} == {1: (True, 200), 2: (True, 500), 3: (False, None), 4: (False, None)}


@pytest.mark.parametrize("seed", range(4))
def test_sent_as_the_drain_rule_says(spark, tmp_path, seed):
    """Random groups, kinds, states and failures, over small Arrow batches and slices."""
    r = random.Random(seed)
    rows = sorted({(r.choice(["a", "b", "c", "hot", "hot", "hot", None, " "]), r.randrange(1, 400)) for _ in range(150)}, key=repr)
    rows = [(g, i, r.choice([1, 2, 3, 3])) for i, (g, _) in zip(r.sample(range(1, 400), len(rows)), rows, strict=True)]
    state = [(g, r.choice(["SIDELINED", "UNSIDELINED"]), r.randrange(400)) for g in ("a", "hot") if r.random() < 0.7]
    codes = {i: r.choice([404, 503]) for _, i, _ in rows if r.random() < 0.04}
    ignore = {"ignore_4xx": r.random() < 0.5, "ignore_non_4xx": r.random() < 0.2}
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(r.choice([1, 3, 17, 10_000])))
    try:
        work, before = work_of(spark, rows), spark.createDataFrame(state, STATE)
        got = ordered.deliver_in_order(work, recording(str(tmp_path), codes), before, r.choice([None, 1, 5]), r.choice([1, 2, 100]), **ignore).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    graded = [(k, i, f"m{i}", "k", codes.get(i, 200), i in codes, i in codes and (ignore["ignore_4xx"] if codes[i] == 404 else ignore["ignore_non_4xx"])) for _, i, k in rows]
    want = {}
    for group in {g for g, _, _ in rows}:
        own = [x for x, (g, _, _) in zip(graded, rows, strict=True) if g == group]
        if group is None or not group.strip():
            want |= {x[1]: True for x in own}
        else:
            status, last = next(((s, n) for g, s, n in state if g == group), (None, None))
            want |= {o[0]: o[3] != "HELD" for o in drain.drain_group(status, last, own)[2]}
    assert {x["id"]: x["sent"] for x in got} == want and len(got) == len(rows)
    assert all((x["status_code"] == codes.get(x["id"], 200)) if x["sent"] else x["status_code"] is None for x in got)
    seen = [x for c in calls(tmp_path) for x in c]
    assert sorted(i for _, i in seen) == sorted(i for i, sent in want.items() if sent)
    # a call never has two messages of one group
    named = [[g for g, _ in c if g is not None and g.strip()] for c in calls(tmp_path)]
    assert all(len(set(c)) == len(c) for c in named)


def test_order_of_calls(spark, tmp_path):
    """One task: the calls of each group ascend in kind and id, although other groups go on between."""
    log = str(tmp_path / "log")

    def send(part):
        with open(log, "a") as f:
            f.writelines(f"{g} {k} {i}\n" for g, k, i in zip(part["group_id"], part["kind_rank"], part["id"], strict=True))
        return [200] * len(part)

    rows = [(f"g{i % 3}", i, 1 + (i * 7) % 3) for i in range(1, 60)]
    assert ordered.deliver_in_order(work_of(spark, rows), send, spark.createDataFrame([], STATE), partitions=1).filter("sent").count() == 59
    lines = [line.split() for line in open(log)]
    for group in ("g0", "g1", "g2"):
        own = [(int(k), int(i)) for g, k, i in lines if g == group]
        assert own == sorted(own) and len(own) >= 19


def test_a_hot_group_is_held_a_batch_at_a_time(spark, tmp_path):
    """No slice and no batch holds more than one Arrow batch of a group of any size."""
    def send(part):
        return [500 if i == 3000 else 200 for i in part["id"]]

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        rows = spark.range(1, 20_001).selectExpr("'hot' as group_id", "id", "concat('m', id) as message_id", "'NEW' as kind", "3 as kind_rank", "'x' as message")
        got = ordered.deliver_in_order(rows, send, spark.createDataFrame([], STATE)).groupBy("sent").agg(F.count("id").alias("n"), F.max("id").alias("top")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r["sent"]: (r["n"], r["top"]) for r in got} == {True: (3000, 3000), False: (17_000, 20_000)}


def test_answers_and_raising_senders(spark, tmp_path):
    import pandas as pd

    def send(part):
        if (part["id"] == 5).any():
            raise RuntimeError("no line")
        return pd.DataFrame({"status_code": [None if i == 7 else 200 for i in part["id"]], "error": ["no route" if i == 7 else None for i in part["id"]], "body": ["ok"] * len(part)})

    got = ordered.deliver_in_order(work_of(spark, [(None, i, 3) for i in range(1, 10)] + [("g", 11, 3), ("g", 12, 3)]), send, spark.createDataFrame([], STATE)).collect()
    by = {r["id"]: r for r in got}
    assert by[5]["status_code"] == 500 and by[5]["body"] == "no line" and by[7]["error"] == "no route" and by[12]["body"] == "ok"
    assert all(r["sent"] for r in got)
    with pytest.raises(Exception, match="answered 0 of"):
        ordered.deliver_in_order(work_of(spark, [(None, 1, 3)]), lambda part: [], spark.createDataFrame([], STATE)).collect()
    assert ordered.deliver_in_order(work_of(spark, []), send, spark.createDataFrame([], STATE)).count() == 0


def test_broker_rows_keep_their_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 4}", f"v{i}") for i in random.Random(1).sample(range(200), 200)], "id long, sequencing_key string, message string")
    outbox.keyed_requests(rows).write.parquet(str(tmp_path / "out"))
    # each key's rows are in one file, by id
    where = spark.read.parquet(str(tmp_path / "out")).select("key", F.input_file_name().alias("f")).distinct()
    assert where.count() == 4
    for f in [p for p in os.listdir(tmp_path / "out") if p.endswith(".parquet")]:
        own = spark.read.parquet(str(tmp_path / "out" / f)).collect()
        for key in {r["key"] for r in own}:
            got = [int(r["value"][1:]) for r in own if r["key"] == key]
            assert got == sorted(got) and len(got) == 50


def test_broker_rows_without_a_key_are_spread(spark):
    rows = spark.range(400).select("id", F.lit(None).cast("string").alias("sequencing_key"), F.concat(F.lit("v"), "id").alias("message"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["n"] for r in outbox.keyed_requests(rows).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 400 and len(sizes) == 4 and max(sizes) < 200


def test_what_a_broker_is_given(spark, tmp_path):
    """to_kafka against a sink in the broker's place, which writes down what each task hands it."""
    from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

    folder = str(tmp_path)

    class Lines(DataSourceWriter):
        def __init__(self, options):
            self.topic, self.servers = options["topic"], options["kafka.bootstrap.servers"]

        def write(self, rows):
            import json
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.writelines(json.dumps([self.servers, self.topic, r["key"], r["value"]]) + "\n" for r in rows)
            return WriterCommitMessage()

    class Broker(DataSource):
        @classmethod
        def name(cls):
            return "broker_in_place"

        def writer(self, schema, overwrite):
            assert [f.name for f in schema.fields] == ["key", "value"]
            return Lines(self.options)

    spark.dataSource.register(Broker)
    rows = spark.createDataFrame([(i, f"k{i % 3}" if i % 5 else None, f"v{i}") for i in random.Random(2).sample(range(60), 60)], "id long, sequencing_key string, message string")
    outbox.to_kafka(rows, "b1:9092,b2:9092", "orders", format="broker_in_place")
    files = [[json.loads(x) for x in open(f"{folder}/{n}")] for n in os.listdir(folder)]
    assert sorted(x[3] for f in files for x in f) == sorted(f"v{i}" for i in range(60))
    assert {tuple(x[:2]) for f in files for x in f} == {("b1:9092,b2:9092", "orders")}
    for key in ("k0", "k1", "k2"):
        held = [[int(x[3][1:]) for x in f if x[2] == key] for f in files]
        assert [h for h in held if h] == [sorted(i for i in range(60) if i % 5 and i % 3 == int(key[1]))]
