"""The stream gives what the batch job gives."""

import datetime as dt
import os
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from gleanbox.operators import drain, relay
from gleanbox.streaming import relay_stream

WORK = "group_id string, id long, message_id string, kind string, kind_rank int, code int, failed boolean, ignored boolean"


def work_rows(n):
    return [(f"g{i % 5}", i, f"m{i}", "NEW", 3, 500 if i % 7 == 3 else 200, i % 7 == 3, False) for i in range(1, n)]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows, state = work_rows(60), [("g1", "UNSIDELINED", 21), ("g2", "SIDELINED", 12)]
    groups = spark.createDataFrame(state, "group_id string, status string, last_id long")
    path = str(tmp_path / "in")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, WORK).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(WORK).parquet(path)
    out = relay_stream.group_outcomes(stream, groups).writeStream.format("memory").queryName("drained").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).option("maxFilesPerTrigger", 1).start()
    end = time.time() + 100
    while time.time() < end and spark.sql("select * from drained").count() < len(rows):
        time.sleep(0.3)
    out.stop()  # a query with timers goes on for ever
    got = {(r["group_id"], r["id"]): (r["outcome"], r["http_status_code"]) for r in spark.sql("select * from drained").collect()}
    batch, after = drain.group_drain(spark.createDataFrame(rows, WORK), groups)
    assert got == {(r["group_id"], r["id"]): (r["outcome"], r["http_status_code"]) for r in batch.collect()}
    assert after.count() <= 5


def test_batches_metrics_and_gaps(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, f"m{i}", None, start + dt.timedelta(seconds=i), 200 if i % 3 else 500, i) for i in range(1, 20) if i != 7]
    schema = "id long, message_id string, group_id string, created_at timestamp, code int, lag_ms long"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    source = relay_stream.read_outbox(spark, path, schema)
    seen = []

    def handle(batch, n):
        seen.append((relay_stream.batch_gaps(batch, 0).collect(), relay_stream.changed_checkpoints(batch, spark.createDataFrame([], "process_id string, message_id string"), 3).count()))
        old, young = relay_stream.ripe(batch, F.lit(start + dt.timedelta(seconds=20)), 10)
        seen.append((old.count(), young.count()))

    relay_stream.relay_batches(source, handle, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in seen[0][0]] == [(7, 8)] and seen[0][1] == 3
    assert seen[1] == (8, 10)
    q = relay_stream.metrics(source).writeStream.format("memory").queryName("figures").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # windows that the watermark has not passed are not told yet
    assert spark.sql("select * from figures").columns == ["window_start", "n_sent", "n_failed", "max_lag_ms"]
    hour = dt.timedelta(hours=1)
    spark.createDataFrame([(100, "m100", None, start + hour, 200, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(101, "m101", None, start + 2 * hour, 200, 1)], schema).coalesce(1).write.mode("append").parquet(path)
    relay_stream.metrics(source).writeStream.format("memory").queryName("figures2").outputMode("append").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r["window_start"]: (r["n_sent"], r["n_failed"], r["max_lag_ms"]) for r in spark.sql("select * from figures2").collect()}
    own = [r for r in rows if 4 <= r[0] < 8]
    assert got[start + dt.timedelta(seconds=4)] == (len(own), sum(r[4] != 200 for r in own), max(r[5] for r in own))


MESSAGE = "id long, message_id string, message string, group_id string, created_at timestamp"
TASK = "id long, task_type string, group_id string, message_id string, from_date timestamp, to_date timestamp, created_at timestamp"
T0 = dt.datetime(2024, 1, 1, 12)


def row(i, group=None, minutes=None):
    return (i, f"m{i}", f"{{{i}}}", group, T0 + dt.timedelta(minutes=i if minutes is None else minutes))


def logging_sender(folder, failing, crash=None):
    """Answers by id, and writes each message that it is given to a file; ``crash`` is a hook before a slice."""

    def send(part):
        if crash:
            crash(part)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.writelines(f"{time.time_ns()} {i}\n" for i in part["id"])
        return [failing.get(int(i), 200) for i in part["id"]]

    return send


def sent_ids(folder):
    """Ids in the order in which they were sent."""
    lines = [line.split() for f in os.listdir(folder) for line in open(f"{folder}/{f}")]
    return [int(i) for _, i in sorted((int(t), i) for t, i in lines)]


def frame(spark, new, tasks=()):
    return relay_stream.relay_input(spark.createDataFrame(list(new), MESSAGE), spark.createDataFrame(list(tasks), TASK))


def lookup(spark, rows):
    return lambda wanted: spark.createDataFrame(rows, MESSAGE).join(wanted, "message_id", "left_semi")


def test_continuous_relay(spark, tmp_path):
    """Late, held and missing rows over four batches with a stop between, against the batch job."""
    files = [
        [row(1), row(2, "g"), row(4, "h"), row(6, "g"), row(7)],  # 3 and 5 are missing
        [row(3, "h"), row(8, "g"), row(90, None, 90)],  # 3 turns up in time; 9 to 89 are missing
        [row(5), row(91, "g", 91), row(92, "h", 92)],  # 5 is too late by now
        [row(50, None, 93), row(93, None, 200)],  # 50 is in time; 93 is too young
    ]
    source, base, log = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "log")
    os.makedirs(log)
    failing = {6: 503, 92: 404}

    def start(now):
        job = relay_stream.Relay(base, logging_sender(log, failing), lanes=3, delay_seconds=60, late_minutes=30, now=F.lit(T0 + dt.timedelta(minutes=now)))
        stream = relay_stream.read_outbox(spark, source, MESSAGE)
        relay_stream.relay_batches(stream, job.handle, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        return job

    for k, rows in enumerate(files):
        spark.createDataFrame(rows, MESSAGE).coalesce(1).write.mode("append").parquet(source)
        job = start(190) if k in (1, 3) else None  # stopped and started again; two batches a run
    outcome = {r["id"]: (r["outcome"], r["reason"], r["http_status_code"]) for n in range(4) for r in job.told(spark, "outcome", n).collect()}
    every = spark.createDataFrame([r for rows in files for r in rows if r[0] not in (5, 93)], MESSAGE)
    answers = spark.createDataFrame([(i, failing.get(i, 200)) for i in range(1, 94)], "id long, status_code int")
    want = relay.relay_outcome(every, answers, spark.createDataFrame([], "group_id string")).collect()
    held = {"HELD": "SIDELINED"}
    assert {i: (held.get(o, o), *x) for i, (o, *x) in outcome.items()} == {r["id"]: (r["outcome"], r["reason"], r["http_status_code"]) for r in want}
    # what is held behind a failure never reached the sender, and nothing was sent twice
    assert sorted(sent_ids(log)) == sorted(r["id"] for r in want if r["reason"] != "GROUP_SIDELINED")
    ids = lambda rows: {i for r in rows for i in range(r["start_id"], r["end_id"])}
    assert {i for n in range(4) for i in ids(job.told(spark, "expired", n).collect())} == {5}
    read = lambda name: job.state(spark, name, 3).collect()
    assert [r["id"] for r in job._small(spark, "held", 3).collect()] == [93]
    assert ids(read("skipped")) == set(range(9, 90)) - {50} and len(read("skipped")) == 2
    assert {(r["group_id"], r["status"], r["last_id"]) for r in read("groups")} == {("g", "SIDELINED", 91), ("h", "SIDELINED", 92)}
    assert {r["id"]: r["sideline_reason_code"] for r in read("sidelined")} == {6: "HTTP_ERROR", 8: "GROUP_SIDELINED", 91: "GROUP_SIDELINED", 92: "HTTP_ERROR"}
    assert job._small(spark, "position", 3).first()["id"] == 92 and job.done(spark) == 3
    # a batch that runs again writes the same, and sends nothing again
    before = sent_ids(log)
    job.handle(spark.createDataFrame(files[3], MESSAGE), 3)
    assert sent_ids(log) == before and {r["id"] for r in job.told(spark, "outcome", 3).collect()} == {50}


class Plain:
    """The same cycles one message after the other, on dicts."""

    def __init__(self, failing, cycle):
        self.failing, self.cycle = failing, cycle
        self.sidelined, self.groups, self.missing, self.last, self.held, self.sent = {}, {}, set(), None, [], []

    def batch(self, new, tasks):
        rows = {r[0]: r for r in self.held + list(new)}
        self.held = []
        fresh = set()
        for _, kind, group, message, since, until, _ in sorted(tasks):
            if kind == "UNSIDELINE_GROUP":
                fresh |= {m for m, s in self.sidelined.items() if s["group"] == group}
                if group in self.groups:
                    self.groups[group] = ("UNSIDELINED", self.groups[group][1])
            elif kind == "UNSIDELINE_MESSAGE":
                fresh |= {message} & set(self.sidelined)
            elif kind == "UNSIDELINE_ALL_UNGROUPED":
                fresh |= {m for m, s in self.sidelined.items() if s["group"] is None and since <= s["updated"] <= until}
        for m in fresh:
            self.sidelined[m]["status"] = "UNSIDELINED"
        claimed = sorted((s["id"], m) for m, s in self.sidelined.items() if s["status"] == "UNSIDELINED")[: self.cycle]
        work = [(1, i, m, self.sidelined[m]["group"]) for i, m in claimed]
        full = len(claimed) >= self.cycle
        behind = sorted(i for i in rows if self.last is not None and i <= self.last)
        ahead = sorted(i for i in rows if self.last is None or i > self.last)
        late, new_ids = ([], []) if full else (behind[: self.cycle], ahead[: self.cycle])
        if len(late) >= self.cycle:
            new_ids = []
        self.held = [rows[i] for i in rows if i not in late and i not in new_ids]
        work += [(2, i, rows[i][1], rows[i][3]) for i in late if i in self.missing] + [(3, i, rows[i][1], rows[i][3]) for i in new_ids]
        self.missing -= set(late)
        if new_ids:
            if self.last is not None:
                self.missing |= set(range(self.last + 1, new_ids[-1])) - set(new_ids)
            else:
                self.missing |= set(range(new_ids[0], new_ids[-1])) - set(new_ids)
            self.last = new_ids[-1]
        names = {1: "UNSIDELINED", 2: "SKIPPED", 3: "NEW"}
        for group in {g for *_, g in work}:
            own = [(k, i, m, names[k], self.failing.get(i, 200), i in self.failing, False) for k, i, m, g in work if g == group]
            status, last = self.groups.get(group, (None, None))
            if group is None:
                done = [o for x in own for o in drain.drain_group(None, None, [x])[2]]
            else:
                status, last, done = drain.drain_group(status, last, own)
                self.groups.pop(group, None)
                if status:
                    self.groups[group] = (status, last)
            for i, m, kind, what, reason, code, _, new_status in done:
                if what != "HELD":
                    self.sent.append((group, i))
                if what == "RELAYED":
                    self.sidelined.pop(m, None)
                else:
                    self.sidelined.setdefault(m, {"id": i, "group": group})
                    self.sidelined[m] |= {"status": new_status, "reason": reason, "code": code, "updated": self.now}


@pytest.mark.parametrize("seed", [1])
def test_cycles_with_releases_equal_the_plain_relay(spark, tmp_path, seed):
    """Failures, releases, late ids and full cycles over many batches, with the relay started anew in between."""
    r = random.Random(seed)
    log = str(tmp_path / "log")
    os.makedirs(log)
    groups, order = [None, "a", "b", "c", "c", "c"], list(range(1, 70))
    every = {i: row(i, r.choice(groups)) for i in order}
    failing = {i: r.choice([404, 500]) for i in order if r.random() < 0.12}
    skipped = set(r.sample(order[5:], 8))
    batches, at, waiting, n = [], 0, sorted(skipped), 9
    for _ in range(6):
        new = [i for i in order[at : at + n] if i not in skipped]
        at += n
        new += [waiting.pop(0) for _ in range(r.choice([0, 1, 2])) if waiting and waiting[0] < at - n]
        batches.append([every[i] for i in new])
    plain, mended = Plain(failing, 9 if seed else 100), dict(failing)
    job = None
    for k, new in enumerate(batches):
        now = T0 + dt.timedelta(minutes=100 + k)
        since, until = T0, T0 + dt.timedelta(days=1)
        tasks = []
        if k in (2, 4):
            tasks += [(10 * k + 1, "UNSIDELINE_GROUP", r.choice("abc"), None, None, None, T0), (10 * k + 2, "UNSIDELINE_ALL_UNGROUPED", None, None, since, until, T0), (10 * k + 3, "MANAGE_PARTITION", None, None, None, None, T0)]
        if k == 3:
            tasks += [(31, "UNSIDELINE_MESSAGE", None, f"m{r.choice(order)}", None, None, T0), (32, "UNSIDELINE_GROUP", "c", None, None, None, T0)]
        if k == 4:
            mended.clear()  # from now on all is delivered
        if k in (0, 4):
            job = None
        own = job or relay_stream.Relay(str(tmp_path / "state"), None, payloads=lookup(spark, list(every.values())), lanes=2, late_minutes=10_000, cycle_rows=plain.cycle, compact_every=3)
        own.now, own.send = F.lit(now), logging_sender(log, dict(mended))
        if job is None and k:  # a relay that is started again takes up ungrouped rows too, if there are sidelined groups
            if any(s == "SIDELINED" for s, _ in plain.groups.values()):
                for s in plain.sidelined.values():
                    if s["group"] is None:
                        s["status"] = "UNSIDELINED"
        job = own
        plain.failing, plain.now = dict(mended), now
        job.handle(frame(spark, new, tasks), k)
        plain.batch(new, tasks)
        assert {(x["group_id"], x["status"], x["last_id"]) for x in job.state(spark, "groups", k).collect()} == {(g, *s) for g, s in plain.groups.items()}
        assert {x["message_id"]: (x["id"], x["group_id"], x["status"], x["sideline_reason_code"], x["http_status_code"]) for x in job.state(spark, "sidelined", k).collect()} == {m: (s["id"], s["group"], s["status"], s["reason"], s["code"]) for m, s in plain.sidelined.items()}
        assert {i for x in job.state(spark, "skipped", k).collect() for i in range(x["start_id"], x["end_id"])} == plain.missing
    assert sorted(sent_ids(log)) == sorted(i for _, i in plain.sent)
    for group in ("a", "b", "c"):  # each group's messages went out in the plain order
        mine = [i for i in sent_ids(log) if every[i][3] == group]
        assert mine == [i for g, i in plain.sent if g == group]
    assert {(x["id"], x["status"]) for x in job.state(spark, "tasks", 5).collect()} >= {(23, "FAILED"), (21, "DONE")}
    assert job.state(spark, "checkpoints", 5).count() <= 2


def test_lanes_that_were_done_are_not_sent_again(spark, tmp_path):
    """One lane dies in mid-batch after the others ended: when the batch runs again only its rows go out."""
    log, gate = str(tmp_path / "log"), str(tmp_path / "gate")
    os.makedirs(log)

    def crash(part):
        if (part["group_id"] == "stuck").any() and not os.path.exists(gate):
            time.sleep(6)  # the other lanes end meanwhile
            os._exit(3)  # the machine goes down

    rows = [row(i, "stuck" if i == 13 else f"g{i}") for i in range(1, 25)]
    make = lambda: relay_stream.Relay(str(tmp_path / "state"), logging_sender(log, {}, crash), lanes=8, now=F.lit(T0))
    with pytest.raises(Exception, match="crashed|EOF"):
        make().handle(frame(spark, rows), 0)
    first = sent_ids(log)
    assert 0 < len(first) < 24
    open(gate, "w").close()
    job = make()
    job.handle(frame(spark, rows), 0)
    later = sent_ids(log)[len(first) :]
    assert set(first) | set(later) == set(range(1, 25))
    finished = len(set(first) - set(later))
    assert finished >= len(first) - 4 and 13 in later and len(later) <= 24 - finished
    assert {r["id"]: r["outcome"] for r in job.told(spark, "outcome", 0).collect()} == {i: "RELAYED" for i in range(1, 25)}
    job.handle(frame(spark, rows), 0)
    assert len(sent_ids(log)) == len(first) + len(later)


def test_first_rows_by_id_are_not_brought_into_one_task(spark, monkeypatch):
    from gleanbox.streaming import relay_stream

    monkeypatch.setattr(relay_stream, "BLOCKS", 7)
    monkeypatch.setattr(relay_stream, "FEW_ROWS", 5)
    ids = [-40, *range(3, 60), 1000, 1001, *range(10**12, 10**12 + 40)]
    rows = spark.createDataFrame([(i, f"m{i}") for i in reversed(ids)], "id long, m string")
    for n in (0, 1, 2, 30, 58, 60, 61, 80, len(ids), 10**9):
        assert sorted(r["id"] for r in relay_stream.first_by_id(rows, n).collect()) == ids[:n]
    assert relay_stream.first_by_id(rows.limit(0), 3).count() == 0
    same = spark.createDataFrame([(5, str(k)) for k in range(20)] + [(1, "a")], "id long, m string")
    assert sorted(r["id"] for r in relay_stream.first_by_id(same, 8).collect()) == [1] + [5] * 7
    every = relay_stream.first_by_id(rows, len(ids))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in every and "Sort" not in every
