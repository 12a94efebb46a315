"""Archiving as verified drops, and sketches that merge."""

import os
import random

import pytest
from pyspark.sql import functions as F

from gleanbox.operators import health
from gleanbox.sources import archive
from gleanbox.sources.archive import IdPartitions


def tables(spark, folder, n=100, size=10):
    made = [IdPartitions(f"{folder}/{name}", size) for name in ("messages", "skipped", "metadata")]
    for table in made:
        table.append(spark.range(n).withColumn("message_id", F.concat(F.lit("m"), "id")))
    return made


def ids(spark, table):
    return sorted(r["id"] for r in table.read(spark).collect())


def files(table):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(table.base) for f in fs if f.endswith(".parquet")}


def wanted(spark, numbers):
    return spark.createDataFrame([(n,) for n in numbers], "partition_no long")


@pytest.mark.parametrize(("modes", "kept"), [(("DEFAULT", "DEFAULT"), False), (("OUTBOUND_READER", "DEFAULT"), True), (("DEFAULT", "OUTBOUND"), True)])
def test_archive_drops_folders(spark, tmp_path, modes, kept):
    messages, skipped, metadata = tables(spark, tmp_path)
    before = files(messages)
    assert archive.archive_partitions(spark, messages, skipped, metadata, wanted(spark, [0, 2]), str(tmp_path / "backup"), *modes) == [0, 2]
    # a bound is stored in the partition after it: partition 2 holds 20 to 29
    assert ids(spark, messages) == [i for i in range(100) if i // 10 not in (0, 2)]
    assert ids(spark, skipped) == list(range(30, 100))
    assert ids(spark, metadata) == (list(range(100)) if kept else list(range(30, 100)))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "backup" / "rows")).collect()) == [*range(10), *range(20, 30)]
    assert {f: t for f, t in files(messages).items()} == {f: t for f, t in before.items() if "=0/" not in f and "=2/" not in f}  # no retained row was written anew
    assert archive.archive_partitions(spark, messages, skipped, metadata, wanted(spark, []), str(tmp_path / "backup")) == []


def test_a_stop_between_any_two_steps_is_safe(spark, tmp_path, monkeypatch):
    """Stopped at each file operation in turn and run again: all rows are in the table or in a verified copy, and the end is the same."""
    real = {name: getattr(archive, name) for name in ("remove", "touch")}
    for stop in (0, 2, 3, 5, 7):
        folder, done = tmp_path / str(stop), [0]
        messages, skipped, metadata = tables(spark, folder, n=40)

        def step(name, *a, stop=stop, done=done):
            if done[0] == stop:
                raise KeyboardInterrupt(name)
            done[0] += 1
            return real[name](*a)

        for name in real:
            monkeypatch.setattr(archive, name, lambda *a, name=name, step=step: step(name, *a))
        with pytest.raises(KeyboardInterrupt):
            archive.archive_partitions(spark, messages, skipped, metadata, wanted(spark, [0, 1]), str(folder / "backup"))
        for name, f in real.items():
            monkeypatch.setattr(archive, name, f)
        copied = folder / "backup" / "verified"
        safe = {i for n in (os.listdir(copied) if copied.exists() else []) if n.isdigit() for i in range(10 * int(n), 10 * int(n) + 10)}
        assert set(ids(spark, messages)) | safe == set(range(40))
        archive.archive_partitions(spark, messages, skipped, metadata, wanted(spark, [0, 1]), str(folder / "backup"))
        assert ids(spark, messages) == ids(spark, skipped) == ids(spark, metadata) == list(range(20, 40))
        assert sorted(r["id"] for r in spark.read.parquet(str(folder / "backup" / "rows")).collect()) == list(range(20))


def test_nothing_is_dropped_for_a_copy_that_differs(spark, tmp_path, monkeypatch):
    messages, skipped, metadata = tables(spark, tmp_path, n=30)
    sums = archive._sums
    monkeypatch.setattr(archive, "_sums", lambda t: {n: (c, h + (1 if "backup" in t.inputFiles()[0] and n == 1 else 0)) for n, (c, h) in sums(t).items()})
    with pytest.raises(RuntimeError, match=r"\[1\]"):
        archive.archive_partitions(spark, messages, skipped, metadata, wanted(spark, [0, 1]), str(tmp_path / "backup"))
    assert ids(spark, messages) == ids(spark, metadata) == list(range(30))


def test_sketches_merge_within_their_bound(spark):
    r = random.Random(5)
    values = [(f"r{k % 3}", k // 1000, int(r.lognormvariate(5, 2))) for k in range(12_000)] + [("r0", 0, None)]
    rows = spark.createDataFrame(values, "relayer_id string, period int, lag_ms int")
    sketches = health.value_sketches(rows, "lag_ms", "relayer_id", "period").cache()
    assert sketches.count() == 36 and sketches.agg(F.sum("n")).first()[0] == 12_000
    ranks = (0.05, 0.5, 0.95, 0.99)
    for by, of in ((["relayer_id"], lambda v: v[0]), ([], lambda v: None)):
        for got in health.merged_quantiles(sketches, *by, ranks=ranks).collect():
            own = sorted(v[2] for v in values if v[2] is not None and of(v) == (got["relayer_id"] if by else None))
            assert got["n"] == len(own)
            for rank in ranks:
                told = got[f"p{round(rank * 100)}"]
                low, high = sum(x < told for x in own) / len(own), sum(x <= told for x in own) / len(own)
                assert low - 0.01 <= rank <= high + 0.01
    assert health.merged_quantiles(health.value_sketches(rows.limit(0), "lag_ms", "relayer_id"), "relayer_id").count() == 0
