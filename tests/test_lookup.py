"""Look-ups by message_id that open few files."""

import random

from pyspark.sql import functions as F

from gleanbox.sources.lookup import FileIndex

SCHEMA = "id long, message_id string, message string"


def test_look_ups_open_the_files_that_hold_the_ids(spark, tmp_path):
    table, r = str(tmp_path / "t"), random.Random(2)
    rows = [(i, f"m{r.getrandbits(60)}", f"p{i}") for i in range(2000)] + [(5000, None, "no id")]
    for k in range(20):
        part = rows[100 * k : 100 * k + 100] + ([rows[-1]] if k == 3 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(table)
    index = FileIndex(table, str(tmp_path / "index"), buckets=8)
    ask = lambda ids: spark.createDataFrame([(i,) for i in ids], "message_id string")
    assert index.find(ask(["m1"])).count() == 0  # an index that is not built yet
    assert index.refresh(spark) == 20 and index.refresh(spark) == 0
    for n in (1, 3, 8):
        some = r.sample(rows[:-1], n)
        found = index.find(ask([m for _, m, _ in some] + ["unknown", None]))
        assert sorted(map(tuple, found.collect())) == sorted(some)
        opened = len({f for f in found.inputFiles()} & set(spark.read.parquet(table).inputFiles()))
        assert opened == len({i // 100 for i, _, _ in some}) and opened <= n
    assert sorted(map(tuple, index.find(ask([m for _, m, _ in rows])).collect())) == sorted(rows[:-1])  # no id is missed
    # only new files are read when more comes, and an id that comes again is in both
    spark.createDataFrame([(9000, rows[0][1], "again"), (9001, "new", "x")], SCHEMA).coalesce(1).write.mode("append").parquet(table)
    assert index.find(ask(["new"])).count() == 0
    assert index.refresh(spark) == 1
    assert sorted(x["id"] for x in index.find(ask([rows[0][1], "new"])).collect()) == [rows[0][0], 9000, 9001]
    assert index.find(ask([])).count() == 0
    plan = index.entries(spark).filter(F.col("bucket").isin([1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1][:80]
