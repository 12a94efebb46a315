"""Mixing sources, against plain apportionment."""

import heapq
import random
import re

import compare
import pytest
from pyspark.sql import functions as F

from gleanbox.llm import mixing as M
from gleanbox.llm import queries


def plain_targets(sizes):
    """{source: size} -> {source: target}, by fixing capped sources one round after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    fixed, free, total = {}, set(order), sum(sizes.values())
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return fixed


def plain_sainte_lague(weights, seats):
    won = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        won[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * won[k] + 1), k))
    return won


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 1000, 50_000]) for s in [None, "", "a", "B", "é", "z1", "z10", "z2"]}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    r = random.Random(seed)
    weights = [r.choice([0.0, 1.0, 3.5, 1000.0 * r.random(), 1e6 * r.random()]) + k * 1e-7 for k in range(30)]
    for seats in (0, 1, 7, 100, 5000):
        rows = spark.createDataFrame([(k, w) for k, w in enumerate(weights)], "k int, w double")
        got = {r["k"]: r["seats"] for r in M.sainte_lague(rows, [F.lit(0)], ["k"], "w", F.lit(seats)).collect()}
        assert [got[k] for k in range(len(weights))] == plain_sainte_lague(weights, seats)


def test_mix(spark, make_docs, odd_docs):
    r = random.Random(1)
    rows = [(100 + k, " ".join(["w"] * r.randrange(0, 60)), "en", r.choice(["big"] * 20 + ["small", None, "mid", "mid"])) for k in range(900)]
    docs = make_docs(rows).unionByName(odd_docs).withColumn("target", F.lit("clash"))
    got = M.mix_sources(docs, shard_docs=50).collect()
    assert len(got) == docs.count()
    sizes = {}
    for x in got:
        assert x["size"] == len(re.findall(r"[^ \t-\r]+", x["text"] or "")) and 0 <= x["taken"] <= 3 * x["size"]
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
    targets = plain_targets(sizes)
    for s in sizes:
        assert {(x["source_size"], round(x["target"], 6)) for x in got if x["source"] == s} == {(sizes[s], round(targets[s], 6))}
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - targets[s]) <= M.BLOCK_TOKENS
    again = M.mix_sources(docs.repartition(7), shard_docs=50).collect()
    key = lambda x: repr((x["doc_id"], x["text"], x["taken"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    report = M.mix_report(docs, shard_docs=50).collect()
    assert sorted((repr(x["doc_id"]), x["taken"]) for x in report) == sorted((repr(x["doc_id"]), x["taken"]) for x in got)
    assert M.mix_sources(docs.limit(0)).count() == 0


def test_columns_of_helper_names(spark, make_docs):
    names = ["shard", "shard_size", "quota", "source_blocks", "_h", "h", "n_shards", "row", "own", "full", "cum", "weight"]
    docs = make_docs([(k, "a b c " * (k % 7), "en", "st"[k % 2]) for k in range(40)]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    got = M.mix_sources(docs, shard_docs=10)
    assert got.columns == [*docs.columns, "size", "source_size", "target", "taken"]
    rows = got.collect()
    assert len(rows) == 40 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_agrees_with_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare.differences(queries.op10_sainte_lague_mix(spark, sf), compare.connection(sf), queries.oracle_sql()["op10_sainte_lague_mix"]) == ""


def test_a_source_per_document(spark):
    """Very many sources: the windows over all of them take time in proportion."""
    import time

    n = 60_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("h"), "id").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 40).cast("int")).alias("text"))
    start = time.perf_counter()
    got = M.mix_report(docs).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("target").alias("target"), F.sum((F.col("taken") > 3 * F.col("size")).cast("int")).alias("over")).first()
    assert (got["n"], got["over"]) == (n, 0) and got["target"] == pytest.approx(got["size"])
    assert time.perf_counter() - start < 60
