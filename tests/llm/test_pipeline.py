"""The whole pipeline on the smallest scale, stage by stage."""

import corpus_pipeline as C
from test_lines import plain as plain_lines

from gleanbox.llm import decontaminate, mixing, neardup
from gleanbox.llm import lines as L
from gleanbox.llm.common import alnum_words, materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    for k, (name, stage) in enumerate(C.STAGES):
        docs = materialize(stage(spark, docs, SF), "test")
        after = docs.collect()
        assert docs.columns[:5] == columns and (k == 4 or docs.columns == columns)
        was = {r["doc_id"]: r for r in before}
        assert {r["doc_id"] for r in after} <= set(was)
        if name == "language ID":
            assert len(after) >= 0.98 * len(before)
        elif name == "line dedup":
            want = plain_lines([(r["doc_id"], r["text"]) for r in before], L.MIN_DOCS, L.MIN_TOKENS)
            assert {r["doc_id"]: r["text"] for r in after} == {d: want[r["text"]] for d, r in was.items()}
        elif name == "near-dedup":
            rows = [(r["doc_id"], neardup.shingles(neardup.words(r["text"]), 5)) for r in before]
            link = {d: {e for e, b in rows if a and b and 100 * len(a & b) >= 80 * len(a | b)} | {d} for d, a in rows}
            group = {}
            for d in sorted(link):
                todo = [d]
                while todo:
                    x = todo.pop()
                    if x not in group:
                        group[x] = d
                        todo += link[x]
            assert {r["doc_id"] for r in after} == {d for d, g in group.items() if d == g}
        elif name == "decontamination":
            items = [b" " + b" ".join(alnum_words(r["text"])) + b" " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            leaks = {d for d, r in was.items() if any(i in b" " + b" ".join(alnum_words(r["text"])) + b" " for i in items)}
            assert {r["doc_id"] for r in after} == set(was) - leaks
        else:
            assert sum(r["taken"] for r in after) > 0 and all(0 < r["taken"] <= 3 * r["size"] for r in after)
            assert sum(r["taken"] for r in after) <= sum(len(r["text"].split()) for r in before) * 1.05
        before = after
    assert decontaminate.THRESHOLD and mixing.CAP == 3


def test_run_is_the_query(spark):
    from gleanbox.llm.queries import queries

    got = {r["doc_id"] for r in queries()["pipeline"](spark, SF).collect()}
    assert got == {r["doc_id"] for r in C.run(spark, SF).collect()} and got


def test_empty_tables(spark, make_docs, tmp_path):
    for name, schema in (("documents", None), ("benchmark", "item_id long, text string")):
        table = make_docs([]) if schema is None else spark.createDataFrame([], schema)
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, make_docs, odd_docs, prose, tmp_path):
    """Nulls, repeated rows, copies, a leak, and columns called as the stages call their own."""
    english = [(k, prose(k, 60), "en", "a" if k % 2 else None) for k in range(100, 130)]
    copies = [(200, english[0][1], "en", "a"), (201, english[0][1], "en", "b")]
    leak = [(300, prose(77, 30) + "\nwhat is the capital of that small far country of ours then " + prose(78, 30), "en", "a")]
    docs = make_docs([*english, english[3], english[3], *copies, *leak]).unionByName(odd_docs)
    clash = docs.selectExpr("*", "doc_id as row", "1 as size", "2 as taken", "3 as h", "4 as shard", "'x' as word", "5 as places", "6 as target", "'k' as key", "7 as n", "8 as quota")
    clash.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "what is the capital of that small far country of ours then"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids <= {r["doc_id"] for r in clash.select("doc_id").collect()}
    assert ids.isdisjoint({1, 2, 3, 200, 201, 300})  # null and empty texts, copies of 100, the leak
    assert all(r["row"] == r["doc_id"] and r["quota"] == 8 and r["taken"] > 0 for r in got)
    assert len(ids & set(range(100, 130))) >= 10
