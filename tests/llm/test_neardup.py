"""Near-duplicates, against all pairs."""

import random

import numpy as np
import pytest

from gleanbox.llm import neardup as N
from gleanbox.llm.components import connected_components


def brute(rows, width, percent):
    """(component, set size) of each (doc_id, text)."""
    sets = [N.shingles(N.words(t), width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    groups = {}
    for k, (doc, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(doc)
    return {(doc, t): (min(groups[find(k)]), len(sets[k])) for k, (doc, t) in enumerate(rows)}


def edited(text, seed, n):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, make_docs, prose, width, percent):
    rows, doc = [], 100
    for seed in range(25):
        base = prose(seed, 20 + 9 * seed)
        rows.append((doc := doc + 1, base))
        for k in range(seed % 6):
            base = edited(base, 31 * seed + k, 1 + k % 3)
            rows.append((doc := doc + 1, base))
    rows += [(9, rows[3][1]), (8, rows[3][1].upper()), (7, "two words"), (6, "two  words"), (5, "two words more"), (4, ""), (3, None), (2, " ")]
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in N.near_duplicates(make_docs(rows), width, percent).collect()}
    want = {(d, n): c for (d, _), (c, n) in brute(rows, width, percent).items()}
    assert got == want


@pytest.mark.parametrize("few", [0, 6, 100])
def test_cells_find_links_that_centres_miss(spark, make_docs, prose, monkeypatch, few):
    """A chain of edits in one crowded bucket, with small cells."""
    monkeypatch.setattr(N, "CELL", 4)
    monkeypatch.setattr(N, "FEW", few)
    text, rows = prose(77, 150), []
    for k in range(40):
        rows.append((k + 1, text))
        text = edited(text, k, 3)
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(make_docs(rows), 3, 85).collect()}
    assert got == {d: c for (d, _), (c, _) in brute(rows, 3, 85).items()}


def test_one_of_each_group(spark, make_docs, odd_docs, prose):
    base = prose(5, 80)
    docs = make_docs([(20, base), (21, base), (22, edited(base, 1, 1)), (23, prose(6, 80)), (23, prose(6, 80))]).unionByName(odd_docs)
    docs = docs.withColumnRenamed("lang", "group")
    kept = N.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None))
    # rows without words all stay; of equal texts one
    assert got == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 20, 23]
    assert N.one_of_each_group(docs.limit(0)).count() == 0


def test_estimate_is_unbiased():
    r = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        both = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = N.signature(np.unique(both[:250])), N.signature(np.unique(both[50:]))
        errors.append((a == b).mean() - 200 / 300)
    assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 6), (20, 21), (21, 20), (5, 5)] + [(100 + k, 101 + k) for k in range(30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 8: 6, 9: 6, 10: 6, 20: 20, 21: 20} | {100 + k: 100 for k in range(31)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_agrees_with_sql(spark):
    import compare

    from gleanbox.llm import queries

    sf = "/root/testdata/sf0.001"
    assert compare.differences(queries.op3_minmax_hashing(spark, sf), compare.connection(sf), queries.oracle_sql()["op3_minmax_hashing"]) == ""


def test_columns_of_helper_names(spark, make_docs, prose):
    from pyspark.sql import functions as F

    names = ["text_key", "spoken", "row", "k_id", "k_text", "_text_key", "_id", "_key", "_one", "_place", "set_key", "group"]
    docs = make_docs([(k, prose(k // 2, 40)) for k in range(20)] + [(50, None), (51, " ")]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    got = N.one_of_each_group(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == [*range(0, 20, 2), 50, 51] and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)


def test_texts_of_classes_are_shuffled_once(spark):
    from gleanbox.llm import neardup

    texts = spark.createDataFrame([(b"a", "one"), (b"a", "one"), (b"b", "two"), (b"c", "three")], "text_key binary, text string")
    involved = spark.createDataFrame([(b"a", 7), (b"c", 9)], "text_key binary, class_id long")
    made = neardup.class_texts(texts, involved.hint("merge"))
    assert sorted(map(tuple, made.collect())) == [(7, "one"), (9, "three")]
    assert made._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 1
    plan = neardup.class_texts(texts, involved.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one of each table


def test_only_rows_that_may_go_are_joined(spark, make_docs, prose, monkeypatch):
    """Whole rows that stay aren't shuffled to tell them from near-duplicates, however many there are."""
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    joined, join = [], N.join_on_row

    def watch(rows, keys, how="left_semi"):
        if "row" in rows.columns:
            joined.append(rows.count())
        return join(rows, keys, how)

    monkeypatch.setattr(N, "join_on_row", watch)
    rows = [(k, prose(k, 30)) for k in range(200)] + [(300 + k, prose(k, 30)) for k in range(9)] + [(7, prose(7, 30)), (500, None)]
    got = sorted(r["doc_id"] for r in N.one_of_each_group(make_docs(rows)).collect())
    assert got == [*range(200), 500]
    assert joined and max(joined) < 40


def test_filter_of_rows_misses_no_key(spark):
    rows = spark.sql("select id doc_id, unhex(md5(string(id))) text_key from range(4000) union all select null, unhex('00')")
    keys = rows.filter("doc_id % 10 = 0 or doc_id is null")
    for words, most in ((N.FILTER_WORDS, 405), (64, 4001)):
        N.FILTER_WORDS, before = words, N.FILTER_WORDS
        got = N.marked(rows, keys).filter("marked")
        N.FILTER_WORDS = before
        assert got.join(keys, "text_key").count() == 401 and got.count() <= most
