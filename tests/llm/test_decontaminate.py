"""Benchmark matches."""

import random

from gleanbox.llm import decontaminate as D
from gleanbox.llm.common import alnum_words

ITEMS = "item_id long, text string"


def index(items):
    from collections import Counter

    f = Counter(w for _, t in items for w in set(alnum_words(t)))
    return D.BlockMaxIndex(items, f, len(items), sum(len(alnum_words(t)) for _, t in items) / len(items))


def test_wand_equals_full_scoring(prose):
    items = [(k, prose(k, 10 + k % 50, 8).replace("\n", " ")) for k in range(150)]
    made = index(items)
    for seed in range(60):
        r = random.Random(seed)
        query = set(alnum_words(prose(seed, 60, 8)))
        if seed % 3 == 0:
            query |= set(r.sample(made.parts[seed][1] + made.parts[seed][2], k=min(9, len(made.parts[seed][1]))))
        for threshold in (0.2, 0.4, 0.6):
            want = {}
            for w in query & made.lists.keys():
                for part, share in zip(*made.lists[w][:2], strict=True):
                    want[part] = want.get(part, 0.0) + share
            want = {p: round(x, 9) for p, x in want.items() if x >= threshold - 1e-9}
            assert {p: round(x, 9) for p, x in made.search(query, threshold)} == want


def test_promising_loses_no_passage(prose):
    items = [(k, prose(k, 10 + k % 50, 8).replace("\n", " ")) for k in range(150)]
    made = index(items)
    for seed in range(40):
        text = prose(900 + seed, 300, 8) + " " + items[seed][1] + " " + prose(seed, seed, 8)
        found = alnum_words(text)
        good = set(made.promising(found))
        for k in range(max(-(-len(found) // D.PART) - 1, 1)):
            if made.search(set(found[k * D.PART : (k + 2) * D.PART])):
                assert k in good


def test_planted_items_are_found_and_nothing_else(spark, make_docs, odd_docs, prose):
    items = [(k, prose(k, 12 + 5 * k).replace("\n", " ")) for k in range(30)]
    items += [(50, None), (51, ""), (52, "too short"), (53, "Question: what is the name of the thing?\nAnswer: quite another thing altogether")]
    rows = [(1000 + k, prose(2000 + k, 40 + 17 * k)) for k in range(60)]
    for k in range(30):
        words = (prose(4000 + k, 150) + " ").split(" ")
        words.insert(5 * k, items[k][1].upper() + "!")
        rows.append((k, " ".join(words)))
    docs = make_docs(rows).unionByName(odd_docs.filter("doc_id is null or doc_id > 900"))
    benchmark = spark.createDataFrame(items, ITEMS)
    got = D.benchmark_matches(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(k, k) for k in range(30)}
    assert all(0.6 <= min(r["score"], r["question_overlap"], r["answer_overlap"]) for r in got)
    kept = D.without_leaks(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1000 + k for k in range(60)]
    assert D.benchmark_matches(docs, benchmark.limit(0)).count() == 0 and D.without_leaks(docs, benchmark.limit(0)).count() == docs.count()


def test_shards_give_the_same(spark, make_docs, prose, monkeypatch):
    items = [(k, prose(k, 30).replace("\n", " ")) for k in range(20)]
    docs = make_docs([(k, prose(99 + k, 90) + " " + items[k][1]) for k in range(20)])
    whole = {tuple(r) for r in D.benchmark_matches(docs, spark.createDataFrame(items, ITEMS)).collect()}
    monkeypatch.setattr(D, "SHARD", 6)
    assert {tuple(r) for r in D.benchmark_matches(docs, spark.createDataFrame(items, ITEMS)).collect()} == whole
    assert len(whole) == 20


def test_question_and_answer():
    assert D.question_and_answer("What is it?\nAnswer: a b")[1] == [b"a", b"b"]
    assert D.question_and_answer("one two three four five six")[1] == [b"five", b"six"]


def test_odd_documents(spark, odd_docs):
    benchmark = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h")], ITEMS)
    assert D.benchmark_matches(odd_docs, benchmark).count() == 0
    assert D.without_leaks(odd_docs, benchmark).count() == odd_docs.count()


def test_short_unspaced_and_unnumbered_items(spark, make_docs, prose):
    chinese, japanese = "水在标准大气压下的沸点是多少度？答案是一百度。", "日本で一番高い山は富士山です"
    items = [(1, "Qorvex ubelin"), (2, chinese), (3, japanese), (None, prose(5, 20)), (None, prose(6, 20)), (4, "！？")]
    docs = make_docs([(1, f"{prose(1, 90)} qorvex, UBELIN {prose(2, 9)}"), (2, f"前面的话。{chinese}后面还有别的话"), (3, f"序文、{japanese}。終わり"), (4, f"{prose(7, 50)} {prose(5, 20)} {prose(6, 20)}"), (5, "qorvex and ubelin 水 山 大气 ！？" + prose(8, 80))])
    benchmark = spark.createDataFrame(items, ITEMS)
    got = sorted(((r["doc_id"], r["item_id"]) for r in D.benchmark_matches(docs, benchmark).collect()), key=repr)
    assert got == [(1, 1), (2, 2), (3, 3), (4, None), (4, None)]
    assert [r["doc_id"] for r in D.without_leaks(docs, benchmark).collect()] == [5]


def test_long_items_need_their_real_answer(prose):
    question, answer = prose(1, 150), prose(2, 50)
    made = index([(1, f"{question}\nAnswer: {answer}"), (2, prose(3, 40))])
    words = question.split()
    assert made.matches(f"{prose(4, 100)} {question}\n{answer} {prose(5, 100)}").keys() == {1}
    assert made.matches(f"{prose(4, 100)} {question} {prose(5, 900)}") == {}
    assert made.matches(f"{prose(4, 100)} {' '.join(words[:70])} {prose(5, 100)}") == {}
