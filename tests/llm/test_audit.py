"""The audit of filters, against every order walked document by document."""

import itertools
import random
import re

import compare
import numpy as np
import pytest

from gleanbox.llm import audit as A
from gleanbox.llm import queries

LABEL = "doc_id long, quality int, toxic int"


def plain_fails(rows):
    """Failing letters of each row (doc_id, text, source)."""
    out = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^ \t-\r]+", text)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        bad["E"] = any((t or "") == text and i is not None and doc_id is not None and i < doc_id for i, t, _ in rows)
        out.append({c for c in bad if bad[c]})
    return out


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    fails, out = plain_fails(rows), {}
    for part in {s or "" for _, _, s in rows}:
        own = [(i, f) for (i, _, s), f in zip(rows, fails, strict=True) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            alive = own
            for step, c in enumerate(order, 1):
                gone = [x for x in alive if c in x[1]]
                alive = [x for x in alive if c not in x[1]]
                redundant = sum(c in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(alive), len(gone), redundant, sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for c in "ABCDE":
            at = [(part, "".join(o), o.index(c) + 1) for o in itertools.permutations("ABCDE")]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k] = out[k] + [total]
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def result(spark, docs, labels):
    found = A.audit_filters(A.filter_cells(docs, spark.createDataFrame(labels, LABEL))).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in found}) == len(found)
    assert all(r["filter"] == r["filter_order"][r["step"] - 1] for r in found)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found}


@pytest.mark.parametrize("seed", range(3))
def test_against_every_document_in_every_order(spark, make_docs, seed):
    r = random.Random(seed)
    make = lambda: " ".join(r.choice(["a", "b", "Cap", "ÀÉ", "x#y", f"w{r.randrange(99)}", f"v{r.randrange(9999)}"]) for _ in range(r.choice([0, 3, 49, 50, 51, 80])))
    texts = [make() for _ in range(25)] + [None, "", " "]
    rows = [(r.choice([None, *range(60)]), r.choice(texts), r.choice([None, "", "p", "q"])) for _ in range(80)]
    rows += rows[:5]  # repeated in full
    labels = [(r.choice([None, *range(60)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(70)]
    docs = make_docs([(i, t, "en", s) for i, t, s in rows])
    clash = docs.selectExpr("*", "1 as part", "2 as mask", "3 as n", "4 as good", "'x' as key")
    got = result(spark, clash, labels)
    want = plain_audit(rows, labels)
    assert got == want


def test_odd_documents(spark, odd_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    assert result(spark, odd_docs, [(5, 1, 0), (5, 0, 1)]) == plain_audit(rows, [(5, 1, 0), (5, 0, 1)])


def test_empty_tables(spark, make_docs):
    assert result(spark, make_docs([]), []) == {}
    assert len(result(spark, make_docs([(1, "a")]), [])) == 600


def test_contraction_of_other_numbers_of_filters():
    """Two filters by hand: 3 documents pass, 5 fail a, 7 fail b, 2 fail both."""
    tensor = np.array([[[3, 7], [5, 2]]], dtype=np.int64)[..., None].repeat(3, axis=-1)
    figures = A.audit_tensors(tensor, "ab")
    # orders ab and ba, two steps each
    assert figures["removed"].tolist() == [[7, 7, 9, 5]] and figures["kept"].tolist() == [[10, 3, 8, 3]]
    assert figures["redundant"].tolist() == [[0, 2, 0, 2]] and figures["unique_fails"].tolist() == [[5, 7, 7, 5]]
    assert figures["shapley"].tolist() == [[12, 16, 16, 12]]


def test_many_parts_at_once(spark, make_docs, monkeypatch):
    monkeypatch.setattr(A, "PARTS_AT_ONCE", 2)
    rows = [(k, f"text {k % 4}", f"s{k % 7}") for k in range(30)]
    assert result(spark, make_docs([(i, t, "en", s) for i, t, s in rows]), []) == plain_audit(rows, [])


def test_query_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare.differences(queries.op11_contingency_audit(spark, sf), compare.connection(sf), queries.oracle_sql()["op11_contingency_audit"]) == ""
