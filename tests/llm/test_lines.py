"""Recurring line templates."""

from collections import Counter, defaultdict

import compare
from pyspark.sql import functions as F

from gleanbox.llm import lines as L
from gleanbox.llm import queries


def mask(line):
    return " ".join(L.WILD if any("0" <= c <= "9" for c in t) else t for t in line.split())


def plain(rows, min_docs, min_tokens):
    """{text: text without recurring lines}, by the docstring's rules; copies by all pairs."""
    texts = {t for _, t in rows if t is not None}
    holders = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            holders[mask(line)].add(t)
    leaf = lambda m: (len(m.split()), tuple(m.split()[: L.LEAD]))
    need = lambda m: min(min_docs, L.LONG_DOCS) if len(m.split()) >= L.LONG_TOKENS else min_docs
    big = {m: h for m, h in holders.items() if len(m.split()) >= min_tokens}
    constants = Counter()
    for m, h in big.items():
        for at, token in enumerate(m.split()):
            constants[leaf(m), at, token] += len(h)
    templates, members = {}, defaultdict(set)
    for m, h in big.items():
        words = [t if at < L.LEAD or constants[leaf(m), at, t] >= need(m) else L.WILD for at, t in enumerate(m.split())]
        loose = sum(w == L.WILD and t != L.WILD for w, t in zip(words, m.split(), strict=True))
        if 5 * loose <= len(words) and 2 * words.count(L.WILD) <= len(words):
            templates[m] = " ".join(words)
            members[templates[m]] |= h
    gone = {m: t for m, t in templates.items() if len(members[t]) >= need(m)}
    hits = {t: Counter() for t in texts}
    for t in texts:
        for x in t.split("\n"):
            if mask(x) in gone:
                hits[t][gone[mask(x)]] += len(x)
    size = {t: len(t.replace("\n", "")) for t in texts}
    flagged = [t for t in texts if hits[t] and sum(hits[t].values()) >= L.COPIED * size[t]]
    copies = {t for t in flagged for u in flagged if t != u and sum((hits[t] & hits[u]).values()) >= L.COPIED * max(size[t], size[u])}
    return {t: t if t in copies else "\n".join(x for x in t.split("\n") if mask(x) not in gone) for t in texts}


def corpus(prose):
    rows = []
    for k in range(60):
        body = prose(k, 60)
        if k % 2:
            body = f"Posted by user{k} at 12:0{k % 10} in the news room\n" + body
        if k % 3 == 0:
            body += "\nAll rights reserved.\nRead more about this and that here"
        if k % 4 == 0:
            body += f"\nShare this with {prose(1000 + k, 1)} and all of your good friends now"
        rows.append((k, body))
    copies = [(100 + k, prose(777, 50)) for k in range(20)]
    near = [(200 + k, prose(778, 60) + f"\nan ending of copy {prose(5000 + k, 4)}") for k in range(15)]
    return rows + copies + near


def test_equals_plain_rules(spark, make_docs, prose):
    rows = corpus(prose)
    for min_docs in (4, 10):
        want = plain(rows, min_docs, L.MIN_TOKENS)
        got = {r["doc_id"]: r for r in L.drop_recurring_lines(make_docs(rows), min_docs).collect()}
        assert len(got) == len(rows)
        for doc, text in rows:
            assert got[doc]["text"] == want[text]
            kept = want[text].split("\n") if want[text] or not got[doc]["n_dropped"] else []
            assert got[doc]["n_dropped"] == len(text.split("\n")) - len(kept)
            assert got[doc]["n_chars"] == len(want[text])


def test_copies_and_clean_documents_stay(spark, make_docs, prose):
    rows = corpus(prose)
    got = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(make_docs(rows)).collect()}
    for doc, text in rows:
        if doc >= 100:
            assert got[doc] == text
        else:
            assert prose(doc, 60) in got[doc] and "Posted by" not in got[doc] and "rights" not in got[doc] and "Share" not in got[doc]


def test_mostly_recurring_texts_lose_their_lines(spark, make_docs, prose):
    long = prose(9, L.LONG_TOKENS + 5).replace("\n", " ")
    page = "\n".join(f"{x} is what every page of ours has" for x in "abcdef")
    rows = [(k, page + "\n" + prose(k, 12)) for k in range(12)]
    rows += [(50 + k, prose(100 + k, 36) + "\n" + long) for k in range(3)]
    rows += [(70 + k, prose(200 + k, 12) + "\n" + long) for k in range(2)]
    got = {r["doc_id"]: r["text"] for r in L.drop_recurring_lines(make_docs(rows)).collect()}
    for k in range(12):
        assert got[k] == prose(k, 12)
    for k in range(3):
        assert got[50 + k] == prose(100 + k, 36)
    assert [got[70], got[71]] == [prose(200, 12), prose(201, 12)]


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumnRenamed("lang", "leaf").withColumnRenamed("source", "key2")
    got = L.drop_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(map(repr, (r["text"] for r in got.collect()))) == sorted(map(repr, (r["text"] for r in docs.collect())))
    assert L.drop_recurring_lines(docs.limit(0)).count() == 0


def test_columns_of_helper_names(spark, make_docs, prose):
    names = ["key", "drops", "hit", "row", "lh", "at", "th", "all", "wanted", "lines", "_key"]
    docs = make_docs(corpus(prose)).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    got = L.drop_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    assert len(rows) == 95 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names) and any(r["n_dropped"] for r in rows)


def test_agrees_with_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op4_line_templates(spark, sf)
    assert got.agg(F.sum("n_dropped")).first()[0] > 0
    assert compare.differences(got, compare.connection(sf), queries.oracle_sql()["op4_line_templates"]) == ""
