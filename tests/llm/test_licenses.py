"""License phrases and templates, against plain search."""

import re

from gleanbox.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def plain(text):
    words = WORD.findall(lower(text or ""))
    places = [(k, label) for p, label in L.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_columns(spark, make_docs, odd_docs):
    docs = make_docs([(1, "Apache-License! mit  LICENSE\nMIT license"), (2, "CC-BY 4.0, cc by-nc"), (3, "the GNU General\nPublic License"), (4, "Éapache license"), (5, "no")]).unionByName(odd_docs)
    got = sorted((tuple(r)[:6] for r in L.scan_licenses(docs).collect()), key=repr)
    assert got == sorted(((r["doc_id"], *plain(r["text"])) for r in docs.collect()), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:6] for r in L.scan_licenses(docs).collect()}
    assert got == {r["doc_id"]: plain(r["text"]) for r in docs.collect()}


def told(label, text, block, templates=None):
    """Telling words by counting: of the words that are no numbers, those in the notices of the fewest labels."""
    templates = templates or L.TEMPLATES
    count = lambda w: sum(any(w in L.words(t) for t in texts) for texts in templates.values())
    own = {w: count(w) for w in L.words(text) if not w.isdigit()}
    telling = {w for w, n in own.items() if n == min(own.values())}
    return len(telling & set(block)) >= max(1, int(0.8 * len(telling) + 1e-9))


def plain_labels(found):
    """Labels of one block's words by comparing all its runs with all templates."""
    every = [(label, t, set(L.words(t))) for label, texts in L.TEMPLATES.items() for t in texts]
    held, block = {}, set(found)
    for k, (label, t, own) in enumerate(every):
        need, best = -(-8 * len(own) // 10), 0
        if not told(label, t, block):
            continue
        if len(own & block) >= 0.25 * len(block) and len(own) >= L.FEW:
            best = len(own & block)
        elif len(own & block) >= need:
            width = need if len(own) < L.FEW else int(need / 0.25)
            runs = [set(found[a : a + width]) for a in range(len(found))]
            best = max((len(run & own) for run in runs if told(label, t, run)), default=0)
        if best >= need:
            held[k] = best / len(own)
    family = lambda a, b: a == b or any(a in f and b in f for f in L.FAMILIES)
    kin = lambda a, b: family(every[a][0], every[b][0]) and 2 * len(every[a][2] & every[b][2]) >= min(len(every[a][2]), len(every[b][2]))
    apart = lambda a, b: (own := every[a][2] - every[b][2]) and len(own & block) >= 0.8 * len(own)
    out = set()
    for k, share in held.items():
        less = any(kin(k, v) and held[v] > share and not apart(k, v) for v in held)
        around = any(kin(k, v) and every[v][2] > every[k][2] and apart(v, k) for v in held)
        if not less and not around:
            out.add(every[k][0])
    return out


def test_labels_of_random_mixtures_equal_plain_comparison():
    import random

    index = L.Templates(L.TEMPLATES, {b"the": 900, b"license": 70}, families=L.FAMILIES)
    every = [t for texts in L.TEMPLATES.values() for t in texts]
    met = set()
    for seed in range(600):
        r, found = random.Random(seed), []
        for _ in range(r.choice([1, 1, 2, 3])):
            own = [w for w in L.words(r.choice(every)) if r.random() > 0.06]
            if r.random() < 0.3:
                own[r.randrange(len(own))] = r.choice(sorted(index.vocabulary))
            found += own + [b"x%d" % r.randrange(9) for _ in range(r.choice([0, 0, 3, 40]))]
        got = set(index.notices(found))
        assert got == plain_labels(found), (seed, b" ".join(found))
        met |= got
    assert met == set(L.TEMPLATES)


def test_stock_words_alone_are_no_notice(spark, make_docs):
    lines = ["Released under the Apache License", "Released under the BSD License.", "Licensed under the EUPL License", "the book was released under the license", "Licensed under the terms of the License, version 3", "This work is licensed under the terms of the public"]
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(make_docs(list(enumerate([*lines, "Released under the MIT License", "released, under the MIT"])))).collect()}
    assert got == {0: "apache", 1: "", 2: "", 3: "", 4: "", 5: "", 6: "mit", 7: "mit"}


BASE_SQL = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
phrases as (select * from (values ('gnu general public license', 'gpl'), ('apache license', 'apache'), ('cc by', 'cc-by'), ('mit license', 'mit')) p(phrase, label)),
places as (
  select d.doc_id, p.label, unnest(range(1, len(d.w) + 1)) as k, d.w, string_split(p.phrase, ' ') as q from docs d cross join phrases p),
hits as (select doc_id, label, k - 1 as start from places where w[k:k + len(q) - 1] = q)
select d.doc_id, len(d.w) as n_words, count(h.start) as n_base, min(h.start) as first_word, max(h.start) as last_word, coalesce(string_agg(distinct h.label, ',' order by h.label), '') as base_labels
from docs d left join hits h on h.doc_id = d.doc_id group by d.doc_id, d.w
"""


def test_base_columns_agree_with_sql(spark):
    import compare

    sf = "/root/testdata/sf0.001"
    got = L.scan_licenses(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert compare.differences(got, compare.connection(sf), BASE_SQL) == ""


def test_templates_are_found_by_containment():
    index = L.Templates(L.TEMPLATES, {b"the": 900, b"license": 5})
    import random

    vocabulary = sorted(index.vocabulary) + [b"x%d" % k for k in range(40)]
    for seed in range(400):
        r = random.Random(seed)
        block = set(r.sample(vocabulary, r.randrange(0, 12)))
        if seed % 2:
            label = r.choice(list(L.TEMPLATES))
            block |= set(r.sample(list(L.words(L.TEMPLATES[label][0])), k=len(L.words(L.TEMPLATES[label][0])) - r.randrange(0, 3)))
        want = set()
        for label, texts in L.TEMPLATES.items():
            for t in texts:
                own = set(L.words(t))
                shared = len(own & block)
                if shared >= L.CONTAINED * len(own) - 1e-9 and shared >= L.ABOUT * len(block) and told(label, t, block):
                    want.add((label, shared / len(own)))
        assert set(index.matches(block)) == want


def test_labels_and_score(spark, make_docs):
    docs = make_docs([(1, "Licensed under CC BY-NC 4.0."), (2, "All rights reserved."), (3, "some rights"), (4, "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files")])
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan_licenses(docs).collect()}
    assert got == {1: ("cc-by,cc-by-nc", 1.0), 2: ("reserved", 1.0), 3: ("", 0.0), 4: ("mit", 1.0)}
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_notices_in_long_blocks_and_two_in_one(spark, make_docs, prose):
    long = prose(3, 400).replace("\n", " ")
    mit, gpl = L.TEMPLATES["mit"][0], L.TEMPLATES["gpl"][0]
    scattered = " ".join(f"{w} {prose(k, 20)}" for k, w in enumerate("all rights reserved".split())).replace("\n", " ")
    docs = make_docs([(1, f"{long} All rights reserved {long}"), (2, f"{long} {gpl} {long}\n{long}"), (3, scattered), (4, f"{mit} {long[:40]} All rights reserved"), (5, long)])
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in L.scan_licenses(docs).collect()}
    assert got[1] == ({"reserved"}, 1.0) and "gpl" in got[2][0]
    assert got[3] == got[5] == ({""}, 0.0)
    assert {"mit", "reserved"} <= got[4][0]


def test_a_second_notice_of_lower_containment_stays():
    index = L.Templates({"a": ["one two three four five"], "b": ["six seven eight nine ten"], "c": ["one two three four six"]}, {})
    assert index.notices(list(L.words("one two three four five six seven eight nine"))) == {"a": 1.0, "b": 0.8, "c": 1.0}
    assert index.notices(list(L.words("one two three four five"))) == {"a": 1.0}
    given, text = L.Templates(L.TEMPLATES, {}, families=L.FAMILIES), "This work is licensed under the GNU General Public License version 3 or a Creative Commons Attribution 4.0 License"
    assert set(given.notices(list(L.words(text)))) == {"gpl", "cc-by"}
    assert given.notices(list(L.words("Licensed under CC BY NC 4.0"))) == {"cc-by-nc": 1.0}


def test_runs_equal_plain_windows():
    import random

    index = L.Templates(L.TEMPLATES, {})
    for seed in range(200):
        r = random.Random(seed)
        found = [r.choice(sorted(index.vocabulary) + [b"x%d" % k for k in range(60)]) for _ in range(r.randrange(90))]
        for t, (_, ranks, need) in enumerate(index.templates):
            width = need if len(ranks) < L.FEW else int(need / L.ABOUT)
            runs = [{index.rank.get(w) for w in found[k : k + width]} for k in range(len(found))]
            want = max((len(run & set(ranks)) for run in runs if index.is_told(t, run)), default=0)
            assert index.most_in_a_run(t, found) == want


def test_variants_are_told_apart(spark, make_docs):
    rows = [(1, "Licensed under CC BY 4.0"), (2, "Licensed under CC BY-NC 4.0"), (3, "the rights reserved for all people"), (4, "some words here, all rights reserved. and more of the words"), (5, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.")]
    got = {r["doc_id"]: r["labels"] for r in L.scan_licenses(make_docs(rows)).collect()}
    assert got == {1: "cc-by", 2: "cc-by,cc-by-nc", 3: "", 4: "reserved", 5: "bsd"}
