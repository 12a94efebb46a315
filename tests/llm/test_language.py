"""Language identification."""

import random

import numpy as np

from gleanbox.llm import language as L


def sentence(lang, seed, n=30):
    r = random.Random(f"{lang}{seed}")
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ein", "ung", "der"], "cc": ["ção", "nho", "lha", "dos"]}[lang]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy(spark, make_docs):
    docs = make_docs([(k, sentence(lang := "aa bb cc".split()[k % 3], k), lang) for k in range(600)])
    model = L.fit(docs.filter("doc_id < 400"))
    got = L.predict(docs.filter("doc_id >= 400"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    held = L.held_out(F.col("doc_id"))
    got = L.predict(docs.filter(held), L.fit(docs.filter(~held))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)


def test_odd_documents(spark, make_docs, odd_docs):
    docs = odd_docs.unionByName(make_docs([(70, "123 !! ... 45"), (71, sentence("aa", 1), "aa"), (72, sentence("bb", 1), "bb"), (73, "щ", "aa")]))
    got = {}
    for r in L.predict(docs.withColumnRenamed("source", "score"), L.fit(docs)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for doc in (1, 2, 3, 70):
        assert (got[doc][0]["lang_pred"], got[doc][0]["score"]) == ("und", 0.0)
    assert got[73][0]["lang_pred"] in ("aa", "bb", "en")
    empty = L.fit(docs.limit(0))
    assert {r["lang_pred"] for r in L.predict(docs, empty).collect()} == {"und"}
    assert L.predict(docs.limit(0), empty).count() == 0


def test_filters_have_no_false_negatives():
    r = np.random.default_rng(1)
    grams = {k: r.integers(0, 1 << 40, 5000, dtype=np.uint64) for k in range(3)}
    model = L.LanguageFilter.build(["a", "b", "c"], [1, 2, 3], grams)
    for k, own in grams.items():
        mask = model.table[L.places(own, 0)] & model.table[L.places(own, 1)]
        assert ((mask >> k) & 1).all()
    other = r.integers(1 << 41, 1 << 42, 200_000, dtype=np.uint64)
    rate = ((model.table[L.places(other, 0)] & model.table[L.places(other, 1)]) & 1).mean()
    assert abs(rate - model.false_rates[0]) < 3e-5


def test_more_than_64_languages(spark, make_docs):
    names = [f"l{k:03d}" for k in range(130)]
    own = {x: [f"{chr(97 + k // 26)}{chr(97 + k % 26)}{c}{d}" for c in "xq" for d in "wz"] for k, x in enumerate(names)}
    text = lambda x, seed: " ".join(random.Random(f"{x}{seed}").choices(own[x], k=30))
    model = L.fit(make_docs([(k, text(x, k // 130), x) for k, x in enumerate(names * 3)]))
    assert model.languages == names
    assert model.predict([text(x, 9) for x in names])[0] == names


def test_languages_that_share_words_don_t_lower_the_share():
    grams = np.unique(L.keys(np.frombuffer(L.letters("one two three four"), dtype=np.uint8).astype(np.uint64), 3))
    text = ["one two three four five six seven eight nine ten"]
    few, many = (L.LanguageFilter.build([f"l{k:02d}" for k in range(n)], [1] * n, dict.fromkeys(range(n), grams)).predict(text) for n in (1, 10))
    assert abs(few[2][0] - many[2][0]) < 1e-9 and many[1][0] < few[1][0]
    assert many[2][0] >= 0.1 > many[1][0]


def test_shares_equal_plain_sets(spark, make_docs):
    """The filters against sets of n-grams, counted by plain loops with the same bounds."""
    from collections import Counter

    rows = [(k, sentence(lang := "aa bb cc".split()[k % 3], k), lang) for k in range(90)]
    grams = lambda t: [(n, L.letters(t)[i : i + n]) for n in L.ORDERS for i in range(len(L.letters(t)) - n + 1)]
    counts = {lang: Counter() for lang in ("aa", "bb", "cc")}
    for lang, own in counts.items():
        # texts of a language are counted as one run of bytes
        for n in L.ORDERS:
            data = b"".join(L.letters(t) for _, t, x in rows if x == lang)
            own.update((n, data[i : i + n]) for i in range(len(data) - n + 1))
    model = L.fit(make_docs(rows))
    texts = [sentence(lang, 900 + k) for k in range(20) for lang in counts]
    rate = {}
    for lang, own in counts.items():
        own = {g: n for g, n in own.items() if n >= L.LEAST_COUNT}
        total = Counter()
        for (n, _), c in own.items():
            total[n] += c
        rate[lang] = {g: c / total[g[0]] for g, c in own.items()}
    best = Counter()
    for own in rate.values():
        for g, x in own.items():
            best[g] = max(best[g], x)
    kept = {lang: {g for g, x in own.items() if x >= L.LEAST_RATE and x >= L.SHARE_OF_BEST * best[g]} for lang, own in rate.items()}
    got = model.shares([L.letters(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        own = grams(t)
        for k, lang in enumerate(model.languages):
            # rows of one language may be cut apart between tasks, which moves few n-grams
            assert abs(row[k] - sum(g in kept[lang] for g in own) / len(own)) < 0.03


def test_columns_keep_their_values(spark, make_docs):
    from pyspark.sql import functions as F

    names = ["score", "lang_pred", "lang_share", "found", "row"]
    docs = make_docs([(k, sentence("aa", k), "aa") for k in range(30)] + [(40, None), (41, "12 34")]).withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})
    got = L.spoken(docs, L.fit(docs), 0.1)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == 30 and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
