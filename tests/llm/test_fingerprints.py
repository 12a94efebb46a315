"""Fingerprints of whole and of edited texts, against plain loops."""

import hashlib
import re

import xxhash

from gleanbox.llm import fingerprints as P


def plain_edits(rows):
    """doc_id -> (edited text, next text); ids differ."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 3
        out[doc] = (text[: len(text) - n] + following[:n], following)
    return out


def xx(*longs):
    """Hash of longs as Spark's xxhash64 chains it, signed."""
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(x.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def plain_sketch(text):
    """(links, fingerprint) of a text."""
    words = re.sub(f"({P.UNSPACED})", r" \1 ", text).split()
    if not words:
        return set(), ""
    own = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    own = [0] * (P.K - 1) + [h - (1 << 64) if h >> 63 else h for h in own] + [0] * (P.K - 1)
    anchors = [(i, xx(*own[i : i + P.K])) for i in range(len(own) - P.K + 1) if min(own[i : i + P.K]) in (own[i], own[i + P.K - 1])]
    links, at, before = [], 0, 0
    for place, anchor in anchors:
        links.append((place - at) << 28 | xx(before, anchor) & 0xFFFFFFF)
        at, before = place, anchor
    return set(links), "".join(f"{x:08x}" for x in links)


def like(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_all_columns_equal_plain_loops(spark, make_docs, prose):
    rows = [(k * 7 % 101, t) for k, t in enumerate([f"text number {k} " * (k % 9) + "é🙂" for k in range(40)] + [prose(k, 3 + 9 * k) for k in range(40)] + [None, "", "ab", "日本語のテキスト です", "x" * 5000])]
    want = plain_edits(rows)
    for block in (1, 4096):
        got = P.with_next(make_docs(rows), ["text"], block).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["next"]["text"] or "" for r in got} == {d: f for d, (_, f) in want.items()}
    result = {r["doc_id"]: r for r in P.fingerprint_edits(make_docs(rows)).collect()}
    assert len(result) == len(rows)
    for doc, text in rows:
        edited, following = want[doc]
        links, digits = plain_sketch(text or "")
        changed, changed_digits = plain_sketch(edited)
        r = result[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text or ""), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (digits, changed_digits)
        assert r["near_edited"] == like(links, changed) and r["near_next"] == like(links, plain_sketch(following)[0])


def test_one_rule_for_all_lengths(prose):
    for n in (5, 23, 24, 25, 60, 300):
        long, short = prose(n, n + 1).split(), prose(n, n + 1).split()[:-1]
        # a word at the end changes the links of at most K windows and one more, on each side
        a, b = plain_sketch(" ".join(long))[0], plain_sketch(" ".join(short))[0]
        assert len(a - b) <= P.K + 1 and len(b - a) <= P.K + 1
    a, b = prose(1, 200).split(), prose(2, 200).split()
    # a moved passage is found, shuffled words are not
    assert like(plain_sketch(" ".join(a + b))[0], plain_sketch(" ".join(b + a))[0]) > 0.85
    assert like(plain_sketch(" ".join(a))[0], plain_sketch(" ".join(sorted(a)))[0]) < 0.05


def test_equal_texts(spark, make_docs, prose):
    rows = [(k, prose(k, 40 + 30 * (k % 7))) for k in range(60)]
    rows += [(k + 200, t) for k, t in rows]
    got = {r["doc_id"]: r for r in P.fingerprint_edits(make_docs(rows)).collect()}
    for k in range(60):
        assert got[k]["fingerprint"] == got[k + 200]["fingerprint"] and got[k]["near_next"] < 0.1
    assert sum(got[k]["near_edited"] for k in range(60)) / 60 > 0.3


def test_blocks_of_one_id(spark, make_docs, prose):
    """Null and repeated ids are cut into blocks by their texts, and each row has one successor."""
    rows = [(None, prose(k, 5)) for k in range(300)] + [(7, prose(900 + k, 5)) for k in range(300)] + [(k, prose(2000 + k, 5)) for k in range(100, 300)]
    docs = make_docs(rows)
    sizes = [r["count"] for r in P.in_blocks(docs, 20)(docs).groupBy("block").count().collect()]
    assert sum(sizes) == 800 and max(sizes) < 80
    got = P.with_next(docs, ["doc_id", "text"], 20).collect()
    assert len(got) == 800 and sorted(r["next"]["text"] for r in got) == sorted(t for _, t in rows)
    assert sum(r["next"]["doc_id"] is None for r in got if r["doc_id"] is not None) == 1


def test_odd_documents(spark, odd_docs):
    got = P.fingerprint_edits(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {""}
    assert P.fingerprint_edits(odd_docs.limit(0)).count() == 0
