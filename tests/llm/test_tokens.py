"""Token counts equal the library's."""

import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanbox.llm import tokens as T

SP = sentencepiece.SentencePieceProcessor(model_file=T.model_path())


def test_given_and_odd_documents(spark, make_docs, odd_docs):
    odd = make_docs([(k, t) for k, t in enumerate(["  a", "a  ", "\n", " \n ", "a▁b", "<s> hi </s><unk>", "日本語 🙂", "\t\tx\r\n", "▁", "\x00a", "ﬁ", "<0x0A>", "x　y"])])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(odd).unionByName(odd_docs)
    got = sorted((tuple(r) for r in T.count_tokens(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        n = len(SP.encode(r["text"] or ""))
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
    assert got == sorted(want, key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁ae.<s>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert T.counter(T.model_path()).count(text) == len(SP.encode(text))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    c = T.PieceCounts(T.model_path())
    for k in range(50):
        c.count(f"qzx{k}wv")
    assert len(c) <= len(c.whole) + 4


def test_empty_table(spark, make_docs):
    assert T.count_tokens(make_docs([])).count() == 0
