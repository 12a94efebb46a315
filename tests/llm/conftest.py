import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang[, source]]) as a table of documents."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    return make_docs([(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, long), (5, long), (5, "tie of an id"), (None, "no id here at all", None, None), (None, None, None, None), (6, "ÀÉ x" * 50, None, "t"), (7, "x" * 100_000), (8, "日本語のテキスト" * 20), (9, "a b c"), (10, "a b c")])


@pytest.fixture(scope="session")
def prose():
    """A text of so many words from a seed, with lines."""

    def make(seed, n, vocabulary=400):
        r = random.Random(seed)
        words = [f"{r.choice('bcdfglmnprst')}{r.choice('aeiou')}{r.randrange(vocabulary)}x".translate(str.maketrans("0123456789", "qwertyuiop")) for _ in range(n)]
        return "\n".join(" ".join(words[k : k + 12]) for k in range(0, n, 12))

    return make
