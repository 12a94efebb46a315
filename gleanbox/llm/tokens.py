"""Token counts of a sentencepiece BPE model by the whole-token shortcut.

Two facts are proved from the vocabulary before counting: no piece has the space mark after
another character, and no piece of several characters holds a line feed. So no merge crosses
such a place, and a text's tokens are those of its pre-tokens, each taken alone. Vocabulary
strings that encode alone as their one token are found beforehand; a pre-token among them
counts one, and only the others are merged (each distinct one once per worker).

Defined cases: null and empty texts have no bytes and no tokens; special strings inside a
text are ordinary text, the library's default; a very long run without spaces is one
pre-token. Input columns of the operator's names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Distinct merged pre-tokens that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Longer pre-tokens are merged anew each time, so a worker's memory is bounded.
REMEMBERED_CHARS = 64
SPACE = "▁"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCounts(dict):
    """Pre-token -> number of tokens; fills itself by merging what is not a whole token.

    The library puts a space mark before every text. A pre-token with a mark is encoded
    without it; another one is encoded after a line feed, whose tokens are not counted.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.processor.get_piece_size())
        pieces = [self.processor.id_to_piece(i) for i in ids if not (self.processor.is_control(i) or self.processor.is_unknown(i) or self.processor.is_byte(i))]
        self.feed = len(self.processor.encode("\n"))
        marks_lead = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        feeds_alone = not any("\n" in p and len(p) > 1 for p in pieces)
        keeps_text = self.processor.decode(self.processor.encode("a  \nb")) == "a  \nb"
        if not (marks_lead and feeds_alone and keeps_text):
            raise ValueError("the vocabulary joins characters across a pre-token's edge")
        self.whole = {p for p in pieces if self.merged(p) == 1}
        self.parts = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n").findall
        super().__init__(dict.fromkeys(self.whole, 1))

    def merged(self, part: str) -> int:
        """Tokens of a pre-token by the library's own merging."""
        if part.startswith(SPACE):
            return len(self.processor.encode(part[1:])) if len(part) > 1 else 1
        return len(self.processor.encode("\n" + part)) - self.feed

    def __missing__(self, part: str) -> int:
        n = self.merged(part)
        if len(part) <= REMEMBERED_CHARS:
            if len(self) > len(self.whole) + REMEMBERED:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[part] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.parts(SPACE + text.replace(" ", SPACE)))) if text else 0


@cache
def counter(path: str) -> PieceCounts:
    return PieceCounts(path)


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each whole text."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(model_path(model)).count
        for pdf in rows:
            n = [count(t) if isinstance(t, str) else 0 for t in pdf["text"]]
            size = [len(t.encode()) if isinstance(t, str) else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n_bytes": size, "n_tokens": n})

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(batches, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
