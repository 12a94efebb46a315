"""Find benchmark items in training texts with a BM25 index and block-max WAND.

The index holds the test items, in parts of at most ``PART`` words. Every passage of a
training text (``2 * PART`` words, a new one each ``PART`` words, so that each run of PART
words lies within one) is a query. Scores are BM25 shares: an item's score over what its own
words give, so one threshold serves all. Retrieval is exact: WAND passes over items whose
list maxima, and then block maxima, can't sum up to the threshold. Most passages are not
looked up at all: an item's commoner words, up to ``COMMON`` of its score, can't reach the
threshold alone, so a passage must have enough of its other words.

A retrieved item counts if its question and its answer overlap the passage: at least
``OVERLAP`` of the words of each are in runs of ``RUN`` words that the passage has too. The
answer is what follows a line or sentence start "Answer:" or "A:", else the last third. Items
of over PART words are retrieved by their pieces, and their whole question and answer are held
against the passages around, as many words to each side as the item has. Items of fewer than
``LEAST`` words must stand in the text word for word.

Words are parted by ASCII and general punctuation; each character of a script without spaces
is a word.

Items go to the driver and the tasks in shards of ``SHARD`` of them, one after the other: a
shard's matches are written before the next shard is read, so what a task holds is bounded.

Defined cases: null and empty texts match nothing, nor do items without words; equal items are
each reported, items with a null id too, by a null item_id; an empty benchmark table gives no
matches; repeated rows are reported each. Row columns of the operator's names are replaced.
"""

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.llm import common

PART = 64
THRESHOLD = 0.6
COMMON = 0.4
OVERLAP = 0.6
RUN = 3
LEAST = 5
K1, B = 1.2, 0.75
BLOCK = 32
SHARD = 20_000

_ANSWER = re.compile(r"(?:^|\n|[.?!]\s)\s*(?:answer|a)\s*:", re.I)
# Punctuation beyond ASCII, and scripts written without spaces.
_MARKS = "\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65"
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_PARTED = re.compile(f"[{_MARKS}{_UNSPACED}]")
_KEPT = re.compile(f"([{_UNSPACED}])")
_MARK = re.compile(f"[{_MARKS}]")


def alnum_words(text: str) -> list[bytes]:
    """Words of a text, and characters where a script has no spaces."""
    if not text.isascii() and _PARTED.search(text):
        text = _KEPT.sub(r" \1 ", _MARK.sub(" ", text))
    return common.alnum_words(text)


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    marked = _ANSWER.search(text)
    if marked and alnum_words(text[: marked.start()]) and alnum_words(text[marked.end() :]):
        return alnum_words(text[: marked.start()]), alnum_words(text[marked.end() :])
    found = alnum_words(text)
    cut = len(found) - max(len(found) // 3, 1)
    return found[:cut], found[cut:]


def runs(found: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return set(zip(*(found[k:] for k in range(n)), strict=False))


def covered(part: list[bytes], passage: list[bytes]) -> float:
    """Share of a part's words that stand in runs of RUN words (or of the part) of the passage."""
    n = min(RUN, len(part))
    if not n:
        return 1.0
    there = runs(passage, n)
    hit = np.zeros(len(part), dtype=bool)
    for k, run in enumerate(zip(*(part[j:] for j in range(n)), strict=False)):
        if run in there:
            hit[k : k + n] = True
    return float(hit.mean())


class BlockMaxIndex:
    """Inverted lists of shares, with the maximum of each list and of each of its blocks."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[bytes, int], n_items: int, mean_words: float):
        self.parts: list[tuple[int | str, list[bytes], list[bytes]]] = []
        self.short: dict[bytes, list[tuple[list[bytes], int | str]]] = {}
        bags: list[Counter[bytes]] = []
        for number, text in items:
            # an item without a number goes by its text
            item = text if number is None else number
            found = alnum_words(text)
            if len(found) < LEAST:
                if found:
                    self.short.setdefault(found[0], []).append((found, item))
                continue
            question, answer = question_and_answer(text)
            pieces = max(1, ceil(len(found) / PART))
            for k in range(pieces):
                self.parts.append((item, question, answer))
                bags.append(Counter(found[k * len(found) // pieces : (k + 1) * len(found) // pieces] if pieces > 1 else question + answer))
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for part, bag in enumerate(bags):
            length = sum(bag.values())
            weight = {}
            for w, tf in bag.items():
                df = frequency.get(w, 1)
                idf = log(1 + (n_items - df + 0.5) / (df + 0.5))
                weight[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_words))
            whole = sum(weight.values())
            for w, x in weight.items():
                lists.setdefault(w, []).append((part, x / whole))
        self.lists = {}
        for w, postings in lists.items():
            places, shares = [p for p, _ in postings], [x for _, x in postings]
            block_max = [max(shares[k : k + BLOCK]) for k in range(0, len(shares), BLOCK)]
            self.lists[w] = (places, shares, block_max)
        self.bound = {w: max(x[2]) for w, x in self.lists.items()}
        self.rare: dict[bytes, list[tuple[int, float]]] = {}
        self.needed: list[float] = []
        for part, bag in enumerate(bags):
            held = 0.0
            # commonest words first; what a passage lacks of the rest it can't make up for
            for w in sorted(bag, key=lambda w: (-frequency.get(w, 1), len(w), w)):
                places, shares, _ = self.lists[w]
                share = shares[bisect_left(places, part)]
                if held + share <= COMMON:
                    held += share
                else:
                    self.rare.setdefault(w, []).append((part, share))
            self.needed.append(THRESHOLD - held - 1e-9)
        self.rare_words = frozenset(self.rare)

    def promising(self, found: list[bytes]) -> list[int]:
        """Numbers of the passages that can hold an item; passage k begins at word k * PART."""
        hits = self.rare_words.intersection(found)
        if not hits:
            return []
        there: dict[int, set[bytes]] = {}
        last = max(-(-len(found) // PART) - 2, 0)
        for place, w in enumerate(found):
            if w in hits:
                k = place // PART
                for passage in {min(k, last), max(k - 1, 0)}:
                    there.setdefault(passage, set()).add(w)
        out = []
        for k, words in sorted(there.items()):
            sums: dict[int, float] = {}
            for w in words:
                for part, share in self.rare[w]:
                    sums[part] = sums.get(part, 0.0) + share
            if any(x >= self.needed[part] for part, x in sums.items()):
                out.append(k)
        return out

    def search(self, query: set[bytes], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (part, score) with a score of at least the threshold, by block-max WAND."""
        end = len(self.parts)
        cursors = [[self.lists[w][0][0], 0, self.bound[w], *self.lists[w]] for w in query if w in self.lists]
        if sum(c[2] for c in cursors) < threshold:
            return []
        out = []
        while True:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, None
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                total += c[2]
                if total >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot is None:
                return out
            part = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
                pivot += 1
            blocks, nearest = 0.0, end
            for c in cursors[: pivot + 1]:
                at = bisect_left(c[3], part, c[1])
                if at < len(c[3]):
                    blocks += c[5][at // BLOCK]
                    last = min((at // BLOCK + 1) * BLOCK, len(c[3])) - 1
                    nearest = min(nearest, c[3][last] + 1)
            if blocks >= threshold - 1e-12:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[3], part, c[1])
                    if c[1] < len(c[3]) and c[3][c[1]] == part:
                        score += c[4][c[1]]
                        c[1] += 1
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else end
                if score >= threshold - 1e-9:
                    out.append((part, score))
            else:
                # no part up to the nearest block end, nor before the next list's place, can reach it
                if pivot + 1 < len(cursors):
                    nearest = min(nearest, cursors[pivot + 1][0])
                nearest = max(nearest, part + 1)
                for c in cursors[: pivot + 1]:
                    c[1] = bisect_left(c[3], nearest, c[1])
                    c[0] = c[3][c[1]] if c[1] < len(c[3]) else end

    def matches(self, text: str | None) -> dict[int | str, tuple[float, float, float]]:
        """item -> (score, question overlap, answer overlap) of its best verified passage."""
        found = alnum_words(text) if text else []
        out: dict[int | str, tuple[float, float, float]] = {}
        if not found:
            return out
        hits = self.short.keys() & set(found) if self.short else ()
        for place, w in enumerate(found if hits else ()):
            for phrase, item in self.short[w] if w in hits else ():
                if found[place : place + len(phrase)] == phrase:
                    out[item] = (1.0, 1.0, 1.0)
        # of items of several pieces: runs of passages with pieces, no passage between them missing
        long: dict[tuple[int | str, int], list[list]] = {}
        for k in self.promising(found):
            passage = found[k * PART : (k + 2) * PART]
            for part, score in self.search(set(passage)):
                item, question, answer = self.parts[part]
                if len(question) + len(answer) > PART:
                    spans = long.setdefault((item, id(question)), [])
                    if spans and k <= spans[-1][1] + 2:
                        spans[-1][1:3] = [k, max(score, spans[-1][2])]
                    else:
                        spans.append([k, k, score, question, answer])
                    continue
                self.verify(out, item, score, question, answer, passage)
        for (item, _), spans in long.items():
            for first, last, score, question, answer in spans:
                around = len(question) + len(answer)
                self.verify(out, item, score, question, answer, found[max(first * PART - around, 0) : (last + 2) * PART + around])
        return out

    @staticmethod
    def verify(out: dict, item: int | str, score: float, question: list[bytes], answer: list[bytes], passage: list[bytes]) -> None:
        q, a = covered(question, passage), covered(answer, passage)
        if q >= OVERLAP and a >= OVERLAP:
            out[item] = max(out.get(item, (0.0, 0.0, 0.0)), (score, q, a))


def item_indexes(benchmark: DataFrame) -> Iterator[tuple[BlockMaxIndex, bool]]:
    """(index, whether there are more) for each shard of the test items, with frequencies over all of them."""
    items = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            found = [alnum_words(t) for t in pdf["text"]]
            n = Counter(w for f in found for w in set(f))
            n[b""] = sum(map(len, found))  # all words; no word is empty
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    n_items = items.count()
    if not n_items:
        return
    shards = ceil(n_items / SHARD)
    frequency = items.select("text").mapInPandas(batches, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    if shards > 1:
        frequency = common.materialize(frequency, "item-words")
    shard = F.pmod(F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id")), F.lit(shards))
    for k in range(shards):
        own = [(r["item_id"], r["text"]) for r in items.filter(shard == k).collect()]
        words = {w for _, t in own for w in alnum_words(t)}
        if shards > 1:
            wanted = items.sparkSession.createDataFrame([(w,) for w in words] + [(b"",)], "word binary")
            held = frequency.join(F.broadcast(wanted), "word")
        else:
            held = frequency
        counts = {bytes(r["word"]): r["n"] for r in held.collect()}
        yield BlockMaxIndex(sorted(own, key=lambda x: (x[0] is None, x[0] or 0, x[1])), counts, n_items, counts.pop(b"", 0) / n_items or 1.0), shards > 1


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified match."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index, many in item_indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def batches(rows: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                found = [(i, None if isinstance(item, str) else item, *x) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) for item, x in shared.value.matches(t if isinstance(t, str) else None).items()]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = slim.mapInPandas(batches, schema)
        if many:
            found = common.materialize(found, "matches")
            shared.destroy()
        out = out.unionByName(found)
    return out


def is_clean(shared):
    """A column function: does a text hold no item of the shared index?"""

    @F.pandas_udf("boolean")
    def clean(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in rows:
            yield pd.Series([not shared.value.matches(t if isinstance(t, str) else None) for t in texts], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no test item."""
    for index, many in item_indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.filter(is_clean(shared)(F.col("text")))
        if many:
            docs = common.materialize(docs, "without-leaks")
            shared.destroy()
    return docs
