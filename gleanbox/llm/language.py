"""Language identification with language-bitmask n-gram filters.

Byte n-grams of the lower-cased letters of labelled texts are counted per language. A
language gets an n-gram if it is frequent enough there, and not much rarer than in the
language where it is most frequent. One table of bit masks holds a Bloom filter for each
language, bit-sliced: a place has one bit per language, and the AND of an n-gram's places
gives all languages that have it; a place has one 64-bit word for each 64 languages. For a text, bits are counted per language over all its
n-grams; the known rate of false positives is taken off; the largest share decides.

Fitting reads at most about ``FIT_DOCS`` labelled texts per language, chosen by hash; the
model's size depends on ``SLOTS`` alone. Prediction reads whole texts of all rows.

Defined cases: a null text, or one without letters, is ``und`` with score 0; letters without
any known n-gram give the language with most labelled texts, score 0; ties go to the earlier
language by code point. An empty table gives an empty result; without labels all is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanbox.llm.common import crc_mod, packed

UNKNOWN = "und"
FIT_DOCS = 3_000
ORDERS = (3, 4, 5)
SLOTS = 1 << 21
HASHES = 2
LEAST_COUNT = 4
SHARE_OF_BEST = 0.25
LEAST_RATE = 2e-6
BATCH_CHARS = 1_000_000

_LETTERS = bytes(ord(chr(c).lower()) if c < 0x80 and chr(c).isalpha() else (c if c >= 0x80 else 0x20) for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def letters(text: str) -> bytes:
    """Lower-cased ASCII letters and all other bytes beyond ASCII; one space for each other run."""
    return b" " + b" ".join(text.encode().translate(_LETTERS).split()) + b" "


def in_pieces(texts: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of about BATCH_CHARS, which bounds what a worker holds at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def keys(data: np.ndarray, order: int) -> np.ndarray:
    """The n-grams at every place of a byte array, packed with their length."""
    n = len(data) - order + 1
    out = np.full(max(n, 0), order, dtype=np.uint64)
    for k in range(order if n > 0 else 0):
        out = (out << np.uint64(8)) | data[k : k + n]
    return out


def places(key: np.ndarray, h: int) -> np.ndarray:
    mixed = (key ^ (key >> np.uint64(29))) * _MIX[h]
    return (mixed >> np.uint64(40)).astype(np.int64) % SLOTS


def language_bits(mask: np.ndarray, k: int) -> np.ndarray:
    """The bit of language k in each mask."""
    kind = mask.dtype.type
    return ((mask if mask.ndim == 1 else mask[:, k // 64]) >> kind(k % 64)) & kind(1)


@dataclass
class LanguageFilter:
    languages: list[str]
    common: str
    table: np.ndarray  # a bit mask of languages in each place, or a row of 64-bit masks
    false_rates: np.ndarray

    @classmethod
    def build(cls, languages: list[str], sizes: list[int], grams: dict[int, np.ndarray]) -> LanguageFilter:
        """grams: the n-grams of the language numbered so."""
        kind = np.uint8 if len(languages) <= 8 else np.uint64
        table = np.zeros(SLOTS if len(languages) <= 64 else (SLOTS, -(-len(languages) // 64)), dtype=kind)
        for k, own in grams.items():
            for h in range(HASHES):
                np.bitwise_or.at(table if table.ndim == 1 else table[:, k // 64], places(own, h), kind(1) << kind(k % 64))
        fill = [float(language_bits(table, k).mean()) for k in range(len(languages))]
        common = languages[int(np.argmax(sizes))] if languages else UNKNOWN
        return cls(languages, common, table, np.array(fill) ** HASHES)

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """For each text and language: the share of n-grams that the language has, corrected."""
        out = np.zeros((len(texts), len(self.languages)))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
        ends = np.cumsum([len(t) for t in texts])
        total = np.zeros(len(texts))
        for order in ORDERS:
            key = keys(data, order)
            if not len(key):
                continue
            mask = self.table[places(key, 0)]
            for h in range(1, HASHES):
                mask &= self.table[places(key, h)]
            # an n-gram belongs to the text in which it ends; those over an edge count for none
            last = np.maximum(ends - order + 1, 0)
            first = np.minimum(np.concatenate([[0], ends[:-1]]), last)
            total += last - first
            for k in range(len(self.languages)):
                run = np.concatenate([[0], np.cumsum(language_bits(mask, k), dtype=np.int64)])
                out[:, k] += run[last] - run[first]
        raw = out / np.maximum(total, 1)[:, None]
        return np.clip((raw - self.false_rates) / (1 - self.false_rates), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        """For each text: its language, score, and the language's share alone."""
        spoken = [i for i, t in enumerate(texts) if isinstance(t, str) and _LETTER.search(t)]
        languages, scores, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        at = 0
        while at < len(spoken) and self.languages:
            batch, size = [], 0
            while at < len(spoken) and (not batch or size < BATCH_CHARS):
                batch.append(spoken[at])
                size += len(texts[spoken[at]])
                at += 1
            share = self.shares([letters(texts[i]) for i in batch])
            best = share.argmax(axis=1)
            for i, row, k in zip(batch, share, best, strict=True):
                sum_ = row.sum()
                languages[i] = self.languages[k] if row[k] > 0 else self.common
                # how far the text is the language's, and the language's alone
                scores[i] = float(row[k] * row[k] / sum_) if sum_ > 0 else 0.0
                shares[i] = float(row[k])
        return languages, scores, shares


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> LanguageFilter:
    """Learn the filters from labelled texts (columns doc_id, text, lang), a bounded sample of them."""
    labelled = docs.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter.build([], [], {})
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_docs / sizes[lang]))])
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    chosen = labelled.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1_000_000)) < F.element_at(share, F.col("lang")) * 1_000_000)

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for lang, group in pdf.groupby("lang"):  # a number
                for texts in in_pieces(letters(t) for t in group["text"]):
                    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
                    for order in ORDERS:
                        key, n = np.unique(keys(data, order), return_counts=True)
                        if len(key):
                            yield pd.DataFrame({"lang": lang, "ord": order, "key": key.astype(np.int64), "n": n})

    counted = chosen.select("text", F.element_at(number, F.col("lang")).alias("lang")).mapInPandas(batches, "lang int, ord int, key long, n long").groupBy("lang", "ord", "key").agg(F.sum("n").alias("n"))
    # rates are of all n-grams of an order; the count bound keeps what is collected to 1/LEAST_COUNT of the sample's n-grams
    counted = counted.filter(F.col("n") >= LEAST_COUNT).toArrow().to_pandas()
    counted["rate"] = counted["n"] / counted.groupby(["lang", "ord"])["n"].transform("sum")
    best = counted.groupby("key")["rate"].transform("max")
    kept = counted[(counted["rate"] >= LEAST_RATE) & (counted["rate"] >= SHARE_OF_BEST * best)]
    grams = {int(k): own.to_numpy().astype(np.uint64) for k, own in kept.groupby("lang")["key"]}
    return LanguageFilter.build(languages, [sizes[x] for x in languages], grams)


def predictions(model: LanguageFilter, spark: SparkSession):
    """A column function: text -> struct of lang_pred, score and lang_share."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, lang_share double")
    def predicted(rows: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in rows:
            languages, scores, shares = shared.value.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": languages, "score": scores, "lang_share": shares})

    return predicted


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """All columns of docs, and lang_pred, score and lang_share, which replace columns of these names.

    The score falls the more languages share a text's n-grams; lang_share doesn't.
    """
    docs = docs.drop("lang_pred", "score", "lang_share")
    found = packed(docs, predictions(model, docs.sparkSession)("text").alias("found"))
    return found.select("row.*", "found.*")


def spoken(docs: DataFrame, model: LanguageFilter, least_share: float) -> DataFrame:
    """The rows of docs, all columns as they are, that are in one of the model's languages by a share of at least ``least_share``."""
    found = packed(docs, predictions(model, docs.sparkSession)("text").alias("found"))
    return found.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.lang_share") >= least_share)).select("row.*")


def held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 5) == 0
