"""Which of several filters removes what, in every order: contractions of contingency tensors.

Each part's documents are counted by which filters they fail: a tensor of one axis of length
two (pass, fail) for each filter. What a filter removes at its step, what it fails that was
gone before, what only it fails: each is a contraction that picks pass, fail or all along
every axis, and one einsum does it for all orders and steps of many parts.

Spark counts (32 cells for a part with five filters); only these counts reach Python, a few
hundred parts at a time. Copies are found by sums too: documents of one text, part and labels
are counted before any shuffle by text, so a text with very many copies is a few rows.

Defined cases: null texts are empty, and so copies of each other; a null source is the part
''; a null doc_id is no copy and has no labels; rows repeated with their id are documents of
their own and no copies of each other, since neither id is smaller; several labels of a document
count as one that has quality or toxic if any has; empty tables give an empty result; other
columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITALS_PERCENT = 5
SYMBOLS = "[#$%&*|]"

#: Parts in one contraction, which makes 600 rows of each.
PARTS_AT_ONCE = 64
MEASURES = ["docs", "good", "toxic"]
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long, filter string"


def text_failures(text: Column) -> list[Column]:
    """Of a text: too few words, too few different ones, too many capitals, a symbol."""
    words = F.array_remove(F.split(text, r"[ \t-\r]+"), "")
    n, capitals = F.size(words), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        100 * capitals.cast("bigint") > MAX_CAPITALS_PERCENT * F.length(text).cast("bigint"),
        text.rlike(SYMBOLS),
    ]


def mask_of(failures: list[Column]) -> Column:
    """Failures as bits, the first filter's the lowest."""
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures)), F.lit(0)).cast("int")


def filter_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by what they fail, those of quality 1 and of toxic 1."""
    whole = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    slim = whole.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), mask_of(text_failures(F.col("text"))).alias("mask"))
    slim = slim.groupBy("doc_id", "part", "key", "mask").agg(F.count(F.lit(1)).alias("n"))
    has = lambda c: F.max((F.col(c) == 1).cast("int"))
    own = labels.filter("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    zero = F.lit(0)
    named = slim.filter("doc_id is not null").join(own, "doc_id", "left").withColumns({"good": F.coalesce("good", zero), "toxic": F.coalesce("toxic", zero)})
    # rows without an id would all meet in one task of the join
    every = named.unionByName(slim.filter("doc_id is null").withColumns({"good": zero, "toxic": zero}))
    kinds = every.groupBy("key", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"),
    )
    firsts = kinds.groupBy("key").agg(F.min("first.doc_id").alias("first_id"))
    marked = kinds.join(firsts, "key")
    original = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("first_id"), F.col("first.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("mask"), original.alias("docs")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - original).alias("docs")))
    cells = marked.select("part", "good", "toxic", F.explode(both).alias("x")).select("part", "x.mask", "x.docs", (F.col("x.docs") * F.col("good")).alias("good"), (F.col("x.docs") * F.col("toxic")).alias("toxic"))
    return cells.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def contract(tensors: np.ndarray, picks: list[np.ndarray]) -> np.ndarray:
    """tensors: (parts, 2, ..., 2, measures); picks: for each axis (n, 2). Gives (parts, n, measures)."""
    axes = "abcdefghijkl"[: len(picks)]
    return np.einsum(f"p{axes}m,{','.join('x' + a for a in axes)}->pxm", tensors, *picks, optimize=True)


def audit_tensors(tensors: np.ndarray, filters: str) -> dict[str, np.ndarray]:
    """Figures of every order and step, each (parts, orders * steps), of tensors with pass at 0 and fail at 1."""
    passes, fails, all_ = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
    orders = ["".join(o) for o in itertools.permutations(filters)]
    steps = [(o[:k], o[k]) for o in orders for k in range(len(filters))]

    def pick(along) -> np.ndarray:
        return contract(tensors, [np.array([along(before, now, f) for before, now in steps]) for f in filters])

    kept = pick(lambda before, now, f: passes if f in before or f == now else all_)
    removed = pick(lambda before, now, f: fails if f == now else passes if f in before else all_)
    failing = pick(lambda before, now, f: fails if f == now else all_)
    unique = pick(lambda before, now, f: fails if f == now else passes)
    own = np.array([now for _, now in steps])
    shapley = np.zeros_like(removed[:, :, 0])
    for f in filters:
        shapley[:, own == f] = removed[:, own == f, 0].sum(axis=1, keepdims=True)
    return {"kept": kept[:, :, 0], "removed": removed[:, :, 0], "redundant": (failing - removed)[:, :, 0], "unique_fails": unique[:, :, 0], "good_lost": removed[:, :, 1], "toxic_lost": removed[:, :, 2], "shapley": shapley}


def _audit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    k = len(FILTERS)
    orders = ["".join(o) for o in itertools.permutations(FILTERS)]
    names = {"filter_order": np.repeat(orders, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)), "filter": np.array(list("".join(orders)))}
    for pdf in batches:
        for at in range(0, len(pdf), PARTS_AT_ONCE):
            some = pdf.iloc[at : at + PARTS_AT_ONCE]
            flat = np.zeros((len(some), 1 << k, len(MEASURES)), dtype=np.int64)
            for row, cells in zip(flat, some["cells"], strict=True):
                for c in cells:
                    row[c["mask"]] = [c[m] for m in MEASURES]
            # the lowest bit, which varies fastest, is the first filter: turn the axes round
            tensors = flat.reshape(len(some), *[2] * k, len(MEASURES)).transpose(0, *range(k, 0, -1), k + 1)
            figures = {c: x.ravel() for c, x in audit_tensors(tensors, FILTERS).items()}
            part = np.repeat(some["part"].to_numpy(), len(names["step"]))
            yield pd.DataFrame({"part": part, **{c: np.tile(x, len(some)) for c, x in names.items()}, **figures})[[c.split()[0] for c in RESULT.split(", ")]]


def audit_filters(cells: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of ``filter_cells``."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most 32 a part
    return parts.mapInPandas(_audit, RESULT)
