"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each permutation gives a signature two values, the smallest and the largest hash of the set;
the share of equal values is an unbiased estimate of the Jaccard similarity, from half the
hash evaluations. ``BANDS`` bands of ``ROWS`` values are the buckets: two sets of similarity
0.8 meet in none of them with a chance of 1.3e-7, of 0.85 with 3e-10.

Texts with equal sets are one class from the start. In a bucket, classes are compared

1. with the bucket's own centre (another class in each bucket); their links are confirmed
   and give components;
2. where classes of a bucket are still in several components, those outside its largest
   component with all others of other components, in cells of about CELL x CELL classes
   inside a task. Pairs whose estimate is ``ERRORS`` standard errors below the threshold
   are passed over. In buckets of more than ``FEW`` classes a cell has the hashes of their
   full sets and gives no more pairs than join its components; in the many small ones it
   gives all pairs.

So no pair is left out but by the bands' and the estimate's chances, the pairs inside a
component, a large group's bulk, are not made, and a crowded bucket gives fewer links than
it has classes. Confirmation, of every link, compares the full sets of shingles themselves.
Classes are told apart by 128 bits of their set, texts by 128 bits of theirs.

Defined cases: a text without words (null, empty, white space) has an empty set and is
linked with nothing; one with fewer words than a shingle has them all as one shingle;
repeated rows of a doc_id with equal text are one document in several rows; a null doc_id
is linked like others and is a component's id only if all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanbox.llm.common import BROADCAST_ROWS, join_checked, materialize, packed
from gleanbox.llm.components import connected_components

PERMUTATIONS = 60
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
CELL = 400
FEW = 16
ERRORS = 6.0
REMEMBERED = 250_000
FILTER_WORDS = BROADCAST_ROWS

_random = np.random.default_rng(41)
_A = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def shingles(found: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles themselves, for exact comparison."""
    if len(found) < width:
        return {tuple(found)} if found else set()
    return set(zip(*(found[k:] for k in range(width)), strict=False))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(found: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in found], dtype=np.uint64)
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : len(h) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """Smallest and largest value under each permutation, 32 bits of each."""
    out = np.empty(2 * PERMUTATIONS, dtype=np.uint32)
    for start in range(0, PERMUTATIONS, 12):
        end = min(start + 12, PERMUTATIONS)
        values = own[None, :] * _A[start:end, None] + _B[start:end, None]
        values ^= values >> np.uint64(32)
        values *= np.uint64(0xD6E8FEB86659FD93)
        out[2 * start : 2 * end : 2] = values.min(axis=1) >> np.uint64(32)
        out[2 * start + 1 : 2 * end : 2] = values.max(axis=1) >> np.uint64(32)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """A bucket for each band. Values of one permutation fall into different bands."""
    mixed = sig.reshape(ROWS, BANDS).T.astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        out = (out ^ mixed[:, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out.astype(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), signature of every row."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for pdf in rows:
            out = []
            for t in pdf["text"]:
                own = shingle_hashes(words(t if isinstance(t, str) else None), width, hashes)
                if len(own):
                    out.append((len(own), xxhash.xxh3_128_digest(own.tobytes()), signature(own).tobytes()))
                else:
                    out.append((0, None, None))
            made = pd.DataFrame(out, columns=["n_shingles", "set_key", "signature"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "text_key": pdf["text_key"], **made})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    return keyed.mapInPandas(batches, "doc_id long, text_key binary, n_shingles long, set_key binary, signature binary")


def text_key(text):
    return F.unhex(F.md5(text))


def bucketed(classes: DataFrame) -> DataFrame:
    """(bucket, class_id, size) for every band of every class."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            all_ = [bands(np.frombuffer(s, dtype=np.uint32)) for s in pdf["signature"]]
            if all_:
                yield pd.DataFrame({"bucket": np.concatenate(all_), "class_id": np.repeat(pdf["class_id"].to_numpy(), BANDS), "size": np.repeat(pdf["size"].to_numpy(), BANDS)})

    return classes.select("class_id", "size", "signature").mapInPandas(batches, "bucket long, class_id long, size long")


def centre_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b, low, high): each class of a bucket with its centre, and their set sizes.

    The centre differs from bucket to bucket: it has the smallest hash of bucket and class.
    """
    place = F.struct(F.xxhash64("bucket", "class_id").alias("h"), "class_id", "size")
    centres = buckets.groupBy("bucket").agg(F.min(place).alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = buckets.join(centres, "bucket").filter(F.col("class_id") != F.col("centre.class_id"))
    return met.select(F.least("class_id", "centre.class_id").alias("a"), F.greatest("class_id", "centre.class_id").alias("b"), F.least("size", "centre.size").alias("low"), F.greatest("size", "centre.size").alias("high"))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    ``texts`` has class_id and text. Rows of one ``a`` stand together, so its set is made once
    in a task; a class with very many partners is split by AQE's skew join.
    """

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, set()
        for pdf in rows:
            links = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if a != last:
                    last, own = a, shingles(words(ta), width)
                other = shingles(words(tb), width)
                common = len(own & other)
                if 100 * common >= percent * (len(own) + len(other) - common):
                    links.append((a, b))
            yield pd.DataFrame(links, columns=["a", "b"])

    left = texts.select(F.col("class_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("class_id").alias("b"), F.col("text").alias("tb"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").mapInPandas(batches, "a long, b long")


def hashed_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class_id, hashes): the sorted 64-bit hashes of a class's full set."""

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for pdf in rows:
            yield pd.DataFrame({"class_id": pdf["class_id"], "hashes": [shingle_hashes(words(t), width, known).tobytes() for t in pdf["text"]]})

    return texts.select("class_id", "text").mapInPandas(batches, "class_id long, hashes binary")


def cells(buckets: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Rows of the cells in which classes of different components meet.

    ``buckets`` has bucket, class_id and component. Of a bucket that holds several
    components, classes outside its largest one stand in rows of a grid, all classes in its
    columns, at most about CELL each; a class is told once in a cell that has it in both.
    Buckets of more than FEW classes carry full sets.
    """
    parts = buckets.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("bulk"), F.sum("n").alias("n")).filter("parts > 1")
    size = lambda n: F.ceil(n / CELL).cast("int")
    open_ = open_.select("bucket", F.col("bulk.component").alias("bulk"), (F.col("n") > FEW).alias("crowded"), size(F.col("n")).alias("n_columns"), size(F.col("n") - F.col("bulk.n")).alias("n_rows"))
    rows = buckets.join(open_, "bucket").withColumns({"outside": F.col("component") != F.col("bulk"), "column": slot("n_columns"), "row": slot("n_rows")})
    cell = lambda r, c, is_row, is_column: F.struct(r.alias("r"), c.alias("c"), is_row.alias("is_row"), is_column.alias("is_column"))
    down = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: cell(r, F.col("column"), F.col("outside") & (r == F.col("row")), F.lit(True)))
    along = F.transform(F.sequence(F.lit(0), F.col("n_columns") - 1), lambda c: cell(F.col("row"), c, F.col("outside"), F.lit(False)))
    along = F.filter(along, lambda x: F.col("outside") & (x["c"] != F.col("column")))
    dealt = rows.withColumn("cell", F.explode(F.concat(down, along))).select("bucket", "cell.*", "class_id", "component", "crowded")
    dealt = dealt.join(classes.select("class_id", "size", "signature"), "class_id")
    crowded = rows.filter("crowded").select("class_id").distinct()
    sets = hashed_sets(texts.join(crowded, "class_id", "left_semi"), width)
    full = dealt.filter("crowded").join(sets, "class_id")
    return full.unionByName(dealt.filter("not crowded").withColumn("hashes", F.lit(None).cast("binary"))).drop("crowded")


def slot(n: str):
    return F.pmod(F.xxhash64("class_id", F.lit(7)), F.greatest(F.col(n), F.lit(1))).cast("int")


def compare_cell(rows: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """(a, b) for pairs of a cell that may be links.

    A pair is looked at in the first band only in which the two meet. With full sets it must
    be a link by their hashes, and is passed over if links of this cell join the two already.
    """
    ids, component, size = rows["class_id"].to_numpy(), rows["component"].to_numpy(), rows["size"].to_numpy()
    sig = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint32).reshape(len(rows), -1)
    outside = rows["is_row"].to_numpy(dtype=bool)
    inside = np.flatnonzero(rows["is_column"].to_numpy(dtype=bool))
    here = rows["bucket"].iloc[0]
    band = int(np.flatnonzero(bands(sig[0]) == here)[0])
    blobs = rows["hashes"].to_numpy()
    exact = blobs[0] is not None
    sets: dict[int, set[int]] = {}
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def full(k: int) -> set[int]:
        if k not in sets:
            sets[k] = set(np.frombuffer(blobs[k], dtype=np.uint64).tolist())
        return sets[k]

    least = percent / 100 - ERRORS * np.sqrt(percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS))
    out = []
    for i in np.flatnonzero(outside):
        near = inside[(component[inside] != component[i])]
        # two classes outside the bulk meet once
        near = near[~(outside[near] & (ids[near] < ids[i]))]
        low, high = np.minimum(size[near], size[i]), np.maximum(size[near], size[i])
        near = near[100 * low >= percent * high]
        if not len(near):
            continue
        same = sig[near] == sig[i]
        likely = same.mean(axis=1) >= least
        near, same = near[likely], same[likely]
        first = same.reshape(len(near), ROWS, BANDS).all(axis=1).argmax(axis=1) == band
        for j in near[first]:
            if not exact:
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                continue
            a, b = find(component[i]), find(component[j])
            if a == b:
                continue
            common = len(full(i) & full(j))
            if 100 * common >= percent * (int(size[i]) + int(size[j]) - common):
                parent[a] = b
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def cell_pairs(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) from all cells. Cells are read as a sorted stream, one held at a time."""
    key = ["bucket", "r", "c"]

    def batches(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in rows:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            edge = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], edge])
            out = [x for s, e in zip(starts, edge, strict=False) for x in compare_cell(pdf.iloc[s:e], percent)]
            rest = pdf.iloc[starts[-1] :]
            yield pd.DataFrame(out, columns=["a", "b"])
        if rest is not None and len(rest):
            yield pd.DataFrame(compare_cell(rest, percent), columns=["a", "b"])

    return dealt.repartition(*key).sortWithinPartitions(*key).mapInPandas(batches, "a long, b long")


def class_texts(texts: DataFrame, involved: DataFrame) -> DataFrame:
    """class_id and text of the involved classes.

    A class has one text_key, so its rows are where the join has brought them: texts are shuffled once.
    """
    return texts.join(involved, "text_key").groupBy("text_key", "class_id").agg(F.first("text").alias("text")).drop("text_key")


def grouped_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, set_key of every row; set_key, group, first of every class).

    ``first`` has the doc_id and text_key of the group's first row: the smallest id, null ids last.
    """
    rows = materialize(signed(docs, width), "signatures")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    classes = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min("n_shingles").alias("size"), F.min("text_key").alias("text_key"), F.first("signature").alias("signature"), F.min(place).alias("place"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    buckets = bucketed(classes)
    crowded = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = materialize(buckets.join(crowded, "bucket", "left_semi"), "buckets")
    # sizes alone rule out pairs: the smaller set must be percent of the larger at least
    pairs = centre_pairs(buckets).filter(100 * F.col("low") >= percent * F.col("high")).select("a", "b").distinct()
    texts = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    involved = classes.join(buckets.select("class_id").distinct(), "class_id", "left_semi").select("class_id", "text_key")
    texts = materialize(class_texts(texts, involved), "texts")
    links = materialize(confirmed(pairs, texts, width, percent), "links-first")
    first = materialize(connected_components(links), "components-first")
    placed = buckets.join(first.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = placed.select("bucket", "class_id", F.coalesce("component", "class_id").alias("component"))
    more = materialize(cell_pairs(cells(placed, classes, texts, width), percent).distinct(), "cell-pairs")
    more = confirmed(more, texts, width, percent)
    final = connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # groups are made of classes, so copies of a text don't crowd one
    grouped = classes.select("set_key", "class_id", "place").join(final.withColumnRenamed("node", "class_id"), "class_id", "left")
    grouped = materialize(grouped.select("set_key", F.coalesce("component", "class_id").alias("group"), "place"), "grouped")
    firsts = materialize(grouped.groupBy("group").agg(F.min("place").alias("first")), "firsts")
    return rows.drop("signature"), join_checked(grouped.drop("place"), firsts, "group").select("set_key", "group", "first")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, group, component_id and kept of every row of docs (doc_id, text).

    The group numbers what is linked; it is null for an empty set.
    """
    rows, classes = grouped_classes(docs, width, percent)
    linked = rows.filter("set_key is not null").join(classes, "set_key").select("doc_id", "n_shingles", "group", F.col("first.doc_id").alias("component_id"))
    alone = rows.filter("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each group the smallest id stays.

    Of rows with the same id and text one stays; rows without words are linked with nothing
    and all stay.
    """
    rows, classes = grouped_classes(docs.select("doc_id", "text"), width, percent)
    firsts = materialize(classes.select("first.doc_id", "first.text_key").distinct(), "kept")
    counted = rows.filter("set_key is not null").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    gone = materialize(join_on_row(counted, firsts, "left_anti").select("doc_id", "text_key"), "gone")
    again = materialize(join_on_row(counted.filter("n > 1"), firsts).select("doc_id", "text_key"), "repeated")
    docs = packed(docs, F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.coalesce(F.col("text").rlike(r"[^ \t-\r]"), F.lit(False)).alias("spoken"))
    # most rows are neither: they stay where they are, and their texts aren't shuffled
    docs = marked(docs, gone.unionByName(again))
    stay = join_on_row(docs.filter("spoken and marked"), gone, "left_anti")
    once = join_on_row(stay, again, "left_anti").select("row")
    one = join_on_row(stay, again).groupBy("doc_id", "text_key").agg(F.first("row").alias("row")).select("row")
    return docs.filter("not (spoken and marked)").select("row").unionByName(once).unionByName(one).select("row.*")


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with ``marked``: true if doc_id and text_key are among the keys, and for a few others.

    A Bloom filter of at most FILTER_WORDS words of 64 bits, three bits of one word a key; it is
    broadcast. With very many keys it marks more of the others, but misses no key.
    """
    word = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(FILTER_WORDS)).alias("word")
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftright(xxhash64(doc_id, text_key, 1), {k}) & 63 as int))")
    bits = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))
    told = keys.select(word, bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("told"))
    met = rows.withColumns({"word": word, "bits": bits}).join(F.broadcast(told), "word", "left")
    return met.withColumn("marked", F.coalesce(F.col("told").bitwiseAND(F.col("bits")) == F.col("bits"), F.lit(False))).drop("word", "bits", "told")


def join_on_row(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose doc_id and text_key are among the keys, or aren't (left_anti)."""
    small = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keys = keys.select(F.col("doc_id").alias("k_id"), F.col("text_key").alias("k_text"))
    return rows.join(F.broadcast(keys) if small else keys, rows["doc_id"].eqNullSafe(keys["k_id"]) & (rows["text_key"] == keys["k_text"]), how)
