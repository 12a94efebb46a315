"""Scoring texts with a probabilistic suffix tree over bytes and words.

A text is its lower-cased words with one space between them and a line feed as its end; a
line feed also stands before it as context. Contexts are of three kinds.

Contexts of up to ``DEPTH`` bytes. A context is a candidate if it is met in at least ``P_MIN``
of all places, and is retained if its next-byte distribution diverges from that of its longest
retained suffix by at least ``DIVERGENCE`` nats in all (Kullback-Leibler, times its count).
Distributions are smoothed with their parent's; the root's with all 256 bytes. A byte is
scored in the state of the longest retained suffix of what stands before it. These contexts
are few, however large the corpus: at most DEPTH / P_MIN reach the driver and the tasks.

Contexts of one whole word of any length, for each word that makes up less than ``P_HEAD`` of
the training tokens; the symbol is the next word. Their number grows with the corpus, so they are
never gathered anywhere: all places of a word meet in a shuffle, in training and in scoring.
What held-out texts hold decides nothing. A word that is frequent in them alone would crowd a
task, so its places there are dealt out over several groups, and its training places, which
are few, go to each of these.
A word's distribution diverges if its places, each predicted by the others of them, gain at
least ``DIVERGENCE`` nats over the bytes' contexts; then the next word is scored by it,
smoothed with what the bytes' contexts give.

Contexts of one whole word with at least ``P_HEAD`` of the training tokens, told apart by the
next words that follow it in at least ``P_HEAD`` of all places, at most 1 / P_HEAD pairs. These
are counted with the bytes' contexts, and go to every task. The divergence test is the same,
but that the bytes' contexts begin with the word; all other next words share what is left,
and are scored by the bytes' contexts times that share. So each word of two training places
or more may be a context, however frequent it is.

Counts come from every training text. A pass before tells, by sketches of a bounded number of cells, which
contexts of five and six bytes and which pairs may be met often enough; a place counts with its
longest context that may, so contexts that can't be candidates make no rows. Words are told
apart by 64-bit hashes, but in their own counts' shuffle by themselves. Scoring steps many pieces of texts at once through the
bytes' contexts as an automaton; a piece starts DEPTH bytes early, after which its state can't
depend on anything before. A greater DEPTH costs a pass of counting more; what lies beyond six
bytes is left to the words' contexts.

The base score needs the count of every word in the training texts. Words with at least
``P_HEAD`` of the training tokens (at most 1 / P_HEAD of them) go to every task; rarer words
are counted where their places meet.

Defined cases: a null text is empty and is scored as its end alone; rows repeated in full are
scored alike; without training texts the tree is its root with equal probabilities, and each
base term is log10(1 / (V + 1)) with V = 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.llm.common import crc_mod, materialize

DEPTH = 6
P_MIN = 2e-6
DIVERGENCE = 6.0
P_HEAD = 1e-6
#: Kinds of counts beside those of byte contexts: of pairs of frequent words, and of a frequent word's places before another.
PAIR, LEADS = -1, -2
#: Bits for a frequent word's number, which is under 1 / P_HEAD.
WORD_BITS = 20
#: Held-out places of a word in one group, and at least as many as a word may have that is no head word.
GROUP_ROWS = 10_000
END = 0x0A
BATCH_BYTES = 1 << 21
FLUSH = 1 << 20
EMIT = 1 << 18
LANE = 256
#: Bits of a sketch's cells by kind: of byte contexts of that length, and of pairs; cells in a row; steps of a threshold's local share.
CELL_BITS = {DEPTH: 20, DEPTH - 1: 20, PAIR: 22}
CHUNK = 1 << 14
STEPS = 8


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def gathered(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]  # one after the other, so that less is held at once
    n = n[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.array([], dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts with the sums of their counts; empties the list, so that its arrays are freed first."""
    keys, n = [np.concatenate([k for k, _ in parts])], [np.concatenate([c for _, c in parts])]
    parts.clear()
    return gathered(keys.pop(), n.pop())


def packed_grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte: it and up to ``depth`` before it, packed, and its place in its text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    return packed_bytes(np.frombuffer(b"".join(texts), dtype=np.uint8), depth), places_in(sizes)


def packed_bytes(data: np.ndarray, depth: int) -> np.ndarray:
    """Every byte with ``depth`` bytes before it, of whatever text; doubling what is packed."""
    packed, have = data.astype(np.int64), 1
    while have <= depth:
        more = min(have, depth + 1 - have)
        before = packed[: max(len(packed) - have, 0)] & ((1 << 8 * more) - 1)
        before <<= 8 * have
        packed[have:] |= before
        have += more
    return packed


def places_in(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the consecutive runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def gram_counts(texts: list[bytes], depth: int = DEPTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context length: packed (context, next byte) and counts. A text is END words END."""
    packed, at = packed_grams(texts, depth)
    out: list = [None] * (depth + 1)
    keys, n = np.unique(packed[at >= depth], return_counts=True)
    for d in range(depth, -1, -1):
        if d < depth:
            # shorter contexts: those of the longer ones, and the places where no more stands before
            low = packed[(at == d) & (at > 0)] & ((1 << 8 * (d + 1)) - 1)
            keys, n = gathered(np.concatenate([keys & ((1 << 8 * (d + 1)) - 1), low]), np.concatenate([n, np.ones(len(low), dtype=n.dtype)]))
        out[d] = (keys, n)
    return out


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of EMIT rows at most."""
    for k in range(0, batch.num_rows, EMIT):
        yield batch.slice(k, EMIT)


def as_symbols(found: list[bytes]) -> bytes:
    return b"\n" + b" ".join(found) + b"\n"


# A-Z in lower case, ASCII white space as spaces
_FOLD = bytes(0x20 if k in b" \t\n\v\f\r" else ord(chr(k).lower()) if k < 0x80 else k for k in range(256))
_random = np.random.default_rng(17)
_BYTES = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_random.integers(1 << 40, 1 << 63)) * 2 + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """At least n powers of the hash's base, and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            each = np.full(n, base, dtype=np.uint64)
            each[0] = 1
            _powers[k] = np.cumprod(each, dtype=np.uint64)
    return _powers


class Pieces:
    """Several texts as symbols, joined, and their words; no Python object is made for a word.

    ``starts``, ``ends``: the places of each text's two ENDs. ``begin``, ``stop``: a word stands
    at begin and before stop, where the space or end after it is. ``first``, ``sizes``: a text's
    first word and how many it has. ``hashes``: of words, 64 bits.
    """

    def __init__(self, raw: bytes, offsets: list[int]):
        folded = raw.translate(_FOLD)
        data = np.frombuffer(b"\n" + b"\n\n".join([folded[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]) + b"\n", dtype=np.uint8)
        # of a run of white space one space stays, and none beside an END
        space = data == 0x20
        parts = space | (data == END)
        space[1:] &= parts[:-1]
        data = data[~space]
        last = np.flatnonzero((data[:-1] == 0x20) & (data[1:] == END))
        self.data = np.delete(data, last) if len(last) else data
        ends = np.flatnonzero(self.data == END)
        self.starts, self.ends = ends[::2], ends[1::2]
        parts = np.flatnonzero((self.data == 0x20) | (self.data == END))
        word = np.diff(parts) > 1
        self.begin, self.stop = parts[:-1][word] + 1, parts[1:][word]
        self.first = np.searchsorted(self.begin, self.starts)
        self.sizes = np.diff(self.first, append=len(self.begin))
        up, down = powers(len(self.data) + 1)
        run = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[self.data] * up[: len(self.data)], out=run[1:])
        h = (run[self.stop] - run[self.begin]) * down[self.begin] + (self.stop - self.begin).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= _MIX
        self.hashes = h ^ (h >> np.uint64(29))

    def words(self, some: np.ndarray) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.begin[some].tolist(), self.stop[some].tolist(), strict=True)]

    def texts(self) -> list[bytes]:
        data = self.data.tobytes()
        return [data[a : b + 1] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def behind(self, depth: int) -> np.ndarray:
        """Which places have so many bytes of their text before them."""
        out = np.ones(len(self.data), dtype=bool)
        for d in range(depth):
            out[np.minimum(self.starts + d, self.ends)] = False
        return out

    def left(self) -> np.ndarray:
        """How many more words stand in a word's text."""
        return np.repeat(self.first + self.sizes, self.sizes) - 1 - np.arange(len(self.begin))


def pieces_of(batches: Iterator[pa.RecordBatch], least: int = BATCH_BYTES // 2) -> Iterator[tuple[pa.RecordBatch, Pieces]]:
    """Rows of at least so many bytes of text together, or what a batch has left, and their texts; a null text is empty."""
    for batch in batches:
        texts = batch["text"].fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        k = 0
        while k < len(texts):
            to = min(max(int(np.searchsorted(offsets, offsets[k] + least)), k + 1), len(texts), k + least // 64)
            raw = data[int(offsets[k]) : int(offsets[to])].to_pybytes() if data is not None else b""
            yield batch.slice(k, to - k), Pieces(raw, (offsets[k : to + 1] - offsets[k]).tolist())
            k = to


class Names:
    """Frequent words and their numbers, found by hash."""

    def __init__(self, names: list[bytes]):
        self.end = names.index(b"\n") if b"\n" in names else None
        own = np.array([k for k in range(len(names)) if k != self.end], dtype=np.int64)
        data, offsets = b"".join(names[k] for k in own), np.cumsum([0] + [len(names[k]) for k in own]).tolist()
        hashes = Pieces(data, offsets).hashes if len(own) else np.array([], dtype=np.uint64)
        order = np.argsort(hashes)
        self.size, self.hashes, self.numbers = len(names), hashes[order], own[order]

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for those that have none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int64)
        where = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[where] == hashes, self.numbers[where], -1)


def cell_of(keys: np.ndarray, kind: int) -> np.ndarray:
    """A key's cell in the sketch of its kind."""
    return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - CELL_BITS[kind])).view(np.int64)


def pairs_of(ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of numbered words before another word, and their packed pairs, -1 if the other has no number.

    A next word that ends its text is told apart from one that doesn't.
    """
    at = np.flatnonzero((ids >= 0) & (left > 0))
    after = ids[at + 1]
    return at, np.where(after < 0, -1, (ids[at] << (WORD_BITS + 1)) | (after << 1) | (left[at] == 1))


@dataclass
class SuffixTree:
    code: np.ndarray  # byte -> column
    moves: np.ndarray  # state and column -> state times columns
    logs: np.ndarray  # state and column -> log10 probability
    states: int
    retained: int

    def byte_logs(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of every byte of the texts joined (each END words END); a first END has 0."""
        data = self.code[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        each = np.zeros(len(data), dtype=np.float32)
        lanes: list[tuple[int, int, int]] = []
        at = 0
        for t in texts:
            lanes += [(at, start, min(start + LANE, len(t))) for start in range(1, len(t), LANE)]
            at += len(t)
        if not lanes:
            return each
        base, start, stop = (np.array(x) for x in zip(*lanes, strict=True))
        order = np.argsort(-(stop - start), kind="stable")
        base, start, stop = base[order], start[order], stop[order]
        state = np.zeros(len(lanes), dtype=np.int32)
        for back in range(DEPTH, 0, -1):
            warm = start >= back
            place = base + np.maximum(start - back, 0)
            state = np.where(warm, self.moves[state + data[place]], state)
        length = stop - start
        first = base + start
        alive = len(lanes)
        for step in range(int(length[0])):
            while length[alive - 1] <= step:
                alive -= 1
            place = first[:alive] + step
            cell = state[:alive] + data[place]
            each[place] = self.logs[cell]
            state[:alive] = self.moves[cell]
        return each

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text (END words END), its first END given."""
        run = np.concatenate([[0.0], np.cumsum(self.byte_logs(texts), dtype=np.float64)])
        return np.diff(run[np.cumsum([0] + [len(t) for t in texts])])


@dataclass
class WordContexts:
    """Frequent words as contexts."""

    keys: np.ndarray  # packed pairs of retained contexts, sorted
    shares: np.ndarray  # their probabilities, without the bytes' contexts' part
    rest: np.ndarray  # number of a word -> weight of the bytes' contexts, 1 if it isn't retained

    def gains(self, ids: np.ndarray, left: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of retained words, and what they add to the log10 probability of the next word; logs: the bytes' of each word."""
        at, pair = pairs_of(ids, left)
        own = self.rest[ids[at]] < 1
        at, pair = at[own], pair[own]
        where = np.minimum(np.searchsorted(self.keys, pair), max(len(self.keys) - 1, 0))
        share = np.where(self.keys[where] == pair, self.shares[where], 0.0) if len(self.keys) else np.zeros(len(at))
        return at, np.log10(share * 10.0 ** np.minimum(-logs[at + 1], 300.0) + self.rest[ids[at]])


def build_contexts(names: list[bytes], keys: np.ndarray, n: np.ndarray, leads: np.ndarray, tree: SuffixTree, divergence: float = DIVERGENCE) -> WordContexts:
    """names: the frequent words by number; keys, n: their pairs, sorted, and counts; leads: places before another word."""
    first, after, last = keys >> (WORD_BITS + 1), (keys >> 1) & ((1 << WORD_BITS) - 1), keys & 1
    logs = np.zeros(len(keys))
    for k in range(0, len(keys), FLUSH // 16):
        part = slice(k, k + FLUSH // 16)
        before = [b" " + names[i] + b" " for i in first[part].tolist()]
        next_ = [names[i] + (b"\n" if end else b" ") for i, end in zip(after[part].tolist(), last[part].tolist(), strict=True)]
        run = np.concatenate([[0.0], np.cumsum(tree.byte_logs([b + w for b, w in zip(before, next_, strict=True)]), dtype=np.float64)])
        ends = np.cumsum([len(b) + len(w) for b, w in zip(before, next_, strict=True)])
        logs[part] = run[ends] - run[ends - np.array([len(w) for w in next_])]
    kinds = np.bincount(first, minlength=len(names))
    others = leads - np.bincount(first, weights=n, minlength=len(names))
    # a place predicted by the others of its word, against the bytes' contexts
    gain = n * (np.log((n - 1) * 10.0 ** np.minimum(-logs, 300.0) + (others + kinds)[first]) - np.log(np.maximum(leads + kinds - 1, 1))[first])
    gain = np.bincount(first, weights=gain, minlength=len(names)) + others * np.log(np.maximum(others + kinds - 1, 1) / np.maximum(leads + kinds - 1, 1))
    retained = (kinds > 0) & (gain >= divergence)
    rest = np.where(retained, (others + kinds) / np.maximum(leads + kinds, 1), 1.0)
    own = retained[first]
    return WordContexts(keys[own], (n / (leads + kinds)[first])[own], rest)


def build_tree(grams: list[tuple[np.ndarray, np.ndarray]], divergence: float = DIVERGENCE) -> SuffixTree:
    """grams: for each context length the packed (context, next) and counts of the candidates."""
    depth = len(grams) - 1
    root = np.zeros(256)
    root[grams[0][0]] = grams[0][1]
    seen = np.flatnonzero(root)
    missing = 256 - len(seen)
    code = np.full(256, len(seen), dtype=np.int32)
    code[seen] = np.arange(len(seen))
    columns = len(seen) + 1
    total = root.sum()
    p = np.concatenate([root[seen], [0.0]])
    share = np.concatenate([np.full(len(seen), 1 / 256), [missing / 256]])
    kinds = max(len(seen), 1)
    p = (p + kinds * share) / (total + kinds)
    # of the candidates of one length: contexts, whether retained, row in the retained distributions
    contexts = [np.array([0], dtype=np.int64)]
    keep = [np.array([True])]
    effective = [np.array([0])]
    table = p[None, :].astype(np.float32)
    for d in range(1, depth + 1):
        keys, n = grams[d]
        ctx, sym = keys >> 8, code[keys & 0xFF]
        own, index = np.unique(ctx, return_inverse=True)
        short = own & ((1 << 8 * (d - 1)) - 1)
        where = np.searchsorted(contexts[d - 1], short)
        where = np.minimum(where, len(contexts[d - 1]) - 1)
        valid = contexts[d - 1][where] == short if len(own) else np.array([], dtype=bool)
        parent = np.where(valid, effective[d - 1][where], 0)
        size = np.bincount(index, weights=n, minlength=len(own))
        kinds = np.bincount(index, minlength=len(own))
        q = table[parent[index], sym]
        raw = n / size[index]
        gain = np.bincount(index, weights=n * np.log(raw / q), minlength=len(own))
        retained = gain >= divergence
        rows = np.full(len(own), -1)
        rows[retained] = len(table) + np.arange(int(retained.sum()))
        dist = table[parent[retained]]
        dist *= (kinds[retained] / (size[retained] + kinds[retained])).astype(np.float32)[:, None]
        local = np.cumsum(retained) - 1
        hit = retained[index]
        np.add.at(dist, (local[index[hit]], sym[hit]), n[hit] / (size + kinds)[index[hit]])
        table = np.concatenate([table, dist])
        del dist
        contexts.append(own)
        keep.append(retained)
        effective.append(np.where(retained, rows, parent))
    # states: retained contexts and their prefixes, so that every state is reached byte by byte
    nodes = [np.array([0], dtype=np.int64)] + [c[k] for c, k in zip(contexts[1:], keep[1:], strict=True)]
    for d in range(depth, 1, -1):
        nodes[d - 1] = np.union1d(nodes[d - 1], nodes[d] >> 8)
    offset = np.cumsum([0] + [len(x) for x in nodes])
    states = int(offset[-1])
    moves = np.zeros((states, columns), dtype=np.int32)
    fail = np.zeros(states, dtype=np.int64)
    logs_row = np.zeros(states, dtype=np.int64)
    for d in range(depth + 1):
        ids = np.arange(offset[d], offset[d + 1])
        if d:
            up = offset[d - 1] + np.searchsorted(nodes[d - 1], nodes[d] >> 8)
            last = code[nodes[d] & 0xFF]
            fail[ids] = moves[fail[up], last] if d > 1 else 0
            moves[ids] = moves[fail[ids]]
            where = np.minimum(np.searchsorted(contexts[d], nodes[d]), max(len(contexts[d]) - 1, 0))
            own = (contexts[d][where] == nodes[d]) & keep[d][where] if len(contexts[d]) else np.zeros(len(ids), dtype=bool)
            logs_row[ids] = np.where(own, effective[d][where] if len(contexts[d]) else 0, logs_row[fail[ids]])
        if d < depth and len(nodes[d + 1]):
            up = offset[d] + np.searchsorted(nodes[d], nodes[d + 1] >> 8)
            moves[up, code[nodes[d + 1] & 0xFF]] = offset[d + 1] + np.arange(len(nodes[d + 1]))
    retained = len(table)
    np.log10(table, out=table)
    table[:, -1] -= log10(max(missing, 1))  # the unseen bytes share one column
    moves *= columns
    return SuffixTree(code, moves.ravel(), table[logs_row].ravel(), states, retained)


def word_counts(docs: DataFrame, held_out: Column) -> DataFrame:
    """word, n, more: counts of all words in training and in held-out texts, and of the end (a lone line feed) once a text."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

        def emit() -> Iterator[pa.RecordBatch]:
            for k, own in enumerate(found):
                n = np.fromiter(own.values(), dtype=np.int64, count=len(own))
                counts = [n, np.zeros_like(n)] if k == 0 else [np.zeros_like(n), n]
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), *map(pa.array, counts)], names=["word", "n", "more"]))
                own.clear()

        for some, pieces in pieces_of(rows):
            flags = some["out"].to_numpy(zero_copy_only=False).astype(bool)
            out = np.repeat(flags, pieces.sizes)
            for k, own in enumerate(found):
                which = np.flatnonzero(out == (k == 1))
                order = which[np.argsort(pieces.hashes[which])]
                h = pieces.hashes[order]
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.array([], dtype=np.int64)
                for w, n in zip(pieces.words(order[first]), np.diff(first, append=len(h)).tolist(), strict=True):
                    own[w] = own.get(w, 0) + n
                own[b"\n"] = own.get(b"\n", 0) + int((flags == (k == 1)).sum())
            if sum(map(len, found)) > FLUSH // 4:
                yield from emit()
        yield from emit()

    counted = docs.select("text", held_out.alias("out")).mapInArrow(batches, "word binary, n long, more long").filter("n > 0 or more > 0")
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("more").alias("more"))


def passing_cells(docs: DataFrame, names: Broadcast, least: dict[int, float]) -> dict[int, np.ndarray]:
    """For each kind of key whether a cell of its sketch may hold one that is met so often.

    Each task counts the keys of a cell, rounds up to an eighth of its share of the threshold, and
    tells a byte; 255 stands for any number. So the sums are never too small, and no key that
    is met often enough can fail.
    """
    share = {kind: P_HEAD if kind == PAIR else P_MIN for kind in CELL_BITS}

    def sketches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {kind: np.zeros(1 << bits, dtype=np.int32) for kind, bits in CELL_BITS.items()}
        places = dict.fromkeys(CELL_BITS, 0)

        def add(kind: int, keys: np.ndarray, n: int) -> None:
            places[kind] += n
            own = cell_of(keys, kind)
            if len(own) << 4 > len(cells[kind]):
                cells[kind] += np.bincount(own, minlength=len(cells[kind])).astype(np.int32)
                return
            own.sort()
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
            cells[kind][own[first]] += np.diff(first, append=len(own)).astype(np.int32)

        for _, pieces in pieces_of(rows):
            packed = packed_bytes(pieces.data, DEPTH)
            for d in (DEPTH, DEPTH - 1):
                add(d, (packed[pieces.behind(d)] & ((1 << 8 * (d + 1)) - 1)) >> 8, len(packed) - len(pieces.starts))
            del packed
            pair = pairs_of(names.value.of(pieces.hashes), pieces.left())[1]
            add(PAIR, pair[pair >= 0], len(pieces.begin))
        for kind, own in cells.items():
            unit = max(1, int(places[kind] * share[kind] / STEPS))
            told = np.minimum(-(-own // unit), 255).astype(np.uint8).reshape(-1, CHUNK)
            some = np.flatnonzero(told.any(axis=1))
            arrays = [np.full(len(some), kind, dtype=np.int32), some.astype(np.int32), np.full(len(some), unit, dtype=np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.array([told[k].tobytes() for k in some], pa.binary())], names=["kind", "chunk", "unit", "cells"])

    def passing(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CHUNK)
        for unit, cells in zip(rows["unit"], rows["cells"], strict=True):
            own = np.frombuffer(cells, dtype=np.uint8)
            total += np.where(own == 255, np.inf, own * float(unit))
        kind = int(rows["kind"].iloc[0])
        return pd.DataFrame({"kind": [kind], "chunk": rows["chunk"].iloc[:1], "bits": [np.packbits(total >= least[kind]).tobytes()]})

    told = docs.select("text").mapInArrow(sketches, "kind int, chunk int, unit long, cells binary").groupBy("kind", "chunk").applyInPandas(passing, "kind int, chunk int, bits binary").toArrow()
    out = {kind: np.zeros(1 << bits, dtype=bool) for kind, bits in CELL_BITS.items()}
    for kind, chunk, bits in zip(*(told[c].to_pylist() for c in ("kind", "chunk", "bits")), strict=True):
        out[kind][chunk * CHUNK : (chunk + 1) * CHUNK] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return out


def longest_counts(docs: DataFrame, depth: int = DEPTH, index: Broadcast | None = None, passing: Broadcast | None = None) -> DataFrame:
    """d, key, n: counts with the longest context that stands at a place (d bytes); PAIR and LEADS count words of the index.

    With ``passing`` a place counts with its longest context that may be a candidate, and pairs count that may be frequent.
    """

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        names, cells = index.value if index else Names([]), passing.value if passing else {}
        leads = np.zeros(names.size, dtype=np.int64)

        def told(d: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from sliced(pa.RecordBatch.from_arrays([*map(pa.array, (np.full(len(keys), d, dtype=np.int32), keys, n))], names=["d", "key", "n"]))

        def add(d: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            parts = held.setdefault(d, [])
            parts.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in parts) > FLUSH:
                parts.append(merged(parts))
                if len(parts[0][0]) > FLUSH // 2:
                    yield from told(d, *parts.pop())

        for _, pieces in pieces_of(rows):
            packed = packed_bytes(pieces.data, depth)
            for d in range(1, depth):  # places where no more stands before
                yield from add(d, packed[pieces.starts[d <= pieces.ends - pieces.starts] + d] & ((1 << 8 * (d + 1)) - 1))
            packed = packed[pieces.behind(depth)]
            for d in range(depth, 0, -1):
                packed &= (1 << 8 * (d + 1)) - 1
                if d not in cells:
                    yield from add(d, packed)
                    break
                ok = cells[d][cell_of(packed >> 8, d)]
                yield from add(d, packed[ok])
                packed = packed[~ok]
            del packed
            if names.size:
                led, pair = pairs_of(ids := names.of(pieces.hashes), pieces.left())
                pair = pair[pair >= 0]
                yield from add(PAIR, pair[cells[PAIR][cell_of(pair, PAIR)]] if PAIR in cells else pair)
                leads += np.bincount(ids[led], minlength=len(leads))
        for d, parts in held.items():
            if parts:
                yield from told(d, *merged(parts))
        if leads.any():
            yield from told(LEADS, np.flatnonzero(leads), leads[leads > 0])

    return docs.select("text").mapInArrow(batches, "d int, key long, n long").groupBy("d", "key").agg(F.sum("n").alias("n"))


def fit_tree(docs: DataFrame, depth: int = DEPTH, p_min: float = P_MIN, divergence: float = DIVERGENCE) -> SuffixTree:
    """Count contexts over all training texts and build the tree from the candidates."""
    return grown_tree(materialize(longest_counts(docs, depth), "grams"), depth, p_min, divergence)


def grown_tree(counted: DataFrame, depth: int = DEPTH, p_min: float = P_MIN, divergence: float = DIVERGENCE) -> SuffixTree:
    """The tree from the counts of the longest contexts."""
    places = counted.filter("d >= 0").agg(F.sum("n")).first()[0] or 0
    level, grams = None, []
    for d in range(depth, -1, -1):
        # the places of shorter contexts are those of the longer ones, and the starts of texts
        own = counted.filter(F.col("d") == d).select("key", "n")
        if level is not None:
            mask = F.lit((1 << 8 * (d + 1)) - 1)
            own = own.unionByName(level.select(F.col("key").bitwiseAND(mask).alias("key"), "n")).groupBy("key").agg(F.sum("n").alias("n"))
        level = materialize(own, f"grams-{d}")
        contexts = level.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total")).filter(F.col("total") >= max(2, p_min * places) if d else F.lit(True))
        kept = level.join(contexts.select("ctx"), F.shiftright(level["key"], 8) == F.col("ctx"), "left_semi").toArrow().to_pandas()
        grams.append((kept["key"].to_numpy(), kept["n"].to_numpy()))
    return build_tree([(k[order := np.argsort(k)], n[order]) for k, n in grams[::-1]], divergence)


def frequent_contexts(counted: DataFrame, names: list[bytes], least: float, tree: SuffixTree) -> WordContexts:
    """Frequent words as contexts, from the counts of their pairs with at least ``least`` places."""
    pairs = counted.filter((F.col("d") == PAIR) & (F.col("n") >= least)).select("key", "n").toArrow()
    keys, n = pairs["key"].to_numpy(), pairs["n"].to_numpy()
    led = counted.filter(F.col("d") == LEADS).select("key", "n").toArrow()
    leads = np.zeros(len(names), dtype=np.int64)
    leads[led["key"].to_numpy()] = led["n"].to_numpy()
    order = np.argsort(keys)
    return build_contexts(names, keys[order], n[order], leads, tree)


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of all texts (doc_id, text) by what was learned from those not held out (by doc_id).

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.
    """
    spark, training = docs.sparkSession, docs.filter(~held_out)
    counts = materialize(word_counts(docs, held_out), "words")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("more").alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("v"), F.sum(F.when(F.col("word") != F.lit(b"\n"), F.col("n") * (F.length("word") + 1))).alias("places")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    bottom = n + 0.1 * (v + 1)
    least = max(2, P_HEAD * n)
    common = counts.filter(F.col("n") >= least).sort("word").toArrow()
    names = common["word"].to_pylist()
    index = spark.sparkContext.broadcast(Names(names))
    terms = np.log10((common["n"].to_numpy() + 0.1) / bottom)
    # at most the share of held-out tokens over P_HEAD of them
    group_rows = max(GROUP_ROWS, least)
    crowded = counts.filter((F.col("n") < least) & (F.col("more") > group_rows)).toArrow()
    groups = {w: -int(-c // group_rows) for w, c in zip(crowded["word"].to_pylist(), crowded["more"].to_pylist(), strict=True)}
    # no more places than there are, since empty texts are left out
    enough = max(2, P_MIN * (totals["places"] or 0))
    passing = spark.sparkContext.broadcast(passing_cells(training, index, {kind: least if kind == PAIR else enough for kind in CELL_BITS}))
    counted = materialize(longest_counts(training, index=index, passing=passing), "grams")
    tree = grown_tree(counted)
    shared = spark.sparkContext.broadcast((tree, frequent_contexts(counted, names, least, tree), terms, groups))
    del tree, names, common
    schema = "doc_id long, row_key long, word binary, dealt int, follows long, lp float, n long, known long, base double, score double"
    columns = [x.split()[0] for x in schema.split(", ")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, contexts, terms, groups = shared.value
        names = index.value
        for some, pieces in pieces_of(rows):
            run = np.concatenate([[0.0], np.cumsum(tree.byte_logs(pieces.texts()), dtype=np.float64)])
            logs = run[pieces.stop + 1] - run[pieces.begin]  # a word's part of the text ends with the space or end after it
            n_texts = len(pieces.sizes)
            text_of = np.repeat(np.arange(n_texts), pieces.sizes)
            ids, left = names.of(pieces.hashes), pieces.left()
            led, gains = contexts.gains(ids, left, logs)
            common = ids >= 0
            known = np.bincount(text_of[common], minlength=n_texts) + (0 if names.end is None else 1)
            base = np.bincount(text_of[common], weights=terms[ids[common]], minlength=n_texts) + (0.0 if names.end is None else terms[names.end])
            score = run[pieces.ends + 1] - run[pieces.starts] + np.bincount(text_of[led], weights=gains, minlength=n_texts)
            row_key, held = some["row_key"].to_numpy(), some["out"].to_numpy(zero_copy_only=False).astype(bool)
            # the rows: rare words, ends of texts if they are rare, texts
            rare = np.flatnonzero(~common)
            ended = np.arange(n_texts) if names.end is None else np.array([], dtype=np.int64)
            text, nth = np.concatenate([text_of[rare], ended]), np.concatenate([rare - pieces.first[text_of[rare]], pieces.sizes[ended]])
            after = np.flatnonzero(left[rare] > 0)
            follows, lp = np.zeros(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.float32)
            follows[after] = (pieces.hashes[rare[after] + 1] ^ np.where(left[rare[after]] == 1, _MIX, np.uint64(0))).view(np.int64)
            lp[after] = logs[rare[after] + 1]
            none = np.ones(len(text), dtype=bool)
            none[after] = False
            words_of = pa.array([*pieces.words(rare), *[b"\n"] * len(ended)], pa.binary())
            which, dealt = np.arange(len(text)), np.zeros(len(text), dtype=np.int64)
            if groups:
                # a held-out place is in one group of its word, a training place in all
                n_groups = np.fromiter((groups.get(w, 1) for w in words_of.to_pylist()), dtype=np.int64, count=len(text))
                times = np.where(held[text], 1, n_groups)
                which = np.repeat(which, times)
                dealt = np.where(held[text[which]], (row_key[text[which]] + nth[which]) % n_groups[which], places_in(times))
                words_of = words_of.take(pa.array(which))
            text = text[which]
            void = lambda kind, n=len(which): pa.nulls(n, kind)
            arrays = [some["doc_id"].take(pa.array(text)), row_key[text], words_of, dealt.astype(np.int32), pa.array(follows[which], mask=none[which]), pa.array(lp[which], mask=none[which]), void(pa.int64()), void(pa.int64()), void(pa.float64()), void(pa.float64())]
            yield from sliced(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=columns))
            # a key of its own keeps the rows of texts apart in the shuffle; no word has a space
            arrays = [some["doc_id"], row_key, pa.array([b" %d" % k for k in row_key.tolist()], pa.binary()), np.zeros(n_texts, dtype=np.int32), void(pa.int64(), n_texts), void(pa.float32(), n_texts), pieces.sizes + 1, known, base, score]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=columns)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"), held_out.alias("out"))
    rows = keyed.mapInArrow(batches, schema)
    is_text = F.col("score").isNotNull()
    # all places of a rare word meet: its count, those of its next words, and what they gain
    pair, place = Window.partitionBy("word", "dealt", "follows"), Window.partitionBy("word", "dealt")
    learned = ~held_out & ~is_text
    met = rows.withColumn("learned", learned).withColumn("led", F.col("learned") & F.col("follows").isNotNull()).repartition("word", "dealt")
    total = lambda x, over: F.coalesce(F.sum(x).over(over), F.lit(0))
    met = met.withColumns({"pairs": total(F.col("led").cast("long"), pair), "pair_lp": F.avg(F.when(F.col("led"), F.col("lp"))).over(pair)})
    met = met.withColumns({"c": total(F.col("learned").cast("long"), place), "size": total(F.col("led").cast("long"), place), "kinds": F.round(total(F.when(F.col("led"), 1 / F.col("pairs")), place))})
    # a place predicted by the others of its word, against the bytes' contexts
    gain = F.ln((F.col("pairs") - 1) * F.pow(F.lit(10.0), F.least(-F.col("pair_lp"), F.lit(300.0))) + F.col("kinds")) - F.ln(F.col("size") - 1 + F.col("kinds"))
    met = met.withColumn("gain", total(F.when(F.col("led") & (F.col("size") > 1), gain), place))
    wide = F.col("size") + F.col("kinds")
    mixed = F.when(F.col("pairs") == 0, F.log10(F.col("kinds") / wide)).otherwise(F.log10(F.col("pairs") / wide + F.col("kinds") / wide * F.pow(F.lit(10.0), F.col("lp"))) - F.col("lp"))
    more = F.when(F.col("follows").isNotNull() & (F.col("size") > 1) & (F.col("gain") >= DIVERGENCE), mixed)
    term = F.log10((F.col("c") + 0.1) / F.lit(bottom))
    # a training place counts once for its text, in the first group; a row repeated in full
    # gives each of its sums as many times as it is there
    per = met.filter(held_out | (F.col("dealt") == 0)).groupBy("doc_id", "row_key").agg(
        F.sum(is_text.cast("long")).alias("copies"),
        F.max("n").alias("n_tokens"),
        F.max("known").alias("known"),
        F.sum((~is_text & (F.col("c") > 0)).cast("long")).alias("met"),
        F.max("base").alias("base"),
        F.sum(F.when(~is_text, term)).alias("terms"),
        F.max("score").alias("score"),
        F.sum(more).alias("more"),
    )
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return per.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("met") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("terms", F.lit(0.0)) / F.col("copies")).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0)) / F.col("copies")).alias("score"),
    )


def is_held_out(doc_id: Column) -> Column:
    return crc_mod(doc_id, 10) == 0
