"""Document fingerprints from closed syncmers over words. DataFrame functions only.

A window of ``K`` consecutive words is an anchor if the smallest of its inner substrings (one
word each, by hash) is its first or last one. The choice looks at nothing outside the window,
so an edit changes anchors only near itself; about 2 in K windows are anchors, and no gap
between two is wider than a window. Texts of all lengths have anchors by this one rule:
before and after a text stand K - 1 blank words, so that a text of one word has windows too.
Each character of a script without spaces is a word.

A fingerprint is the whole sequence of anchors and grows with the text: for each anchor the
distance from the one before, a hex digit, and seven digits of the pair of both. Places are
sums of distances. Matching is positional: what two texts can share are anchors in a row at
the same distance (``links``), wherever in the texts they stand, so a moved passage counts
and scattered words don't. Likeness is the share of links that both have among all of either.

Defined cases: null and empty texts have an empty fingerprint; two empty fingerprints are
alike (1), an empty and another one are not (0). Repeated ids stand in order of their texts'
hashes, null ids come last. Cost grows linearly with a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.llm.common import join_checked, materialize, partitions

K = 5
BLOCK_ROWS = 512
RANGES = 10_000
CUTS = 256
#: Scripts written without spaces.
UNSPACED = r"[฀-໿က-႟ក-៿ぁ-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ]"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: a lambda's variable is not computed anew for each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.transform(F.array_remove(F.split(spaced, r"\s+"), ""), lambda w: F.xxhash64(w))


def links_of(hashes: Column, k: int = K) -> Column:
    """The links of all closed syncmers in order, 32 bits each; ``hashes`` holds a hash per word."""

    def closed(h: Column, i: Column) -> Column:
        return F.least(F.get(h, i), F.get(h, i + (k - 1))) <= F.least(*[F.get(h, i + j) for j in range(1, k - 1)])

    def link(at: Column, anchors: Column, place: Column, j: Column) -> Column:
        gap = place - F.coalesce(F.get(at, j - 1), F.lit(0))
        pair = F.xxhash64(F.coalesce(F.get(anchors, j - 1), F.lit(0).cast("long")), F.get(anchors, j))
        return F.shiftleft(gap, 28).bitwiseOR(pair.bitwiseAND(F.lit(0xFFFFFFF)).cast("int"))

    def within(h: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.size(h) - k), lambda i: closed(h, i))
        return let(places, lambda at: let(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])), lambda anchors: F.transform(at, lambda place, j: link(at, anchors, place, j))))

    blank = F.array_repeat(F.lit(0).cast("long"), k - 1)
    return let(hashes, lambda own: F.when(F.size(own) > 0, let(F.concat(blank, own, blank), within)).otherwise(F.array().cast("array<int>")))


def as_text(links: Column) -> Column:
    """Eight hex digits for each link: its distance, and its pair of anchors."""
    return F.array_join(F.transform(links, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the links that both have among all of either."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def cuts_up_to(cuts: Column, value: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= value))


def in_blocks(docs: DataFrame, block_rows: int):
    """A function that adds i (the id, a null one lowest), h (the text's hash) and block, in order of i and h.

    Quantiles cut the ids into at most RANGES ranges, and a range into at most CUTS blocks by
    quantiles of its own; an id that fills a range is cut by h, into as many blocks as its
    rows need. The ranges come to the driver, and their cuts go to every task.
    """
    keyed = lambda rows: rows.withColumns({"i": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "h": F.xxhash64("text")})
    ids = keyed(docs.select("doc_id", "text")).select("i", "h")
    n = max(1, min(RANGES, round(max(partitions(docs.sparkSession), ids.count() // block_rows) ** 0.5)))
    quantiles = ids.agg(F.percentile_approx("i", [k / n for k in range(1, n)] or [0.5], 10 * n).alias("q")).first()["q"] or []
    # a quantile met twice is an id with many rows, and gets a range of its own
    tops = sorted({*quantiles, *(a + 1 for a, b in zip(quantiles, quantiles[1:], strict=False) if a == b)})
    width = max(1, round(len(tops) ** 0.5))
    groups = [tops[k : k + width] for k in range(0, len(tops), width)]
    longs = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    whole = cuts_up_to(longs([g[-1] for g in groups]), F.col("i"))
    rest = F.coalesce(F.get(F.array(*[longs(g) for g in groups]), whole), longs([])) if groups else longs([])
    number = F.least(whole * width, F.lit(len(tops))) + cuts_up_to(rest, F.col("i"))
    per = ids.withColumn("range", number).groupBy("range").agg(F.count(F.lit(1)).alias("n"), (F.min("i") == F.max("i")).alias("one"), F.percentile_approx("i", [k / CUTS for k in range(1, CUTS)], 10 * CUTS).alias("cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(block_rows * CUTS) / F.col("n"))).cast("int")
    layout = per.select("range", "one", F.ceil(F.col("n") / block_rows).alias("parts"), F.array_distinct(F.filter("cuts", lambda c, k: (k + 1) % step == 0)).alias("cuts"))
    layout = materialize(layout, "ranges")
    share = (F.shiftright("h", 32) + F.lit(2**31)) / F.lit(2.0**32)
    sub = F.when(F.col("one"), F.floor(share * F.col("parts")).cast("long")).otherwise(cuts_up_to(F.col("cuts"), F.col("i")).cast("long"))

    def add(rows: DataFrame) -> DataFrame:
        there = keyed(rows).withColumn("range", number).join(F.broadcast(layout), "range")
        return there.withColumn("block", F.col("range").cast("long") * F.lit(2**40) + sub).drop("range", "one", "parts", "cuts")

    return add


def with_next(docs: DataFrame, columns: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds next, a struct of ``columns`` of the next document in descending doc_id order, cyclically.

    Rows stand in blocks of neighbouring ids; the first row of each block is also dealt to the
    block before it, so a window over one block sees all successors it needs. What goes over
    all blocks is one row of each.
    """
    order, add = F.struct("i", "h"), in_blocks(docs, block_rows)
    blocks = add(docs.select("doc_id", "text")).groupBy("block").agg(F.max(order).alias("head"))
    above = Window.orderBy("block")
    blocks = blocks.withColumn("ghost", F.coalesce(F.lead("block").over(above), F.min("block").over(Window.partitionBy(F.lit(0)))))
    docs = join_checked(add(docs), materialize(blocks, "heads"), "block")
    own = F.struct(F.col("block").alias("b"), F.lit(False).alias("g"))
    ghost = F.when(order == F.col("head"), F.struct(F.col("ghost").alias("b"), F.lit(True).alias("g")))
    dealt = docs.withColumn("to", F.explode(F.array_compact(F.array(own, ghost))))
    window = Window.partitionBy("to.b").orderBy("to.g", F.col("i").desc(), F.col("h").desc())
    dealt = dealt.withColumn("next", F.lead(F.struct(*columns)).over(window))
    return dealt.filter(~F.col("to.g")).drop("to", "i", "h", "block", "head", "ghost")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likenesses.

    The edited text has its last third replaced by as many first code points of the next
    document's text, or all of them. Equal texts have equal fingerprints.
    """
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = with_next(docs.withColumn("links", links_of(word_hashes(F.col("text")))), ["text", "links"])
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - third), F.substring(F.col("next.text"), F.lit(1), third))
    docs = docs.withColumn("edited", edited).withColumn("edited_links", links_of(word_hashes(F.col("edited"))))
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("links")).alias("fingerprint"),
        as_text(F.col("edited_links")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("links"), F.col("next.links")).alias("near_next"),
    )
