"""Drop lines of recurring templates with a fixed-depth template tree. DataFrame functions only.

Tokens with a digit become ``<*>``. A line's leaf is given by its token count and its first
``LEAD`` tokens. In a leaf, a token that stands at one place in enough texts is a constant;
other tokens become ``<*>``, up to one in five. Of a template's tokens at most half may be
``<*>``: rows of numbers are no template. A template that enough different texts have is
recurring; its lines are dropped. Enough is ``min_docs`` texts, and ``long_docs`` for lines
of ``long_tokens`` tokens or more, which don't recur by chance. Lines of fewer than
``min_tokens`` tokens ("Thank you.") are too short to be templates: they would be single
words of running text, and stay.

Exact copies of a text count once. A text is left whole, for near-duplicate detection to
decide, only if a copy of it is confirmed: a different text that shares recurring lines of
at least ``COPIED`` of the characters of the longer of the two. Copies are looked for in the
buckets of ``SEEDS`` minimum hashes of a text's recurring templates, where each text is
compared with the bucket's centre; no pairs are made within a bucket. Any other text loses
its recurring lines, all of them if it has no others.

Each line is masked once. The wording of a candidate line is read again from one of its
texts, and lines are dropped by their places.

Defined cases: a null text stays null, an empty one empty, with no lines; repeated rows get
the same result; other columns are passed through whatever their names, and columns of the
operator's names (n_lines, n_dropped) are replaced; n_chars, if there, is set anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbox.llm.common import join_checked, materialize, packed

MIN_DOCS = 10
LONG_DOCS = 3
LONG_TOKENS = 40
MIN_TOKENS = 3
LEAD = 3
COPIED = 0.8
SEEDS = 4
WILD = "<*>"


def masked(line: Column) -> Column:
    """A line with one space between tokens and ``<*>`` for tokens that hold a digit."""
    plain = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, r"[^ ]*[0-9][^ ]*", WILD)).otherwise(plain)


def text_key(text: Column) -> Column:
    """What stands for a text: equal texts have equal lines and equal results."""
    return F.concat_ws("-", F.xxhash64(text), F.hash(text), F.length(text))


def slim_lines(docs: DataFrame) -> DataFrame:
    """Every line of every text without its wording: key, at, lh (of the masked line), leaf, n_tokens, chars."""
    lines = docs.filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    lines = lines.select("key", "at", F.length("raw").alias("chars"), masked(F.col("raw")).alias("line"))
    lines = lines.withColumn("tokens", F.split("line", " "))
    return lines.select("key", "at", "chars", F.xxhash64("line").alias("lh"), F.size("tokens").alias("n_tokens"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEAD)).alias("leaf"))


def enough(min_docs: int, long_docs: int, long_tokens: int) -> Column:
    """In how many texts a line of n_tokens must stand."""
    return F.when(F.col("n_tokens") >= long_tokens, F.lit(min(min_docs, long_docs))).otherwise(F.lit(min_docs))


def with_wording(docs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds ``line``, the masked wording, to (lh, key, at): each read from the text of its key."""
    wanted = materialize(candidates.groupBy("key").agg(F.collect_list(F.struct("at", "lh")).alias("wanted")), "wanted")
    texts = docs.filter(F.col("text").isNotNull()).select(text_key(F.col("text")).alias("key"), "text")
    held = join_checked(texts, wanted, "key", each=F.size("wanted"))
    # lines as a lambda's variable: a text is split once
    picked = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform("wanted", lambda w: F.struct(w["lh"].alias("lh"), F.get(lines, w["at"]).alias("raw"))))
    held = held.select(F.explode(F.get(picked, F.lit(0))).alias("x")).select("x.lh", "x.raw")
    wording = held.groupBy("lh").agg(F.min("raw").alias("raw")).select("lh", masked(F.col("raw")).alias("line"))
    return candidates.join(wording, "lh")


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, long_docs: int = LONG_DOCS, long_tokens: int = LONG_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(slim rows of all lines, the recurring ones: lh, th of the template, template, n_texts)."""
    slim = materialize(slim_lines(docs), "lines")
    need = enough(min_docs, long_docs, long_tokens)
    texts = slim.filter(F.col("n_tokens") >= min_tokens)
    # a leaf with too few lines, copies counted, has too few texts: most lines go here, before any shuffle of them
    leaves = texts.groupBy("leaf", "n_tokens").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= need).select("leaf")
    held = join_checked(texts, materialize(leaves, "leaves"), "leaf", "left_semi")
    per_text = materialize(held.groupBy("leaf", "n_tokens", "lh", "key").agg(F.min("at").alias("at")), "leaf-lines")
    counted = per_text.groupBy("leaf", "n_tokens", "lh").agg(F.count(F.lit(1)).alias("n_texts"), F.min(F.struct("key", "at")).alias("place"))
    distinct = materialize(counted.select("leaf", "n_tokens", "lh", "n_texts", "place.*"), "distinct-lines")
    # a leaf's texts may be fewer than the sum over its lines, never more
    heavy = distinct.groupBy("leaf", "n_tokens").agg(F.sum("n_texts").alias("n")).filter(F.col("n") >= need).select("leaf")
    distinct = with_wording(docs, distinct.join(heavy, "leaf", "left_semi"))
    tokens = materialize(distinct.select("leaf", "n_tokens", "lh", "n_texts", F.posexplode(F.split("line", " ")).alias("at", "token")), "tokens")
    often = tokens.groupBy("leaf", "n_tokens", "at", "token").agg(F.sum("n_texts").alias("n")).filter(F.col("n") >= need).select("leaf", "at", "token", F.lit(True).alias("constant"))
    marked = tokens.join(often, ["leaf", "at", "token"], "left")
    word = F.when(F.col("constant") | (F.col("at") < LEAD), F.col("token")).otherwise(F.lit(WILD))
    rebuilt = marked.groupBy("n_tokens", "lh").agg(F.array_sort(F.collect_list(F.struct("at", word.alias("word")))).alias("words"), F.sum((word == WILD).cast("int")).alias("n_fields"), F.sum(((word == WILD) & (F.col("token") != WILD)).cast("int")).alias("n_loose"))
    template = F.array_join(F.transform("words", lambda x: x["word"]), " ")
    fits = rebuilt.filter((F.col("n_loose") * 5 <= F.col("n_tokens")) & (F.col("n_fields") * 2 <= F.col("n_tokens"))).select("lh", "n_tokens", template.alias("template"))
    fits = materialize(fits.withColumn("th", F.xxhash64("template")), "templates")
    placed = join_checked(per_text.select("key", "lh"), fits.select("lh", "th", "n_tokens"), "lh")
    heavy = placed.select("th", "n_tokens", "key").distinct().groupBy("th", "n_tokens").agg(F.count(F.lit(1)).alias("n_texts")).filter(F.col("n_texts") >= need)
    return slim, materialize(fits.join(heavy.drop("n_tokens"), "th").select("lh", "th", "template", "n_texts"), "recurring")


def confirmed_copies(hits: DataFrame, sizes: DataFrame, copied: float = COPIED) -> DataFrame:
    """Keys of texts that share recurring lines of ``copied`` of the longer one with another text.

    ``hits`` has key, th and chars (of the template's lines in the text), ``sizes`` key and
    all (a text's characters). Only texts that recurring lines make up so far can be copies.
    """
    gone = hits.groupBy("key").agg(F.sum("chars").alias("gone")).join(sizes, "key")
    flagged = materialize(hits.join(gone.filter(F.col("gone") >= F.lit(copied) * F.col("all")).select("key", "all"), "key"), "flagged")
    least = [F.min(F.xxhash64(F.lit(k), "th")).alias(f"m{k}") for k in range(SEEDS)]
    buckets = flagged.groupBy("key").agg(*least).select("key", F.posexplode(F.array(*[f"m{k}" for k in range(SEEDS)])).alias("seed", "bucket"))
    centres = buckets.groupBy("seed", "bucket").agg(F.min("key").alias("centre"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    pairs = buckets.join(centres, ["seed", "bucket"]).filter(F.col("key") != F.col("centre")).select("key", "centre").distinct()
    theirs = flagged.select(F.col("key").alias("centre"), "th", F.col("chars").alias("c_chars"), F.col("all").alias("c_all"))
    theirs = theirs.join(pairs.select("centre").distinct(), "centre", "left_semi")
    shared = flagged.join(pairs, "key").join(theirs, ["centre", "th"]).groupBy("key", "centre").agg(F.sum(F.least("chars", "c_chars")).alias("shared"), F.greatest(F.max("all"), F.max("c_all")).alias("longer"))
    sure = shared.filter(F.col("shared") >= F.lit(copied) * F.col("longer"))
    return sure.select(F.explode(F.array("key", "centre")).alias("key")).distinct()


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, copied: float = COPIED) -> DataFrame:
    """Documents without the lines of recurring templates; adds n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    columns = docs.columns
    slim, found = recurring_lines(docs.select("text"), min_docs, min_tokens)
    # a text's copies have the same key and places
    hit = materialize(join_checked(slim, found.select("lh", "th"), "lh").groupBy("key", "at", "th").agg(F.max("chars").alias("chars")), "hits")
    whole = join_checked(slim, materialize(hit.select("key").distinct(), "hit-texts"), "key", "left_semi")
    sizes = whole.groupBy("key", "at").agg(F.max("chars").alias("chars")).groupBy("key").agg(F.sum("chars").alias("all"))
    copies = confirmed_copies(hit.groupBy("key", "th").agg(F.sum("chars").alias("chars")), sizes, copied)
    drops = hit.join(copies, "key", "left_anti").groupBy("key").agg(F.collect_list("at").alias("drops"))
    out = packed(docs, "text").withColumn("key", F.coalesce(text_key(F.col("text")), F.lit("")))
    out = join_checked(out, materialize(drops, "drops"), "key", "left", F.size("drops"))
    # places left, then their lines; the split text is a lambda's variable, so that it is split once
    kept = F.transform(F.array(F.split("text", "\n")), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drops")), lambda k: F.get(lines, k)))
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(F.array_join(F.get(kept, F.lit(0)), "\n"))
    n_lines = F.when(F.length("text") > 0, F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1).otherwise(F.lit(0))
    out = out.select("row", "drops", text.alias("text"), n_lines.cast("long").alias("n_lines"))
    n_chars = F.when(F.col("drops").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")) if "n_chars" in columns else None
    anew = {"text": F.col("text"), "n_chars": n_chars}
    same = [anew[c].alias(c) if c in anew else F.col("row")[c].alias(c) for c in columns]
    return out.select(*same, F.col("n_lines"), F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))
