"""Mix sources to target weights by Sainte-Laguë apportionment. DataFrame functions only.

Targets share all words by weight; no target exceeds ``cap`` times its source's words, and
the excess is shared again. Equal-token blocks go to sources, and a source's blocks to its
shards, by highest quotients w/(2k+1). In each shard documents stand in seeded order and
form one stream of words; whole passes and then the first blocks of that stream are taken.

Defined cases: a null text has size 0; a null source is a source of its own, last in order;
an empty table gives an empty result; repeated rows are documents of their own; columns the
operator adds (size, source_size, target, taken) replace input columns of the same name, and
all others are passed through whatever their names. A source's shards, one row for each
``shard_docs`` documents, meet in one window, since Sainte-Laguë compares all their quotients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.llm.common import join_checked, materialize, packed, word_count

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK_TOKENS = 16
SHARD_DOCS = 4096
SEED = 20240


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: documents, words, weight and target. ``sizes`` has source and size.

    The windows without partitions run over one row per source. Sources stand in order of
    the ratio cap / weight; the first whose level is within its own ratio sets the level.
    """
    per = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), at + 1))
    per = per.withColumn("_cap", cap * F.col("source_size").cast("double"))
    per = per.withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cap").over(above), F.lit(0.0))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # all less those above: a frame that ends with the last row would be summed anew for each source
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(above), F.lit(0.0))
    total = F.sum("source_size").over(everything)
    per = per.withColumns({"_level": (total - before) / rest, "_place": F.row_number().over(order)})
    fits = F.when(F.col("_level") <= F.col("_ratio"), F.struct("_place", "_level"))
    level = F.min(fits).over(everything)["_level"]
    # rounding can leave the last source a hair above its own ratio
    level = F.coalesce(level, F.max("_ratio").over(everything))
    target = F.least(F.col("_cap"), level * F.col("weight"))
    return per.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def sainte_lague(rows: DataFrame, group: list[Column], key: list[str], weight: str, seats: Column) -> DataFrame:
    """Adds ``seats``: the group's seats dealt by highest quotients weight / (2k + 1).

    With n rows and s seats in a group, whose fair shares are q, every winner k lies within
    q (1 -+ n / 2s) -+ 1/2, so about 3n quotients decide the allotment, not all s of them.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(whole), F.sum(weight).over(whole)
    rows = rows.withColumns({"_s": seats.cast("long"), "_n": n, "_w": total})
    share = F.when(F.col("_w") > 0, F.col(weight) / F.col("_w") * F.col("_s")).otherwise(F.lit(0.0))
    slack = F.when(F.col("_s") > 0, F.col("_n") / (2.0 * F.col("_s"))).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_q": share, "_slack": slack})
    sure = F.greatest(F.floor(F.col("_q") * (1 - F.col("_slack")) - 0.5), F.lit(0)).cast("long")
    most = F.ceil(F.col("_q") * (1 + F.col("_slack")) + 0.5).cast("long")
    rows = rows.withColumn("_sure", F.when(F.col(weight) > 0, sure).otherwise(F.lit(0)))
    rows = rows.withColumn("_open", F.col("_s") - F.sum("_sure").over(whole))
    asks = rows.withColumn("_k", F.explode_outer(F.when((F.col(weight) > 0) & (F.col("_s") > 0), F.sequence("_sure", most))))
    quotient = F.col(weight) / (2 * F.col("_k") + 1)
    best = Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in key], "_k")
    won = asks.withColumn("_won", (F.col("_k").isNotNull() & (F.row_number().over(best) <= F.col("_open"))).cast("long"))
    kept = [c for c in rows.columns if not c.startswith("_")]
    return won.groupBy(*kept, "_sure").agg(F.sum("_won").alias("_extra")).select(*kept, (F.col("_sure") + F.col("_extra")).alias("seats"))


def sized(docs: DataFrame, *more: str, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words), h (the seeded place of a document), and further columns."""
    seeded = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.coalesce(F.col("text"), F.lit(""))))
    return docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), F.conv(F.substring(seeded, 1, 15), 16, 10).cast("long").alias("h"))


def plan_quotas(slim: DataFrame, weights=WEIGHTS, cap: int = CAP, block_tokens: int = BLOCK_TOKENS, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """(sources with their targets and shard counts, quotas in words per source and shard)."""
    sources = source_targets(slim, weights, cap).withColumn("n_shards", F.ceil(F.col("n_docs") / shard_docs).cast("long"))
    all_blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens)
    sources = sources.withColumn("blocks", all_blocks.cast("long"))
    dealt = sainte_lague(sources, [F.lit(0)], ["source"], "target", F.col("blocks"))
    sources = materialize(dealt.drop("blocks").withColumnRenamed("seats", "source_blocks"), "sources")
    shards = in_shards(slim, sources).groupBy("source", "shard", "source_blocks").agg(F.sum("size").alias("shard_size"))
    dealt = sainte_lague(shards, [F.col("source")], ["shard"], "shard_size", F.col("source_blocks"))
    quota = F.least(F.col("seats") * block_tokens, cap * F.col("shard_size"))
    return sources, materialize(dealt.select("source", "shard", "shard_size", quota.alias("quota")), "quotas")


def in_shards(docs: DataFrame, sources: DataFrame) -> DataFrame:
    own = sources.select(F.col("source").alias("own"), "source_size", "target", "n_shards", "source_blocks")
    there = join_checked(docs, own, F.col("source").eqNullSafe(F.col("own")))
    return there.withColumn("shard", F.pmod(F.col("h"), F.col("n_shards"))).drop("own", "n_shards")


def take_blocks(docs: DataFrame, sources: DataFrame, quotas: DataFrame) -> DataFrame:
    """Adds source_size, target and taken, the words of each document that the mix takes, to what sized() gives."""
    q = quotas.select(F.col("source").alias("own"), F.col("shard").alias("own_shard"), "shard_size", "quota")
    there = join_checked(in_shards(docs, sources), q, F.col("source").eqNullSafe(F.col("own")) & (F.col("shard") == F.col("own_shard")))
    before = Window.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.greatest(F.col("shard_size"), F.lit(1)))).otherwise(F.lit(0))
    there = there.withColumns({"full": passes, "cum": F.coalesce(F.sum("size").over(before), F.lit(0))})
    part = F.col("quota") - F.col("full") * F.col("shard_size")
    taken = F.col("full") * F.col("size") + F.least(F.greatest(part - F.col("cum"), F.lit(0)), F.col("size"))
    return there.withColumn("taken", taken.cast("long")).select(*docs.columns, "source_size", "target", "taken").drop("h")


def mix_sources(docs: DataFrame, **plan) -> DataFrame:
    """Documents with size, source_size, target and taken (words taken, repeats counted)."""
    docs = docs.drop("size", "source_size", "target", "taken")
    plans = plan_quotas(materialize(sized(docs), "sizes"), **plan)
    whole = packed(docs, "doc_id", "source", "text")
    return take_blocks(sized(whole, "row"), *plans).select("row.*", "size", "source_size", "target", "taken")


def mix_report(docs: DataFrame, **plan) -> DataFrame:
    """doc_id, source and the same decisions, without the texts: only ids and sizes are shuffled."""
    slim = materialize(sized(docs), "sizes")
    return take_blocks(slim, *plan_quotas(slim, **plan))
