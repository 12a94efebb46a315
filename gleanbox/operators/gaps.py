"""Gaps in the id sequence, without a window over the whole table, kept as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanbox.operators.assemble import eligible_skipped, is_eligible

BLOCK = 100_000
#: Widths of the pieces that a gap is cut into, one after the other, before it is expanded.
PIECES = (10**8, 10**4)


def _missing_between(ids: DataFrame, by: list[str], block: int, start: int | None = None) -> DataFrame:
    """``by``, gap_start and gap_end of ids missing between rows of ``ids`` (by, id) of one ``by``.

    Ids are cut into blocks of a fixed width. Gaps inside a block come from a window over
    the block alone; the small table of each block's first and last id gives those between
    blocks: one row a block, a table 1/block the size of the ids.
    """
    ids = ids.select(*by, F.col("id").cast("bigint").alias("id")).distinct().withColumn("_block", F.floor(F.col("id") / block))
    inside = ids.withColumn("_before", F.lag("id").over(Window.partitionBy(*by, "_block").orderBy("id")))
    edges = ids.groupBy(*by, "_block").agg(F.min("id").alias("id"), F.max("id").alias("_last"))
    between = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")))
    if start is not None:
        between = between.withColumn("_before", F.coalesce("_before", F.lit(start - 1)))
    found = inside.select(*by, "_before", "id").unionByName(between.select(*by, "_before", "id")).filter("id - _before > 1")
    return found.select(*by, (F.col("_before") + 1).alias("gap_start"), F.col("id").alias("gap_end"))


def sequence_gaps(ids: DataFrame, start: int | None = None, block: int = BLOCK) -> DataFrame:
    """[gap_start, gap_end) of ids missing between the rows of ``ids`` (id).

    The first id of a run opens no gap, unless an empty batch that began at ``start`` came
    before it.
    """
    return _missing_between(ids, [], block, start)


def skipped_ids(gaps: DataFrame) -> DataFrame:
    """A NEW skipped row for each missing id.

    A gap is cut into ever smaller pieces, and the smallest are dealt out before they are
    expanded, so that a long gap is neither one array nor one task.
    """
    pieces = gaps.select(F.col("gap_start").cast("bigint").alias("lo"), F.col("gap_end").cast("bigint").alias("hi")).filter("lo < hi")
    for width in PIECES:
        pieces = pieces.select(F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(width).cast("bigint"))).alias("lo"), "hi").withColumn("hi", F.least(F.col("lo") + width, "hi"))
    n = int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = pieces.repartition(n, "lo").select(F.explode(F.sequence("lo", F.col("hi") - 1)).alias("id"))
    return ids.select("id", F.col("id").alias("message_seq_id"), F.lit("NEW").alias("status"), F.lit(0).alias("retry_count"))


# ------------------------------------------------------------------ intervals
# Missing ids that are waited for, as rows (start_id, end_id, status, created_at) that don't
# overlap; end_id is the first id beyond. A gap is one row however long it is.


def intervals_of(gaps: DataFrame, as_of: Column) -> DataFrame:
    return gaps.select(F.col("gap_start").alias("start_id"), F.col("gap_end").alias("end_id"), F.lit("NEW").alias("status"), as_of.cast("timestamp").alias("created_at"))


def located(intervals: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """(id, start_id): those of ``ids`` that lie in an interval, with the interval's start.

    An id's interval is the last one that begins at or before it. It is looked up within the
    id's block, in a window over the block's points: where intervals begin, and the block's
    own beginning for one that comes from a block before. Which interval covers a block whole
    comes from a window over one row a block.
    """
    own = ids.select(F.col("id").cast("bigint").alias("id")).distinct().withColumn("_block", F.floor(F.col("id") / block))
    rows = intervals.select("start_id", "end_id", F.floor(F.col("start_id") / block).alias("_first"), F.floor((F.col("end_id") - 1) / block).alias("_last"))
    begin = rows.select(F.col("_first").alias("_block"), F.col("start_id").alias("_at"), "start_id", "end_id")
    tail = rows.filter("_last > _first").select(F.col("_last").alias("_block"), (F.col("_last") * block).alias("_at"), "start_id", "end_id")
    nothing = F.lit(None).cast("bigint")
    # of intervals longer than a block's neighbours at most one begins in a block
    asked = own.select("_block").distinct().select("_block", nothing.alias("start_id"), nothing.alias("end_id"), nothing.alias("_last"))
    long = rows.filter("_last - _first >= 2").select(F.col("_first").alias("_block"), "start_id", "end_id", "_last")
    upto = Window.orderBy("_block", F.col("start_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cover = long.unionByName(asked).withColumn("_x", F.last(F.when(F.col("start_id").isNotNull(), F.struct("start_id", "end_id", "_last")), ignorenulls=True).over(upto))
    cover = cover.filter("start_id is null and _block < _x._last").select("_block", (F.col("_block") * block).alias("_at"), "_x.start_id", "_x.end_id")
    points = begin.unionByName(tail).unionByName(cover).withColumn("id", nothing).unionByName(own.select("_block", F.col("id").alias("_at"), nothing.alias("start_id"), nothing.alias("end_id"), "id"))
    before = Window.partitionBy("_block").orderBy("_at", F.col("id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("start_id").isNotNull(), F.struct("start_id", "end_id")), ignorenulls=True).over(before)
    return points.withColumn("_x", last).filter("id is not null and id < _x.end_id").select("id", F.col("_x.start_id").alias("start_id"))


def split_intervals(intervals: DataFrame, found: DataFrame, block: int = BLOCK) -> DataFrame:
    """What is left of the intervals that ``found`` (id, start_id) touches: the ids between those found.

    New rows keep the other columns of the interval they come from.
    """
    touched = intervals.join(found.select("start_id").distinct(), "start_id", "left_semi")
    ends = touched.select("start_id", F.explode(F.array(F.col("start_id") - 1, F.col("end_id"))).alias("id"))
    left = _missing_between(found.select("start_id", "id").unionByName(ends), ["start_id"], block)
    return left.join(touched.drop("end_id"), "start_id").drop("start_id").withColumnsRenamed({"gap_start": "start_id", "gap_end": "end_id"}).select(*intervals.columns)


def interval_changes(intervals: DataFrame, arrived: DataFrame, new: DataFrame, last_time: Column | None, minutes: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(changes, expired intervals, late ids) as ids arrive, gaps open and time goes on.

    Intervals created more than ``minutes`` before the last message's time are given up. Ids
    that turn up in the others are late; they split their interval. ``changes`` are rows as in
    the table with _gone, true for a start_id that is no more.
    """
    live = intervals if last_time is None else eligible_skipped(intervals, last_time, minutes)
    expired = intervals.limit(0) if last_time is None else intervals.filter(~F.coalesce(is_eligible(last_time, minutes), F.lit(False)))
    late = located(live, arrived)
    left = split_intervals(live, late)
    touched = late.select("start_id").distinct()
    # an interval that loses ids behind its first keeps its start
    gone = expired.select("start_id").unionByName(touched.join(left.select("start_id"), "start_id", "left_anti"))
    nothing = {c: F.lit(None).cast(intervals.schema[c].dataType) for c in intervals.columns if c != "start_id"}
    changes = left.unionByName(new.select(*intervals.columns)).withColumn("_gone", F.lit(False))
    return changes.unionByName(gone.withColumns(nothing).withColumn("_gone", F.lit(True)).select(*changes.columns)), expired, late.select("id")
