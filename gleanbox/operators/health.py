"""Backlog, lag and error figures of a relay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanbox.functions.times import millis_between


def named_checkpoints(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.filter("message_id is not null").select("message_id").distinct()


def pending_count(messages: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Largest id less the id of the message that the latest checkpoint names; 0 for what is missing."""
    latest = checkpoints.agg(F.max_by("message_id", F.struct("updated_at", "process_id")).alias("message_id"))
    at = messages.join(F.broadcast(latest), "message_id", "left_semi").agg(F.max("id").alias("done"))  # one row
    top = messages.agg(F.max("id").alias("top"))
    return top.crossJoin(at).select((F.coalesce("top", F.lit(0)) - F.coalesce("done", F.lit(0))).cast("bigint").alias("pending"))


def processed_lag(messages: DataFrame, checkpoints: DataFrame, as_of: Column) -> DataFrame:
    """Milliseconds since the first and the last checkpointed message, by id; null when none."""
    found = messages.join(named_checkpoints(checkpoints), "message_id", "left_semi")
    ends = found.agg(F.min_by("created_at", "id").alias("first"), F.max_by("created_at", "id").alias("last"))
    return ends.select(millis_between(as_of, F.col("first")).alias("min_lag_ms"), millis_between(as_of, F.col("last")).alias("max_lag_ms"))


def delivery_lag(delivered: DataFrame, lanes: int) -> DataFrame:
    """Largest and mean latest lag over lanes, from rows (bucket, id, lag_ms).

    The mean divides by all lanes, also those that delivered nothing; both are null if no lag
    is above 0.
    """
    latest = delivered.groupBy("bucket").agg(F.max_by("lag_ms", "id").alias("lag_ms"))
    found = latest.agg(F.max("lag_ms").alias("top"), F.sum("lag_ms").alias("total"))
    real = F.col("top") > 0
    return found.select(F.when(real, F.col("top")).alias("max_lag_ms"), F.when(real, F.floor(F.col("total") / lanes)).cast("bigint").alias("avg_lag_ms"))


def processed_count(outcome: DataFrame) -> DataFrame:
    """New messages relayed or sidelined, by lane (bucket). Ignored failures don't count."""
    return outcome.filter("outcome <> 'IGNORED'").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_processed"))


def delivery_errors(responses: DataFrame) -> DataFrame:
    """Counts of 4xx, 5xx and timeouts (499), and response-time percentiles, exact."""
    klass = F.floor(F.col("status_code") / 100)
    count = lambda c: F.count(F.when(c, 1)).cast("bigint")
    times = [F.percentile("latency_ms", p).alias(f"p{round(p * 100)}_ms") for p in (0.5, 0.95, 0.99)]
    return responses.agg(count(klass == 4).alias("n_4xx"), count(klass == 5).alias("n_5xx"), count(F.col("status_code") == 499).alias("n_timeout"), F.count(F.lit(1)).alias("n_sent"), *times)


def lag_histogram(rows: DataFrame, value: str, width: int) -> DataFrame:
    """Counts in buckets of a width."""
    return rows.filter(F.col(value).isNotNull()).groupBy((F.floor(F.col(value) / width) * width).cast("bigint").alias("bucket_start")).agg(F.count(F.lit(1)).alias("n"))


def value_sketches(rows: DataFrame, value: str, *by: Column | str, k: int = 400) -> DataFrame:
    """A quantile sketch of whole numbers for each of ``by`` (a relay, a period): a few kB that merge.

    A rank that a sketch tells is off by less than one in a hundred with k = 400 and a
    confidence of 99 %, whatever the number of values; nulls are left out.
    """
    return rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketches: DataFrame, *by: Column | str, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of merged sketches for each of ``by``: periods to days, relays to all."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("_sketch"), F.sum("n").alias("n"))
    told = [F.kll_sketch_get_quantile_bigint("_sketch", F.lit(r)).alias(f"p{round(r * 100)}") for r in ranks]
    return merged.select(*[c for c in merged.columns if c != "_sketch"], *told)


def relay_snapshots(active: DataFrame, messages: DataFrame, sidelined: DataFrame, groups: DataFrame, checkpoints: DataFrame, as_of: Column) -> DataFrame:
    """One row of backlog figures for each active relay; all tables have a relayer_id, and each is read once or, for messages, twice.

    A relay without rows has zeros, and nulls where there is nothing to tell. Checkpoints are
    a row a lane.
    """
    per = lambda table, *figures: table.groupBy("relayer_id").agg(*figures)
    count = F.count(F.lit(1))
    top = per(messages, F.max("id").alias("max_id"), count.alias("n_messages"))
    parked = per(sidelined, F.count(F.when(F.col("status") == "SIDELINED", 1)).alias("n_sidelined"))
    held = per(groups, count.alias("n_sidelined_groups"))
    lanes = per(checkpoints, count.alias("n_checkpoints"), F.count("message_id").alias("n_started"), F.max_by("message_id", F.struct("updated_at", "process_id")).alias("latest"))
    named = checkpoints.filter("message_id is not null").select("relayer_id", "message_id").distinct()
    found = messages.select("relayer_id", "message_id", "id", "created_at").join(named, ["relayer_id", "message_id"], "left_semi")
    found = found.join(lanes.select("relayer_id", F.col("latest").alias("message_id"), F.lit(True).alias("is_latest")), ["relayer_id", "message_id"], "left")
    done = per(found, F.max(F.when(F.col("is_latest"), F.col("id"))).alias("done"), F.min_by("created_at", "id").alias("first"), F.max_by("created_at", "id").alias("last"))
    rows = active.select("relayer_id").distinct()
    for figures in (top, parked, held, lanes.drop("latest"), done):
        rows = rows.join(figures, "relayer_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        "relayer_id",
        "max_id",
        *[zero(c) for c in ("n_messages", "n_sidelined", "n_sidelined_groups", "n_checkpoints", "n_started")],
        (F.coalesce("max_id", F.lit(0)) - F.coalesce("done", F.lit(0))).cast("bigint").alias("pending"),
        millis_between(as_of, F.col("first")).alias("min_lag_ms"),
        millis_between(as_of, F.col("last")).alias("max_lag_ms"),
    )


def health_snapshot(messages: DataFrame, sidelined: DataFrame, groups: DataFrame, checkpoints: DataFrame, outcome: DataFrame, delivered: DataFrame, lanes: int, as_of: Column, partition_size: int) -> DataFrame:
    """One row: ids, backlog, sidelines, checkpoints, lags, messages processed, headroom of the last partition.

    ``outcome`` is that of relay_outcome, ``delivered`` has bucket, id and lag_ms. Messages are read
    once: the checkpointed ones, which give backlog and lag, are flagged in the same pass.
    """
    named = named_checkpoints(checkpoints).withColumn("named", F.lit(True))
    latest = checkpoints.agg(F.max_by("message_id", F.struct("updated_at", "process_id")).alias("latest"))
    seen = messages.select("id", "message_id", "created_at").join(F.broadcast(named), "message_id", "left").crossJoin(F.broadcast(latest))  # one row a lane; one row
    ends = seen.agg(
        F.max("id").alias("max_id"),
        F.max(F.when(F.col("message_id") == F.col("latest"), F.col("id"))).alias("done"),
        F.min(F.when(F.col("named"), F.struct("id", "created_at"))).alias("first"),
        F.max(F.when(F.col("named"), F.struct("id", "created_at"))).alias("last"),
    )
    top = ends.select(
        "max_id",
        F.coalesce("max_id", F.lit(-1)).cast("bigint").alias("last_id"),
        (F.coalesce("max_id", F.lit(0)) - F.coalesce("done", F.lit(0))).cast("bigint").alias("pending"),
        millis_between(as_of, F.col("first.created_at")).alias("min_lag_ms"),
        millis_between(as_of, F.col("last.created_at")).alias("max_lag_ms"),
    )
    side = sidelined.agg(F.count(F.when(F.col("status") == "SIDELINED", 1)).alias("n_sidelined"))
    grouped = groups.agg(F.count(F.lit(1)).alias("n_sidelined_groups"))
    own = checkpoints.agg(F.count(F.lit(1)).alias("n_checkpoints"), F.count("message_id").alias("n_started"))
    processed = outcome.filter("outcome <> 'IGNORED'").agg(F.count(F.lit(1)).alias("n_processed"))
    lag = delivery_lag(delivered, lanes).withColumnsRenamed({"max_lag_ms": "max_delivery_lag_ms", "avg_lag_ms": "avg_delivery_lag_ms"})
    out = top
    for one_row in (side, grouped, own, processed, lag):
        out = out.crossJoin(F.broadcast(one_row))
    end = (F.floor(F.col("max_id") / partition_size) + 1) * partition_size
    return out.withColumn("max_partition_id", end.cast("bigint")).withColumn("headroom", (end - F.col("max_id")).cast("bigint"))
