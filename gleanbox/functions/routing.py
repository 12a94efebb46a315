"""Where a message is written: shards by exchange, by time, or both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_by_exchange(exchange: Column, patterns: list[tuple[str, str]], default: str | None) -> Column:
    """The cluster of the first pattern that matches the whole name, else the default."""
    out = F.lit(default).cast("string")
    for pattern, cluster in reversed(patterns):
        out = F.when(exchange.rlike(f"^(?:{pattern})$"), F.lit(cluster)).otherwise(out)
    return out


def shard_tables(cluster: Column) -> tuple[Column, Column]:
    """(message table, metadata table) of a cluster; without one the names have no prefix."""
    prefix = F.coalesce(F.concat(cluster, F.lit("_")), F.lit(""))
    return F.concat(prefix, F.lit("messages")), F.concat(prefix, F.lit("message_meta_data"))


def us_week(at: Column) -> Column:
    """Week of the year as in the US: weeks start on Sunday, and the one with 1 January is the first."""
    day = F.dayofweek(at)
    ends = F.date_add(at.cast("date"), 7 - day)
    first = F.dayofweek(F.trunc(at, "year"))
    return F.when(F.year(ends) > F.year(at), F.lit(1)).otherwise(F.floor((F.dayofyear(at) + first - 2) / 7) + 1).cast("int")


def shard_by_time(at: Column, unit: str) -> Column:
    """h_, d_, m_ or w_ and the time's digits. The week goes with the calendar year."""
    if unit == "w":
        return F.concat(F.lit("w_"), F.date_format(at, "yyyy"), F.lpad(us_week(at).cast("string"), 2, "0"))
    return F.concat(F.lit(f"{unit}_"), F.date_format(at, {"h": "yyyyMMddHH", "d": "yyyyMMdd", "m": "yyyyMM"}[unit]))


def mixed_shard(exchange_part: Column, time_part: Column) -> Column:
    """Both parts with an underscore, or the one that is not blank; null if both are."""
    parts = F.concat_ws("_", *[F.when(F.trim(p) != "", p) for p in (exchange_part, time_part)])
    return F.when(parts != "", parts)


def legacy_table(suffix: Column) -> Column:
    return F.when(F.coalesce(F.trim(suffix), F.lit("")) != "", F.concat(F.lit("outbound_messages_"), suffix)).otherwise(F.lit("outbound_messages"))
