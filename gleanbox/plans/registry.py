"""Registered queries: each job over the derived tables, beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from gleanbox import fixtures


@dataclass(frozen=True)
class Context:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def as_of(self) -> Column:
        return fixtures.as_of(self.spark, self.sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: In SQL the time of a run is the last event's.
AS_OF = "(select max(ts) from events)"


def query(tables: str, sql: str | None = None):
    """Register a function of (context, *tables) under its own name."""
    names = tables.split()

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Context(spark, sf_dir), *fixtures.tables(spark, sf_dir, *names))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = fixtures.with_tables(sql.replace("@as_of", AS_OF), *[n for n in names if n in fixtures.TABLES]) if any(n in fixtures.TABLES for n in names) else sql.replace("@as_of", AS_OF)
        return f

    return register


def java_hash_sql(text: str) -> str:
    points = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::bigint)"
    unsigned = f"list_reduce(list_prepend(0::bigint, {points}), lambda a, x: (a * 31 + x) & 4294967295)"
    return f"(case when {unsigned} >= 2147483648 then {unsigned} - 4294967296 else {unsigned} end)"


def bucket_sql(key_hash: str, lanes: int) -> str:
    return f"(case when {key_hash} = -2147483648 then 0 else abs({key_hash}) % {lanes} end)"
