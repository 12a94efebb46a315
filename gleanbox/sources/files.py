"""Files in whatever store Spark reads, by its own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it, if it is there."""
    fs, place = _place(spark, path)
    fs.delete(place, True)


def touch(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.create(place, True).close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, place = _place(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []
