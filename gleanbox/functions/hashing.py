"""Sequencing keys, their hashes and the lanes they fall into."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 4294967295
_SIGN = 2147483648


def signed32(h: Column) -> Column:
    """An unsigned 32-bit number as a signed one."""
    return F.when(h >= _SIGN, h - F.lit(_BITS + 1)).otherwise(h)


def java_hash(text: Column) -> Column:
    """sum of s[i] * 31^(n-1-i) over UTF-16 units, as a signed 32-bit number; null hashes to 0.

    A higher-order function is interpreted per character: apply it to distinct keys.
    """
    chars = F.filter(F.split(text, ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        point = F.ascii(c).cast("long")
        wide = point - 65536
        high = F.lit(55296) + F.shiftright(wide, 10)
        low = F.lit(56320) + wide.bitwiseAND(F.lit(1023))
        one = (a * 31 + point).bitwiseAND(F.lit(_BITS))
        two = ((a * 31 + high) * 31 + low).bitwiseAND(F.lit(_BITS))
        return F.when(point < 65536, one).otherwise(two)

    return F.coalesce(F.aggregate(chars, F.lit(0).cast("long"), step, signed32), F.lit(0)).cast("long")


def md5_hash(text: Column) -> Column:
    """The first four bytes of the MD5 digest as a little-endian signed number; null is ''."""
    digest = F.md5(F.coalesce(text, F.lit("")))
    turned = F.concat(*[F.substring(digest, k, 2) for k in (7, 5, 3, 1)])
    return signed32(F.conv(turned, 16, 10).cast("long"))


ALGORITHMS = {"java": java_hash, "md5": md5_hash}


def bucket(key: Column, lanes: int, algorithm: str = "java") -> Column:
    """abs(hash) modulo lanes; the one hash without a positive counterpart goes to lane 0."""
    h = ALGORITHMS[algorithm](key)
    return F.when(h == -_SIGN, F.lit(0)).otherwise(F.abs(h) % lanes).cast("int")


def lane_name(relay: str, bucket_: Column) -> Column:
    return F.concat(F.lit(f"Processor_{relay}_SP_"), bucket_.cast("string"))


def sequencing_key(group_id: Column, message_id: Column) -> Column:
    """The group, blank ones too; without a group the message id's own hash as text."""
    return F.coalesce(group_id, java_hash(message_id).cast("string"))


def is_ungrouped(group_id: Column) -> Column:
    """Null groups, and groups of only white space and control characters, have no order."""
    return F.coalesce(F.regexp_replace(group_id, r"^[\x00-\x20]+", ""), F.lit("")) == ""


def spread_key(group_id: Column, message_id: Column) -> Column:
    """A join key that equals the group, or for ungrouped rows a value that no group has.

    Rows without a group would all have the key null or blank and meet in one task.
    """
    return F.when(is_ungrouped(group_id), F.concat(F.lit("\x00"), message_id)).otherwise(group_id)
