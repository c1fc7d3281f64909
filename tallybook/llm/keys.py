"""Joins on keys of which some may be very frequent, with broadcasts of proven size only."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1000
BUCKETS = 1 << 23


def join_counted(
    rows: DataFrame, groups: DataFrame, key: str | list[str], copies: str, total: int
) -> DataFrame:
    """Inner join of rows with the one group of their key, where ``copies`` counts its rows.

    At most ``HOT_KEYS`` keys can hold a ``1 / HOT_KEYS`` share of the rows. Their groups are
    broadcast, so that no shuffle gathers a frequent key; the others are joined by key.
    """
    key = [key] if isinstance(key, str) else key
    hot = F.col(copies) >= max(total / HOT_KEYS, 2)
    frequent = groups.where(hot)
    rare = rows.join(F.broadcast(frequent.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(frequent), key).unionByName(rare.join(groups.where(~hot), key))


def maybe_among(rows: DataFrame, keys: DataFrame, on: Sequence[str], among: bool) -> DataFrame:
    """Rows whose key may be one of ``keys``, or those whose key surely is none of them.

    A bitmap of the keys' hashes is broadcast, ``BUCKETS`` bits in rows of 64: of one size at most,
    whatever the keys are.
    """
    place = F.pmod(F.xxhash64(*on), F.lit(BUCKETS))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("bigint")
    bitmap = (
        keys.select(word.alias("_word"), F.call_function("shiftleft", one, bit).alias("_bit"))
        .groupBy("_word")
        .agg(F.bit_or("_bit").alias("_bits"))
    )
    found = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return (
        rows.withColumn("_word", word)
        .join(F.broadcast(bitmap), "_word", "left")
        .where(found if among else ~found)
        .drop("_word", "_bits")
    )


def only(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is one of ``keys``; a null key equals a null key.

    Rows that cannot be among them are left where they are, all others are joined.
    """
    near = maybe_among(rows, keys, on, True)
    return near.join(_renamed(keys, on), _same(near, on), "left_semi")


def without(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is none of ``keys``; see ``only``."""
    near = maybe_among(rows, keys, on, True)
    kept = near.join(_renamed(keys, on), _same(near, on), "left_anti")
    return maybe_among(rows, keys, on, False).unionByName(kept)


def _renamed(keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return keys.select(*[F.col(c).alias(f"_key_{c}") for c in on]).distinct()


def _same(rows: DataFrame, on: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in on:
        same &= rows[c].eqNullSafe(F.col(f"_key_{c}"))
    return same
