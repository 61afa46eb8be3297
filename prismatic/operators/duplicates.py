"""Exact and near duplicates of pictures by content hash and 64-bit perceptual hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector


def exact_source(items: DataFrame, hash_col: str, id_col: str, order_col: str) -> DataFrame:
    """Each item with the latest other item of its hash, if there is one.

    The two latest rows of each hash are aggregated first, so a hash that many items share is no join of
    its items with each other.
    """
    best = F.max(F.struct(order_col, id_col))
    first = items.groupBy(hash_col).agg(best.alias("a"))
    second = items.join(first, hash_col).where(F.struct(order_col, id_col) != F.col("a")).groupBy(hash_col).agg(best.alias("b"))
    two = first.join(second, hash_col, "left")
    source = F.when(F.col(f"a.{id_col}") != F.col(id_col), F.col(f"a.{id_col}")).otherwise(F.col(f"b.{id_col}"))
    return items.join(two, hash_col, "left").select(id_col, source.alias("source_id"))


def bands(hash_value, count: int):
    """The hash cut into `count` bands with their number: two hashes of a distance below `count` share one."""
    size, rest = divmod(64, count)
    parts, at = [], 0
    for k in range(count):
        width = size + (k < rest)
        mask = (1 << width) - 1
        parts.append(F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(hash_value, at).bitwiseAND(F.lit(mask)).alias("value")))
        at += width
    return F.explode(F.array(*parts)).alias("piece")


def near_pairs(items: DataFrame, distance: int, id_col: str, hash_col: str, *within: str) -> DataFrame:
    """Pairs (a < b) of items of the same `within` whose hashes differ in at most `distance` bits.

    By the pigeonhole principle such hashes agree in one of distance + 1 bands, so the join is an equi-join
    by band. Items of equal hashes are pairs, too.
    """
    cut = items.select(*within, F.col(id_col).alias("id"), F.col(hash_col).alias("h"), bands(F.col(hash_col), distance + 1))
    left, right = cut.select(*within, "piece", F.col("id").alias("a"), F.col("h").alias("x")), cut.select(*within, "piece", F.col("id").alias("b"), F.col("h").alias("y"))
    met = left.join(right, [*within, "piece"]).where((F.col("a") < F.col("b")) & (vector.hamming(F.col("x"), F.col("y")) <= distance))
    return met.select(*within, "a", "b", vector.hamming(F.col("x"), F.col("y")).alias("distance")).distinct()
