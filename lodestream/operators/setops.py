"""Set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_sizes(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str, str, str]) -> DataFrame:
    """(part, n): how many keys are in both, only in a, only in b, in either; one aggregation over both tables."""
    tagged = a.select(F.col(key).alias("key"), F.lit(1).alias("side")).unionByName(b.select(F.col(key).alias("key"), F.lit(2).alias("side")))
    sides = tagged.groupBy("key").agg(F.bit_or("side").alias("sides"))
    sizes = sides.agg(*[F.count_if(c).alias(n) for n, c in zip(names, (F.col("sides") == 3, F.col("sides") == 1, F.col("sides") == 2, F.lit(True)), strict=True)])
    return sizes.select(F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(n).alias("n")) for n in names])).alias("x")).select("x.*")


def union_first_wins(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of first, and those rows of second whose key first doesn't have."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def colliding_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have: empty, if ids are unique across them."""
    return a.select(key).intersect(b.select(key))


def missing(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that were wanted but not found, repeated rows counted."""
    return wanted.exceptAll(found)


def disjoint_ranges(ranges: DataFrame, start: str, stop: str) -> DataFrame:
    """One row: whether half-open ranges of a bounded list are pairwise disjoint."""
    from pyspark.sql import Window

    order = Window.orderBy(start, stop)
    late = F.col(start) < F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return ranges.select(F.coalesce(late, F.lit(False)).alias("late")).agg(F.coalesce(~F.bool_or("late"), F.lit(True)).alias("disjoint"))
