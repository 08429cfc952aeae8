"""Matching records of two tables by nearest time, for the same entity within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, *, keys: Sequence[str], tolerance: int, slot: int | None = None) -> DataFrame:
    """Each left row that has a right row of the same keys within tolerance, with the nearest one.

    left: keys, at, and columns to keep. right: keys, at, id (a number). `at` is in
    microseconds, tolerance inclusive, before or after. Of equally near right rows the one
    with the smallest id is taken. Adds id and distance, instead of left's own columns of
    those names. Rows with a null key or time match nothing; repeated left rows come out
    repeatedly; equal right rows don't matter; further columns of right are ignored.

    Both tables are united, sorted per entity and time, and every left row is given the last
    right row before it and the next one after it. An entity's time is cut into slots (of
    `slot` microseconds, at least the tolerance), so that no entity, however large, is sorted
    by one task; right rows near a slot's edge are given to both neighbours.
    """
    slot = max(slot or 12 * tolerance, tolerance, 1)
    kept = [c for c in left.columns if c not in (*keys, "at", "id", "distance")]
    # inside, every column has a name of its own
    entity = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    at = F.col("`at`").cast("bigint")
    whole = " and ".join(f"`{c}` is not null" for c in (*keys, "at"))
    carried = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    placed = left.filter(whole).select(*entity, F.floor(at / slot).alias("slot"), at.alias("t"), *carried, F.lit(None).cast("struct<at:bigint,id:bigint>").alias("right"))
    spread = F.explode(F.sequence(F.floor((at - tolerance) / slot), F.floor((at + tolerance) / slot)))
    near = right.filter(whole + " and id is not null").select(*entity, spread.alias("slot"), at.alias("t"), F.struct(at.alias("at"), F.col("id").cast("bigint").alias("id")).alias("right"))
    both = placed.unionByName(near, allowMissingColumns=True)
    group = [*[f"k{i}" for i in range(len(keys))], "slot"]
    before = Window.partitionBy(*group).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(*group).orderBy(F.col("t").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    backwards = F.when(F.col("right").isNotNull(), F.struct(F.col("right.at").alias("at"), (-F.col("right.id")).alias("id")))
    sides = both.withColumn("last", F.max(backwards).over(before)).withColumn("next", F.min("right").over(after)).filter("right is null")
    back, ahead = F.col("t") - F.col("last.at"), F.col("next.at") - F.col("t")
    choice = F.array_min(
        F.array_compact(
            F.array(
                F.when(back <= tolerance, F.struct(back.alias("distance"), (-F.col("last.id")).alias("id"))),
                F.when(ahead <= tolerance, F.struct(ahead.alias("distance"), F.col("next.id").alias("id"))),
            )
        )
    )
    found = sides.withColumn("choice", choice).filter("choice is not null")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("t").alias("at"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "choice.id", "choice.distance")
