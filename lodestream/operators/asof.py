"""Attributes as they were known at the time of an event.

A state of an entity holds from its effective time on, but can't be used before it was
loaded. Ordered by availability (the later of both times), the state in force is a running
maximum of (effective time, smallest id), so the two-time question becomes an as-of lookup
in one time, which an embedded DuckDB answers for each bucket of entities.

No step gathers an entity: time is cut into slices, an entity's slices go to different
buckets, and each slice is given the state carried into it. Slices of one entity that still
hold too many events are salted, their few states being copied to every salt.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.functions.scalars import micros
from lodestream.session import cut_lineage, partitions

#: Hot slices are at most rows / max_group; from this many on, the join with them is shuffled.
BROADCAST_ROWS = 100_000


def current_state_versions(
    states: DataFrame, *, key: Column, effective: Column, available: Column, tie: Column, payload: dict[str, Column], slice_seconds: int = 86_400
) -> DataFrame:
    """Rows (key, slice, at, state, previous): from microsecond `at` on, `state` is in force.

    state and previous are structs (effective, tie, payload...), tie negated so that the
    smallest is preferred; previous is null for an entity's first version. At most one row
    per key and `at`: ties are resolved here, before any join. Rows without key, effective
    or available time are never in force and don't appear. An empty table gives no rows.
    """
    width = slice_seconds * 1_000_000
    entry = F.struct(micros(effective).alias("effective"), (-tie).alias("tie"), *[c.alias(n) for n, c in payload.items()])
    at = F.greatest(micros(effective), micros(available))
    best = (
        states.filter(key.isNotNull() & effective.isNotNull() & available.isNotNull() & tie.isNotNull())
        .select(key.alias("key"), at.alias("at"), entry.alias("entry"))
        .groupBy("key", "at")
        .agg(F.max("entry").alias("entry"))
        .withColumn("slice", F.floor(F.col("at") / width))
    )
    best = cut_lineage(best, "states")
    within = Window.partitionBy("key", "slice").orderBy("at")
    running = best.withColumn("running", F.max("entry").over(within))
    ends = running.groupBy("key", "slice").agg(F.max("entry").alias("top"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slice", F.max("top").over(before).alias("carried"))
    state = F.when(F.col("carried").isNull() | (F.col("running") > F.col("carried")), F.col("running")).otherwise(F.col("carried"))
    versions = running.join(carried, ["key", "slice"]).withColumn("state", state)
    versions = versions.withColumn("previous", F.coalesce(F.lag("state").over(within), F.col("carried")))
    return versions.filter(~F.col("state").eqNullSafe(F.col("previous"))).select("key", "slice", "at", "state", "previous")


def as_of(events: DataFrame, versions: DataFrame, *, slice_seconds: int = 86_400, max_group: int = 200_000, memory_mb: int = 256) -> DataFrame:
    """Left as-of join of events (key, at, event...) with versions (key, slice, at, state).

    Every event row comes out once with `state`, null where nothing was in force. key is
    compared as text, `at` is in microseconds; events with a null key or time get null.
    The other columns of events pass through; they may not be called state or slice.
    """
    spark = events.sparkSession
    width = slice_seconds * 1_000_000
    state_type = versions.schema["state"].dataType
    passed = [c for c in events.columns if c not in ("key", "at")]
    sliced = events.withColumn("slice", F.floor(F.col("at") / width))
    counts = cut_lineage(sliced.groupBy("key", "slice").agg(F.count(F.lit(1)).alias("n")), "slices")
    hot = counts.filter(F.col("n") > max_group).select("key", "slice", F.ceil(F.col("n") / max_group).cast("int").alias("salts"))
    n_events, n_hot = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > max_group)).first()
    buckets = max(partitions(spark), -(-n_events // max_group))

    # The state carried into each slice that has events.
    # (A join, not a union and a grouping: united children that are partitioned alike are taken
    # to be aligned, which they aren't once their partitions were coalesced one by one.)
    ends = versions.groupBy("key", "slice").agg(F.max_by("state", "at").alias("last"))
    steps = ends.join(counts.select("key", "slice", F.lit(True).alias("asked")), ["key", "slice"], "full")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("carried", F.last("last", ignorenulls=True).over(before)).filter("asked")
    carried = steps.filter("carried is not null").select("key", "slice", (F.col("slice") * width).cast("bigint").alias("at"), F.col("carried").alias("state"), F.lit(0).alias("own"))
    known = versions.join(counts.select("key", "slice"), ["key", "slice"], "left_semi").select("key", "slice", "at", "state", F.lit(1).alias("own"))
    right = known.unionByName(carried)

    if n_hot:
        hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
        salts = F.coalesce(F.col("salts"), F.lit(1))
        sliced = sliced.join(hot, ["key", "slice"], "left").withColumn("salt", F.pmod(F.xxhash64("at", *passed), salts).cast("int")).drop("salts")
        right = right.join(hot, ["key", "slice"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    else:
        sliced, right = sliced.withColumn("salt", F.lit(0)), right.withColumn("salt", F.lit(0))
    bucket = F.pmod(F.xxhash64("key", "slice", "salt"), F.lit(buckets)).alias("bucket")
    left = sliced.select(bucket, "key", "at", *passed)
    right = right.select(bucket, "key", "at", "own", "state")

    def lookup(events: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        # what doesn't fit the memory goes where the engine itself spills, and is gone with the task
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        with tempfile.TemporaryDirectory(prefix="asof-", dir=local) as spill, duckdb.connect(config={"threads": 1, "memory_limit": f"{memory_mb}MB", "temp_directory": spill}) as con:
            con.register("arrived", events)
            con.register("known", versions)
            names = ", ".join(f'e."{c}"' for c in passed)
            # a version at a slice's very start is newer than what was carried into the slice
            return con.sql(f"""
                with v as (select "key", "at", arg_max("state", "own") as "state" from known group by "key", "at")
                select e."key", e."at"{", " * bool(names)}{names}, v."state"
                from arrived as e asof left join v on e."key" = v."key" and e."at" >= v."at"
            """).to_arrow_table()

    out = left.drop("bucket").withColumn("state", F.lit(None).cast(state_type)).schema
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(lookup, out)


def attributes_as_of(
    events: DataFrame,
    states: DataFrame,
    *,
    event_key: Column,
    event_time: Column,
    event_columns: Sequence[str],
    state_key: Column,
    effective: Column,
    available: Column,
    tie: Column,
    payload: dict[str, Column],
    slice_seconds: int = 86_400,
    max_group: int = 200_000,
) -> DataFrame:
    """Each event with the attributes that held and were already loaded at its time.

    Of the states with effective and available time not after the event the one with the
    latest effective time counts; if equal, the one with the smallest tie (a number).
    Returns event_columns and the payload columns (null: no state in force), one row per
    event row, repeated events included. Events without key or time get nulls. Other columns
    of either table, whatever their names, are ignored; payload names may repeat event
    columns only at the caller's peril, so such a clash is an error.
    """
    if clash := set(event_columns) & set(payload):
        raise ValueError(f"payload names repeat event columns: {sorted(clash)}")
    versions = current_state_versions(states, key=state_key, effective=effective, available=available, tie=tie, payload=payload, slice_seconds=slice_seconds)
    numbered = [F.col(f"`{c}`").alias(f"e{i}") for i, c in enumerate(event_columns)]
    found = as_of(events.select(event_key.alias("key"), micros(event_time).alias("at"), *numbered), versions, slice_seconds=slice_seconds, max_group=max_group)
    return found.select(*[F.col(f"e{i}").alias(c) for i, c in enumerate(event_columns)], *[F.col(f"state.`{n}`").alias(n) for n in payload])
