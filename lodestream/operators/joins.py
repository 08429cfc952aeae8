"""Joins beyond a plain equi-join, each expressed so that it shuffles on keys that spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import bounded_rows, broadcast_if_small


def interval_grades(exposures: DataFrame, events: DataFrame, *, keys: Sequence[str], start: str, at: str, grade: str, window: int) -> DataFrame:
    """Exposures with the highest grade of an event of the same keys within [start, start + window]; 0 if none.

    Times are numbers (microseconds). exposures needs a column `exposure` that identifies a
    row; repeated ones come out once. Time is cut into buckets as wide as the window: an
    exposure meets two buckets, an event lies in one, so that equality on keys and bucket
    bounds what a key can multiply. Null keys or times match nothing.
    """
    bucket = F.floor(F.col(start) / window)
    asked = exposures.select("exposure", *keys, start, F.explode(F.array(bucket, bucket + 1)).alias("__bucket"))
    happened = events.select(*keys, F.col(at).alias("__at"), F.col(grade).alias("__grade"), F.floor(F.col(at) / window).alias("__bucket"))
    met = asked.join(happened, [*keys, "__bucket"]).filter(F.col("__at").between(F.col(start), F.col(start) + window))
    best = met.groupBy("exposure").agg(F.max("__grade").alias("grade"))
    return exposures.distinct().join(best, "exposure", "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def restricted(events: DataFrame, *allowed: tuple[DataFrame, str]) -> DataFrame:
    """Events whose value of each named column occurs in the table given with it."""
    for table, column in allowed:
        events = events.join(table.select(column), column, "left_semi")
    return events


def judged_groups(df: DataFrame, *, group: Sequence[str], grade: str, least: int = 2) -> DataFrame:
    """Rows of groups that have at least `least` rows and one positive grade."""
    good = df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"), F.max(grade).alias("__best")).filter((F.col("__n") >= least) & (F.col("__best") > 0))
    return df.join(good.select(*group), list(group), "left_semi")


def with_defaults(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left rows with columns of right, a default where right has no such row or a null."""
    joined = left.join(right.select(*keys, *defaults), list(keys), "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def both_directions(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Every undirected edge from either end."""
    rest = [c for c in edges.columns if c not in (source, target)]
    return edges.unionByName(edges.select(F.col(target).alias(source), F.col(source).alias(target), *rest))


def names_of_codes(df: DataFrame, codes: str, *, row: Sequence[str], table: DataFrame, code: str, names: Sequence[str], bound: int = 100_000) -> DataFrame:
    """Rows with the sorted distinct names of their codes; an empty array where none is known.

    The code table is broadcast only if it is counted to be within bound.
    """
    named = table.select(F.col(code).alias("__code"), F.explode(F.array_distinct(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")))).alias("__name"))
    found = df.select(*row, F.explode_outer(codes).alias("__code")).join(broadcast_if_small(named, bound), "__code", "left")
    return found.groupBy(*row).agg(F.sort_array(F.collect_set("__name")).alias("names"))


def score_against_queries(items: DataFrame, queries: DataFrame, score: Column, *, bound: int = 1_000) -> DataFrame:
    """Every item with every query of a stated, bounded set for which score is above 0.

    queries: (query_id, ...). They travel as one literal array, so that items are read once
    and never shuffled; score may use the columns of both.
    """
    rows = bounded_rows(queries, bound, "the set of queries")
    if not rows:
        return items.limit(0).selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in queries.dtypes]).withColumn("score", F.lit(0.0))
    literal = F.array(*[F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in queries.dtypes]) for r in rows])
    return items.withColumn("__q", F.explode(literal)).select(*items.columns, "__q.*").withColumn("score", score).filter("score > 0")


def latest_before(df: DataFrame, *, key: str, time: str, value: str, cutoff: Column, tie: str) -> DataFrame:
    """(key, value, time): each key's value at the latest time not after cutoff; of equal times the smallest tie."""
    held = df.filter(F.col(key).isNotNull() & F.col(time).isNotNull() & (F.col(time) <= cutoff))
    first = held.groupBy(key).agg(F.max(F.struct(F.col(time), (-F.col(tie)).alias("__tie"), F.col(value))).alias("__s"))
    return first.select(key, F.col(f"__s.{value}").alias(value), F.col(f"__s.{time}").alias(time))


def strictly_earlier(daily: DataFrame, *, keys: Sequence[str], day: str, sums: Sequence[str]) -> DataFrame:
    """Per key and day, what the sums came to on strictly earlier days; 0 on the first.

    daily has one row per key and day, so that a key's window is no longer than its days.
    """
    before = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, day, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])


def missing_endpoints(edges: DataFrame, nodes: DataFrame, *, ends: Sequence[str], node: str) -> DataFrame:
    """(end, id, edges): ends of edges that are no nodes, with how many edges refer to them."""
    told = edges.select(F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).cast("string").alias("id")) for e in ends])).alias("r")).select("r.*")
    counted = told.groupBy("end", "id").agg(F.count(F.lit(1)).alias("edges"))
    return counted.join(nodes.select(F.col(node).cast("string").alias("id")), "id", "left_anti").select("end", "id", "edges")


def carry_forward(current: DataFrame, previous: DataFrame, *, key: str, locked: Sequence[str], review: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Current rows with the review columns of the previous row of their key.

    Copied only if all locked columns are the same (nulls equal) and all required review
    columns are filled; null otherwise. One previous row per key is expected.
    """
    old = previous.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__old_{c}") for c in dict.fromkeys([*locked, *review, *required])])
    same = F.lit(True)
    for c in locked:
        same = same & F.col(c).eqNullSafe(F.col(f"__old_{c}"))
    for c in required:
        same = same & F.col(f"__old_{c}").isNotNull() & (F.col(f"__old_{c}").cast("string") != "")
    joined = current.join(old, F.col(key) == F.col("__key"), "left")
    same = F.col("__key").isNotNull() & same
    return joined.select(*[F.col(c) for c in current.columns if c not in review], *[F.when(same, F.col(f"__old_{c}")).alias(c) for c in review])


def replace_merge(first: DataFrame, retried: DataFrame, key: str) -> DataFrame:
    """Rows of both tables, those of retried instead of those of first with the same key."""
    return first.join(retried.select(key), key, "left_anti").unionByName(retried)


def merge_unique(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(union, collisions): collisions has the keys that occur more than once."""
    both = left.unionByName(right)
    return both, both.groupBy(key).agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
