"""Streaming forms of two batch operators: beyond the batch engine, and labelled so.

With an availableNow trigger both give what the batch form gives over the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_matches(exposures: DataFrame, events: DataFrame, *, keys: Sequence[str], start: str, at: str, window: str = "30 minutes", lateness: str = "1 hour", how: str = "inner") -> DataFrame:
    """Exposures with events of the same keys within [start, start + window], both streams with a watermark.

    how: inner, or leftOuter, where exposures without an event come out once the watermark
    has passed them. Times are timestamps with zone, as watermarks need them.
    """
    left = exposures.withWatermark(start, lateness)
    right = events.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(at).alias("__at"), *[c for c in events.columns if c not in (*keys, at)]).withWatermark("__at", lateness)
    same = [F.col(k) == F.col(f"__{k}") for k in keys]
    condition = F.col("__at").between(F.col(start), F.col(start) + F.expr(f"interval {window}"))
    for c in same:
        condition = c & condition
    return left.join(right, condition, how).drop(*[f"__{k}" for k in keys]).withColumnRenamed("__at", at)


def running_counts(events: DataFrame, *, item: str, kind: str, kinds: dict[str, str], at: str, window: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Events per item and kind so far, or per item and window of time; a redelivered event (event_id) counts once."""
    seen = events.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["event_id"])
    group = [item] if window is None else [F.window(at, window), item]
    return seen.groupBy(*group).agg(*[F.count_if(F.col(kind) == v).alias(n) for v, n in kinds.items()])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Works off what there is and stops. append writes parquet; complete and update replace the table with the last state."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
