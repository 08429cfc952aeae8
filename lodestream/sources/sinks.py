"""Writing tables: immutable parts, CSV, property-graph files, manifests, upserts."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import safe_cell
from lodestream.operators.aggs import digest
from lodestream.session import cut_lineage


class Different(ValueError):
    """What is already written differs from what should be written."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_immutable(df: DataFrame, path: str, *, format: str = "json", rows_per_file: int = 0) -> dict:
    """Writes parts once; writing the same rows again is accepted, others raise Different. Returns rows and digest."""
    spark = df.sparkSession
    now = digest(df, df.columns).first().asDict()
    if _exists(spark, path):
        there = spark.read.schema(df.schema).format(format).load(path)
        if digest(there, df.columns).first().asDict() != now:
            raise Different(path)
        return now
    writer = df.write.mode("errorifexists").format(format)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).save(path)
    return now


def write_csv(df: DataFrame, path: str, *, safe: bool = False) -> None:
    """CSV with a header; the folder appears only when it is complete. safe: no cell can be taken for a formula."""
    if safe:
        df = df.select(*[safe_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns])
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as a property graph's bulk loader reads them: typed headers, distinct sorted aliases joined by ;."""
    joined = F.array_join(F.array_sort(F.array_distinct(F.coalesce("aliases", F.array().cast("array<string>")))), ";")
    return nodes.select(F.col("id").alias("~id"), F.col("type").alias("~label"), F.col("label").alias("label:String"), F.col("status").alias("status:String"), joined.alias("aliases:String[]"))


def graph_edges(edges: DataFrame, properties: list[str]) -> DataFrame:
    """Edges as a property graph's bulk loader reads them, their further columns as one JSON text."""
    props = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return edges.select(F.col("id").alias("~id"), F.col("source_id").alias("~from"), F.col("target_id").alias("~to"), F.col("type").alias("~label"), props.alias("properties:String"))


def manifest(parts: dict[str, dict], **about: object) -> dict:
    """What was written, and a hash over all of it; the same parts give the same hash."""
    body = {"parts": parts, **about}
    return body | {"manifest_hash": hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()}


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table after changed and new rows, one per key, have replaced those with the same key."""
    return current.join(changes.select(key), key, "left_anti").select(*changes.columns).unionByName(changes)


def update_column(current: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """The table with one column set where changes has a value for the key, whatever else it holds."""
    new = changes.select(F.col(key).alias("__key"), F.col(column).alias("__new")).filter("__new is not null")
    joined = current.join(new, F.col(key) == F.col("__key"), "left")
    return joined.select(*[F.coalesce("__new", c).alias(c) if c == column else F.col(c) for c in current.columns])


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that df has rows for, and leaves the others; df may read from path."""
    cut_lineage(df, "overwrite").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def send(df: DataFrame, deliver: Callable[[list[dict]], None], *, batch: int = 500, attempts: int = 5, longest_wait: float = 30.0) -> None:
    """Hands rows to an external system in batches, from each partition; a failed batch is tried again after a growing wait."""

    def partition(rows: Iterable) -> None:
        def flush(waiting: list[dict]) -> None:
            for n in range(attempts):
                try:
                    return deliver(waiting)
                except Exception:
                    if n == attempts - 1:
                        raise
                    time.sleep(min(longest_wait, 2.0**n * 0.1))

        waiting: list[dict] = []
        for r in rows:
            waiting.append(r.asDict(recursive=True))
            if len(waiting) >= batch:
                flush(waiting)
                waiting = []
        if waiting:
            flush(waiting)

    df.foreachPartition(partition)
