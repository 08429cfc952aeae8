"""Session defaults and the few helpers every operator shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "lodestream", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def load(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent on a single machine (tests), a temporary folder is used;
    on a cluster it has to be set, since a folder of one machine would lose rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
    key = "spark.lodestream.fallback.dir"
    made = spark.conf.get(key, None)
    if not made or not os.path.isdir(made):
        made = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set(key, made)
    return f"file://{made}"


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Unlike a block-manager copy it outlives executors, and unlike recomputation it is
    the same rows for every reader, even after task retries. The table goes when the driver's
    process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


class TooLarge(ValueError):
    """A side that has to fit one process is larger than its stated bound."""


def bounded_rows(df: DataFrame, bound: int, what: str) -> list[Row]:
    """Rows of a table that must be small; never more than bound + 1 rows reach the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise TooLarge(f"{what} has more than {bound} rows")
    return rows


def broadcast_if_small(df: DataFrame, bound: int = 100_000) -> DataFrame:
    """df marked for broadcast if it is counted to have at most bound rows; else the join is left to a shuffle."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
