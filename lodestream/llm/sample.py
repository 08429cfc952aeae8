"""A reproducible sample that stays as data grows.

The first time a record is seen, its epoch is written down, and with it the rate that was
fixed for that epoch. A record is chosen if a counter-based generator, keyed by its
identifier and counting epochs, falls below that rate: so nothing that comes later can change the choice.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import broadcast_if_small, cut_lineage, shared_folder

#: The generator's resolution: 52 bits, exact in a double.
SPAN = float(1 << 52)


def uniform(identifier: Column, seed: str, counter: Column) -> Column:
    """The number in [0, 1) that a counter-based generator keyed by seed and identifier gives at a counter: SHA-256 as block function."""
    block = F.sha2(F.concat_ws(":", F.lit(seed), counter.cast("string"), identifier), 256)
    return F.conv(F.substring(block, 1, 13), 16, 10).cast("bigint") / F.lit(SPAN)


def frozen_rates(first_seen: DataFrame, *, target_per_epoch: float, floor: float) -> DataFrame:
    """(epoch, rate) from (id, epoch): what an epoch's rate was set to as it began.

    The rate is the share that would have given target_per_epoch in the mean epoch so far,
    between floor and 1; it depends on earlier epochs only, so that an epoch's later
    arrivals leave it as it is. The first epoch is taken whole.
    """
    sizes = first_seen.groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    rate = F.lit(float(target_per_epoch)) * F.count("n").over(before) / F.sum("n").over(before)
    return sizes.select("epoch", F.when(rate.isNull(), 1.0).otherwise(F.least(F.greatest(rate, F.lit(float(floor))), F.lit(1.0))).alias("rate"))


def first_seen(df: DataFrame, *, identifier: Column, epoch: Column) -> DataFrame:
    """(id, epoch) of the first epoch in which a record appears; null ids and epochs don't count."""
    return df.filter(identifier.isNotNull() & epoch.isNotNull()).groupBy(identifier.alias("id")).agg(F.min(epoch).alias("epoch"))


def extend_registry(registry: DataFrame | None, df: DataFrame, *, identifier: Column, epoch: Column, target_per_epoch: float, floor: float) -> DataFrame:
    """The registry (id, epoch, rate) after df arrived; entries that are in it already stay as they are.

    The caller writes it down before the next batch arrives. Epochs whose rate the registry
    knows keep it; new epochs get theirs from all that was seen before.
    """
    seen = cut_lineage(first_seen(df, identifier=identifier, epoch=epoch), "first-seen")
    if registry is None:
        rates = frozen_rates(seen, target_per_epoch=target_per_epoch, floor=floor)
        return seen.join(broadcast_if_small(rates), "epoch").select("id", "epoch", "rate")
    new = seen.join(registry.select("id"), "id", "left_anti")
    known = registry.groupBy("epoch").agg(F.max("rate").alias("known"))
    rates = frozen_rates(registry.select("id", "epoch").unionByName(new), target_per_epoch=target_per_epoch, floor=floor)
    rates = rates.join(known, "epoch", "left").select("epoch", F.coalesce("known", "rate").alias("rate"))
    return registry.select("id", "epoch", "rate").unionByName(new.join(broadcast_if_small(rates), "epoch").select("id", "epoch", "rate"))


def kept_registry(name: str, df: DataFrame, *, identifier: Column, epoch: Column, target_per_epoch: float, floor: float) -> DataFrame:
    """The registry that is kept under that name in the shared folder, extended by df.

    Only new entries are written, beside those of earlier runs, so that a run that breaks off
    leaves nothing that the next one couldn't extend. Should two runs have written the same
    record, its earliest epoch counts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/registry-{hashlib.sha256(name.encode()).hexdigest()[:32]}"
    schema = df.select(identifier.alias("id"), epoch.alias("epoch"), F.lit(0.0).alias("rate")).schema

    def read() -> DataFrame | None:
        try:
            rows = spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return rows.groupBy("id").agg(F.min(F.struct("epoch", "rate")).alias("x")).select("id", "x.epoch", "x.rate")

    before = read()
    new = extend_registry(before, df, identifier=identifier, epoch=epoch, target_per_epoch=target_per_epoch, floor=floor)
    if before is not None:
        new = cut_lineage(new.join(before.select("id"), "id", "left_anti"), "new-entries")
    if before is None or not new.isEmpty():
        new.write.mode("append").parquet(path)
    return read()


def stable_sample(df: DataFrame, registry: DataFrame, *, identifier: Column, seed: str) -> DataFrame:
    """All rows of df whose record the registry has and the generator chooses, with id, epoch and rate.

    Rows with a null identifier are never chosen. df's own columns named id, epoch or rate
    give way to the sample's.
    """
    chosen = registry.filter(uniform(F.col("id"), seed, F.col("epoch")) < F.col("rate")).select(F.col("id").alias("__id"), "epoch", "rate")
    return df.withColumn("__id", identifier).drop("id", "epoch", "rate").join(chosen, "__id").withColumnRenamed("__id", "id")
