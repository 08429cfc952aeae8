"""Ranking metrics, their comparison, and the reports around them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestream.session import bounded_rows

METRICS = ("ndcg", "mrr", "hit_1", "hit_k", "precision")


def ranking_metrics(df: DataFrame, *, group: str, score: str, grade: str, tie: str, k: int = 10) -> DataFrame:
    """(group, ndcg, mrr, hit_1, hit_k, precision) of each ranked group, to 6 decimals.

    Gains are 2^grade - 1, discounts log2(place + 1); equal scores are ranked by tie.
    precision divides by k however few rows there are; all are 0 without a positive grade.
    A group of any size is sorted with spilling and only its first k rows are aggregated.
    """
    by_score = Window.partitionBy(group).orderBy(F.desc_nulls_last(score), F.asc(tie))
    by_grade = Window.partitionBy(group).orderBy(F.desc_nulls_last(grade), F.asc(tie))
    ranked = df.select(group, F.coalesce(F.col(grade), F.lit(0)).alias("__g"), F.row_number().over(by_score).alias("__place"), F.row_number().over(by_grade).alias("__best"))
    gain = lambda p: F.when(F.col(p) <= k, (F.pow(F.lit(2.0), F.col("__g")) - 1) / F.log2(F.col(p) + 1.0)).otherwise(0.0)
    good = (F.col("__g") > 0) & (F.col("__place") <= k)
    first = F.min(F.when(good, F.col("__place")))
    sums = ranked.groupBy(group).agg(F.sum(gain("__place")).alias("__dcg"), F.sum(gain("__best")).alias("__ideal"), first.alias("__first"), F.count_if(good).alias("__good"))
    return sums.select(
        group,
        F.round(F.coalesce(F.try_divide("__dcg", "__ideal"), F.lit(0.0)), 6).alias("ndcg"),
        F.round(F.coalesce(1.0 / F.col("__first"), F.lit(0.0)), 6).alias("mrr"),
        (F.coalesce(F.col("__first"), F.lit(0)) == 1).cast("double").alias("hit_1"),
        F.col("__first").isNotNull().cast("double").alias("hit_k"),
        F.round(F.col("__good") / F.lit(float(k)), 6).alias("precision"),
    )


def mean_metrics(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.round(F.avg(m), 4).alias(m) for m in METRICS], F.count(F.lit(1)).alias("queries"))


def relative_lift(before: Column, after: Column) -> Column:
    """(after - before) / before; null where there was nothing before."""
    return F.try_divide(after - before, before)


def subgroup(baseline: DataFrame, changed: DataFrame, *, group: str, metric: str = "ndcg") -> DataFrame:
    """One row: means of both, their relative lift, and in how many groups the metric got better or worse."""
    both = baseline.select(group, F.col(metric).alias("b")).join(changed.select(group, F.col(metric).alias("c")), group)
    d = F.col("c") - F.col("b")
    out = both.agg(F.count(F.lit(1)).alias("queries"), F.avg("b").alias("before"), F.avg("c").alias("after"), F.count_if(d > 1e-12).alias("improved"), F.count_if(d < -1e-12).alias("regressed"))
    return out.select("queries", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round(relative_lift(F.col("before"), F.col("after")), 4).alias("lift"), "improved", "regressed", (F.col("queries") - F.col("improved") - F.col("regressed")).alias("unchanged"))


def paired_bootstrap(deltas: DataFrame, value: str, *, repeats: int = 3000, seed: int = 1111, blocks: int = 4096) -> DataFrame:
    """One row (mean, low, high): the mean difference and the bounds of its 95 % interval.

    Rows fall into blocks by the hash of their id (column `id`), which add up before anything
    is shuffled; blocks are drawn a Poisson(1) number of times per repetition. Few rows are
    blocks of their own, of many the blocks' sums vary as the rows do. So all repetitions are
    one product of a bounded matrix, and partitions don't matter.
    """
    rows = deltas.filter(F.col(value).isNotNull()).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.col(value).cast("double").alias("v"))
    sums = rows.groupBy("block").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    one = sums.agg(F.sort_array(F.collect_list(F.struct("block", "s", "n"))).alias("blocks"))  # at most `blocks` of them

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for held in batch.column(0).to_pylist():
                s, n = np.array([x["s"] for x in held], float), np.array([x["n"] for x in held], float)
                times = np.random.Generator(np.random.Philox(key=seed)).poisson(1.0, (repeats, blocks))[:, [x["block"] for x in held]]
                means = (times @ s) / np.maximum(times @ n, 1.0)
                low, high = np.quantile(means, [0.025, 0.975]).tolist() if held else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([float(x)] if held else [None], pa.float64()) for x in (s.sum() / max(1.0, n.sum()), low or 0.0, high or 0.0)], names=["mean", "low", "high"])

    return one.mapInArrow(draw, "mean double, low double, high double").select(*[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def gates(checks: dict[str, bool | None]) -> tuple[bool, list[str]]:
    """Whether all conditions hold, and which don't; an unknown one doesn't."""
    failed = [n for n, ok in checks.items() if not ok]
    return not failed, failed


def rank_propensity(df: DataFrame, *, rank: str, clicked: str, max_rank: int = 100, alpha: float = 2.0, beta: float = 20.0) -> DataFrame:
    """(rank, propensity) for 1..max_rank: smoothed click rates relative to rank 1, from 0.02 to 1, never rising."""
    seen = df.filter(F.col(rank).between(1, max_rank)).groupBy(F.col(rank).cast("int").alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(clicked) > 0).alias("c"))
    ranks = df.sparkSession.range(1, max_rank + 1).select(F.col("id").cast("int").alias("rank"))
    raw = ranks.join(seen, "rank", "left").select("rank", ((F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("n", F.lit(0)) + alpha + beta)).alias("p"))
    # one row per rank
    anchor = F.greatest(F.first("p").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(1e-6))
    scaled = raw.select("rank", F.greatest(F.lit(0.02), F.least(F.lit(1.0), F.col("p") / anchor)).alias("p"))
    return scaled.select("rank", F.min("p").over(Window.orderBy("rank")).alias("propensity"))


def inverse_weight(propensity: Column, clip: float = 10.0) -> Column:
    return F.least(F.lit(clip), 1.0 / F.greatest(F.coalesce(propensity, F.lit(0.02)), F.lit(0.02)))


def coverage(df: DataFrame, *, group: str, features: Sequence[str], relevant: Column, active: Column) -> DataFrame:
    """One row: groups and rows in which a feature says anything, and groups whose gate is open."""
    some = F.lit(False)
    for f in features:
        some = some | (F.coalesce(F.col(f), F.lit(0.0)) != 0)
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_if(some).alias("with"), F.bool_or(some).alias("any"), F.bool_or(some & relevant).alias("relevant"), F.bool_or(active).alias("active"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(c), F.count(F.lit(1))), F.lit(0.0)), 4)
    return per.agg(F.count(F.lit(1)).alias("queries"), F.sum("rows").alias("rows"), F.sum("with").alias("rows_with_feature"), share(F.col("any")).alias("any_feature"), share(F.col("relevant")).alias("relevant_covered"), share(F.col("active")).alias("gate_active"))


def review_scores(jobs: DataFrame, relations: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, passed) from reviewed counts.

    jobs: published, valid, missed, incorrect_alias; relations: is_valid (0 or 1). A metric
    without anything to measure is null and not passed.
    """
    j = jobs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("published", "valid", "missed", "incorrect_alias")])
    r = relations.agg(F.coalesce(F.sum("is_valid"), F.lit(0)).alias("good"), F.count(F.lit(1)).alias("all"))
    one = j.withColumn("one", F.lit(1)).join(r.withColumn("one", F.lit(1)), "one")
    ratio = lambda a, b: F.round(F.try_divide(a.cast("double"), b), 8)
    c = F.col
    values = {
        "mention_precision": ratio(c("valid"), c("published")),
        "mention_recall": ratio(c("valid"), c("valid") + c("missed")),
        "exact_alias_precision": ratio(c("published") - c("incorrect_alias"), c("published")),
        "published_relation_precision": ratio(c("good"), c("all")),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), F.coalesce(v >= F.lit(thresholds.get(n, 0.0)), F.lit(False)).alias("passed")) for n, v in values.items()]))
    return one.select(each.alias("x")).select("x.*")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, *, query: str, item: str, rank: str, k: int = 200) -> DataFrame:
    """One row: mean recall within k, reciprocal rank, and hits at 1 and 10, over queries with relevant items."""
    wanted = relevant.select(query, item).distinct()
    found = wanted.join(ranked.filter(F.col(rank) <= k).groupBy(query, item).agg(F.min(rank).alias("__r")), [query, item], "left")
    per = found.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.count("__r").alias("met"), F.min("__r").alias("first"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    first = F.coalesce(F.col("first"), F.lit(10**9))
    return per.agg(F.count(F.lit(1)).alias("queries"), mean(F.col("met") / F.col("n")).alias("recall"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), mean((first <= 1).cast("double")).alias("hit_1"), mean((first <= 10).cast("double")).alias("hit_10"))


def exact_bootstrap(deltas: DataFrame, value: str, *, repeats: int = 3000, seed: int = 1111, bound: int = 100_000) -> tuple[float, float, float]:
    """The classical resampling of a bounded list of differences, on the driver: mean and 95 % bounds. For longer lists there is paired_bootstrap."""
    import random

    values = [r[0] for r in bounded_rows(deltas.filter(F.col(value).isNotNull()).orderBy("id").select(value), bound, "the differences")]
    if not values:
        return 0.0, 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(repeats))
    return sum(values) / len(values), means[int(0.025 * (repeats - 1))], means[int(0.975 * (repeats - 1))]
