"""Ranking models: a LambdaMART fit on a bounded sample of groups, portable trees, tuning."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def tree_score(node: dict, values: np.ndarray, index: dict[str, int]) -> np.ndarray:
    """One tree's leaf for every row; values and thresholds are compared in single precision, less goes to yes."""
    if "leaf" in node:
        return np.full(len(values), float(node["leaf"]))
    children = {c["nodeid"]: c for c in node["children"]}
    yes = values[:, index[node["split"]]].astype(np.float32) < np.float32(node["split_condition"])
    out = np.empty(len(values))
    out[yes] = tree_score(children[node["yes"]], values[yes], index)
    out[~yes] = tree_score(children[node["no"]], values[~yes], index)
    return out


def predict_trees(df: DataFrame, model: dict, allowed: Sequence[str] | None = None) -> Column:
    """The model's score as a column of df; features that aren't allowed count as 0, and so do nulls.

    model: {"features": names, "base": number, "trees": nested nodes}; it travels as JSON.
    """
    names, text = list(model["features"]), json.dumps(model)
    used = [F.col(n).cast("double") if allowed is None or n in allowed else F.lit(0.0) for n in names]

    @F.pandas_udf(DoubleType())
    def score(*columns: pd.Series) -> pd.Series:
        loaded = json.loads(text)
        values = np.column_stack([c.fillna(0.0).to_numpy(float) for c in columns])
        index = {n: i for i, n in enumerate(names)}
        return pd.Series(loaded["base"] + sum((tree_score(t, values, index) for t in loaded["trees"]), np.zeros(len(values))))

    return score(*used)


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, names: Sequence[str], depth: int, least: int, l2: float, rate: float, ids: itertools.count) -> dict:
    """A regression tree on binned features by Newton steps."""
    node = {"nodeid": next(ids)}
    best = (1e-9, None, None)
    whole = g.sum() ** 2 / (h.sum() + l2)
    if depth > 0:
        for f, edge in enumerate(edges):
            n = np.bincount(x[:, f], minlength=len(edge) + 1).cumsum()[:-1]
            gl, hl = (np.bincount(x[:, f], w, minlength=len(edge) + 1).cumsum()[:-1] for w in (g, h))
            gain = gl**2 / (hl + l2) + (g.sum() - gl) ** 2 / (h.sum() - hl + l2) - whole
            gain[(n < least) | (len(g) - n < least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best[1] is None:
        return node | {"leaf": float(-rate * g.sum() / (h.sum() + l2))}
    _, f, cut = best
    yes = x[:, f] <= cut
    grow = lambda m: _grow(x[m], edges, g[m], h[m], names, depth - 1, least, l2, rate, ids)
    children = [grow(yes), grow(~yes)]
    return node | {"split": names[f], "split_condition": float(edges[f][cut]), "yes": children[0]["nodeid"], "no": children[1]["nodeid"], "children": children}


def _lambdas(score: np.ndarray, label: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of pairwise loss, weighted by the change of NDCG."""
    g, h = np.zeros(len(score)), np.full(len(score), 1e-6)
    for lo, hi in zip(group[:-1], group[1:], strict=True):
        y, s = label[lo:hi], score[lo:hi]
        if y.max(initial=0) == y.min(initial=0):
            continue
        gain, place = 2.0**y - 1, np.empty(hi - lo)
        place[np.argsort(-s, kind="stable")] = np.arange(1, hi - lo + 1)
        ideal = (np.sort(gain)[::-1] / np.log2(np.arange(2, hi - lo + 2))).sum()
        better = y[:, None] > y[None, :]
        swing = np.abs((gain[:, None] - gain[None, :]) * (1 / np.log2(place + 1)[:, None] - 1 / np.log2(place + 1)[None, :])) / ideal
        p = 1 / (1 + np.exp(np.clip(s[:, None] - s[None, :], -30, 30)))
        push = np.where(better, swing * p, 0)
        bend = np.where(better, swing * p * (1 - p), 0)
        g[lo:hi] += push.sum(0) - push.sum(1)
        h[lo:hi] += bend.sum(0) + bend.sum(1)
    return g, h


def fit_lambdamart(df: DataFrame, *, group: str, label: str, features: Sequence[str], trees: int = 50, depth: int = 4, rate: float = 0.1, bins: int = 64, least: int = 20, l2: float = 1.0, sample_groups: int = 5_000, group_rows: int = 200) -> dict:
    """A portable ranking model from a bounded sample: of the sample_groups groups of least hash up to group_rows rows each.

    Both bounds are parameters, so that the sample has at most sample_groups * group_rows rows,
    which reach the driver as Arrow columns. Of a larger group its best row and rows drawn by
    hash are taken. Groups without a positive label teach nothing. Without rows the model is a
    constant.
    """
    sizes = df.groupBy(group).agg(F.max(label).alias("__best")).filter(F.col("__best") > 0)
    chosen = sizes.orderBy(F.xxhash64(group), group).limit(sample_groups).select(group)
    columns = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]
    rows = df.join(chosen, group, "left_semi").select(F.col(group).cast("string").alias("g"), F.coalesce(F.col(label), F.lit(0)).cast("double").alias("y"), *columns)
    best = (F.row_number().over(Window.partitionBy("g").orderBy(F.desc("y"), F.xxhash64("y", *features))) > 1).alias("__later")
    drawn = Window.partitionBy("g").orderBy("__later", F.xxhash64("y", *features), "y", *features)
    rows = rows.select("*", best).withColumn("__n", F.row_number().over(drawn)).filter(F.col("__n") <= group_rows).drop("__n", "__later")
    rows = [tuple(r) for r in zip(*(c.to_pylist() for c in rows.toArrow().columns), strict=True)]
    model = {"features": list(features), "base": 0.0, "trees": []}
    if not rows:
        return model
    rows.sort()
    y, x = np.array([r[1] for r in rows]), np.array([r[2:] for r in rows])
    names = np.array([r[0] for r in rows])
    starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    # a threshold just above each edge: smaller values go to yes in single precision, too
    edges = [np.nextafter(e.astype(np.float32), np.float32(np.inf)).astype(float) for e in edges]
    binned = np.column_stack([np.searchsorted(e, x[:, f].astype(np.float32), "right") for f, e in enumerate(edges)])
    score, ids = np.zeros(len(y)), itertools.count()
    index = {n: i for i, n in enumerate(features)}
    for _ in range(trees):
        g, h = _lambdas(score, y, starts)
        tree = _grow(binned, edges, g, h, list(features), depth, least, l2, rate, ids)
        model["trees"].append(tree)
        score += tree_score(tree, x, index)
    return model


def tune(train: Callable[[dict], dict], measure: Callable[[dict], float], grid: dict[str, Sequence]) -> tuple[dict, dict, list[tuple[dict, float]]]:
    """The best options of a grid by what measure says about the model that train makes of them; the first of equals."""
    trials, best = [], None
    for values in itertools.product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        model = train(options)
        value = measure(model)
        trials.append((options, value))
        if best is None or value > best[1]:
            best = (options, value, model)
    if best is None:
        raise ValueError("the grid is empty")
    return best[0], best[2], trials
