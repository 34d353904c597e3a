"""Isolation forest (Liu, Ting and Zhou 2008) fitted tree by tree in parallel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread


def c_factor(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    h = np.log(np.maximum(n - 1, 1)) + 0.5772156649015329
    return np.where(n > 2, 2 * h - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def scrambled(key: np.ndarray, seed: int) -> np.ndarray:
    """A 63-bit hash of each key for each seed."""
    z = key + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(1)


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, split, left, right, path length at leaf); feature -1 marks a leaf."""
    nodes: list[tuple[int, float, int, int, float]] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        idx, depth, parent, side = stack.pop()
        me = len(nodes)
        if parent >= 0:
            f, s, l, r, p = nodes[parent]
            nodes[parent] = (f, s, me if side == 0 else l, me if side == 1 else r, p)
        sub = x[idx]
        wide = np.flatnonzero(sub.max(axis=0) > sub.min(axis=0)) if len(idx) > 1 else []
        if depth >= limit or len(wide) == 0:
            nodes.append((-1, 0.0, -1, -1, float(depth + c_factor(len(idx)))))
            continue
        f = int(rng.choice(wide))
        s = float(rng.uniform(sub[:, f].min(), sub[:, f].max()))
        nodes.append((f, s, -1, -1, 0.0))
        go = sub[:, f] < s
        stack += [(idx[~go], depth + 1, me, 1), (idx[go], depth + 1, me, 0)]
    return nodes


def path_lengths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), dtype=int)
    while True:
        f = nodes[at, 0].astype(int)
        inner = f >= 0
        if not inner.any():
            return nodes[at, 4]
        rows = np.flatnonzero(inner)
        n = nodes[at[rows]]
        left = x[rows, f[rows]] < n[:, 1]
        at[rows] = np.where(left, n[:, 2], n[:, 3]).astype(int)


@dataclass
class Forest:
    """Trees and scaling; its size is set by trees and sample size, not by the data."""

    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    trees: list[np.ndarray]
    psi: int
    offset: float = -0.5

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.std
        h = sum(path_lengths(t, z) for t in self.trees) / len(self.trees)
        return -np.power(2.0, -h / float(c_factor(self.psi)))

    def score(self, df: DataFrame, out: str = "decision") -> DataFrame:
        """Add the decision value; below 0 means anomaly."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        features, offset = self.features, self.offset

        @F.pandas_udf("double")
        def decide(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = shared.value
            for p in parts:
                yield pd.Series(model.score_samples(p[features].to_numpy(dtype=float)) - offset)

        return df.withColumn(out, decide(F.struct(*features)))


def fit(df: DataFrame, features: Sequence[str], id_col: str, trees: int = 150, psi: int = 256,
        contamination: float = 0.03, seed: int = 42, min_rows: int = 500) -> Forest | None:
    """Fit every tree on its own ``psi`` rows, those with the smallest hashes under the tree's hash function.

    The subsample per tree is a step of the method and the same for any number of rows (all rows serve if there are fewer). A
    task keeps at most ``psi`` rows per tree; every tree is grown in its own task. The decision offset is the contamination
    quantile of the scores of *all* rows.
    """
    features = list(features)
    x = df.select(F.col(id_col).alias("_id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    stat = x.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{i}") for i, c in enumerate(features)
                                           for k, f in (("a", F.avg), ("s", F.stddev_pop))]).first()
    if stat["n"] < min_rows:
        return None
    mean = np.array([stat[f"a{i}"] for i in range(len(features))])
    std = np.array([stat[f"s{i}"] or 1.0 for i in range(len(features))])
    psi = int(min(psi, stat["n"]))
    names = ", ".join(f"`{c}` double" for c in features)

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of each tree the ``psi`` rows of a task with the smallest hashes under that tree's hash function."""
        held: list[pd.DataFrame | None] = [None] * trees
        for pdf in parts:
            key = pdf["_h"].to_numpy().astype(np.uint64)
            for k in range(trees):
                h = scrambled(key, seed * 1000 + k)
                at = np.argpartition(h, psi)[:psi] if len(h) > psi else np.arange(len(h))
                new = pdf.iloc[at][features].assign(_h=h[at].astype(np.int64), _tree=k)
                both = new if held[k] is None else pd.concat([held[k], new], ignore_index=True)
                held[k] = both.nsmallest(psi, "_h", keep="all") if len(both) > psi else both
        if held[0] is not None:
            yield from (t[["_tree", "_h", *features]] for t in held)

    drawn = x.withColumn("_h", F.xxhash64("_id")).mapInPandas(draw, f"_tree int, _h long, {names}")
    limit = math.ceil(math.log2(max(psi, 2)))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["_tree"].iloc[0])
        pdf = pdf.sort_values(["_h", *features]).head(psi)
        z = (pdf[features].to_numpy(dtype=float) - mean) / std
        nodes = grow(z, np.random.default_rng(seed * 1000 + k), limit)
        a = np.array(nodes, dtype=float)
        return pd.DataFrame({"tree": k, "node": np.arange(len(a)), "feature": a[:, 0], "split": a[:, 1], "left": a[:, 2],
                             "right": a[:, 3], "path": a[:, 4]})

    rows = (spread(drawn, "_tree").groupBy("_tree").applyInPandas(
        build, "tree long, node long, feature double, split double, left double, right double, path double").toPandas())
    rows = rows.sort_values(["tree", "node"])
    grown = [g[["feature", "split", "left", "right", "path"]].to_numpy() for _, g in rows.groupby("tree")]
    forest = Forest(features, mean, std, grown, psi, offset=0.0)
    cut = forest.score(x, "_s").agg(F.approx_percentile("_s", contamination, 10000).alias("q")).first()["q"]
    forest.offset = float(cut)
    return forest
