"""Regressions of very many groups in one pass.

Products of columns are summed inside the tasks, group by group; only these small matrices are shuffled, added up and solved side by
side. A group's rows never gather anywhere, so a zone with a third of all rows costs no more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grams(df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """``(*keys, target, n, g)``: number of rows and the matrix of products of ``(1, features, target)``, row by row as one array.

    Rows with a null among features or target are left out. Features and target are taken relative to one row of the group in each task,
    whose values come along as ``base``: columns far from zero then lose no digits.
    """
    keys, features, targets = list(keys), list(features), list(targets)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    held = 200  # groups summed before they are handed on

    def run(parts):
        total: dict = {}

        def out():
            rows = [(*k, t, n, base.tolist(), g.ravel().tolist()) for (k, t), (n, base, g) in total.items()]
            return pd.DataFrame(rows, columns=[*keys, "target", "n", "base", "g"])

        for pdf in parts:
            for k, rows in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
                k = k if isinstance(k, tuple) else (k,)
                for t in targets:
                    v = rows[[*features, t]].to_numpy(np.float64)
                    v = v[~np.isnan(v).any(axis=1)]
                    if not len(v):
                        continue
                    n, base, g = total.get((k, t), (0, v[0], 0.0))
                    x = np.hstack([np.ones((len(v), 1)), v - base])
                    total[k, t] = (n + len(v), base, g + x.T @ x)
            if len(total) > held:
                yield out()
                total.clear()
        if total:
            yield out()

    schema = f"{kinds}{', ' if kinds else ''}target string, n long, base array<double>, g array<double>"
    return df.select(*keys, *features, *targets).mapInPandas(run, schema)


def _moved(base: np.ndarray, g: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The matrix of products relative to ``to`` instead of ``base``."""
    m = np.eye(len(base) + 1)
    m[1:, 0] = base - to
    return m @ g @ m.T


def fit(df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], ridge: float = 0.0) -> DataFrame:
    """``(*keys, target, n, intercept, coefficients, rmse, gradient)`` of each group with at least two rows.

    ``ridge`` weighs the squares of the coefficients of standardised features, per row; constant features get the coefficient 0.
    ``gradient`` is the largest violation of the normal equations, in standardised units.
    """
    keys, features = list(keys), list(features)
    g = grams(df, keys, features, targets)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    names = [*keys, "target", "n", "intercept", "coefficients", "rmse", "gradient"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ascending=False)
        to = np.array(pdf["base"].iloc[0])
        size = len(to) + 1
        total = sum(_moved(np.array(b), np.array(m).reshape(size, size), to) for b, m in zip(pdf["base"], pdf["g"]))
        n = int(pdf["n"].sum())
        if n < 2:
            return pd.DataFrame(columns=names)
        mean = total[0, 1:] / n
        cov = total[1:, 1:] / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0.0))
        scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean + to))] = 0.0
        use, y = np.flatnonzero(scale[:-1] > 0), len(to) - 1
        c = cov[np.ix_(use, use)] / np.outer(scale[use], scale[use])
        r = cov[use, y] / scale[use]
        w = np.linalg.lstsq(c + ridge * np.eye(len(use)), r, rcond=1e-10)[0] if len(use) else np.zeros(0)
        beta = np.zeros(y)
        beta[use] = w / scale[use]
        miss = cov[y, y] - 2 * beta @ cov[:-1, y] + beta @ cov[:-1, :-1] @ beta
        gradient = float(np.abs(c @ w + ridge * w - r).max() / max(scale[y], 1e-300)) if len(use) else 0.0
        head = [pdf[k].iloc[0] for k in (*keys, "target")]
        intercept = float(mean[y] + to[y] - beta @ (mean[:-1] + to[:-1]))
        return pd.DataFrame([[*head, n, intercept, beta.tolist(), float(np.sqrt(max(miss, 0.0))), gradient]], columns=names)

    schema = f"{kinds}{', ' if kinds else ''}target string, n long, intercept double, coefficients array<double>, rmse double, gradient double"
    return g.groupBy(*keys, "target").applyInPandas(run, schema)


def predict(df: DataFrame, fitted: DataFrame, keys: Sequence[str], features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``(*keep, target, predicted_value, ci_lower, ci_upper)`` for each row and target of its group; null where a feature is."""
    f = fitted.select(*[F.col(k).alias(f"_{k}") for k in keys], "target", "intercept", "coefficients", "rmse")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    v = F.col("intercept")
    for i, x in enumerate(features):
        v = v + F.get("coefficients", F.lit(i)) * F.col(x)
    v = F.when(v.isNotNull(), F.greatest(F.lit(0.0), v))
    d = df.join(f, same).withColumn("predicted_value", v)
    return d.select(*keep, "target", "predicted_value", F.greatest(F.lit(0.0), F.col("predicted_value") - 1.96 * F.col("rmse")).alias("ci_lower"),
                    (F.col("predicted_value") + 1.96 * F.col("rmse")).alias("ci_upper"))
