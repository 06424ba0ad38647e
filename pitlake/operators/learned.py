"""Scores that are learned: rolling cross-sectional ridge regressions and a small network."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitlake.functions.exprs import zscore


def moments(x: DataFrame, names: Sequence[str], label: str) -> DataFrame:
    """Per session: counts and sums of products of the features, an intercept and the label. A fit over any window is a sum
    of these rows, so the data are aggregated once, in the JVM, whatever the number of fits."""
    cols = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    ok = F.col(label).isNotNull()
    for n in names:
        ok = ok & F.col(n).isNotNull()
    aggs = [F.sum(a * b).alias(f"xx_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    aggs += [F.sum(a * F.col(label)).alias(f"xy_{i}") for i, a in enumerate(cols)]
    return x.where(ok).groupBy("session_index").agg(F.count(F.lit(1)).alias("n"), *aggs)


def rolling_ridge(x: DataFrame, names: Sequence[str], label: str, at: DataFrame, window: int, horizon: int, strength: float = 1.0, least: int = 50) -> DataFrame:
    """session_index, coef: at each session of `at` the ridge coefficients (intercept first, not penalised) over the
    sessions of the window whose labels, `horizon` sessions ahead, were known by then."""
    m, k = moments(x, names, label), len(names) + 1
    sums = [c for c in m.columns if c not in ("session_index",)]
    fit = at.select(F.col("session_index").alias("at"))
    inside = (F.col("session_index") <= F.col("at") - horizon) & (F.col("session_index") > F.col("at") - horizon - window)
    rows = fit.join(m, inside).groupBy("at").agg(*[F.sum(c).alias(c) for c in sums]).where(F.col("n") >= least)

    def solve(batches):
        for p in batches:
            out = []
            for r in p.to_dict("records"):
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = r[f"xx_{i}_{j}"]
                b = np.array([r[f"xy_{i}"] for i in range(k)])
                ridge = strength * np.eye(k)
                ridge[0, 0] = 0
                out.append((r["at"], np.linalg.lstsq(a + ridge, b, rcond=None)[0].tolist()))
            yield pd.DataFrame(out, columns=["session_index", "coef"])

    return rows.mapInPandas(solve, "session_index int, coef array<double>")


def ridge_scores(x: DataFrame, names: Sequence[str], fits: DataFrame) -> DataFrame:
    """x at the sessions of the fits with score, the fitted value."""
    score = sum((F.col("coef")[i + 1] * F.col(n) for i, n in enumerate(names)), F.col("coef")[0])
    return x.join(F.broadcast(fits), "session_index").withColumn("score", score).drop("coef")


def standardised(x: DataFrame, names: Sequence[str], bound: float = 3.0) -> DataFrame:
    """Features as z-scores by date, within bounds, 0 where unknown."""
    return x.withColumns({n: zscore(F.col(n).cast("double"), ["date"], bound, 0.0) for n in names})


def forward_return(panel: DataFrame, horizon: int, name: str = "fwd") -> DataFrame:
    """panel with the return from the next open to the open `horizon` sessions after; known only then."""
    w = Window.partitionBy("security_id").orderBy("session_index")
    a = F.max("open").over(w.rangeBetween(1, 1))
    b = F.max("open").over(w.rangeBetween(1 + horizon, 1 + horizon))
    return panel.withColumn(name, F.when(a > 0, b / a - 1))


def dense_columns(x: DataFrame, names: Sequence[str], share: float = 0.9) -> list[str]:
    """Features that are known in a share of the rows and vary."""
    r = x.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"c_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    return [c for c in names if r.n and r[f"c_{c}"] >= share * r.n and (r[f"s_{c}"] or 0) > 0]


def mlp_scores(x: DataFrame, names: Sequence[str], label: str, hidden: tuple[int, ...] = (32, 16), seeds: int = 3, epochs: int = 20, rate: float = 1e-3, l2: float = 1e-4) -> DataFrame:
    """date, security_id, score: a network for each year, fitted on all years before, mean of seeds.

    A year's training rows are one group of a few features, so `x` should be month ends of the universe.
    """
    years = x.select(F.year("date").alias("fit")).distinct()
    both = years.join(x.withColumn("_y", F.year("date")), F.col("_y") <= F.col("fit"))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        year = rows["fit"].iloc[0]
        old, new = rows[(rows["_y"] < year) & rows[label].notna()], rows[rows["_y"] == year]
        if len(old) < 50:
            return pd.DataFrame({"date": pd.Series([], dtype=object), "security_id": pd.Series([], dtype="int64"), "score": pd.Series([], dtype="float64")})
        old = old.sort_values(["date", "security_id"])
        a, y = old[list(names)].fillna(0).to_numpy(float), old[label].to_numpy(float)
        b = new[list(names)].fillna(0).to_numpy(float)
        y = (y - y.mean()) / (y.std() or 1)
        out = np.zeros(len(b))
        for seed in range(seeds):
            out += _mlp(a, y, b, hidden, seed, epochs, rate, l2)
        return pd.DataFrame({"date": new["date"].to_numpy(), "security_id": new["security_id"].to_numpy(), "score": out / seeds})

    return both.groupBy("fit").applyInPandas(fit, "date date, security_id long, score double")


def _mlp(a: np.ndarray, y: np.ndarray, b: np.ndarray, hidden: tuple[int, ...], seed: int, epochs: int, rate: float, l2: float) -> np.ndarray:
    """Predictions for b of a network fitted to (a, y) by Adam."""
    rng = np.random.default_rng(seed)
    sizes = [a.shape[1], *hidden, 1]
    p = [rng.normal(0, np.sqrt(2 / m), (m, n)) for m, n in zip(sizes, sizes[1:], strict=False)] + [np.zeros(n) for n in sizes[1:]]
    layers = len(sizes) - 1
    m1, m2, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0

    def forward(x: np.ndarray) -> list[np.ndarray]:
        acts = [x]
        for i in range(layers):
            z = acts[-1] @ p[i] + p[layers + i]
            acts.append(np.maximum(z, 0) if i < layers - 1 else z)
        return acts

    for _ in range(epochs):
        order = rng.permutation(len(a))
        for at in range(0, len(a), 4096):
            own = order[at : at + 4096]
            acts = forward(a[own])
            g = (acts[-1][:, 0] - y[own])[:, None] / len(own)
            grads: list[np.ndarray] = [np.zeros(0)] * len(p)
            for i in range(layers - 1, -1, -1):
                grads[i] = acts[i].T @ g + l2 * p[i]
                grads[layers + i] = g.sum(axis=0)
                g = (g @ p[i].T) * (acts[i] > 0) if i else g
            t += 1
            for i, d in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * d
                m2[i] = 0.999 * m2[i] + 0.001 * d * d
                p[i] -= rate * (m1[i] / (1 - 0.9**t)) / (np.sqrt(m2[i] / (1 - 0.999**t)) + 1e-8)
    return forward(b)[-1][:, 0]
