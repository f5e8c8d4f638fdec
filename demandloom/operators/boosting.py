"""Gradient-boosted trees over binned features: Poisson for the mean, pinball for quantiles.

Training takes a bounded sample of rows (by hash, so it does not depend on partitioning) and runs one model per task,
models side by side; the trees are small arrays, and prediction is a map over all rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
DEPTH = 5
RATE = 0.07
LEAST_LEAF = 40
RIDGE = 1.0
TREES, QUANTILE_TREES = 220, 140
SAMPLE_ROWS = 100_000


class Booster:
    """Trees of one objective: tau None is Poisson, else the pinball loss at tau."""

    def __init__(self, tau: float | None, trees: int, depth: int = DEPTH, rate: float = RATE, least: int = LEAST_LEAF):
        self.tau, self.trees, self.depth, self.rate, self.least = tau, trees, depth, rate, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            # missing values have the last bin to themselves
            out[:, j] = np.where(np.isnan(x[:, j]), BINS - 1, np.searchsorted(e, x[:, j]))
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        self.edges = [np.unique(np.nanquantile(c, np.linspace(0, 1, BINS - 1)[1:-1])) if np.isfinite(c).any() else np.zeros(0) for c in x.T]
        b = self._binned(x)
        self.start = float(np.log(max(y.mean(), 1e-6))) if self.tau is None else float(np.quantile(y, self.tau))
        raw = np.full(len(y), self.start)
        self.forest = []
        for _ in range(self.trees):
            if self.tau is None:
                mu = np.exp(np.clip(raw, -20, 20))
                gradient, hessian = mu - y, mu
            else:
                gradient, hessian = np.where(y > raw, -self.tau, 1 - self.tau), np.ones(len(y))
            tree, leaf = self._grow(b, gradient, hessian)
            for k in np.unique(leaf):
                rows = leaf == k
                if self.tau is None:
                    tree["value"][k] = -gradient[rows].sum() / (hessian[rows].sum() + RIDGE)
                else:
                    tree["value"][k] = np.quantile(y[rows] - raw[rows], self.tau)
            raw += self.rate * tree["value"][leaf]
            self.forest.append(tree)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """A tree of full levels: node k has children 2k + 1 and 2k + 2; a node that does not split sends all left."""
        n, m = b.shape
        size = 2 ** (self.depth + 1) - 1
        feature, cut = np.zeros(size, np.int32), np.full(size, BINS, np.int32)
        node = np.zeros(n, np.int64)
        for level in range(self.depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-6)
            for j in range(m):
                at = local * BINS + b[:, j]
                gs, hs, cs = (np.bincount(at, w, count * BINS).reshape(count, BINS).cumsum(1) for w in (g, h, None))
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(cs < self.least) | (ct - cs < self.least)] = -np.inf
                k = gain.argmax(1)
                top = gain[np.arange(count), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + count][better] = j
                cut[first : first + count][better] = k[better]
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        return {"feature": feature, "cut": cut, "value": np.zeros(size)}, node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Never below 0."""
        b = self._binned(x)
        raw = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree in self.forest:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, tree["feature"][node]] > tree["cut"][node])
            raw += self.rate * tree["value"][node]
        return np.maximum(0.0, np.exp(np.clip(raw, -20, 20)) if self.tau is None else raw)


def fit_models(rows: DataFrame, features: list[str], taus: tuple[float | None, ...], trees: int, quantile_trees: int, sample_rows: int = SAMPLE_ROWS, depth: int = DEPTH) -> dict[float | None, Booster]:
    """One model per tau (None: the mean) on at most about sample_rows rows of (level, key, date, y, features)."""
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = rows.where(F.pmod(F.xxhash64("level", "key", "date"), F.lit(1_000_003)) < share * 1_000_003)
    jobs = sample.withColumn("tau", F.explode(F.array(*[F.lit(-1.0 if t is None else t) for t in taus])))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tau = float(pdf["tau"].iloc[0])
        pdf = pdf.sort_values(["level", "key", "date"])
        model = Booster(None if tau < 0 else tau, trees if tau < 0 else quantile_trees, depth).fit(pdf[features].to_numpy(float), pdf["y"].to_numpy(float))
        return pd.DataFrame({"tau": [tau], "model": [pickle.dumps(model)]})

    fitted = jobs.select("tau", "level", "key", "date", "y", *[F.col(c).cast("float").alias(c) for c in features]).groupBy("tau").applyInPandas(fit, "tau double, model binary").collect()
    return {None if r["tau"] < 0 else r["tau"]: pickle.loads(r["model"]) for r in fitted}


def predict(rows: DataFrame, models: dict[float | None, Booster], features: list[str], keep: list[str]) -> DataFrame:
    """keep, then mean and q_<tau> for every row."""
    sent = rows.sparkSession.sparkContext.broadcast(models)
    names = {t: "mean" if t is None else f"q_{round(100 * t)}" for t in models}
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema] + [f"{n} double" for n in names.values()])

    def run(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            yield pdf[keep].assign(**{names[t]: m.predict(x) for t, m in sent.value.items()})

    return rows.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c not in keep]).mapInPandas(run, schema)
