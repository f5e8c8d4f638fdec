"""Indicator columns, and the Poisson regression of one matrix that absorbed.py must agree with."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dummies(rows: DataFrame, column: str, values: list, drop_first: bool = True) -> DataFrame:
    """Indicator columns column_value; without the first (in order) as the reference level."""
    kept = sorted(values)[1 if drop_first else 0 :]
    return rows.withColumns({f"{column}_{v}": (F.col(column) == v).cast("int") for v in kept})


def poisson_irls(x: np.ndarray, y: np.ndarray, ridge: float = 1e-6, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and robust standard errors of a log-link Poisson regression by reweighted least squares."""
    beta = np.zeros(x.shape[1])
    beta[0] = np.log(max(y.mean(), 1e-3))
    keep = np.eye(x.shape[1]) * ridge * len(y)
    for _ in range(rounds):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        step = np.linalg.pinv((x * mu[:, None]).T @ x + keep) @ (x.T @ (y - mu))
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    mu = np.exp(np.clip(x @ beta, -30, 30))
    bread = np.linalg.pinv((x * mu[:, None]).T @ x + keep)
    score = x * (y - mu)[:, None]
    return beta, np.sqrt(np.clip(np.diag(bread @ (score.T @ score) @ bread), 0, None))


def design(pdf: pd.DataFrame, effects: list[str], regressors: list[str]) -> np.ndarray:
    """Intercept, regressors, and dummies of the effects without their first level."""
    parts = [np.ones((len(pdf), 1)), pdf[regressors].to_numpy(float)]
    parts += [pd.get_dummies(pdf[e], drop_first=True).to_numpy(float) for e in effects]
    return np.concatenate(parts, 1)
