"""All folds of a series in one scan: smoothing states, forecasts and one-step fitted values at every origin.

A series comes as its days with sales; the task that has it lays a few hundred of them out as a matrix of days, walks the
days once with all smoothing constants side by side, and notes at each origin what every method knows by then. No dense
grid is shuffled, and no fold starts from the first day again.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators.baselines import ALPHAS, BASELINES, CROSTON_ALPHA, SEASON, seasonal_naive
from demandloom.operators.panel import HORIZON

#: Series that are walked side by side.
AT_ONCE = 256
STATES = "fold int, level string, key string, n int, actual array<double>, naive double, week array<double>, ses double, alpha double, croston_sba double, resid array<double>"


def walk(y: np.ndarray, ends: list[int], alphas: tuple[float, ...] = ALPHAS, croston_alpha: float = CROSTON_ALPHA) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(smoothed level, its alpha, Croston's rate) of each row of y (series x days) before each of the days in ends.

    The alpha has the least squared one-step error so far, the smaller one on a tie. Without a day before, level and rate
    are 0; with one sale, the rate is its size over the days; without any, 0.
    """
    rows = len(y)
    a = np.array(alphas)
    level, sse = np.zeros((rows, len(a))), np.zeros((rows, len(a)))
    size, gap, last, sales, first = (np.zeros(rows) for _ in range(5))
    at = dict.fromkeys(ends)
    for day in range(max(ends, default=0) + 1):
        if day in at:
            best = sse.argmin(1)
            rate = size / np.maximum(gap, 1e-9) * (1 - croston_alpha / 2)
            rate = np.where(sales == 0, 0.0, np.where(sales == 1, first / max(day, 1), rate))
            at[day] = level[np.arange(rows), best], a[best], rate
        if day == max(ends, default=0):
            break
        now = y[:, day]
        if day == 0:
            level[:] = now[:, None]
        else:
            miss = now[:, None] - level
            sse += miss * miss
            level = a * now[:, None] + (1 - a) * level
        sold, place = now > 0, float(day + 1)
        new, more = sold & (sales == 0), sold & (sales > 0)
        size = np.where(new, now, np.where(more, croston_alpha * now + (1 - croston_alpha) * size, size))
        gap = np.where(new, place, np.where(more, croston_alpha * (place - last) + (1 - croston_alpha) * gap, gap))
        first = np.where(new, now, first)
        last = np.where(sold, place, last)
        sales = sales + sold
    return [at[e] for e in ends]


def residuals(y: np.ndarray, alpha: np.ndarray, end: int, tail: int) -> np.ndarray:
    """One-step errors y - level before it, of the last `tail` days before end (zeros in front), each row by its alpha."""
    level = y[:, 0].copy() if end else np.zeros(len(y))
    out = np.zeros((len(y), tail))
    for day in range(1, end):
        if day >= end - tail:
            out[:, tail - end + day] = y[:, day] - level
        level = alpha * y[:, day] + (1 - alpha) * level
    return out


def differences(y: np.ndarray, end: int, tail: int) -> np.ndarray:
    """y less its value SEASON days before, of the last `tail` days before end (zeros in front)."""
    out = np.zeros((len(y), tail))
    begin = max(end - tail, SEASON)
    if begin < end:
        out[:, tail - (end - begin) :] = y[:, begin:end] - y[:, begin - SEASON : end - SEASON]
    return out


def fold_states(panel: DataFrame, first: datetime.date, last: datetime.date, starts: list[tuple[int, datetime.date]], tail: int = 0, errors: str = "ses") -> DataFrame:
    """A row per fold and series of panel (level, key, date, y): what each method knows at the origin, and the days from there.

    Days of first..last without a row are 0; rows outside count nothing. starts: (fold, origin). n: days before the origin;
    week: the last up to SEASON of them; actual: up to HORIZON days from the origin; naive is null without a day before.
    tail: how many errors, to the day before the origin, resid has (null for 0): one-step errors of the smoothing (ses), or
    of the seasonal naive (seasonal). A series is walked in the task that has it, in memory in proportion to its days. An
    empty panel has no rows.
    """
    if first is None:
        return panel.sparkSession.createDataFrame([], STATES)
    days = (last - first).days + 1
    ends = [min(max((o - first).days, 0), days) for _, o in starts]
    inside = panel.where(F.col("date").between(F.lit(first), F.lit(last)) & F.col("y").isNotNull())
    series = inside.groupBy("level", "key").agg(F.sort_array(F.collect_list(F.struct(F.datediff("date", F.lit(first)).alias("t"), F.col("y").cast("double").alias("y")))).alias("r"))
    series = series.select("level", "key", F.col("r.t").alias("t"), F.col("r.y").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cut in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[cut : cut + AT_ONCE]
                y = np.zeros((len(part), days))
                for i, (t, v) in enumerate(zip(part["t"], part["y"], strict=True)):
                    np.add.at(y[i], t, v)
                for (fold, _), end, (level, alpha, rate) in zip(starts, ends, walk(y, ends), strict=True):
                    out = pd.DataFrame({"fold": np.int32(fold), "level": part["level"].to_numpy(), "key": part["key"].to_numpy(), "n": np.int32(end)})
                    out["actual"] = list(y[:, end : end + HORIZON])
                    out["naive"] = y[:, end - 1] if end else np.nan
                    out["week"] = list(y[:, max(end - SEASON, 0) : end])
                    out["ses"], out["alpha"], out["croston_sba"] = level, alpha, rate
                    if tail:
                        out["resid"] = list(residuals(y, alpha, end, tail) if errors == "ses" else differences(y, end, tail))
                    else:
                        out["resid"] = None
                    yield out

    found = series.mapInPandas(run, STATES)
    return found.withColumn("naive", F.nanvl("naive", F.lit(None).cast("double")))


def backtest(states: DataFrame, methods: tuple[str, ...] = tuple(BASELINES)) -> DataFrame:
    """(fold, level, key, method, h, y, yhat) of fold_states: every method on every day of the horizon."""
    days = states.select("fold", "level", "key", "week", "naive", "ses", "croston_sba", F.posexplode("actual").alias("h0", "y")).withColumn("h", F.col("h0") + 1)
    forecasts = [F.struct(F.lit(m).alias("method"), (seasonal_naive(F.col("week"), F.col("h")) if m == "seasonal_naive" else F.col(m)).alias("yhat")) for m in methods]
    return days.withColumn("f", F.explode(F.array(*forecasts))).select("fold", "level", "key", "f.method", "h", "y", "f.yhat")
