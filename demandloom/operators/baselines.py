"""Baseline forecasters over ordered history arrays, and the rolling-origin backtest.

A history is one array per (fold, series); each method is a fold over it by a higher-order function, so nothing leaves
the JVM, and the horizon is a generator of 28 rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.panel import FOLDS, HORIZON, origins

SEASON = 7
ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 20))
CROSTON_ALPHA = 0.1


def naive(ys: Column, h: Column) -> Column:
    """The last value; null without history."""
    return F.when(F.size(ys) > 0, F.element_at(ys, -1))


def seasonal_naive(ys: Column, h: Column) -> Column:
    """The last week tiled; a shorter history repeats its last value."""
    n = F.size(ys)
    return F.when(n >= SEASON, F.try_element_at(ys, n - SEASON + 1 + (h - 1) % SEASON)).otherwise(naive(ys, h))


def smoothed(ys: Column, alpha: Column) -> Column:
    """(sse, alpha, level) of exponential smoothing that starts at the first value."""
    first = F.struct(F.try_element_at(ys, F.lit(1)).alias("level"), F.lit(0.0).alias("sse"))
    step = lambda s, y: F.struct((alpha * y + (1 - alpha) * s["level"]).alias("level"), (s["sse"] + (y - s["level"]) * (y - s["level"])).alias("sse"))
    return F.aggregate(F.slice(ys, 2, F.greatest(F.size(ys) - 1, F.lit(0))), first, step, lambda s: F.struct(s["sse"].alias("sse"), alpha.alias("alpha"), s["level"].alias("level")))


def ses_fit(ys: Column) -> Column:
    """(sse, alpha, level) of the best alpha by in-sample one-step error; the smaller alpha wins a tie. Null without history."""
    return F.when(F.size(ys) > 0, F.array_min(F.transform(F.array(*[F.lit(a) for a in ALPHAS]), lambda a: smoothed(ys, a))))


def ses(ys: Column, h: Column) -> Column:
    return F.when(F.size(ys) > 0, ses_fit(ys)["level"]).otherwise(F.lit(0.0))


def croston(ys: Column, h: Column, alpha: float = CROSTON_ALPHA, sba: bool = True) -> Column:
    """Smoothed size over smoothed interval, with the Syntetos-Boylan correction.

    The interval starts at the position of the first sale. No sale: 0; exactly one: its size over the length of the
    history, without the correction.
    """
    at = F.filter(F.transform(ys, lambda y, i: F.struct((i + 1).cast("double").alias("i"), y.alias("y"))), lambda x: x["y"] > 0)
    first = F.try_element_at(at, F.lit(1))
    start = F.struct(first["y"].alias("z"), first["i"].alias("p"), first["i"].alias("last"))
    step = lambda s, x: F.struct((alpha * x["y"] + (1 - alpha) * s["z"]).alias("z"), (alpha * (x["i"] - s["last"]) + (1 - alpha) * s["p"]).alias("p"), x["i"].alias("last"))
    end = F.aggregate(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), start, step)
    rate = end["z"] / F.greatest(end["p"], F.lit(1e-9)) * (1 - alpha / 2 if sba else 1.0)
    return F.when(F.size(at) == 0, F.lit(0.0)).when(F.size(at) == 1, first["y"] / F.size(ys)).otherwise(rate)


#: The registry: forecast of day h (1 is the first) from the history array.
BASELINES: dict[str, Callable[[Column, Column], Column]] = {"naive": naive, "seasonal_naive": seasonal_naive, "ses": ses, "croston_sba": croston}


def histories(grid: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, level, key, ys, actual): values before the origin in date order, and those of the horizon.

    Series are collected once; each fold is a slice of the array, so six folds do not shuffle six copies.
    """
    whole = grid.groupBy("level", "key").agg(F.sort_array(F.collect_list(F.struct("date", "y"))).alias("r"))
    met = whole.crossJoin(F.broadcast(folds))
    n = F.greatest(F.lit(0), F.least(F.size("r"), F.datediff("origin", F.col("r")[0]["date"])))
    ys = F.transform("r", lambda x: x["y"])
    return met.select("fold", "level", "key", F.slice(ys, F.lit(1), n).alias("ys"), F.slice(ys, n + 1, F.lit(HORIZON)).alias("actual"))


def backtest(grid: DataFrame, methods: tuple[str, ...] = tuple(BASELINES), folds: int = FOLDS, starts: DataFrame | None = None) -> DataFrame:
    """(fold, level, key, method, h, y, yhat): every method on every fold and day of the horizon.

    starts: (fold, origin), where they are known more cheaply than from the grid's days.
    """
    hist = histories(grid, origins(grid, folds) if starts is None else starts)
    # what does not depend on the day is computed once per history
    once = hist.withColumns({f"m_{m}": BASELINES[m](F.col("ys"), F.lit(1)) for m in methods if m != "seasonal_naive"})
    tail = once.withColumn("week", F.slice("ys", F.greatest(F.size("ys") - SEASON + 1, F.lit(1)), F.least(F.size("ys"), F.lit(SEASON)))).drop("ys")
    days = tail.select("*", F.posexplode("actual").alias("h0", "y")).withColumn("h", F.col("h0") + 1)
    forecasts = [F.struct(F.lit(m).alias("method"), (seasonal_naive(F.col("week"), F.col("h")) if m == "seasonal_naive" else F.col(f"m_{m}")).alias("yhat")) for m in methods]
    return days.withColumn("f", F.explode(F.array(*forecasts))).select("fold", "level", "key", "f.method", "h", "y", "f.yhat")
