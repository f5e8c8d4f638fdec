"""Price response with series effects absorbed, from the sales alone: no dummy per series, no row per empty day.

A series is given by its stretches: periods [t0, t1) over which its price and promotion stay the same. A period with sales
is a stretch of its own; the empty periods between two sales are one, at the price carried over. All series share the
calendar, whose effects (week of the year, weekday, event) follow from the period.

Poisson: given the slopes, the effect of a series is the log of its sales over what it would sell without one, so it drops
out of the equations exactly. Each round of Newton's method needs, per group, only sums over slopes and calendar effects;
empty periods enter them through prefix sums over the calendar. Each task sums its series, Spark adds up the tasks, and the
driver solves for the slopes: what reaches it has the square of the calendar's effects per group, however many series
there are. Errors are robust to heteroskedasticity (HC0) and equal those of the regression with a dummy per series.

Gaussian: least squares with or without series means taken out, by the same sums in one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.operators.panel import event_of
from demandloom.sources.store import written

LEAST_ROWS = 60
ROUNDS = 50
SETTLED = 1e-8
#: The longest step of a slope in one round.
LONGEST_STEP = 3.0
FIT = "estimate double, se double, cross double, cross_se double, n long, status string"
#: A matrix of series x periods is multiplied faster than stretches are gathered from so many stretches in this many periods on.
MATRIX_GAIN = 20
#: Series x periods, and stretches, that a task works on at a time.
CELLS_AT_ONCE, STRETCHES_AT_ONCE = 2_000_000, 100_000
#: Effects of the calendar; the first level of each, in order, is the reference. snap: the first ten days of a month.
EFFECTS = {"woy": F.weekofyear, "dow": F.weekday, "event": event_of, "snap": lambda d: (F.dayofmonth(d) <= 10).cast("int")}


def stretches(panel: DataFrame, series: list[str], periods: int) -> DataFrame:
    """series, t0, t1, units, price, promo from (series, t, units, price, promo), one row per series and period with sales.

    Between sales the last price holds, without promotion; before the first sale the first one. Rows outside
    0 <= t < periods, or without a price, are not taken.
    """
    w = Window.partitionBy(*series).orderBy("t")
    kept = panel.where((F.col("t") >= 0) & (F.col("t") < periods) & F.col("price").isNotNull())

    def part(a: Column, b: Column, units: Column, promo: Column) -> Column:
        values = {"units": units, "price": F.col("price"), "promo": promo}
        return F.struct(a.cast("int").alias("t0"), b.cast("int").alias("t1"), *[v.cast("double").alias(n) for n, v in values.items()])

    t, none = F.col("t"), F.lit(0.0)
    head = part(F.when(F.lag("t").over(w).isNull(), F.lit(0)).otherwise(t), t, none, none)
    gap = part(t + 1, F.coalesce(F.lead("t").over(w), F.lit(periods)), none, none)
    rows = kept.select(*series, F.array(head, part(t, t + 1, F.col("units"), F.col("promo")), gap).alias("parts"))
    return rows.select(*series, F.explode(F.filter("parts", lambda s: s["t0"] < s["t1"])).alias("s")).select(*series, "s.*")


def with_rivals(pieces: DataFrame, place: list[str], item: str, periods: int) -> DataFrame:
    """pieces cut where any price of their place (store, department) changes, with rival_log_rel.

    It is the mean, over the other items of the place, of log price over the item's median price of all its days and
    places; 0 for an item alone.
    """
    days = (F.col("t1") - F.col("t0")).cast("long")
    base = pieces.groupBy(item).agg(F.percentile("price", 0.5, days).alias("base"))
    own = pieces.join(base, item).withColumn("log_rel", F.ln(F.greatest("price", F.lit(0.01)) / F.greatest("base", F.lit(0.01)))).drop("base")
    by_place = Window.partitionBy(*place).orderBy("t0")
    steps = own.select(*place, "t0").distinct().withColumn("t1", F.coalesce(F.lead("t0").over(by_place), F.lit(periods)))
    spine = steps.join(own.select(*place, item).distinct(), place)
    held = F.struct(*[c for c in own.columns if c not in (*place, item, "t0", "t1")])
    met = spine.join(own.select(*place, item, "t0", held.alias("s")), [*place, item, "t0"], "left")
    met = met.withColumn("s", F.last("s", ignorenulls=True).over(Window.partitionBy(*place, item).orderBy("t0"))).select(*place, item, "t0", "t1", "s.*")
    w = Window.partitionBy(*place, "t0")
    others = F.count("log_rel").over(w) - 1
    return met.withColumn("rival_log_rel", F.when(others > 0, (F.sum("log_rel").over(w) - F.col("log_rel")) / others).otherwise(0.0))


def calendar_effects(spark: SparkSession, first: Column, periods: int, step: int, effects: tuple[str, ...]) -> np.ndarray:
    """Indicators (periods x levels without the first of each effect) of the periods, `step` days apart, from a date on."""
    days = spark.range(periods).select(F.date_add(first, (F.col("id") * step).cast("int")).alias("d"), "id").orderBy("id")
    rows = days.select(*[EFFECTS[e](F.col("d")).alias(e) for e in effects]).toPandas() if effects else pd.DataFrame(index=range(periods))
    parts = [pd.get_dummies(rows[e], drop_first=True).to_numpy(float) for e in effects]
    return np.concatenate(parts, 1) if parts else np.zeros((periods, 0))


class Stretches:
    """The stretches of whole series, one after the other: x (stretches x slopes), y, t0, t1, and where each series begins."""

    def __init__(self, pdf: pd.DataFrame, columns: list[str]):
        sizes = pdf["t0"].map(len).to_numpy()
        joined = {c: np.concatenate(pdf[c].to_list()).astype(float) if len(pdf) else np.zeros(0) for c in ("t0", "t1", "y", *columns)}
        self.t0, self.t1, self.y = joined["t0"].astype(int), joined["t1"].astype(int), joined["y"]
        self.x = np.stack([joined[c] for c in columns], 1)
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.series = np.repeat(np.arange(len(sizes)), sizes)

    def products(self, x: np.ndarray, weight: np.ndarray, day: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over all periods of the stretches: sum of w z z', and by series the sums of w z and of w.

        w = weight of the stretch x day of the period; z = x of the stretch and c of the period.
        """
        t0, t1, periods = self.t0, self.t1, len(day)
        days = np.concatenate(([0.0], np.cumsum(day)))
        total = weight * (days[t1] - days[t0])
        sums = np.concatenate((np.add.reduceat(x * total[:, None], self.starts), self._by_series(weight, c * day[:, None])), 1)
        level = lambda v: np.cumsum(np.bincount(t0, v, periods + 1) - np.bincount(t1, v, periods + 1))[:periods] * day
        cross = np.stack([level(weight * x[:, j]) for j in range(x.shape[1])]) @ c
        square = np.block([[(x * total[:, None]).T @ x, cross], [cross.T, (c * level(weight)[:, None]).T @ c]])
        return square, sums, np.add.reduceat(total, self.starts)

    def _by_series(self, weight: np.ndarray, effects: np.ndarray) -> np.ndarray:
        """By series the sum of weight x effects over its periods: from sums up to each period where stretches are few, else day by day."""
        t0, t1, n, periods = self.t0, self.t1, len(self.starts), len(effects)
        if len(t0) * MATRIX_GAIN < n * periods:
            upto = np.concatenate((np.zeros((1, effects.shape[1])), np.cumsum(effects, 0)))
            return np.add.reduceat(weight[:, None] * (upto[t1] - upto[t0]), self.starts)
        length = t1 - t0
        before = np.concatenate(([0], np.cumsum(length)))[:-1]
        by_day = np.zeros(n * periods)
        by_day[np.repeat(self.series * periods + t0 - before, length) + np.arange(length.sum())] = np.repeat(weight, length)
        return by_day.reshape(n, periods) @ effects

    def poisson(self, slopes: np.ndarray, c: np.ndarray, last: bool) -> tuple[np.ndarray, np.ndarray]:
        """(information, score) of the slopes with series effects at their best; last: the score's outer products instead."""
        k, y = self.x.shape[1], self.y
        day, base = np.exp(np.clip(c @ slopes[k:], -30, 30)), np.exp(np.clip(self.x @ slopes[:k], -30, 30))
        days = np.concatenate(([0.0], np.cumsum(day)))
        sold = np.add.reduceat(y, self.starts)
        free = np.add.reduceat(base * (days[self.t1] - days[self.t0]), self.starts)
        weight = base * (sold / free)[self.series]
        square, sums, _ = self.products(self.x, weight, day, c)
        some = sold > 0
        score = np.concatenate((y @ self.x, y @ c[self.t0])) - sums[some].sum(0)
        if not last:
            return square - (sums[some] / sold[some, None]).T @ sums[some], score
        mean = sums / np.where(some, sold, 1.0)[:, None]
        empty = y == 0
        a0, g0, n0 = self.products(self.x, np.where(empty, weight**2, 0.0), day**2, c)
        a1, g1, n1 = self.products(self.x, np.where(empty, 0.0, (y - weight * day[self.t0]) ** 2), np.ones(len(day)), c)
        g, n = g0 + g1, n0 + n1
        return a0 + a1 - g.T @ mean - mean.T @ g + (mean * n[:, None]).T @ mean, score

    def demeaned(self, absorb: bool) -> tuple[np.ndarray, np.ndarray]:
        """x and y less their series' mean over its periods; else x after a constant, and y."""
        if not absorb:
            return np.concatenate((np.ones((len(self.y), 1)), self.x), 1), self.y
        days = (self.t1 - self.t0).astype(float)
        both = np.concatenate((self.x, self.y[:, None]), 1)
        mean = np.add.reduceat(both * days[:, None], self.starts) / np.add.reduceat(days, self.starts)[:, None]
        both = both - mean[self.series]
        return both[:, :-1], both[:, -1]

    def gaussian(self, slopes: np.ndarray | None, c: np.ndarray, absorb: bool) -> tuple[np.ndarray, np.ndarray]:
        """(X'X, X'y), or with slopes the residuals' outer products of X and no score; effects of the calendar stay as they are."""
        x, y = self.demeaned(absorb)
        one, k = np.ones(len(c)), x.shape[1]
        if slopes is None:
            square, _, _ = self.products(np.concatenate((x, y[:, None]), 1), np.ones(len(y)), one, c)
            keep = [*range(k), *range(k + 1, square.shape[0])]
            return square[np.ix_(keep, keep)], square[keep, k]
        fixed, moving = y - x @ slopes[:k], c @ slopes[k:]
        terms = ((fixed**2, one), (-2 * fixed, moving), (np.ones(len(y)), moving**2))
        return sum(self.products(x, weight, day, c)[0] for weight, day in terms), np.zeros(len(slopes))


def _portions(pdf: pd.DataFrame, periods: int) -> Iterator[pd.DataFrame]:
    """Some series at a time, so that what a task holds is bounded."""
    series = max(1, CELLS_AT_ONCE // max(1, periods))
    upto = pdf["t0"].map(len).cumsum().to_numpy() // STRETCHES_AT_ONCE
    number = np.arange(len(pdf)) // series
    for _, some in pdf.groupby([upto, number], sort=False):
        yield some


def _sums(s: Stretches, family: str, slopes: np.ndarray | None, c: np.ndarray, last: bool, absorb: bool) -> tuple[np.ndarray, np.ndarray]:
    return s.poisson(slopes, c, last) if family == "poisson" else s.gaussian(slopes if last else None, c, absorb)


def _solve(sums, groups: list, width: int, family: str) -> dict:
    """{group: (slopes, errors, settled)}; sums(slopes by group, last) gives (square, score) by group."""
    slopes = {g: np.zeros(width) for g in groups}
    active, bread, settled = dict(slopes), {}, dict.fromkeys(groups, False)
    for _ in range(ROUNDS if family == "poisson" else 1):
        for g, (square, score) in (sums(active, False) if active else {}).items():
            bread[g] = np.linalg.pinv(square, rcond=1e-11, hermitian=True)
            step = bread[g] @ score
            longest = np.abs(step).max()
            slopes[g] = slopes[g] + (step if family == "gaussian" else step * min(1.0, LONGEST_STEP / max(longest, 1e-300)))
            settled[g] = bool(longest < SETTLED) or family == "gaussian"
        active = {g: slopes[g] for g in active if not settled[g]}
    meat = sums(slopes, True) if groups else {}
    return {g: (slopes[g], np.sqrt(np.clip(np.diag(bread[g] @ meat[g][0] @ bread[g]), 0, None)), settled[g]) for g in groups}


def _arrays(pieces: DataFrame, by: list[str], series: list[str], y: str, columns: list[str]) -> DataFrame:
    """A row per series of a group, with its stretches as arrays in the order of time; a null in by, y or a slope drops a stretch."""
    numbers = [F.col(c).cast("double").alias(n) for c, n in ((y, "y"), *((c, c) for c in columns))]
    whole = pieces.dropna("any", subset=[*by, y, *columns]).select(*by, *[s for s in series if s not in by], "t0", "t1", *numbers)
    rows = F.sort_array(F.collect_list(F.struct("t0", "t1", "y", *columns)))
    return whole.groupBy(*by, *[s for s in series if s not in by]).agg(rows.alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in ("t0", "t1", "y", *columns)])


def _status(n: int, spread: float, sold: float, least: int) -> str | None:
    if n < least:
        return "few rows"
    if sold == 0:
        return "no sales"
    return None if spread >= 1e-9 else "no price variation"


def _found(solved: tuple, first: int, rival: int | None) -> tuple[list[float | None], str]:
    slopes, errors, settled = solved
    cross = [None, None] if rival is None else [float(slopes[rival]), float(errors[rival])]
    return [float(slopes[first]), float(errors[first]), *cross], "fitted" if settled else "not settled"


def fit_groups(
    pieces: DataFrame, by: list[str], series: list[str], c: np.ndarray, y: str = "units", regressors: tuple[str, ...] = ("log_p", "promo"),
    rival: str | None = None, family: str = "poisson", absorb: bool = True, least: int = LEAST_ROWS,
) -> DataFrame:
    """(by..., estimate, se, cross, cross_se, n, status) of few groups of any number of series: the first slope, and the rival's.

    pieces: by, series, t0, t1, y and regressors; c: effects of the periods. n counts periods. A group of fewer than
    least, or whose price never changes, has null estimates and a status that says so; one whose rounds did not settle
    has its last estimates and 'not settled'; the others are 'fitted'. Series without sales say nothing to a Poisson fit.
    """
    columns = [*regressors, *([rival] if rival else [])]
    table = written(_arrays(pieces, by, series, y, columns), "stretches")
    spark, n_rows = pieces.sparkSession, F.aggregate(F.zip_with("t1", "t0", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, v: s + v)
    price = F.col(columns[0])
    spread = F.max(F.array_max(price)) - F.min(F.array_min(price))
    facts = table.groupBy(*by).agg(F.sum(n_rows).alias("n"), spread.alias("spread"), F.max(F.array_max("y")).alias("sold")).collect()
    status = {tuple(r[b] for b in by): _status(r["n"], r["spread"] or 0.0, r["sold"], least) for r in facts}
    head = table.select(*by).schema
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in head)
    width = len(columns) + c.shape[1] + (0 if absorb else 1)
    shared = spark.sparkContext.broadcast(c)

    def sums(slopes: dict[tuple, np.ndarray], last: bool) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for g, part in pdf.groupby(by, sort=False, dropna=False):
                    for some in _portions(part, len(shared.value)) if g in slopes else ():
                        square, score = _sums(Stretches(some, columns), family, slopes[g], shared.value, last, absorb)
                        total[g] = total.get(g, 0.0) + np.concatenate((square.ravel(), score))
            for g, got in total.items():
                yield pd.DataFrame({**{b: [v] * len(got) for b, v in zip(by, g, strict=True)}, "at": np.arange(len(got)), "value": got})

        added = table.mapInPandas(run, f"{names}, at int, value double").groupBy(*by, "at").agg(F.sum("value").alias("value")).toPandas()
        out = {}
        for g, part in added.groupby(by, sort=False, dropna=False):
            flat = part.sort_values("at")["value"].to_numpy()
            out[g] = flat[: width * width].reshape(width, width), flat[width * width :]
        return out

    solved = _solve(sums, [g for g, s in status.items() if s is None], width, family)
    first = 0 if absorb else 1
    rows = []
    for r in facts:
        g = tuple(r[b] for b in by)
        values, said = _found(solved[g], first, first + len(regressors) if rival else None) if g in solved else ([None] * 4, status[g])
        rows.append((*g, *values, r["n"], said))
    return spark.createDataFrame(rows, f"{names}, {FIT}")


def fit_each(
    pieces: DataFrame, by: list[str], series: list[str], c: np.ndarray, y: str = "units", regressors: tuple[str, ...] = ("log_p", "promo"), least: int = LEAST_ROWS
) -> DataFrame:
    """fit_groups for any number of groups of few series each, such as items over stores: each is solved where it is."""
    columns = list(regressors)
    table = _arrays(pieces, by, series, y, columns)
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*by).schema)
    shared = pieces.sparkSession.sparkContext.broadcast(c)
    width = len(columns) + c.shape[1]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Stretches(pdf, columns)
        n, price = int((s.t1 - s.t0).sum()), s.x[:, 0]
        said, values = _status(n, float(np.ptp(price)), float(s.y.max()), least), [None] * 4
        if said is None:
            solved = _solve(lambda slopes, last: {0: _sums(s, "poisson", slopes[0], shared.value, last, True)}, [0], width, "poisson")
            values, said = _found(solved[0], 0, None)
        kinds = [f.split()[0] for f in FIT.split(", ")]
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, **{k: pd.Series([v], dtype="float64") for k, v in zip(kinds, values)}, "n": [n], "status": [said]})

    return table.groupBy(*by).applyInPandas(fit, f"{names}, {FIT}")
