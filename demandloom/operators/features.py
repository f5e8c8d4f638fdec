"""Leakage-safe features of a dense daily panel.

Every look back at the target goes through a lag of the horizon, so a row may be used to forecast its own day from
the last day of known sales. All windows over a series share one partitioning and ordering; only the same-weekday
mean has its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.panel import EVENTS, HORIZON, dense

LAGS = (28, 29, 30, 35, 42, 56, 364)
WINDOWS = (7, 28, 56)
#: Days before an origin that the features of its horizon look back to.
LOOK_BACK = max(*LAGS, HORIZON + max(WINDOWS) + 55)
FEATURES = (
    *[f"lag_{k}" for k in LAGS], *[f"rmean_{w}" for w in WINDOWS], *[f"rstd_{w}" for w in WINDOWS],
    "zero_share_56", "dow_mean_4w", "dow", "month", "doy_sin", "doy_cos", "is_weekend", "promo", "snap", "price_rel_56", "price_chg_7", "log_price", "days_to_xmas",
    *[f"ev_{e}" for e in EVENTS],
)
SERIES = ("level", "key")


def by_date(*keys: str):
    return Window.partitionBy(*(keys or SERIES)).orderBy("date")


def lags(y: str = "y") -> dict[str, Column]:
    w = by_date()
    return {f"lag_{k}": F.lag(y, k).over(w) for k in LAGS}


def _at_least(value: Column, y: str, frame, rows: int) -> Column:
    """value, if the frame has that many known rows."""
    return F.when(F.count(y).over(frame) >= rows, value)


def rolling(y: str = "y") -> dict[str, Column]:
    """Means, sample deviations and the zero share over windows that end at the horizon's lag.

    The zero share divides by the raw window length: min(56, row number), rows before the series' first included.
    """
    out = {}
    w = by_date()
    for n in WINDOWS:
        frame = w.rowsBetween(-(HORIZON + n - 1), -HORIZON)
        out[f"rmean_{n}"] = _at_least(F.avg(y).over(frame), y, frame, max(2, n // 4))
        out[f"rstd_{n}"] = _at_least(F.stddev_samp(y).over(frame), y, frame, max(2, n // 4))
    frame = w.rowsBetween(-(HORIZON + 55), -HORIZON)
    zeros = F.sum((F.col(y) == 0).cast("double")).over(frame)
    out["zero_share_56"] = _at_least(zeros / F.least(F.lit(56), F.row_number().over(w)), y, frame, 14)
    return out


def same_weekday_mean(y: str = "y") -> Column:
    """Mean of the same weekday four to seven weeks back."""
    frame = by_date(*SERIES, "dow").rowsBetween(-7, -4)
    return _at_least(F.avg(y).over(frame), y, frame, 2)


def price_features(price: str = "price") -> dict[str, Column]:
    w = by_date()
    frame = w.rowsBetween(-55, 0)
    return {
        "price_rel_56": _at_least(F.try_divide(F.col(price), F.avg(price).over(frame)), price, frame, 7),
        "price_chg_7": F.try_divide(F.col(price), F.lag(price, 7).over(w)) - 1,
        "log_price": F.ln(F.greatest(F.col(price), F.lit(0.01))),
    }


def calendar_features() -> dict[str, Column]:
    """From date and event."""
    d = F.col("date")
    doy = F.dayofyear(d)
    return {
        "dow": F.weekday(d), "month": F.month(d),
        "doy_sin": F.sin(2 * math.pi * doy / 365.25), "doy_cos": F.cos(2 * math.pi * doy / 365.25),
        "is_weekend": F.weekday(d).isin(5, 6).cast("int"), "days_to_xmas": F.least(F.lit(45), F.abs(360 - doy)),
        **{f"ev_{e}": (F.col("event") == e).cast("byte") for e in EVENTS},
    }


def fill_price(price: str = "price", carried: Column | None = None) -> Column:
    """A missing price takes the last one before it in its series, else the carried one, else the series' first one.

    Where nothing comes before, the first one after is the first of the whole series: a frame that Spark evaluates once
    per series, whereas one from each row to the end would be walked anew for every row.
    """
    w = by_date()
    before = F.last(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return F.coalesce(before, *([] if carried is None else [carried]), F.first(price, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _weighted(then: dict[str, Column]) -> Column:
    """How the price by units related to the mean price on the day that then describes; 1 if nothing was sold."""
    by_units = F.try_divide(then["revenue"], F.nullif(then["y"], F.lit(0.0)))
    return F.coalesce(F.try_divide(by_units, F.try_divide(then["price_sum"], then["n"])), F.lit(1.0))


_WEIGHTS = ("revenue", "y", "price_sum", "n")


def prices(panel: DataFrame, weighting: str) -> DataFrame:
    """panel with the price and promo of each day that has sales."""
    plain_price, plain_promo = F.try_divide("price_sum", "n"), F.try_divide("promo_sum", "n")
    if weighting == "lagged":
        w = by_date()
        return panel.withColumns({"price": plain_price * _weighted({c: F.lag(c, HORIZON).over(w) for c in _WEIGHTS}), "promo": plain_promo})
    price = F.coalesce(F.try_divide("revenue", F.nullif("y", F.lit(0.0))), plain_price)
    return panel.withColumns({"price": price, "promo": F.coalesce(F.try_divide("promo_units", F.nullif("y", F.lit(0.0))), plain_promo)})


def exogenous(panel: DataFrame, weighting: str = "lagged") -> DataFrame:
    """price, promo and snap of every row of a dense panel with y, revenue, promo_units, price_sum, promo_sum, n.

    lagged: plain means of the day, the price scaled by how the price by units and the plain one related on the
    horizon's lag. same_day weights by the units of the day itself, as in the original system; that leaks the target
    above the bottom level.
    """
    return prices(panel, weighting).withColumn("price", fill_price()).withColumns({"promo": F.coalesce("promo", F.lit(0.0)), "snap": F.lit(0)})


def exogenous_since(sparse: DataFrame, since: DataFrame) -> DataFrame:
    """exogenous (lagged) of the dense panel from a day on, from the sparse one: since has one row (cut).

    Each series brings the last price from before the cut along; its weight is looked up on the one day that it needs.
    """
    old = sparse.crossJoin(F.broadcast(since)).where("date < cut AND n > 0")
    last = old.groupBy(*SERIES).agg(F.max("date").alias("last"), F.max_by(F.try_divide("price_sum", "n"), "date").alias("plain"))
    then = sparse.select(*SERIES, F.date_add("date", HORIZON).alias("last"), *_WEIGHTS)
    carried = last.join(then, [*SERIES, "last"], "left").select(*SERIES, (F.col("plain") * _weighted({c: F.col(c) for c in _WEIGHTS})).alias("carried"))
    # the days of one more horizon before the cut give the weights of those after it
    earlier = since.select(F.date_sub("cut", HORIZON).alias("cut"))
    panel = prices(dense(sparse, "y", "revenue", "promo_units", "price_sum", "promo_sum", "n", since=earlier), "lagged")
    rows = panel.crossJoin(F.broadcast(since)).where("date >= cut").join(carried, list(SERIES), "left")
    filled = rows.withColumn("price", fill_price(carried=F.col("carried")))
    return filled.withColumns({"promo": F.coalesce("promo", F.lit(0.0)), "snap": F.lit(0)}).drop("cut", "carried")


def add_features(panel: DataFrame) -> DataFrame:
    """All of FEATURES on rows (level, key, date, y, price, promo, snap, event)."""
    first = panel.withColumns({**lags(), **rolling(), **price_features(), **calendar_features()})
    return first.withColumn("dow_mean_4w", same_weekday_mean())


def training_rows(features: DataFrame, origin: Column) -> DataFrame:
    """Rows before the origin that have every feature, so a year of history at least."""
    return features.where(F.col("date") < origin).dropna("any", subset=[c for c in FEATURES if c in features.columns])
