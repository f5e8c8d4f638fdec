"""Quantile forecasts: losses, coverage, crossing, rearrangement, newsvendor orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICE_LEVELS = (0.50, 0.75, 0.90, 0.95, 0.98)


def pinball(y: Column, forecast: Column, tau: Column | float) -> Column:
    """Pinball loss of one forecast."""
    tau = F.lit(tau) if isinstance(tau, float) else tau
    d = y - forecast
    return F.greatest(tau * d, (tau - 1) * d)


def covered(y: Column, forecast: Column) -> Column:
    return (y <= forecast + 1e-9).cast("double")


def implied_cost_ratio(q: Column) -> Column:
    """What a service level says about the cost of a missed unit against an unsold one."""
    q = F.greatest(F.least(q, F.lit(1 - 1e-6)), F.lit(1e-6))
    return q / (1 - q)


def newsvendor_quantile(under: Column, over: Column) -> Column:
    return F.coalesce(F.try_divide(under, F.nullif(under + over, F.lit(0.0))), F.lit(0.5))


def order_up_to(need: Column, on_hand: Column, case_pack: Column) -> Column:
    """Whole cases for what is needed beyond the stock, never negative."""
    return F.ceil(F.greatest(need - on_hand, F.lit(0.0)) / case_pack) * case_pack


def cross_scores(fan: DataFrame, taus: tuple[float, ...] = SERVICE_LEVELS) -> DataFrame:
    """fan: (y, q array in the order of taus). Each quantile scored under every tau's loss: tau, coverage, mean, pinball_<tau>."""
    rows = fan.select("y", F.posexplode("q").alias("i", "f")).withColumn("tau", F.element_at(F.array(*[F.lit(t) for t in taus]), F.col("i") + 1))
    losses = [F.avg(pinball(F.col("y"), F.col("f"), t)).alias(f"pinball_{round(100 * t)}") for t in taus]
    return rows.groupBy("tau").agg(F.avg(covered(F.col("y"), F.col("f"))).alias("coverage"), F.avg("f").alias("mean"), *losses)


def crossings(q: Column) -> Column:
    """Number of adjacent pairs of a fan that cross; null pairs do not."""
    n = F.size(q)
    gaps = F.zip_with(F.slice(q, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(q, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    return F.size(F.filter(gaps, lambda d: d < -1e-9))


def crossing_rate(fan: DataFrame) -> Column:
    """Aggregate: crossing pairs over pairs; 0 for fans of fewer than two quantiles."""
    return F.coalesce(F.try_divide(F.sum(crossings(F.col("q"))).cast("double"), F.nullif(F.sum(F.greatest(F.size("q") - 1, F.lit(0))), F.lit(0))), F.lit(0.0))


def rearranged(q: Column) -> Column:
    """The same values in order: never worse in pinball loss, and free of crossings."""
    return F.array_sort(q)


def normal_quantile(tau: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(tau)
