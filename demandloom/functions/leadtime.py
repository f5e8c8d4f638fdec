"""Lead-time demand: block bootstrap of standardised errors, and the shortcuts it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.functions.quantiles import normal_quantile

BLOCK = 7
LEAST_POOL = 30
#: Paths drawn for a series.
SAMPLES = 4_000


def standardised(error: Column, point: Column) -> Column:
    """Error over the root of the forecast, floored at a quarter."""
    return error / F.sqrt(F.greatest(point, F.lit(0.25)))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def hashed_start(seed: int = 17) -> Callable[[Column, Column, Column, Column], Column]:
    """Block starts from a hash of (key, sample, block): independent of partitioning."""
    return lambda key, sample, block, most: F.pmod(F.xxhash64(key, sample, block, F.lit(seed)), most)


def lcg_start(key: Column, sample: Column, block: Column, most: Column) -> Column:
    """Block starts from one step of a linear congruence, which any SQL engine can follow."""
    return F.pmod((sample * 1103515245 + block * 12345 + 20011) % 2147483648, most)


def _drawn(points: DataFrame, pools: DataFrame, length: int, samples: int) -> DataFrame:
    """A row per series and sample, with its pool of finite errors and its path by day."""
    pools = pools.withColumn("pool", F.filter("pool", finite))
    path = F.col("path") if "path" in points.columns else F.array_repeat(F.col("point"), length)
    met = points.join(pools, "key").withColumn("path", path)
    pool = F.when(F.size("pool") < LEAST_POOL, F.raise_error(F.lit(f"a pool needs {LEAST_POOL} errors"))).otherwise(F.col("pool"))
    return met.withColumn("pool", pool).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)).cast("array<bigint>")))


def _demand(day: Column, start, block: int) -> Column:
    first = start(F.col("key"), F.col("sample"), F.floor(day / block).cast("bigint"), (F.size("pool") - block + 1).cast("bigint"))
    z, p = F.element_at("pool", (first + day % block + 1).cast("int")), F.element_at("path", day + 1)
    return F.greatest(F.lit(0.0), p + z * F.sqrt(F.greatest(p, F.lit(0.25))))


def daily_paths(points: DataFrame, pools: DataFrame, length: int, samples: int, start=lcg_start, block: int = BLOCK) -> DataFrame:
    """(key, sample, day, demand): contiguous blocks of a series' standardised errors on its forecast path.

    points: (key, point) a constant forecast, or (key, path) an array by day. pools: (key, pool) arrays in time order;
    null and non-finite errors are left out, and a pool of fewer than 30 others raises. Demand is not negative.
    """
    days = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda d: _demand(d, start, block))
    return _drawn(points, pools, length, samples).select("key", "sample", F.posexplode(days).alias("day", "demand"))


def leadtime_totals(points: DataFrame, pools: DataFrame, length: int, samples: int, start=lcg_start, block: int = BLOCK) -> DataFrame:
    """(key, sample, demand): the sums of daily_paths by sample, without a row per day."""
    days = F.aggregate(F.sequence(F.lit(0), F.lit(length - 1)), F.lit(0.0), lambda a, d: a + _demand(d, start, block))
    return _drawn(points, pools, length, samples).select("key", "sample", days.alias("demand"))


def leadtime_samples(paths: DataFrame) -> DataFrame:
    return paths.groupBy("key", "sample").agg(F.sum("demand").alias("demand"))


def leadtime_quantiles(samples: DataFrame, taus: tuple[float, ...]) -> DataFrame:
    """(key, tau, quantile), linearly interpolated."""
    q = samples.groupBy("key").agg(F.percentile("demand", F.array(*[F.lit(t) for t in taus])).alias("q"))
    return q.select("key", F.posexplode("q").alias("i", "quantile")).select("key", F.element_at(F.array(*[F.lit(t) for t in taus]), F.col("i") + 1).alias("tau"), "quantile")


def iid_normal(total: Column, sigma: Column, length: Column, tau: float) -> Column:
    """Sum of the path plus the normal quantile of independent days."""
    return total + F.lit(normal_quantile(tau)) * sigma * F.sqrt(length)
