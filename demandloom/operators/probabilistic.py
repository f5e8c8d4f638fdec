"""Joint samples: draws at the bottom, summed up the hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators.reconcile import bottom_up


def reconcile_draws(edge: DataFrame, draws: DataFrame, *by: str) -> DataFrame:
    """(level, key, sample, by..., value) from bottom draws (bkey, sample, by..., value): coherent draw by draw."""
    return bottom_up(edge, draws, "sample", *by)


def sample_quantiles(draws: DataFrame, taus: tuple[float, ...], *by: str) -> DataFrame:
    """(level, key, by..., q): interpolated quantiles over samples, in the order of taus."""
    return draws.groupBy("level", "key", *by).agg(F.percentile("value", F.array(*[F.lit(t) for t in taus])).alias("q"))


def level_ratios(draws: DataFrame, bottom_level: str, tau: float) -> DataFrame:
    """(level, q95, ratio, gap): sum of own quantiles by level, the bottom's sum over it, and the difference."""
    q = sample_quantiles(draws, (tau,)).withColumn("own", F.col("q")[0])
    child = q.where(F.col("level") == bottom_level).agg(F.sum("own").alias("child"))
    own = q.groupBy("level").agg(F.sum("own").alias("q95"))
    return own.crossJoin(F.broadcast(child)).select("level", "q95", F.try_divide("child", F.nullif("q95", F.lit(0.0))).alias("ratio"), (F.col("q95") - F.col("child")).alias("gap"))


def coherence_gap(edge: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Over rows (level, key, value): largest and mean excess of summed bottom quantiles over own ones, and the share above 1e-9."""
    bottom = quantiles.select(F.col("key").alias("bkey"), "value").join(edge.select("bkey").distinct(), "bkey")
    summed = bottom_up(edge, bottom).withColumnRenamed("value", "child")
    gap = summed.join(quantiles, ["level", "key"]).withColumn("gap", F.col("child") - F.col("value"))
    return gap.agg(F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.avg((F.col("gap") > 1e-9).cast("double")).alias("share_incoherent"))


def nearest_psd(c, floor: float = 1e-8):
    """A symmetric matrix with its eigenvalues raised to the floor, for covariances that come from elsewhere."""
    import numpy as np

    values, vectors = np.linalg.eigh((c + c.T) / 2)
    return vectors @ np.diag(np.clip(values, floor, None)) @ vectors.T


def bottom_samples(points: DataFrame, tails: DataFrame, samples: int = 500, shrink: float = 0.2, seed: int = 7, length: int = 180) -> DataFrame:
    """(bkey, h, sample, value): Gaussian draws around points (bkey, h, value) with the residuals' shrunk correlation, for any number of series.

    tails: (bkey, tail) residuals of `length` days. With the standardised residuals R (series x days), a draw is
    sd * (sqrt(1 - shrink) R z / sqrt(days) + sqrt(shrink) e): its correlation is the residuals', shrunk towards none. The
    days' z belong to the sample and the day of the horizon and are made alike in every task, e to the series as well; so
    no correlation matrix is formed, none must be made definite, and a lost task is redone alike. Draws are not negative;
    a series without spread keeps its points. Points without a tail are not drawn.
    """
    import hashlib

    import numpy as np
    import pandas as pd

    days_of = points.groupBy("bkey").agg(F.sort_array(F.collect_list(F.struct("h", "value"))).alias("p")).select("bkey", F.col("p.h").alias("h"), F.col("p.value").alias("value"))
    per = days_of.join(tails.select("bkey", "tail"), "bkey")
    common, own = float(np.sqrt(1 - shrink)), float(np.sqrt(shrink))

    def draw(batches):
        days: dict[int, np.ndarray] = {}
        for pdf in batches:
            for key, hs, values, tail in zip(pdf["bkey"], pdf["h"], pdf["value"], pdf["tail"], strict=True):
                r = np.asarray(tail, float) - np.mean(tail)
                sd = r.std()
                mine = np.random.default_rng([seed, int.from_bytes(hashlib.sha256(key.encode()).digest()[:8])])
                for h, value in zip(hs, values, strict=True):
                    if h not in days:
                        days[h] = np.random.default_rng([seed, int(h)]).standard_normal((samples, length))
                    noise = common * (days[h] @ r) / np.sqrt(length) + own * sd * mine.standard_normal(samples)
                    yield pd.DataFrame({"bkey": key, "h": np.int32(h), "sample": np.arange(samples), "value": np.maximum(0.0, value + noise)})

    return per.mapInPandas(draw, "bkey string, h int, sample long, value double")
