"""Sections of the pricing report: figures (section, cat_id, figure, value) from tables of fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.operators.elasticity import shrink


def _figures(df: DataFrame, section: str, **values: Column) -> DataFrame:
    """A row per category and figure; figures without a value are left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), v.cast("double").alias("value")) for n, v in values.items()])).alias("f")
    return df.select(F.lit(section).alias("section"), "cat_id", pairs).select("section", "cat_id", "f.figure", "f.value").where("value IS NOT NULL")


def heterogeneity(item_fits: DataFrame) -> DataFrame:
    """Is pricing below the category estimable: items, the spread of raw and of shrunk slopes, and the mean squared error's share of the raw spread."""
    fitted = shrink(item_fits.where("status = 'fitted' AND se IS NOT NULL"))
    per = fitted.groupBy("cat_id").agg(
        F.count("*").alias("n"), F.avg("estimate").alias("mean"), F.stddev_samp("estimate").alias("raw"), F.stddev_samp("shrunk").alias("shrunk"),
        F.avg(F.col("se") * F.col("se")).alias("noise"), F.var_samp("estimate").alias("var"),
    )
    noise = F.least(F.lit(1.0), F.try_divide("noise", F.nullif("var", F.lit(0.0))))
    return _figures(per, "heterogeneity", items=F.col("n"), category_mean=F.col("mean"), sd_raw=F.col("raw"), sd_shrunk=F.col("shrunk"), noise_share=noise)


def segments(segment_fits: DataFrame) -> DataFrame:
    """Slopes of promoted and shelf weeks, of fast and slow items, and the difference within each pair."""
    of = lambda name: F.max(F.when((F.col("segment") == name) & (F.col("status") == "fitted"), F.col("estimate")))
    names = ("promo_weeks", "shelf_weeks", "high_volume", "low_volume")
    per = segment_fits.groupBy("cat_id").agg(*[of(n).alias(n) for n in names])
    pairs = {"promo_less_shelf": F.col("promo_weeks") - F.col("shelf_weeks"), "high_less_low": F.col("high_volume") - F.col("low_volume")}
    return _figures(per, "segments", **{n: F.col(n) for n in names}, **pairs)


def rivals(cross_fits: DataFrame) -> DataFrame:
    """Own and rivals' slopes of spec G, what leaving out weekdays and events does to the rivals' (H), and the rivals to the own (I)."""
    of = lambda spec, c: F.max(F.when((F.col("spec") == spec) & (F.col("status") == "fitted"), F.col(c)))
    asked = {"own": ("G", "estimate"), "cross": ("G", "cross"), "cross_se": ("G", "cross_se"), "plain_cross": ("H", "cross"), "own_without_rivals": ("I", "estimate")}
    per = cross_fits.groupBy("cat_id").agg(*[of(*source).alias(name) for name, source in asked.items()])
    attenuation = 1 - F.try_divide("plain_cross", F.nullif("cross", F.lit(0.0)))
    kept = {c: F.col(c) for c in asked if c != "plain_cross"}
    return _figures(per, "rivals", **kept, attenuation=attenuation, absorbed=F.col("own_without_rivals") - F.col("own"))
