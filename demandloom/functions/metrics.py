"""Accuracy metrics as aggregate expressions, and intermittency classes. No percentage error divides by single actuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADI_CUT, CV2_CUT = 1.32, 0.49
SEASON = 7


def wmape(y: str = "y", yhat: str = "yhat") -> Column:
    """Sum of absolute errors over sum of absolute actuals; null if that is 0. Of a group: ratio of sums, no mean of ratios."""
    return F.try_divide(F.sum(F.abs(F.col(y) - F.col(yhat))), F.sum(F.abs(F.col(y))))


def bias(y: str = "y", yhat: str = "yhat") -> Column:
    """Sum of (forecast - actual) over sum of absolute actuals: positive is over-forecast."""
    return F.try_divide(F.sum(F.col(yhat) - F.col(y)), F.sum(F.abs(F.col(y))))


def seasonal_scale(history: DataFrame, *keys: str) -> DataFrame:
    """Per series: mean absolute and mean squared seasonal difference; null for a series of a season or less."""
    d = F.col("y") - F.lag("y", SEASON).over(Window.partitionBy(*keys).orderBy("date"))
    return history.withColumn("d", d).groupBy(*keys).agg(F.avg(F.abs("d")).alias("scale_abs"), F.avg(F.col("d") * F.col("d")).alias("scale_sq"))


def mase(scale: Column, y: str = "y", yhat: str = "yhat") -> Column:
    return F.try_divide(F.avg(F.abs(F.col(y) - F.col(yhat))), F.nullif(F.max(scale), F.lit(0.0)))


def rmsse(scale: Column, y: str = "y", yhat: str = "yhat") -> Column:
    e = F.col(y) - F.col(yhat)
    return F.sqrt(F.try_divide(F.avg(e * e), F.nullif(F.max(scale), F.lit(0.0))))


def adi_cv2(panel: DataFrame, *keys: str) -> DataFrame:
    """Per series: adi (rows per non-zero row), cv2 (population), class. Without sales: adi null (infinite), cv2 0."""
    sold = F.when(F.col("y") != 0, F.col("y"))
    out = panel.groupBy(*keys).agg(F.try_divide(F.count("*").cast("double"), F.count(sold)).alias("adi"), F.coalesce(F.pow(F.try_divide(F.stddev_pop(sold), F.avg(sold)), 2), F.lit(0.0)).alias("cv2"))
    return out.withColumn("class", demand_class(F.col("adi"), F.col("cv2")))


def sparse_adi_cv2(panel: DataFrame, span: DataFrame, *keys: str) -> DataFrame:
    """adi_cv2 of every series of panel before an origin, from its days with sales: span has one row (origin, days), the days before it."""
    sold = F.when((F.col("date") < F.col("origin")) & (F.col("y") != 0), F.col("y"))
    per = panel.crossJoin(F.broadcast(span)).groupBy(*keys).agg(F.first("days").cast("double").alias("days"), F.count(sold).alias("n"), F.stddev_pop(sold).alias("sd"), F.avg(sold).alias("mean"))
    out = per.select(*keys, F.try_divide("days", "n").alias("adi"), F.coalesce(F.pow(F.try_divide("sd", "mean"), 2), F.lit(0.0)).alias("cv2"))
    return out.withColumn("class", demand_class(F.col("adi"), F.col("cv2")))


def demand_class(adi: Column, cv2: Column) -> Column:
    """A null interval counts as infinite, so an all-zero series is intermittent."""
    rare = F.coalesce(adi >= ADI_CUT, F.lit(True))
    return F.when(~rare & (cv2 < CV2_CUT), "smooth").when(~rare, "erratic").when(cv2 < CV2_CUT, "intermittent").otherwise("lumpy")


def gap_summary(panel: DataFrame, *keys: str) -> DataFrame:
    """zero_share, median_adi (mean gap between sales), median_cv2, series, days: medians over series with two sales."""
    w = Window.partitionBy(*keys).orderBy("date")
    rows = panel.withColumn("i", F.row_number().over(w))
    sold = rows.where("y > 0").withColumn("gap", F.col("i") - F.lag("i").over(w))
    per = sold.groupBy(*keys).agg(F.avg("gap").alias("adi"), F.pow(F.stddev_pop("y") / F.avg("y"), 2).alias("cv2"), F.count("*").alias("n")).where("n >= 2")
    whole = panel.agg(F.avg((F.col("y") == 0).cast("double")).alias("zero_share"), F.count_distinct(*keys).alias("series"), F.count_distinct("date").alias("days"))
    return whole.crossJoin(per.agg(F.median("adi").alias("median_adi"), F.median("cv2").alias("median_cv2")))


def autocorrelation(x: str, lag: int, *order: str) -> Column:
    """corr of a series with itself so many rows earlier, over a lagged column made by with_lag."""
    return F.corr(x, f"{x}_lag{lag}")
