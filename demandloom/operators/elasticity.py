"""Price response: rival index, shrinkage and scores; fits are in regression.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rival_index(rows: DataFrame, item: str = "item_id", price: str = "sell_price", group: tuple[str, ...] = ("date", "store_id", "dept_id")) -> DataFrame:
    """log_rel (log of price over the item's median) and rival_log_rel, its mean over the other rows of the group; 0 alone."""
    base = rows.groupBy(item).agg(F.median(price).alias("__base"))
    w = Window.partitionBy(*group)
    out = rows.join(base, item).withColumn("log_rel", F.ln(F.col(price) / F.col("__base"))).drop("__base")
    n = F.count("log_rel").over(w)
    return out.withColumn("rival_log_rel", F.when(n > 1, (F.sum("log_rel").over(w) - F.col("log_rel")) / (n - 1)).otherwise(0.0))


def ols_slope(rows: DataFrame, y: str, x: str, *by: str) -> DataFrame:
    """(by..., slope, se, n): least squares with an intercept, heteroskedasticity-robust (HC0) error, in two aggregations."""
    fit = rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.avg(x).alias("mx"), F.regr_sxx(y, x).alias("sxx"), F.count("*").alias("n"))
    e = F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)
    d = F.col(x) - F.col("mx")
    meat = rows.join(fit, list(by)).groupBy(*by).agg(F.sum(d * d * e * e).alias("meat"))
    return fit.join(meat, list(by)).where("sxx > 0").select(*by, "slope", (F.sqrt("meat") / F.col("sxx")).alias("se"), "n")


def within(rows: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """Columns less their group mean: fixed effects without dummies."""
    w = Window.partitionBy(*by)
    return rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def shrink(table: DataFrame, group: str = "cat_id") -> DataFrame:
    """shrunk: each estimate drawn to its group's mean by its own error against the spread between items.

    The spread is the estimates' sample variance less their mean squared error; none left means the group mean for all.
    """
    w = Window.partitionBy(group)
    mean = F.avg("estimate").over(w)
    tau2 = F.greatest(F.coalesce(F.var_samp("estimate").over(w), F.lit(0.0)) - F.avg(F.col("se") * F.col("se")).over(w), F.lit(0.0))
    weight = F.when(tau2 > 0, tau2 / (tau2 + F.col("se") * F.col("se"))).otherwise(0.0)
    return table.withColumn("shrunk", mean + weight * (F.col("estimate") - mean))


def score_estimates(table: DataFrame, group: str = "cat_id") -> DataFrame:
    """Raw, shrunk and group-mean estimates against truth: mae, rmse, corr_with_truth, sd, within_cat_mae, within_cat_corr."""
    w = Window.partitionBy(group)
    base = shrink(table, group).withColumn("mean", F.avg("estimate").over(w)).withColumn("dev_truth", F.col("truth") - F.avg("truth").over(w))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("estimator"), F.col(c).alias("e")) for n, c in (("raw_per_item", "estimate"), ("shrunk_to_category", "shrunk"), ("category_mean_only", "mean"))])).alias("k")
    rows = base.select(group, "truth", "dev_truth", kinds).select(group, "truth", "dev_truth", "k.*")
    rows = rows.withColumn("dev", F.col("e") - F.avg("e").over(Window.partitionBy(group, "estimator")))
    corr = lambda a, b: F.when((F.stddev_pop(a) > 1e-12) & (F.stddev_pop(b) > 1e-12), F.corr(a, b))
    err = F.col("e") - F.col("truth")
    return rows.groupBy("estimator").agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), corr("e", "truth").alias("corr_with_truth"), F.stddev_pop("e").alias("sd"),
        F.avg(F.abs(F.col("dev") - F.col("dev_truth"))).alias("within_cat_mae"), F.coalesce(corr("dev", "dev_truth"), F.lit(0.0)).alias("within_cat_corr"),
    )
