"""What a planner asks for, as functions from artifact tables to one row per request."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.functions import quantiles as Q
from demandloom.operators.markdown import DEPTHS, HALFLIFE, SALVAGE


def health(fans: DataFrame) -> DataFrame:
    """(status, series)."""
    return fans.agg(F.count_distinct("key").alias("series")).select(F.when(F.col("series") > 0, "ok").otherwise("missing").alias("status"), "series")


def series(fans: DataFrame, limit: int = 50) -> DataFrame:
    """The first keys in order."""
    return fans.select("key").distinct().orderBy("key").limit(limit)


def forecast(fans: DataFrame, scores: DataFrame, classes: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per key: fan (arrays by day, rearranged), class, error against the seasonal naive, overrides by day.

    fans: (key, h, mean, q); scores: (key, wmape, seasonal_wmape). vs_seasonal_naive is model less baseline here, so
    negative is good: the service's sign, which is the reverse of the report's.
    """
    rows = fans.withColumn("q", Q.rearranged(F.col("q")))
    per = rows.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("h", "mean", "q"))), lambda r: F.struct(r["mean"].alias("mean"), r["q"].alias("q"))).alias("path"))
    out = per.join(scores, "key", "left").join(classes, "key", "left").withColumn("vs_seasonal_naive", F.col("wmape") - F.col("seasonal_wmape"))
    if overrides is not None:
        days = latest_overrides(overrides).groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("horizon_day", "value")))).alias("overrides"))
        out = out.join(days, "key", "left")
    return out


def order_rules() -> dict[str, Column]:
    """What a request must satisfy; a refused one names the first that it does not."""
    return {
        "lead_time_days": F.col("lead_time_days").between(1, 28),
        "case_pack": F.col("case_pack") >= 1,
        "service_level": (F.col("service_level") > 0) & (F.col("service_level") < 1),
        "on_hand": F.col("on_hand") >= 0,
    }


def valid_orders(requests: DataFrame) -> DataFrame:
    """Requests with accepted and refused: the first of order_rules() that fails, a null included; null for accepted ones."""
    first = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in order_rules().items()])
    return requests.withColumn("refused", first).withColumn("accepted", F.col("refused").isNull())


ORDER = ("service_level_used", "implied_cost_ratio", "cover_units", "mean_units", "buffer_over_mean", "order_quantity")


def answers(fans: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per request, refused ones included: its columns, accepted, reason ('ok', a rule of order_rules() or 'unknown key') and ORDER.

    The level asked for snaps to the nearest of the five (the lower one half-way), and so does the ratio. Daily
    quantiles are summed, which takes all days to go wrong together. What is not accepted has no order; requests that
    repeat are each answered.
    """
    taus = F.array(*[F.lit(t) for t in Q.SERVICE_LEVELS])
    nearest = F.array_min(F.transform(taus, lambda t, i: F.struct(F.round(F.abs(t - F.col("service_level")), 9).alias("d"), i.alias("i"), t.alias("t"))))
    paths = fans.withColumn("q", Q.rearranged(F.col("q"))).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("h", "q", "mean"))).alias("path"))
    met = valid_orders(requests).join(paths, "key", "left").withColumn("n", nearest)
    reason = F.coalesce("refused", F.when(F.col("path").isNull(), "unknown key"), F.lit("ok"))
    met = met.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok")
    days = F.when(F.col("accepted"), F.filter("path", lambda d: d["h"] <= F.col("lead_time_days")))
    total = lambda f: F.aggregate(days, F.lit(0.0), lambda a, d: a + f(d))
    met = met.withColumn("cover_units", total(lambda d: F.get(d["q"], F.col("n.i")))).withColumn("mean_units", total(lambda d: d["mean"]))
    level = F.when(F.col("accepted"), F.col("n.t"))
    quantity = F.when(F.col("accepted"), Q.order_up_to(F.round("cover_units", 9), F.col("on_hand"), F.col("case_pack")).cast("long"))
    out = met.withColumns({"service_level_used": level, "implied_cost_ratio": Q.implied_cost_ratio(level), "buffer_over_mean": F.col("cover_units") - F.col("mean_units"), "order_quantity": quantity})
    return out.select(*requests.columns, "accepted", "reason", *ORDER)


def orders(fans: DataFrame, requests: DataFrame) -> DataFrame:
    """The accepted requests of answers() with their orders."""
    return answers(fans, requests).where("accepted").select(*requests.columns, *ORDER)


def valid_overrides(log: DataFrame) -> DataFrame:
    """Entries of an override log that count: day 0 to 27, value not negative, a reason of four characters or more."""
    return log.where(F.col("horizon_day").between(0, 27) & (F.col("value") >= 0) & (F.length("reason") >= 4))


def latest_overrides(log: DataFrame) -> DataFrame:
    """The last valid entry of each (key, day) of an append-only log; nothing is rewritten."""
    newest = F.max_by(F.struct("value", "reason", "author"), F.struct("ts", "entry"))
    return valid_overrides(log).groupBy("key", "horizon_day").agg(newest.alias("o")).select("key", "horizon_day", "o.value", "o.reason", "o.author")


def append_overrides(log: DataFrame, path: str) -> None:
    valid_overrides(log).write.mode("append").parquet(path)


def markdown_grid(items: DataFrame, weeks: int = 6) -> DataFrame:
    """(key, depth, units, revenue_index, recommended): six depths for each item (key, base_daily, elasticity, inventory)."""
    lam = math.log(2.0) / HALFLIFE
    decay = sum(math.exp(-lam * t) for t in range(weeks * 7))
    rows = items.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in DEPTHS])))
    units = F.least(F.col("base_daily") * decay * F.pow(1 - F.col("depth"), F.col("elasticity")), F.col("inventory"))
    rows = rows.withColumn("units", units).withColumn("revenue_index", F.col("units") * (1 - F.col("depth")) + SALVAGE * (F.col("inventory") - F.col("units")))
    best = F.min_by("depth", F.struct(-F.round("revenue_index", 6), F.col("depth"))).over(Window.partitionBy("key"))
    return rows.withColumn("recommended", best).select("key", "depth", "units", "revenue_index", "recommended")
