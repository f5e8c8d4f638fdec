"""Features of the target and of prices, from the days with sales alone.

A day without sales is a zero that no row holds. Frames are ranges of day numbers over the rows there are; how many days
a frame has, the empty ones included, follows from the day and the first day of the panel. So a store x item series costs
its sales and the rows that are asked about, and no grid of series x days is made. Results are those of features.py on the
dense panel.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.features import LAGS, SERIES, WINDOWS, _weighted
from demandloom.operators.panel import HORIZON


def asked_days(panel: DataFrame, since: datetime.date, until: datetime.date) -> DataFrame:
    """(level, key, date): every series of the panel on every day from since to until."""
    days = F.explode(F.sequence(F.lit(since), F.lit(until))).alias("date")
    return panel.select(*SERIES).distinct().select(*SERIES, days)


def target_features(panel: DataFrame, asked: DataFrame, first: datetime.date) -> DataFrame:
    """asked (level, key, date, unique) with y, lags, rolling means and deviations, zero_share_56 and dow_mean_4w.

    panel: (level, key, date, y), a row per series and day with sales; first: the panel's first day, before which nothing
    is known. y of an asked day without sales is 0.
    """
    t = F.datediff("date", F.lit(first))
    looked_back = asked.agg(F.date_sub(F.min("date"), max(*LAGS, HORIZON + max(WINDOWS))).alias("since"))
    rows = panel.crossJoin(F.broadcast(looked_back)).where("date >= since").select(*SERIES, "date", "y", F.lit(False).alias("asked"))
    both = rows.unionByName(asked.select(*SERIES, "date", F.lit(None).cast("double").alias("y"), F.lit(True).alias("asked"))).withColumn("t", t)
    w = Window.partitionBy(*SERIES).orderBy("t")
    over = lambda c, a, b: F.coalesce(c.over(w.rangeBetween(-a, -b)), F.lit(0.0))
    y, day = F.col("y"), F.col("t")
    known = lambda k: F.when(day >= k, over(F.sum(y), k, k))
    out: dict[str, Column] = {"y0": over(F.sum(y), 0, 0), **{f"lag_{k}": known(k) for k in LAGS}}
    for n in WINDOWS:
        a, b = HORIZON + n - 1, HORIZON
        size = F.greatest(F.lit(0), F.least(F.lit(n), day - HORIZON + 1)).cast("double")
        total, square = over(F.sum(y), a, b), over(F.sum(y * y), a, b)
        enough = size >= max(2, n // 4)
        out[f"rmean_{n}"] = F.when(enough, total / size)
        out[f"rstd_{n}"] = F.when(enough, F.sqrt(F.greatest(square - total * total / size, F.lit(0.0)) / (size - 1)))
        if n == 56:
            sold = over(F.sum(F.when(y != 0, 1.0)), a, b)
            out["zero_share_56"] = F.when(size >= 14, (size - sold) / F.least(F.lit(56), day + 1))
    weeks = [HORIZON + 7 * k for k in range(4)]
    seen = sum((F.when(day >= k, 1).otherwise(0) for k in weeks), F.lit(0))
    same = sum((over(F.sum(y), k, k) for k in weeks), F.lit(0.0))
    out["dow_mean_4w"] = F.when(seen >= 2, same / seen)
    found = both.withColumns(out).where("asked")
    return found.select(*SERIES, "date", F.col("y0").alias("y"), *[c for c in out if c != "y0"])


def price_features(panel: DataFrame, asked: DataFrame, first: datetime.date) -> DataFrame:
    """asked (level, key, date, unique) with price, promo, price_rel_56, price_chg_7 and log_price, as of the dense panel.

    panel: (level, key, date, y, revenue, price_sum, promo_sum, n), a row per series and day with sales. A day's price is
    its plain mean, scaled as in features.exogenous; it holds until the next sale, the first one also before itself. The
    sum of prices up to a day follows from the sums at the sales, so a mean over days is a difference of two such sums.
    """
    w = Window.partitionBy(*SERIES).orderBy("t")
    then = w.rangeBetween(-HORIZON, -HORIZON)
    sold = panel.where("n > 0").withColumn("t", F.datediff("date", F.lit(first)))
    weight = _weighted({c: F.sum(c).over(then) for c in ("revenue", "y", "price_sum", "n")})
    sold = sold.withColumn("p", F.col("price_sum") / F.col("n") * weight).where("p IS NOT NULL")
    before, gap = F.lag("p").over(w), F.col("t") - F.lag("t").over(w) - 1
    step = F.coalesce(before * gap, F.col("p") * F.col("t")) + F.col("p")
    sold = sold.withColumn("step", step)
    sold = sold.withColumn("upto", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    event = F.struct("t", "p", "upto", (F.col("promo_sum") / F.col("n")).alias("promo"))
    events = sold.select(*SERIES, "t", F.lit(None).cast("date").alias("date"), F.lit(-1).alias("back"), event.alias("e"))
    points = asked.select(*SERIES, "date", F.explode(F.array(*[F.lit(k) for k in (0, 7, 56)])).alias("back"))
    points = points.withColumn("t", F.datediff("date", F.lit(first)) - F.col("back")).where("t >= 0")
    both = events.unionByName(points, allowMissingColumns=True)
    in_order = Window.partitionBy(*SERIES).orderBy("t", "back")
    last = F.last("e", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    lead = F.first(F.col("e")["p"], ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = both.withColumns({"last": last, "lead": lead}).where("back >= 0")
    price = F.coalesce(F.col("last.p"), F.col("lead"))
    total = F.coalesce(F.col("last.upto") + F.col("last.p") * (F.col("t") - F.col("last.t")), F.col("lead") * (F.col("t") + 1))
    at = lambda k, c: F.max(F.when(F.col("back") == k, c))
    per = met.groupBy(*SERIES, "date").agg(
        at(0, price).alias("price"), at(0, total).alias("c0"), at(56, total).alias("c56"), at(7, price).alias("price7"), at(0, F.col("t")).alias("t"),
        at(0, F.when(F.col("last.t") == F.col("t"), F.col("last.promo"))).alias("promo"),
    )
    days = F.least(F.lit(56), F.col("t") + 1)
    mean = (F.col("c0") - F.coalesce("c56", F.lit(0.0))) / days
    return per.select(
        *SERIES, "date", "price", F.coalesce("promo", F.lit(0.0)).alias("promo"), F.when(days >= 7, F.try_divide("price", mean)).alias("price_rel_56"),
        (F.try_divide("price", "price7") - 1).alias("price_chg_7"), F.ln(F.greatest("price", F.lit(0.01))).alias("log_price"),
    )
