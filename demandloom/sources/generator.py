"""A synthetic panel with a planted truth, from tables of items and stores.

Everything random comes from hashes or generators seeded per key, so any partitioning gives the same panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandloom.operators.panel import calendar

#: Shares and base rates of the demand tiers, category elasticities by rank, and the panel's effects.
TIERS = (("A", 0.20, 12.0), ("B", 0.35, 4.0), ("C", 0.30, 1.2), ("D", 0.15, 0.35))
CATEGORY_ELASTICITIES = (-2.1, -1.2, -0.6)
ELASTICITY_SPREAD = 0.22
CROSS, PROMO_LIFT = 0.35, 0.35
PROMO_DEPTHS = (0.10, 0.15, 0.20, 0.25, 0.33)


def uniform(seed: str, *keys: str) -> Column:
    """A number in [0, 1) from a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def normal(seed: str, *keys: str) -> Column:
    return F.sqrt(-2 * F.ln(1 - uniform(seed + "r", *keys))) * F.cos(2 * np.pi * uniform(seed + "a", *keys))


def items(table: DataFrame) -> DataFrame:
    """item_id, dept_id, cat_id, base_price -> with tier, base_rate, cat_elasticity, elasticity, snap_sens."""
    u = uniform("tier", "item_id")
    tier, rate, edge = F.lit(TIERS[-1][0]), F.lit(TIERS[-1][2]), 1.0
    for name, share, base in reversed(TIERS[:-1]):
        edge = sum(s for n, s, _ in TIERS if n <= name)
        tier, rate = F.when(u < edge, name).otherwise(tier), F.when(u < edge, base).otherwise(rate)
    rank = F.pmod(F.crc32(F.col("cat_id").cast("binary")), F.lit(len(CATEGORY_ELASTICITIES))).cast("int")
    cat = F.element_at(F.array(*[F.lit(e) for e in CATEGORY_ELASTICITIES]), rank + 1)
    return table.withColumns({"tier": tier, "base_rate": rate * F.exp(0.3 * normal("rate", "item_id")), "cat_elasticity": cat}).withColumns({"elasticity": F.col("cat_elasticity") * F.exp(ELASTICITY_SPREAD * normal("elasticity", "item_id")), "snap_sens": 0.3 * uniform("snap", "item_id")})


def price_paths(series: DataFrame, days: int) -> DataFrame:
    """(item_id, store_id, day, price, promo): base price with resets, and weekly promotions that are likelier before demand rises."""
    schema = "item_id string, store_id string, day int, price double, promo int"

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        rng = np.random.default_rng(abs(int(row["seed"])))
        price = np.full(days, float(row["base_price"]))
        for at in sorted(rng.choice(np.arange(1, days), size=min(days - 1, int(rng.integers(3, 8))), replace=False)):
            price[at:] *= rng.uniform(0.94, 1.09)
        promo = np.zeros(days, int)
        for week in range(0, days, 7):
            z = np.cos(2 * np.pi * (week % 365) / 365.25)
            if rng.random() < np.clip(0.07 + 0.09 * z, 0.01, 0.55):
                promo[week : week + 7] = 1
                price[week : week + 7] *= 1 - rng.choice(PROMO_DEPTHS)
        return pd.DataFrame({"item_id": row["item_id"], "store_id": row["store_id"], "day": np.arange(days), "price": np.round(price, 2), "promo": promo})

    seeded = series.select("item_id", "store_id", "base_price", F.xxhash64(F.lit("path"), "item_id", "store_id").alias("seed"))
    return seeded.groupBy("item_id", "store_id").applyInPandas(path, schema)


def panel(item_table: DataFrame, stores: DataFrame, start: str, days: int) -> DataFrame:
    """The sales panel: date, store_id, state_id, item_id, dept_id, cat_id, sales, sell_price, promo, snap, event, dow.

    Demand: base x season x event x weekday x snap x price^elasticity x exp(cross x rivals) x promotion, mixed by a
    gamma and drawn as Poisson. Prices of all siblings exist before any demand is drawn.
    """
    chosen = items(item_table)
    series = chosen.crossJoin(stores.select("store_id", "state_id"))
    cal = calendar(stores.sparkSession.range(days).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date"), F.col("id").cast("int").alias("day0"))).withColumn("day0", F.datediff("date", F.lit(start).cast("date")))
    rows = price_paths(series, days).join(series, ["item_id", "store_id"]).withColumn("date", F.date_add(F.lit(start).cast("date"), F.col("day"))).join(F.broadcast(cal.drop("day", "day0")), "date")
    rel = F.ln(F.col("price") / F.col("base_price"))
    w = Window.partitionBy("date", "store_id", "dept_id")
    n = F.count(rel).over(w)
    rows = rows.withColumn("rival", F.when(n > 1, (F.sum(rel).over(w) - rel) / (n - 1)).otherwise(0.0)).withColumn("snap", (F.dayofmonth("date") <= 10).cast("int"))
    season = 1 + 0.15 * F.cos(2 * np.pi * (F.col("doy") - 340) / 365.25)
    weekday = F.when(F.col("dow") >= 5, 1.3).otherwise(0.9)
    mean = F.col("base_rate") * season * F.col("event_mult") * weekday * (1 + F.col("snap") * F.col("snap_sens")) * F.exp(F.col("elasticity") * rel) * F.exp(CROSS * F.col("rival")) * (1 + PROMO_LIFT * F.col("promo"))
    rows = rows.withColumn("mean", mean).withColumn("seed", F.xxhash64(F.lit("demand"), "item_id", "store_id"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rng = np.random.default_rng(abs(int(pdf["seed"].iloc[0])))
        pdf["sales"] = rng.poisson(pdf["mean"].to_numpy() * rng.gamma(4.0, 0.25, len(pdf))).astype("int32")
        return pdf.drop(columns=["mean", "seed"])

    kept = ["date", "store_id", "state_id", "item_id", "dept_id", "cat_id", "price", "promo", "snap", "event", "dow"]
    schema = "date date, store_id string, state_id string, item_id string, dept_id string, cat_id string, price double, promo int, snap int, event string, dow int, sales int"
    drawn = rows.select(*kept, "mean", "seed").groupBy("item_id", "store_id").applyInPandas(draw, schema)
    return drawn.withColumnRenamed("price", "sell_price")


def truth(item_table: DataFrame, sales: DataFrame) -> DataFrame:
    """One row: elasticities by category and item as maps, the planted effects, and the panel's extent."""
    chosen = items(item_table)
    maps = chosen.agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("cat_id", "cat_elasticity")))).alias("elasticity_by_category"), F.map_from_entries(F.collect_list(F.struct("item_id", "elasticity"))).alias("elasticity_by_item"))
    extent = sales.agg(F.avg((F.col("sales") == 0).cast("double")).alias("zero_share"), F.count_distinct("item_id", "store_id").alias("n_series"), F.count("*").alias("n_rows"), F.count_distinct("date").alias("days"), F.min("date").cast("string").alias("date_min"), F.max("date").cast("string").alias("date_max"))
    return maps.crossJoin(extent).withColumns({"elasticity_spread": F.lit(ELASTICITY_SPREAD), "cross_elasticity": F.lit(CROSS), "promo_display_lift": F.lit(PROMO_LIFT)})
