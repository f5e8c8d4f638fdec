"""Deciding on one belief and scoring it in another world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.operators import markdown as K


def decision_table(items: DataFrame, good: float, bad: float, worlds: dict[str, float]) -> DataFrame:
    """(cat, world, rev_none, rev_flat, rev_bad, rev_good, rev_oracle, good_vs_none_pct, bad_cost_pct, good_cost_pct).

    items: (key, cat, base_daily, ref_price, inventory). Decisions do not depend on the world, but for the oracle's;
    all are scored in one projection per world.
    """
    beliefs = {"good": good, "bad": bad, **{f"oracle_{w}": e for w, e in worlds.items()}}
    rows = items.withColumns({f"e_{n}": F.lit(e) for n, e in beliefs.items()})
    decided = items
    for n in beliefs:
        decided = decided.join(K.best_schedules(rows, f"e_{n}").select("key", F.col("depths").alias(f"d_{n}")), "key")
    flat = K.best_schedules(rows, "e_good", [(d,) * K.PHASES for d in K.DEPTHS]).select("key", F.col("depths").alias("d_flat"))
    decided = decided.join(flat, "key").withColumn("d_none", F.array(*[F.lit(0.0)] * K.PHASES))
    scored = decided.withColumn("w", F.explode(F.array(*[F.struct(F.lit(w).alias("world"), F.lit(e).alias("e"), F.col(f"d_oracle_{w}").alias("d_oracle")) for w, e in worlds.items()])))
    policies = {"none": F.col("d_none"), "flat": F.col("d_flat"), "bad": F.col("d_bad"), "good": F.col("d_good"), "oracle": F.col("w.d_oracle")}
    revenue = {f"rev_{p}": K.simulate(F.col("base_daily"), F.col("ref_price"), F.col("inventory"), F.col("w.e"), d)["revenue"] for p, d in policies.items()}
    total = scored.select("cat", "w.world", *[c.alias(n) for n, c in revenue.items()]).groupBy("cat", "world").agg(*[F.sum(n).alias(n) for n in revenue])
    share = lambda p: 100 * (1 - F.col(p) / F.col("rev_oracle"))
    return total.withColumns({"good_vs_none_pct": 100 * (F.col("rev_good") / F.col("rev_none") - 1), "bad_cost_pct": share("rev_bad"), "good_cost_pct": share("rev_good")})
