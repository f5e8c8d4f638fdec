"""Markdown decisions: season simulation, schedule search, multi-item evaluation and the constrained plan.

A season is a fold over its days inside the row, so simulating schedules for all items is a projection: no shuffle
until the best schedule of each item is picked by a map-side-combined minimum.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
PHASES = 3
PHASE_DAYS = 14
HALFLIFE = 21.0
SALVAGE = 0.05


def schedules(depths: tuple[float, ...] = DEPTHS, phases: int = PHASES) -> list[tuple[float, ...]]:
    """Depth by phase, never rising in price; 56 for six depths and three phases, in lexicographic order."""
    return list(itertools.combinations_with_replacement(depths, phases))


def schedule_column(options: list[tuple[float, ...]]) -> Column:
    """Array of (i, depths)."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(d)) for d in s]).alias("depths")) for i, s in enumerate(options)])


def simulate(base: Column, price: Column, inventory: Column, elasticity: Column, depths: Column, phase_days: int = PHASE_DAYS, phases: int = PHASES) -> Column:
    """(revenue, sold, leftover) of one season: daily demand decays, is cut by the stock, and what is left is salvaged."""

    def day(s: Column, t: Column) -> Column:
        paid = 1 - F.element_at(depths, (t / phase_days).cast("int") + 1)
        take = F.least(base * F.pow(F.lit(2.0), -t / HALFLIFE) * F.pow(paid, elasticity), s["left"])
        return F.struct((s["revenue"] + take * price * paid).alias("revenue"), (s["sold"] + take).alias("sold"), (s["left"] - take).alias("left"))

    start = F.struct(F.lit(0.0).alias("revenue"), F.lit(0.0).alias("sold"), inventory.cast("double").alias("left"))
    end = lambda s: F.struct((s["revenue"] + s["left"] * price * SALVAGE).alias("revenue"), s["sold"].alias("sold"), s["left"].alias("leftover"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(phase_days * phases - 1)), start, day, end)


def expected_full_price(base: Column, days: int = PHASES * PHASE_DAYS) -> Column:
    """Demand of a season without discounts: a geometric sum."""
    r = 2.0 ** (-1 / HALFLIFE)
    return base * ((1 - r**days) / (1 - r))


def best_schedules(items: DataFrame, elasticity: str, options: list[tuple[float, ...]] | None = None) -> DataFrame:
    """(key, i, depths, revenue): the schedule of the highest revenue by item, the earlier one among equals (to six places)."""
    options = options or schedules()
    rows = items.withColumn("s", F.explode(schedule_column(options)))
    revenue = simulate(F.col("base_daily"), F.col("ref_price"), F.col("inventory"), F.col(elasticity), F.col("s.depths"))["revenue"]
    pick = rows.select("key", "s.i", "s.depths", revenue.alias("revenue"))
    best = F.min_by(F.struct("i", "depths", "revenue"), F.struct(-F.round("revenue", 6), F.col("i")))
    return pick.groupBy("key").agg(best.alias("b")).select("key", "b.*")


def phase_demand(base: Column, elasticity: Column, depth: Column, rival: Column, cross: float, phase: Column, phase_days: int = PHASE_DAYS) -> Column:
    """Expected units of a phase: own price, rivals' mean log relative price, and decay summed over its days."""
    lam = math.log(2.0) / HALFLIFE
    decay = F.exp(-lam * phase * phase_days) * ((1 - math.exp(-lam * phase_days)) / (1 - math.exp(-lam)))
    return base * decay * F.pow(1 - depth, elasticity) * F.exp(cross * rival)


def rival_of(depth: Column, group: Window) -> Column:
    """Mean log relative price of the others in the group; 0 for one alone."""
    log_rel = F.ln(F.greatest(1 - depth, F.lit(1e-6)))
    n = F.count(log_rel).over(group)
    return F.when(n > 1, (F.sum(log_rel).over(group) - log_rel) / (n - 1)).otherwise(0.0)


def evaluate(plan: DataFrame, elasticity: str, cross: float) -> DataFrame:
    """Per item of a plan (key, dept, base_daily, ref_price, inventory, elasticity, phase, depth): revenue, units, spend, leftover.

    Each item draws on its own stock, phase by phase; leftovers are salvaged.
    """
    rival = rival_of(F.col("depth"), Window.partitionBy("dept", "phase"))
    demand = phase_demand(F.col("base_daily"), F.col(elasticity), F.col("depth"), F.col("rival"), cross, F.col("phase"))
    rows = plan.withColumn("rival", rival).withColumn("demand", demand)
    before = F.coalesce(F.sum("demand").over(Window.partitionBy("key").orderBy("phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("q", F.greatest(F.lit(0.0), F.least(F.col("demand"), F.col("inventory") - before)))
    per = rows.groupBy("key").agg(F.sum(F.col("q") * F.col("ref_price") * (1 - F.col("depth"))).alias("sales"), F.sum("q").alias("units"), F.sum(F.col("q") * F.col("ref_price") * F.col("depth")).alias("spend"), F.max("inventory").alias("inventory"), F.max("ref_price").alias("price"))
    left = F.col("inventory") - F.col("units")
    return per.select("key", (F.col("sales") + SALVAGE * F.col("price") * left).alias("revenue"), "units", "spend", left.alias("leftover"))


#: Items of one constrained plan: the search runs on the driver, over one department at a time.
MOST_ITEMS = 40


def _undominated(options: list[tuple[float, float, float, tuple]]) -> list[tuple[float, float, float, tuple]]:
    """Options (value, units, spend, choice) that no other matches in value with less spend, the most valuable first."""
    kept: list[tuple[float, float, float, tuple]] = []
    for o in sorted(options, key=lambda o: (-o[0], o[2], o[3])):
        if not kept or o[2] < kept[-1][2] - 1e-12:
            kept.append(o)
    return kept


def choose_plan(options: list[list[tuple[float, float, float]]], stock: list[float], pools: list[list[int]], budget: float | None) -> tuple[str, list[int], float]:
    """The choice of one option per item, exact to a ten-thousandth: (status, option by item, value).

    options[i]: (value, units, spend) by option. Units of a pool's items together stay within its stock, as does each
    other item within its own; spend of all within the budget. A pool becomes one item whose options are the joint
    ones that fit. What remains is bound by the budget alone: depth-first branch and bound, the bound being what is
    decided plus the best open values less a price on their spend, plus that price on what is left to spend.
    """
    groups = [list(p) for p in pools] + [[i] for i in range(len(options)) if not any(i in p for p in pools)]
    joint = []
    for members in groups:
        room = sum(stock[i] for i in members)
        rows: list[tuple[float, float, float, tuple]] = [(0.0, 0.0, 0.0, ())]
        for at, i in enumerate(members):
            rest = sum(min(u for _, u, _ in options[k]) for k in members[at + 1 :])
            rows = [(v + v2, u + u2, s + s2, (*c, j)) for v, u, s, c in rows for j, (v2, u2, s2) in enumerate(options[i]) if u + u2 + rest <= room + 1e-9]
        if not rows:
            return "Infeasible", [], 0.0
        joint.append(_undominated(rows))
    n = len(groups)
    multipliers = [0.0]
    if budget is not None:
        # the price with the lowest bound for the whole bounds its parts well too; the bound is convex in the price
        bound_at = lambda m: sum(max(v - m * s for v, _, s, _ in o) for o in joint) + m * budget
        low, high = 0.0, 4.0
        for _ in range(50):
            third = (high - low) / 3
            low, high = (low, high - third) if bound_at(low + third) <= bound_at(high - third) else (low + third, high)
        multipliers = [(low + high) / 2, 0.0]
    reduced = {m: [max(v - m * s for v, _, s, _ in o) for o in joint] for m in multipliers}
    tails = {m: [sum(reduced[m][i:]) for i in range(n + 1)] for m in multipliers}
    joint = [sorted(o, key=lambda x: multipliers[0] * x[2] - x[0]) for o in joint]
    rest_spend = [sum(min(x[2] for x in o) for o in joint[i:]) for i in range(n + 1)]
    best: tuple[float, list[tuple]] = (-math.inf, [])
    chosen: list[tuple] = [()] * n

    def walk(i: int, value: float, spend: float) -> None:
        nonlocal best
        left = math.inf if budget is None else budget - spend
        bound = min(tails[m][i] + (m * left if m else 0.0) for m in multipliers)
        # within a ten-thousandth of the best counts as no better: demand is not known that well
        if value + bound <= best[0] + max(1e-9, 1e-4 * abs(best[0])):
            return
        if i == n:
            best = (value, chosen.copy())
            return
        for v, _, s, c in joint[i]:
            if s + rest_spend[i + 1] <= left + 1e-9:
                chosen[i] = c
                walk(i + 1, value + v, spend + s)

    walk(0, 0.0, 0.0)
    if not best[1]:
        return "Infeasible", [], 0.0
    picked = [0] * len(options)
    for members, c in zip(groups, best[1], strict=True):
        for i, j in zip(members, c, strict=True):
            picked[i] = j
    return "Optimal", picked, best[0]


def solve_plan(items: list[dict], cross: float, budget: float | None = None, pools: list[list[int]] | None = None, rounds: int = 12, phase_days: int = PHASE_DAYS) -> dict:
    """Fixed point of the plan over the rival index, damped by half; converged when the schedule repeats.

    items: item_id, dept, base_daily, ref_price, elasticity, inventory. Returns status, depths by item and phase,
    value, converged, iterations and the history of the index's largest move.
    """
    if len(items) > MOST_ITEMS:
        raise ValueError(f"one plan takes {MOST_ITEMS} items at most")
    all_ = schedules()
    lam = math.log(2.0) / HALFLIFE
    decay = [sum(math.exp(-lam * t) for t in range(p * phase_days, (p + 1) * phase_days)) for p in range(PHASES)]
    rival = [[0.0] * PHASES for _ in items]
    history: list[float] = []
    before = None
    status, depths, value, converged = "Infeasible", [], 0.0, False
    for _ in range(rounds):
        options = []
        for it, r in zip(items, rival, strict=True):
            row = []
            for s in all_:
                q = [it["base_daily"] * decay[p] * (1 - s[p]) ** it["elasticity"] * math.exp(cross * r[p]) for p in range(PHASES)]
                units = sum(q)
                revenue = sum(x * it["ref_price"] * (1 - d) for x, d in zip(q, s, strict=True))
                row.append((revenue + SALVAGE * it["ref_price"] * (it["inventory"] - units), units, sum(x * it["ref_price"] * d for x, d in zip(q, s, strict=True))))
            options.append(row)
        status, picked, value = choose_plan(options, [it["inventory"] for it in items], pools or [], budget)
        if status != "Optimal":
            break
        depths = [all_[j] for j in picked]
        if depths == before:
            converged = True
            history.append(0.0)
            break
        before = depths
        move = 0.0
        for i, it in enumerate(items):
            others = [j for j in range(len(items)) if j != i and items[j]["dept"] == it["dept"]]
            for p in range(PHASES):
                new = sum(math.log(max(1 - depths[j][p], 1e-6)) for j in others) / len(others) if others else 0.0
                move = max(move, abs(new - rival[i][p]))
                rival[i][p] = 0.5 * rival[i][p] + 0.5 * new
        history.append(move)
    return {"status": status, "depths": depths, "value": value, "converged": converged, "iterations": len(history), "history": history}
