"""Sparse windows, exact selection, budgets and the planner's answers against plain versions."""

from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from demandloom.functions import selection as SL
from demandloom.operators import features as X
from demandloom.operators import panel as P
from demandloom.operators import sparse as SP
from demandloom.plans import service as V

FIRST = date(2022, 1, 3)


def test_sparse_features_equal_the_dense_ones(spark):
    rng = np.random.default_rng(1)
    days, rows = 460, []
    for k, share in enumerate((1.0, 0.4, 0.05)):
        rows += [("store", f"k{k}", FIRST + timedelta(days=d), float(rng.integers(0, 7))) for d in range(days) if rng.random() < share]
    rows += [("store", "edge", FIRST, 5.0), ("store", "edge", FIRST + timedelta(days=days - 1), 2.0)]
    panel = spark.createDataFrame(rows, "level string, key string, date date, y double")
    names = [*X.lags(), *X.rolling(), "dow_mean_4w"]
    grid = P.dense(panel).withColumn("dow", F.weekday("date")).withColumns({**X.lags(), **X.rolling(), "dow_mean_4w": X.same_weekday_mean()})
    for a, b in ((days - 28, days - 1), (0, 70), (300, 330)):
        since, until = FIRST + timedelta(days=a), FIRST + timedelta(days=b)
        got = SP.target_features(panel, SP.asked_days(panel, since, until), FIRST)
        of = lambda df: {(r.key, r.date): (r.y, *[None if r[c] is None else round(r[c], 9) for c in names]) for r in df.collect()}
        assert of(got) == of(grid.where(F.col("date").between(F.lit(since), F.lit(until))))
    assert SP.target_features(panel.limit(0), SP.asked_days(panel.limit(0), FIRST, FIRST), FIRST).count() == 0


def test_sparse_prices_equal_the_dense_ones(spark):
    rng = np.random.default_rng(5)
    days, rows = 200, []
    for key, share in (("often", 0.7), ("seldom", 0.05), ("late", 0.0)):
        kept = [d for d in range(days) if rng.random() < share] or [days - 3]
        rows += [("store", key, FIRST + timedelta(days=d), float(rng.integers(1, 9)), float(rng.uniform(5, 90)), 1.0, float(rng.uniform(5, 30)), int(rng.integers(0, 3)), int(rng.integers(1, 4))) for d in kept]
    rows += [("store", "ends", FIRST + timedelta(days=d), 2.0, 9.0, 1.0, 4.0 + d, 1, 1) for d in (0, days - 1)]
    panel = spark.createDataFrame(rows, "level string, key string, date date, y double, revenue double, promo_units double, price_sum double, promo_sum long, n long")
    dense = X.exogenous(P.dense(panel, "y", "revenue", "promo_units", "price_sum", "promo_sum", "n")).withColumns(X.price_features())
    names = ("price", "promo", "price_rel_56", "price_chg_7", "log_price")
    of = lambda df: {(r.key, r.date): tuple(None if r[c] is None else round(r[c], 9) for c in names) for r in df.collect()}
    got = of(SP.price_features(panel, SP.asked_days(panel, FIRST, FIRST + timedelta(days=days - 1)), FIRST))
    want = of(dense)
    assert got.keys() == want.keys() and len(got) == 4 * days
    assert all(a == b or all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-8) for x, y in zip(a, b, strict=True)) for a, b in ((got[k], want[k]) for k in want))


def test_no_grid_is_made_for_sparse_features(spark):
    panel = spark.createDataFrame([("store", "k", FIRST, 1.0), ("store", "k", FIRST + timedelta(days=3000), 2.0)], "level string, key string, date date, y double")
    asked = panel.select("level", "key", "date")
    assert SP.target_features(panel, asked, FIRST).count() == 2
    plan = SP.target_features(panel, asked, FIRST)._jdf.queryExecution().toString()
    assert "explode" not in plan.lower() and "Generate" not in plan


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 4, 2000).astype(float), "one": np.array([7.0]), "wide": np.array([-1.7e308, 1.7e308, 0.0, 1e-300]), "near": 1.0 + np.arange(50) * 2.0**-52, "heavy": np.concatenate((rng.lognormal(0, 6, 500), [3.0] * 900))}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("normal", None), ("normal", float("nan")), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    taus = (0.0, 0.25, 0.5, 0.951, 1.0)
    got = {r.g: r.q for r in SL.quantiles(df, "v", taus, "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        ordered = np.sort(values)
        for tau, q in zip(taus, got[g], strict=True):
            p = tau * (len(ordered) - 1)
            a, b = int(np.floor(p)), int(np.ceil(p))
            want = ordered[a] if a == b else (b - p) * ordered[a] + (p - a) * ordered[b]
            assert q == want or abs(q - want) <= 1e-12 * abs(want), (g, tau)
    whole = SL.quantiles(df.where("g = 'ties'"), "v", (0.5,)).first().q
    assert whole == [float(np.median(groups["ties"]))]
    assert SL.quantiles(df.limit(0), "v", (0.5,), "g").count() == 0


def test_budget_is_met_exactly(spark):
    rng = np.random.default_rng(3)
    draws = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(i, float(d)) for i, d in enumerate(draws)], "i int, d double").repartition(4)
    order = sorted(range(500), key=lambda i: (draws[i], i))
    for k in (0, 1, 7, 250, 500, 900):
        assert {r.i for r in SL.smallest(df, "d", k, "i").collect()} == set(order[:k])


def test_every_request_is_answered(spark):
    fans = spark.createDataFrame([(k, h, [1.0, 2.0, 3.0, 4.0, 5.0], 1.5) for k in ("a", "b") for h in range(1, 29)], "key string, h int, q array<double>, mean double")
    asked = [("a", 7, 0.9, 6, 0.0), ("a", 7, 0.9, 6, 0.0), ("a", 0, 0.9, 6, 0.0), ("a", 7, 1.0, 6, 0.0), ("b", 28, 0.97, 1, 10.0), ("x", 7, 0.9, 6, 0.0), ("b", 7, None, 6, 0.0), ("b", 7, 0.9, 0, 0.0), (None, 7, 0.9, 6, 0.0), ("b", 7, 0.9, 6, -1.0), ("x", 99, 0.9, 6, 0.0)]
    requests = spark.createDataFrame([(i, *r) for i, r in enumerate(asked)], "id int, key string, lead_time_days int, service_level double, case_pack int, on_hand double")
    got = {r.id: r for r in V.answers(fans, requests).collect()}
    assert [got[i].reason for i in range(len(asked))] == ["ok", "ok", "lead_time_days", "service_level", "ok", "unknown key", "service_level", "case_pack", "unknown key", "on_hand", "lead_time_days"]
    assert (got[0].cover_units, got[0].mean_units, got[0].order_quantity) == (21.0, 10.5, 24) == (got[1].cover_units, got[1].mean_units, got[1].order_quantity)
    assert (got[4].service_level_used, got[4].cover_units, got[4].order_quantity) == (0.98, 140.0, 130)
    assert all(r.accepted == (r.reason == "ok") and (r.order_quantity is None) == (r.reason != "ok") for r in got.values())
    assert V.orders(fans, requests).count() == 3
