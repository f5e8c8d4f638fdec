"""Units with hand-computed results, properties, and SQL equality on the smallest tables."""

import math
from datetime import date, timedelta
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom import catalogue
from demandloom.functions import leadtime as L
from demandloom.functions import metrics as M
from demandloom.functions import quantiles as Q
from demandloom.operators import baselines as B
from demandloom.operators import boosting as GB
from demandloom.operators import deep as D
from demandloom.operators import elasticity as E
from demandloom.operators import features as X
from demandloom.operators import gate as G
from demandloom.operators import markdown as K
from demandloom.operators import panel as P
from demandloom.operators import probabilistic as PR
from demandloom.operators import reconcile as R
from demandloom.operators import regression as RG
from demandloom.sources.sales import sales

SF = "/root/testdata/sf0.001"


def series(spark, values, key="k", level="store", start=date(2023, 1, 2)):
    return spark.createDataFrame([(level, key, start + timedelta(days=i), float(v)) for i, v in enumerate(values)], "level string, key string, date date, y double")


def test_wmape_bias_by_hand(spark):
    df = spark.createDataFrame([(10.0, 8.0), (0.0, 2.0), (5.0, 5.0)], "y double, yhat double")
    r = df.agg(M.wmape().alias("w"), M.bias().alias("b")).first()
    assert abs(r.w - 4 / 15) < 1e-12 and abs(r.b) < 1e-12
    assert df.where("y = 0").agg(M.wmape().alias("w")).first().w is None


def test_demand_classes(spark):
    rng = np.random.default_rng(0)
    rare = np.zeros(400)
    rare[rng.choice(400, 60, replace=False)] = rng.exponential(20, 60)
    cases = {"smooth": rng.poisson(30, 400), "intermittent": [3.0 if i % 5 == 0 else 0 for i in range(400)], "lumpy": rare, "erratic": rng.exponential(20, 400) + 0.01, "none": np.zeros(50)}
    df = None
    for k, v in cases.items():
        s = series(spark, v, k)
        df = s if df is None else df.union(s)
    got = {r.key: r["class"] for r in M.adi_cv2(df, "key").collect()}
    assert got == {**{k: k for k in cases if k != "none"}, "none": "intermittent"}


def test_baselines_against_plain_loops(spark):
    rng = np.random.default_rng(1)
    for y in (rng.poisson(1, 90).astype(float), np.array([6.0 if i % 4 == 3 else 0.0 for i in range(300)]), np.zeros(20), np.array([0, 0, 5.0, 0]), np.array([2.0, 3.0])):
        df = spark.createDataFrame([([float(v) for v in y],)], "ys array<double>")
        r = df.select(*[f(F.col("ys"), F.lit(9)).alias(n) for n, f in B.BASELINES.items()]).first()
        best = None
        for k in range(1, 20):
            a, level, sse = round(0.05 * k, 2), y[0], 0.0
            for v in y[1:]:
                sse, level = sse + (v - level) ** 2, a * v + (1 - a) * level
            best = min(best or (math.inf,), (sse, a, level))
        assert abs(r.ses - best[2]) < 1e-9
        hits = np.flatnonzero(y > 0)
        if len(hits) == 0:
            want = 0.0
        elif len(hits) == 1:
            want = y[hits[0]] / len(y)
        else:
            z, p = y[hits[0]], hits[0] + 1.0
            for before, i in zip(hits, hits[1:]):
                z, p = 0.1 * y[i] + 0.9 * z, 0.1 * (i - before) + 0.9 * p
            want = z / p * 0.95
        assert abs(r.croston_sba - want) < 1e-9
        assert r.naive == y[-1] and r.seasonal_naive == (y[len(y) - 7 + 1] if len(y) >= 7 else y[-1])


def test_features_do_not_see_the_horizon(spark):
    rng = np.random.default_rng(2)
    base = series(spark, rng.poisson(3, 500)).withColumns({"dow": F.weekday("date")})
    origin = date(2023, 1, 2) + timedelta(days=472)
    later = base.withColumn("y", F.when(F.col("date") >= F.lit(origin), F.col("y") * 1000 + 777).otherwise(F.col("y")))
    cols = {**X.lags(), **X.rolling(), "dow_mean_4w": X.same_weekday_mean()}
    a, b = ([tuple(r) for r in d.withColumns(cols).where(F.col("date") >= F.lit(origin)).orderBy("date").select(*cols).collect()] for d in (base, later))
    assert len(a) == 28 and a == b
    assert any(x is not None for x in a[0])


def test_lagged_weights_do_not_leak_prices(spark):
    rows = [("store", "k", date(2023, 1, 1) + timedelta(days=i), 5.0 + i % 3, 50.0 + i, 1.0, 30.0, 1, 3) for i in range(60)]
    df = spark.createDataFrame(rows, "level string, key string, date date, y double, revenue double, promo_units double, price_sum double, promo_sum long, n long")
    moved = df.withColumn("y", F.when(F.col("date") >= F.lit(date(2023, 2, 20)), F.col("y") * 50).otherwise(F.col("y")))
    same = lambda d, w: [r.price for r in X.exogenous(d, w).orderBy("date").collect()]
    assert same(df, "lagged") == same(moved, "lagged")
    assert same(df, "same_day") != same(moved, "same_day")


def test_proportions(spark):
    groups = spark.createDataFrame([("a", "A", 10.0), ("b", "A", 30.0), ("c", "B", 0.0), ("d", "B", 0.0)], "c string, p string, y double")
    assert {r.c: r.share for r in R.proportions(groups, "c", "p").collect()} == {"a": 0.25, "b": 0.75, "c": 0.5, "d": 0.5}


def test_quantile_tools(spark):
    df = spark.createDataFrame([(1.0, [1.0, 5.0, 4.0]), (1.0, [1.0, 2.0, 3.0])], "y double, q array<double>")
    assert df.agg(Q.crossing_rate(df)).first()[0] == 0.25
    after = df.withColumn("q", Q.rearranged(F.col("q")))
    assert after.agg(Q.crossing_rate(after)).first()[0] == 0
    one = spark.range(1)
    r = one.select(Q.order_up_to(F.lit(9.0), F.lit(0.0), F.lit(1)), Q.order_up_to(F.lit(9.0), F.lit(4.0), F.lit(4)), Q.order_up_to(F.lit(9.0), F.lit(99.0), F.lit(4)), Q.newsvendor_quantile(F.lit(9.0), F.lit(1.0)), Q.pinball(F.lit(1.0), F.lit(0.0), 0.9)).first()
    assert tuple(r) == (9, 8, 0, 0.9, 0.9)


def test_gate_screen_matters(spark):
    rows = [("k", "biased", 10.0, 12.0)] * 10 + [("k", "noisy", 10.0, 14.0), ("k", "noisy", 10.0, 6.0)] * 5
    df = spark.createDataFrame(rows, "key string, method string, y double, yhat double")
    scored = G.score_methods(G.method_sums(df, "key"), "key")
    assert G.choose(scored, "key").first().method == "noisy"
    assert G.choose(scored, "key", limit=None).first().method == "biased"


def test_season_and_schedules(spark):
    assert len(K.schedules()) == 56
    r = spark.range(1).select(K.simulate(F.lit(3.0), F.lit(10.0), F.lit(60.0), F.lit(-1.8), F.array(F.lit(0.0), F.lit(0.2), F.lit(0.4))).alias("s")).first().s
    left, revenue = 60.0, 0.0
    for t in range(42):
        d = (0.0, 0.2, 0.4)[t // 14]
        take = min(3.0 * 2 ** (-t / 21) * (1 - d) ** -1.8, left)
        left, revenue = left - take, revenue + take * 10 * (1 - d)
    assert abs(r.revenue - (revenue + left * 0.5)) < 1e-9 and abs(r.leftover - left) < 1e-9


def test_plan_search_is_exact(spark):
    import itertools

    rng = np.random.default_rng(5)
    options = [[(float(rng.uniform(50, 100)), float(rng.uniform(1, 9)), float(rng.uniform(0, 9))) for _ in range(7)] for _ in range(4)]
    stock = [6.0, 6.0, 6.0, 6.0]
    for pools, budget in (([], None), ([[0, 1]], None), ([], 9.0), ([[1, 2]], 12.0)):
        best = -math.inf
        for c in itertools.product(range(7), repeat=4):
            units = [options[i][j][1] for i, j in enumerate(c)]
            ok = all(units[i] <= stock[i] for i in range(4) if not any(i in p for p in pools)) and all(sum(units[i] for i in p) <= sum(stock[i] for i in p) for p in pools)
            if ok and (budget is None or sum(options[i][j][2] for i, j in enumerate(c)) <= budget):
                best = max(best, sum(options[i][j][0] for i, j in enumerate(c)))
        status, picked, value = K.choose_plan(options, stock, pools, budget)
        assert (status == "Optimal") == (best > -math.inf)
        if picked:
            assert value <= best + 1e-9 and value >= best * (1 - 2e-4)
    items = [{"item_id": str(i), "dept": "d", "base_daily": 3.0, "ref_price": 10.0, "elasticity": -1.8, "inventory": 120.0} for i in range(4)]
    r = K.solve_plan(items, 0.35)
    assert r["status"] == "Optimal" and r["converged"] and all(a <= b for d in r["depths"] for a, b in zip(d, d[1:]))
    assert K.solve_plan([dict(items[0], inventory=1.0)], 0.0)["status"] == "Infeasible"


def test_shrinkage_extremes(spark):
    rng = np.random.default_rng(6)
    for spread, se, low in ((0.0, 1.0, True), (2.0, 0.05, False)):
        est = rng.normal(-1.5, max(spread, 1e-9), 60) + rng.normal(0, se * 0.5, 60)
        df = spark.createDataFrame([("c", float(e), se) for e in est], "cat_id string, estimate double, se double")
        out = [r.shrunk for r in E.shrink(df).collect()]
        assert (np.std(out) < 1e-9) if low else (abs(np.std(out) / np.std(est) - 1) < 0.02)


def test_poisson_fit_recovers_the_truth():
    rng = np.random.default_rng(7)
    log_p = rng.normal(0, 0.3, 3000)
    y = rng.poisson(np.exp(1.0 - 1.7 * log_p))
    beta, se = RG.poisson_irls(np.stack([np.ones(3000), log_p], 1), y.astype(float))
    assert abs(beta[1] + 1.7) < 4 * se[1] and 0 < se[1] < 0.1


def test_boosting_learns_mean_and_quantiles():
    rng = np.random.default_rng(8)
    x = rng.uniform(0, 1, (4000, 3))
    y = rng.poisson(2 + 8 * (x[:, 0] > 0.5)).astype(float)
    p = GB.Booster(None, 60).fit(x, y).predict(x)
    assert np.abs(p - (2 + 8 * (x[:, 0] > 0.5))).mean() < 0.5
    q = GB.Booster(0.9, 60).fit(x, y).predict(x)
    assert 0.86 < (y <= q + 1e-9).mean() < 0.96


def test_calendar_events(spark):
    days = spark.createDataFrame([(d,) for d in (date(2023, 11, 23), date(2023, 11, 17), date(2023, 11, 16), date(2023, 11, 24), date(2024, 2, 4), date(2024, 7, 4), date(2024, 12, 25))], "date date")
    got = {r.date: r.event for r in P.calendar(days).collect()}
    assert list(got[d] for d in sorted(got)) == ["none", "ThanksgivingRunup", "Thanksgiving", "BlackFriday", "SuperBowl", "July4", "Christmas"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


CHECKED = ("S1_scan_project", "P4_date_filters", "J1_calendar_join", "A2_multi_agg", "A9_ordered_stats", "A19_leave_one_out", "W2_rolling", "W10_gaps", "M1_wmape_by_level", "M5_intermittency", "A15_pivot_wmape", "B4_croston", "H7_mint_two_level", "H13_reconcile_draws", "Q1_pinball_table", "L2_bootstrap_lcg", "C5_gates", "E9_shrinkage", "K2_schedules", "V4_orders", "V5_override_latest", "S6_nested_parquet", "ST1_daily_events",
           "P7_complete_rows", "P17_finite_filter", "R2_mase_by_class", "H15_coherence_gap", "E10_estimator_correlations", "V2_health_series", "V5_override_append", "S5_json_document",
    "R1_six_levels", "R5_recon_six_levels", "V8_answers", "P20_window_budget", "S9_panel_cache", "S14_text_report", "L9_compare_methods", "E4_naive_specs", "H6_shrinkage", "B15_feature_matrix", "W6_price_windows",
)


def test_models_are_trained_at_full_size(spark, monkeypatch):
    trees, windows = [], []
    small_models, small_network = GB.fit_models, D.fit_network

    def models(rows, features, taus, n, n_quantile, sample_rows=GB.SAMPLE_ROWS, depth=GB.DEPTH):
        trees.append((n, n_quantile, sample_rows, depth))
        return small_models(rows, features, taus, 1, 1, 1000, 1)

    def network(rows, budget=D.WINDOW_BUDGET, epochs=12, width=256, seed=0):
        windows.append((D.sample_windows(rows, budget).count(), rows.count(), epochs, width))
        return small_network(rows, 50, 1, 8)

    monkeypatch.setattr(GB, "fit_models", models)
    monkeypatch.setattr(D, "fit_network", network)
    for name in ("B6_boosted_mean", "B7_boosted_quantiles", "B12_deep_forecast", "R7_series_sweep"):
        assert catalogue.queries()[name](spark, SF).count() > 0
    assert trees == [(220, 0, 100_000, 5), (0, 140, 100_000, 5)]
    assert all(w[2:] == (12, 256) for w in windows)
    assert windows[0][0] == windows[0][1]
    used = [w[0] for w in windows[1:]]
    assert len(used) == 3 and max(used) < 1.05 * min(used) and min(used) > 9_000


def test_draws_are_as_many_as_the_methods_need(spark, monkeypatch):
    counts = []
    paths, joint = L.leadtime_totals, PR.bottom_samples
    monkeypatch.setattr(L, "leadtime_totals", lambda a, b, days, n: counts.append(n) or paths(a, b, days, 20))
    monkeypatch.setattr(PR, "bottom_samples", lambda a, b, samples=500, **kw: counts.append(samples) or joint(a, b, 20, **kw))
    for name in ("L9_compare_methods", "H12_joint_samples"):
        assert catalogue.queries()[name](spark, SF).count() > 0
    assert counts == [4000, 4000, 4000, 500]


def test_sweep_sizes_follow_the_table():
    assert D.sweep_arms(150, 2400) == ((10, 50, 150), 10 * 2317)
    assert D.sweep_arms(30_000, 1913) == ((2_000, 10_000, 30_000), 150_000)
    assert D.sweep_arms(1, 50) == ((1,), 1)



@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda v: f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)
    norm = lambda rows: sorted(tuple(show(v) for v in r) for r in rows)
    assert norm(got.select(*columns).collect()) == norm(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_module_lists_everything():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 70


def test_recent_prices_equal_those_of_the_whole_panel(spark):
    rng = np.random.default_rng(12)
    rows = []
    for key in ("a", "b", "old", "new"):
        days = {"a": range(0, 700, 3), "b": sorted(rng.choice(700, 60, replace=False)), "old": (5, 33, 61), "new": (699,)}[key]
        rows += [("store", key, date(2022, 1, 1) + timedelta(days=int(d)), float(rng.integers(1, 9)), float(rng.uniform(5, 90)), 1.0, float(rng.uniform(5, 30)), int(rng.integers(0, 2)), int(rng.integers(1, 4))) for d in days]
    sparse = spark.createDataFrame(rows, "level string, key string, date date, y double, revenue double, promo_units double, price_sum double, promo_sum long, n long")
    cut = date(2022, 1, 1) + timedelta(days=400)
    since = spark.createDataFrame([(cut,)], "cut date")
    of = lambda d: {(r.key, r.date): (None if r.price is None else round(r.price, 9), round(r.promo, 9), r.y) for r in d.where(F.col("date") >= F.lit(cut)).collect()}
    assert of(X.exogenous_since(sparse, since)) == of(X.exogenous(P.dense(sparse, "y", "revenue", "promo_units", "price_sum", "promo_sum", "n")))


def test_all_six_levels_have_one_total(spark):
    s = sales(spark, "/root/testdata/sf0.001")
    sums = {r.level: (r.y, r.k) for r in P.roll_up(s, P.ALL_LEVELS).groupBy("level").agg(F.round(F.sum("y"), 4).alias("y"), F.count_distinct("key").alias("k")).collect()}
    assert set(sums) == set(P.ALL_LEVELS) and len({y for y, _ in sums.values()}) == 1
    assert sums["store_item"][1] > sums["store_dept"][1] > sums["store_cat"][1]


def test_small_parts(spark, tmp_path):
    from demandloom.operators import probabilistic as PR
    from demandloom.operators.deep import fixed_stride
    from demandloom.plans import service as V
    from demandloom.sources import sales as S

    edge = spark.createDataFrame([("total", "T", "a"), ("total", "T", "b")], "level string, key string, bkey string")
    q = spark.createDataFrame([("total", "T", 7.0), ("store", "a", 5.0), ("store", "b", 4.0)], "level string, key string, value double")
    assert tuple(PR.coherence_gap(edge, q).first()) == (2.0, 2.0, 1.0)
    assert np.linalg.eigvalsh(PR.nearest_psd(np.array([[1.0, 2.0], [2.0, 1.0]]))).min() > 0
    assert fixed_stride(1000, 10, 100) == 91 and fixed_stride(100, 1, 10**6) == 1
    fans = spark.createDataFrame([("b", 1), ("a", 1), ("a", 2)], "key string, h int")
    assert tuple(V.health(fans).first()) == ("ok", 2) and V.health(fans.limit(0)).first().status == "missing"
    assert [r.key for r in V.series(fans, 1).collect()] == ["a"]
    path = tmp_path / "truth.json"
    path.write_text('{"x": {"p": 1.5}, "n": 3}')
    assert S.available(spark, str(path)) and not S.available(spark, str(tmp_path / "none"))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("x", T.MapType(T.StringType(), T.DoubleType())), T.StructField("n", T.IntegerType())])
    assert tuple(S.read_json_document(spark, str(path), schema).first()) == ({"p": 1.5}, 3)
    from demandloom.functions import leadtime as L

    pools = spark.createDataFrame([("k", [1.0, math.nan, math.inf, None] + [0.0] * 40)], "key string, pool array<double>")
    point = spark.createDataFrame([("k", 2.0)], "key string, point double")
    paths = L.daily_paths(point, pools, 7, 20)
    sums = {r.sample: r.demand for r in L.leadtime_samples(paths).collect()}
    totals = L.leadtime_totals(point, pools, 7, 20).collect()
    assert all(abs(sums[r.sample] - r.demand) < 1e-9 for r in totals) and len(totals) == 20
    assert paths.where("isnan(demand) OR demand > 100 OR demand IS NULL").count() == 0 and paths.count() == 140
