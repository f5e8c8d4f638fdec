"""Price response with absorbed effects, minimum trace, joint samples, fold states and stored artifacts, against plain versions."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandloom.operators import absorbed as AB
from demandloom.operators import baselines as B
from demandloom.operators import folds as FO
from demandloom.operators import panel as P
from demandloom.operators import probabilistic as PR
from demandloom.operators import reconcile as R
from demandloom.operators import regression as RG
from demandloom.sources import artifacts as A

FIRST = date(2023, 1, 2)
PERIODS = 60


def sparse_sales(rng, cats=("a", "b"), stores=4, slopes=(-2.0, -1.0)):
    """(sales of some periods, the same as a dense panel at carried prices) with planted slopes and series effects."""
    sold, dense = [], []
    for cat, slope in zip(cats, slopes, strict=True):
        for store in range(stores):
            effect = 1.2 + rng.normal(0, 0.5)
            keep = rng.random(PERIODS) < 0.6
            keep[rng.integers(PERIODS)] = True
            price, promo = np.exp(rng.normal(0, 0.4, PERIODS)), (rng.random(PERIODS) < 0.25) * 1.0
            held = price[np.flatnonzero(keep)[0]]
            for t in range(PERIODS):
                if keep[t]:
                    held = price[t]
                    units = float(rng.poisson(np.exp(effect + slope * np.log(held) + 0.4 * promo[t] + 0.2 * (t % 7 == 3))))
                    sold.append((cat, store, t, units, float(held), float(promo[t])))
                dense.append((cat, store, t, units if keep[t] else 0.0, float(np.log(held)), float(promo[t]) if keep[t] else 0.0))
    return sold, pd.DataFrame(dense, columns=["cat", "store", "t", "units", "log_p", "promo"])


def pieces_of(spark, sold):
    panel = spark.createDataFrame(sold, "cat string, store int, t int, units double, price double, promo double").repartition(3)
    return AB.stretches(panel, ["cat", "store"], PERIODS).withColumns({"log_p": F.ln("price"), "log_q": F.log1p("units")})


def test_stretches_fill_every_period_once(spark):
    sold, dense = sparse_sales(np.random.default_rng(1))
    rows = pieces_of(spark, sold).collect()
    got = {(r.cat, r.store, t): (r.units, round(r.log_p, 9), r.promo) for r in rows for t in range(r.t0, r.t1)}
    assert sum(r.t1 - r.t0 for r in rows) == len(got) == len(dense)
    assert got == {(r.cat, r.store, r.t): (r.units, round(r.log_p, 9), r.promo) for r in dense.itertuples()}


def test_sums_by_series_agree_and_portions_are_whole(monkeypatch):
    rng = np.random.default_rng(9)
    rows = []
    for _ in range(40):
        cuts = np.unique(np.concatenate(([0, PERIODS], rng.integers(0, PERIODS, rng.integers(1, 30)))))
        keep = rng.random(len(cuts) - 1) < 0.8  # stretches may be missing
        keep[0] = True
        rows.append({"t0": cuts[:-1][keep], "t1": cuts[1:][keep], "y": rng.random(keep.sum()), "log_p": rng.normal(size=keep.sum())})
    pdf = pd.DataFrame(rows)
    s, effects = AB.Stretches(pdf, ["log_p"]), rng.normal(size=(PERIODS, 5))
    weight = rng.random(len(s.y))
    want = np.array([sum(weight[i] * effects[s.t0[i] : s.t1[i]].sum(0) for i in np.flatnonzero(s.series == k)) for k in range(40)])
    for gain in (0, 10**9):
        monkeypatch.setattr(AB, "MATRIX_GAIN", gain)
        assert np.allclose(s._by_series(weight, effects), want)
    monkeypatch.setattr(AB, "CELLS_AT_ONCE", 7 * PERIODS)
    monkeypatch.setattr(AB, "STRETCHES_AT_ONCE", 50)
    parts = list(AB._portions(pdf, PERIODS))
    assert len(parts) > 5 and max(map(len, parts)) <= 7 and [i for p in parts for i in p.index] == list(range(40))


def test_absorbed_fits_equal_those_with_dummies(spark):
    sold, dense = sparse_sales(np.random.default_rng(2))
    pieces, c = pieces_of(spark, sold), AB.calendar_effects(spark, F.lit(FIRST), PERIODS, 1, ("dow",))
    extra = [("few", 1, 4 * k, 4 * k + 4, 1.0, 0.1 * k) for k in range(3)] + [("flat", 1, 0, PERIODS, 2.0, 0.5), ("none", 1, 0, 50, 0.0, 0.5), ("none", 1, 50, PERIODS, 0.0, 0.7)]
    odd = pieces.select("cat", "store", "t0", "t1", "units", "log_p", "promo").unionByName(spark.createDataFrame(extra, "cat string, store int, t0 int, t1 int, units double, log_p double").withColumn("promo", F.lit(0.0)))
    got = {r.cat: r for r in AB.fit_groups(odd, ["cat"], ["store"], c).collect()}
    each = {r.cat: r for r in AB.fit_each(odd, ["cat"], ["store"], c).collect()}
    for cat in ("a", "b"):
        part = dense[dense["cat"] == cat].assign(dow=lambda d: d["t"] % 7)
        beta, se = RG.poisson_irls(RG.design(part, ["store", "dow"], ["log_p", "promo"]), part["units"].to_numpy(), ridge=0.0)
        for fit in (got[cat], each[cat]):
            assert abs(fit.estimate - beta[1]) < 1e-6 and abs(fit.se - se[1]) < 1e-6 and fit.n == len(part) and fit.status == "fitted"
    assert {k: v.status for k, v in got.items()} == {"a": "fitted", "b": "fitted", "few": "few rows", "flat": "no price variation", "none": "no sales"} == {k: v.status for k, v in each.items()}
    assert got["few"].estimate is None
    assert AB.fit_groups(pieces.limit(0), ["cat"], ["store"], c).count() == 0 == AB.fit_each(pieces.limit(0), ["cat"], ["store"], c).count()


def test_least_squares_equal_those_of_the_dense_panel(spark):
    sold, dense = sparse_sales(np.random.default_rng(3), slopes=(-1.5, -0.5))
    pieces = pieces_of(spark, sold)
    c, none = (AB.calendar_effects(spark, F.lit(FIRST), PERIODS, 1, e) for e in (("dow",), ()))
    dense["q"] = np.log1p(dense["units"])

    def ols(x, y):
        inverse = np.linalg.pinv(x.T @ x)
        b = inverse @ x.T @ y
        e = y - x @ b
        return b, np.sqrt(np.diag(inverse @ ((x * (e**2)[:, None]).T @ x) @ inverse))

    plain = {r.cat: r for r in AB.fit_groups(pieces, ["cat"], ["store"], none, "log_q", ("log_p", "promo"), family="gaussian", absorb=False).collect()}
    fixed = {r.cat: r for r in AB.fit_groups(pieces, ["cat"], ["store"], c, "log_q", ("log_p", "promo"), family="gaussian").collect()}
    for cat in ("a", "b"):
        part = dense[dense["cat"] == cat]
        b, se = ols(np.column_stack([np.ones(len(part)), part[["log_p", "promo"]]]), part["q"].to_numpy())
        assert abs(plain[cat].estimate - b[1]) < 1e-9 and abs(plain[cat].se - se[1]) < 1e-9
        centred = part[["log_p", "promo", "q"]] - part.groupby("store")[["log_p", "promo", "q"]].transform("mean")
        days = pd.get_dummies(part["t"] % 7, drop_first=True).to_numpy(float)
        b, se = ols(np.column_stack([centred[["log_p", "promo"]], days]), centred["q"].to_numpy())
        assert abs(fixed[cat].estimate - b[0]) < 1e-9 and abs(fixed[cat].se - se[0]) < 1e-9


def test_rivals_equal_those_of_the_dense_panel(spark):
    sold, dense = sparse_sales(np.random.default_rng(4), cats=("a", "b", "c"), slopes=(-1.0,) * 3, stores=2)
    pieces = pieces_of(spark, sold).withColumn("dept", F.when(F.col("cat") == "c", "alone").otherwise("both"))
    got = AB.with_rivals(pieces, ["store", "dept"], "cat", PERIODS).collect()
    dense["dept"] = np.where(dense["cat"] == "c", "alone", "both")
    base = dense.groupby("cat")["log_p"].transform(lambda v: np.log(np.median(np.exp(v))))
    dense["rel"] = dense["log_p"] - base
    groups = dense.groupby(["store", "dept", "t"])["rel"]
    n = groups.transform("count")
    dense["rival"] = np.where(n > 1, (groups.transform("sum") - dense["rel"]) / np.maximum(n - 1, 1), 0.0)
    want = {(r.cat, r.store, r.t): (r.units, r.promo, round(r.rival, 9)) for r in dense.itertuples()}
    assert {(r.cat, r.store, t): (r.units, r.promo, round(r.rival_log_rel, 9) + 0.0) for r in got for t in range(r.t0, r.t1)} == {k: (u, p, v + 0.0) for k, (u, p, v) in want.items()}


def test_planted_elasticities_are_recovered(spark, monkeypatch):
    from demandloom.sources import generator as GN

    # with one elasticity per category there is one truth for a fit that weighs items by their sales
    monkeypatch.setattr(GN, "ELASTICITY_SPREAD", 0.0)
    items = spark.createDataFrame([(f"{c}_{d}_{i}", f"{c}_{d}", c, 4.0 + i) for c in ("FOODS", "HOBBIES") for d in (1, 2) for i in range(8)], "item_id string, dept_id string, cat_id string, base_price double")
    stores = spark.createDataFrame([(f"S{k}", "X") for k in range(6)], "store_id string, state_id string")
    days = 1092
    sold = GN.panel(items, stores, "2022-01-03", days).cache()
    planted = {r.cat_id: r.e for r in GN.items(items).groupBy("cat_id").agg(F.avg("elasticity").alias("e")).collect()}
    panel = sold.select("cat_id", "dept_id", "item_id", "store_id", F.datediff("date", F.lit("2022-01-03").cast("date")).alias("t"), F.col("sales").alias("units"), F.col("sell_price").alias("price"), "promo")
    pieces = AB.stretches(panel, ["cat_id", "dept_id", "item_id", "store_id"], days).withColumn("log_p", F.ln("price"))
    pieces = AB.with_rivals(pieces, ["store_id", "dept_id"], "item_id", days).cache()
    c = AB.calendar_effects(spark, F.lit("2022-01-03").cast("date"), days, 1, ("woy", "event", "dow", "snap"))
    for r in AB.fit_groups(pieces, ["cat_id"], ["item_id", "store_id"], c, rival="rival_log_rel").collect():
        assert abs(r.estimate - planted[r.cat_id]) < 0.1, (r, planted)
        assert abs(r.cross - GN.CROSS) < max(0.1, 4 * r.cross_se) and 0 < r.se < 0.1 and r.status == "fitted"


# minimum trace


def dense_mint(s, resid, method):
    n, bottom = s.shape
    if method == "ols":
        w = np.eye(n)
    elif method == "wls":
        v = resid.var(1)
        w = np.diag(np.where(v <= 0, 1e-6, v))
    else:
        centred = resid - resid.mean(1, keepdims=True)
        cov = centred @ centred.T / (resid.shape[1] - 1)
        sd = np.sqrt(np.diag(cov))
        sd = np.where(sd == 0, 1e-9, sd)
        r = (cov / np.outer(sd, sd))[~np.eye(n, dtype=bool)]
        weight = np.clip(r.var() / ((r**2).mean() + 1e-12), 0.05, 1.0)
        w = weight * np.diag(np.diag(cov)) + (1 - weight) * cov
        w = w + np.eye(n) * np.trace(w) / n * 1e-6
    inverse = np.linalg.inv(w)
    return s @ np.linalg.solve(s.T @ inverse @ s, s.T @ inverse)


LEVELS = ("total", "state", "store", "store_cat")


def small_tree(spark):
    bottom = [(f"s{k // 4}", f"t{k // 2}", f"c{k % 2}") for k in range(11)]
    df = spark.createDataFrame(bottom, "state_id string, store_id string, cat_id string")
    names = [("total", "TOTAL"), *[("state", x) for x in sorted({b[0] for b in bottom})], *[("store", x) for x in sorted({b[1] for b in bottom})], *[("store_cat", f"{b}|{c}") for _, b, c in bottom]]
    member = lambda level, key, b: {"total": True, "state": b[0] == key, "store": b[1] == key, "store_cat": f"{b[1]}|{b[2]}" == key}[level]
    return R.tree(df, LEVELS), names, np.array([[float(member(v, k, b)) for b in bottom] for v, k in names])


def test_minimum_trace_equals_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    nodes, names, s = small_tree(spark)
    assert nodes.count() == len(names)
    length, hs = 30, 5
    resid = rng.normal(size=(len(names), length)) * rng.uniform(0.5, 3, (len(names), 1)) + rng.normal(size=length)
    resid[-1] = 0.0  # a series without errors
    base = rng.uniform(1, 9, (len(names), hs))
    rows = spark.createDataFrame([(v, k, h + 1, float(base[i, h])) for i, (v, k) in enumerate(names) for h in range(hs)], "level string, key string, h int, value double")
    tails = spark.createDataFrame([(v, k, [float(x) for x in resid[i]]) for i, (v, k) in enumerate(names)], "level string, key string, tail array<double>")
    got = {(r.method, r.level, r.key, r.h): r.value for r in R.mint(rows, nodes, tails, LEVELS, length=length).collect()}
    assert len(got) == 3 * len(names) * hs
    for method in ("ols", "wls", "shrink"):
        want = dense_mint(s, resid, method) @ base
        mine = np.array([[got[method, v, k, h + 1] for h in range(hs)] for v, k in names])
        assert np.allclose(mine, want, atol=1e-6), method
        assert np.allclose(mine, s @ mine[-s.shape[1] :])
    summed = R.sum_up(rows.where("level = 'store_cat'").select("key", "h", "value"), nodes, LEVELS, "h").collect()
    up = {(r.level, r.key, r.h): r.value for r in summed}
    assert np.allclose([[up[v, k, h + 1] for h in range(hs)] for v, k in names], s @ base[-s.shape[1] :])


def test_shrinkage_without_the_matrix(spark):
    rng = np.random.default_rng(6)
    resid = rng.normal(size=(40, 25)) + 0.8 * rng.normal(size=25)
    centred = resid - resid.mean(1, keepdims=True)
    r = np.corrcoef(centred)[~np.eye(40, dtype=bool)]
    tails = spark.createDataFrame([([float(x) for x in row],) for row in resid], "tail array<double>").repartition(3)
    weight, variance, n = R.shrinkage(tails, 25)
    assert abs(weight - np.clip(1 - r.mean() ** 2 / (r**2).mean(), 0.05, 1.0)) < 1e-9
    assert abs(variance - resid.var(1, ddof=1).mean()) < 1e-9 and n == 40


def test_joint_samples_have_the_shrunk_covariance(spark):
    rng = np.random.default_rng(7)
    resid = rng.normal(size=(5, 60)) * np.array([[1.0], [2.0], [0.5], [1.0], [0.0]]) + np.array([[1.0], [1.0], [-1.0], [0.0], [0.0]]) * rng.normal(size=60)
    resid[4] = 3.0
    points = spark.createDataFrame([(f"k{i}", h, 1000.0) for i in range(5) for h in (1, 2)], "bkey string, h int, value double")
    tails = spark.createDataFrame([(f"k{i}", [float(x) for x in row]) for i, row in enumerate(resid)], "bkey string, tail array<double>")
    draws = PR.bottom_samples(points, tails, samples=20_000, length=60).toPandas()
    again = PR.bottom_samples(points.repartition(5), tails.repartition(2), samples=20_000, length=60).toPandas()
    wide = draws.pivot(index=["h", "sample"], columns="bkey", values="value")
    pd.testing.assert_frame_equal(wide, again.pivot(index=["h", "sample"], columns="bkey", values="value"))
    sd = resid.std(1)
    corr = np.nan_to_num(np.corrcoef(resid[:4]), nan=0.0)
    want = np.outer(sd[:4], sd[:4]) * (0.8 * corr + 0.2 * np.eye(4))
    assert np.abs(np.cov(wide.to_numpy()[:, :4].T) - want).max() < 0.05 * want.max()
    assert (wide["k4"] == 1000.0).all() and np.abs(wide.mean() - 1000).max() < 0.1
    low = PR.bottom_samples(points.withColumn("value", F.lit(0.1)), tails, samples=200, length=60)
    assert low.where("value < 0").count() == 0 and low.count() == 2000


# fold states


def test_fold_states_equal_folds_from_the_start(spark):
    rng = np.random.default_rng(8)
    days = 300
    rows = []
    for k, share in enumerate((1.0, 0.5, 0.1, 0.02, 0.0)):
        kept = [d for d in range(days) if rng.random() < share] or [days - 1]
        rows += [("store", f"k{k}", FIRST + timedelta(days=d), float(rng.integers(0, 9))) for d in kept]
    panel = spark.createDataFrame(rows + [("store", "edge", FIRST, 4.0), ("store", "late", FIRST + timedelta(days=days - 1), 2.0)], "level string, key string, date date, y double")
    grid = P.dense(panel)
    starts = [(r.fold, r.origin) for r in P.origins(grid).collect()]
    last = FIRST + timedelta(days=days - 1)
    states = FO.fold_states(panel, FIRST, last, starts, tail=40)
    of = lambda d: {(r.fold, r.key, r.method, r.h): (r.y, r.yhat) for r in d.collect()}
    assert of(FO.backtest(states)) == of(B.backtest(grid))
    hist = B.histories(grid, P.origins(grid)).withColumn("fit", B.ses_fit(F.col("ys"))).collect()
    alphas = {(r.fold, r.key): r.fit.alpha for r in hist}
    for r in states.collect():
        ys = next(h.ys for h in hist if (h.fold, h.key) == (r.fold, r.key))
        assert r.alpha == alphas[r.fold, r.key] and r.n == len(ys)
        level, errors = ys[0], []
        for y in ys[1:]:
            errors.append(y - level)
            level = r.alpha * y + (1 - r.alpha) * level
        assert np.allclose(r.resid, errors[-40:])
    seasonal = FO.fold_states(panel, FIRST, last, starts[:1], tail=40, errors="seasonal").where("key = 'k0'").first()
    ys = next(h.ys for h in hist if (h.fold, h.key) == (seasonal.fold, "k0"))
    assert np.allclose(seasonal.resid, (np.array(ys[7:]) - np.array(ys[:-7]))[-40:])
    none = FO.fold_states(panel, FIRST, last, [(1, FIRST - timedelta(days=3)), (2, FIRST + timedelta(days=3))], tail=5).orderBy("fold", "key").collect()
    assert none[0].naive is None and (none[0].ses, none[0].croston_sba, none[0].n, none[0].week) == (0.0, 0.0, 0, [])
    assert FO.fold_states(panel.limit(0), None, None, []).count() == 0


# artifacts


def test_artifacts_are_built_once_and_pinned(spark, tmp_path):
    source = tmp_path / "in.parquet"
    spark.range(5).write.parquet(str(source))
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(str(source)).withColumn("double", F.col("id") * 2)

    ask = lambda **p: A.stored(spark, "t", [str(source)], p, build)
    first = ask(x=1)
    assert first.count() == 5 and ask(x=1).count() == 5 and len(built) == 1
    assert ask(x=2).count() == 5 and len(built) == 2
    spark.range(7).write.mode("overwrite").parquet(str(source))
    second = ask(x=1)
    assert second.count() == 7 and len(built) == 3
    assert first.count() == 5  # a reader keeps the version that it was given while a new one is published
    at = A.folder(spark, "t", {"x": 1, "paths": [str(source)]})
    A.publish(spark.range(2), at)
    assert A.current(spark, at).count() == 2 and second.count() == 7
    assert A.current(spark, at, "other inputs") is None and A.current(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(Exception):
        first.count()  # two versions are kept


def test_bucketed_artifacts_exchange_nothing(spark, tmp_path):
    from pyspark.sql import Window

    source = tmp_path / "in.parquet"
    spark.range(300).selectExpr("concat('k', id % 7) AS key", "id AS t", "CAST(id AS double) AS y").write.parquet(str(source))
    ask = lambda: A.stored(spark, "b", [str(source)], {}, lambda: spark.read.parquet(str(source)), ("key",), ("t",))
    for _ in range(2):  # as written, and as opened again
        table = ask()
        df = table.withColumn("step", F.col("y") - F.lag("y").over(Window.partitionBy("key").orderBy("t"))).groupBy("key").agg(F.sum("step").alias("s"), F.count("*").alias("n"))
        df.collect()
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.key: (r.s, r.n) for r in df.collect()} == {f"k{k}": (float(max(range(k, 300, 7)) - k), len(range(k, 300, 7))) for k in range(7)}
        for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("artifact_")]:
            spark.sql(f"DROP TABLE {name}")  # a later session does not know the table


def test_reports_are_in_order(spark, tmp_path):
    from demandloom.sources import sales as S

    a = spark.createDataFrame([(k % 3, f"k{k:03d}", k) for k in range(200)], "g int, key string, n int").repartition(7)
    S.write_report({"First": (a, ["g", "key"]), "Second": (a.groupBy("g").count(), ["g"])}, str(tmp_path / "r"))
    lines = [line for p in sorted((tmp_path / "r").glob("part-*")) for line in p.read_text().splitlines()]
    want = ["## First", *[f"{k % 3}\tk{k:03d}\t{k}" for k in sorted(range(200), key=lambda k: (k % 3, k))], "## Second", "0\t67", "1\t67", "2\t66"]
    assert lines == want


def test_pricing_sections(spark):
    from demandloom.plans import sections as SC

    fit = "cat_id string, {}, estimate double, se double, cross double, cross_se double, status string"
    items = spark.createDataFrame([("a", f"i{k}", -1.0 - 0.1 * k, 0.05, None, None, "fitted") for k in range(5)] + [("a", "x", None, None, None, None, "few rows")], fit.format("item_id string"))
    got = {(r.section, r.cat_id, r.figure): r.value for r in SC.heterogeneity(items).collect()}
    assert got["heterogeneity", "a", "items"] == 5 and abs(got["heterogeneity", "a", "category_mean"] + 1.2) < 1e-9
    assert abs(got["heterogeneity", "a", "noise_share"] - 0.0025 / 0.025) < 1e-9 and got["heterogeneity", "a", "sd_shrunk"] < got["heterogeneity", "a", "sd_raw"]
    parts = spark.createDataFrame([("a", "promo_weeks", -2.0, 0.1, None, None, "fitted"), ("a", "shelf_weeks", -1.5, 0.1, None, None, "fitted"), ("a", "low_volume", -1.0, 0.1, None, None, "not settled")], fit.format("segment string"))
    assert {r.figure: r.value for r in SC.segments(parts).collect()} == {"promo_weeks": -2.0, "shelf_weeks": -1.5, "promo_less_shelf": -0.5}
    cross = spark.createDataFrame([("a", "G", -1.5, 0.1, 0.4, 0.05, "fitted"), ("a", "H", -1.4, 0.1, 0.1, 0.05, "fitted"), ("a", "I", -1.3, 0.1, None, None, "fitted")], fit.format("spec string"))
    got = {r.figure: round(r.value, 9) for r in SC.rivals(cross).collect()}
    assert got == {"own": -1.5, "cross": 0.4, "cross_se": 0.05, "attenuation": 0.75, "own_without_rivals": -1.3, "absorbed": 0.2}
