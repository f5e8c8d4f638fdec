"""Backtests, reconciliation, quantiles, lead time and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.catalogue.base import SCALE, UPPER, days_of, grid_of, last_day, last_fold, last_origin, origins_of, panel_of, states_of
from demandloom.catalogue.registry import Catalogue, r6, r6s
from demandloom.catalogue.sql import with_
from demandloom.functions import leadtime as L
from demandloom.functions import metrics as M
from demandloom.functions import quantiles as Q
from demandloom.operators import baselines as B
from demandloom.operators import folds as FO
from demandloom.operators import gate as G
from demandloom.operators import panel as P
from demandloom.operators import reconcile as R
from demandloom.sources.sales import sales
from demandloom.sources.store import written

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles
BOTH = "round(sum(abs(y - yhat)) / nullif(sum(abs(y)), 0), 6) AS wmape, round(sum(yhat - y) / nullif(sum(abs(y)), 0), 6) + 0.0::DOUBLE AS bias"


def backtest_of(spark, sf_dir, *levels: str, methods: tuple[str, ...] = tuple(B.BASELINES)):
    """The rolling-origin backtest of the upper levels, or some of them, from the stored fold states."""
    return FO.backtest(states_of(spark, sf_dir).where(F.col("level").isin(*(levels or UPPER))), methods)


def classes_before(spark, sf_dir, *levels: str, fold: int = 4):
    """(level, key, class) from the days before a fold's origin: with fold 4 no evaluation day has a part in a series' class."""
    panel = panel_of(spark, sf_dir).where(F.col("level").isin(*(levels or UPPER)))
    origin = origins_of(spark, sf_dir).where(F.col("fold") == fold).select("origin")
    days = sales(spark, sf_dir).agg(F.min("date").alias("first")).crossJoin(origin).select("origin", F.datediff("origin", "first").alias("days"))
    return M.sparse_adi_cv2(panel, days, "level", "key").select("level", "key", "class")


def store_sums(backtest, *by: str):
    """Sums by method and window (selecting: folds 1 to 3), kept: everything below reads these few rows."""
    return written(G.method_sums(backtest.withColumn("selecting", F.col("fold") <= 3), *by, "selecting"), "method-sums")


@C.query(with_("backtest", """SELECT level, round(n, 6) AS naive, round(s, 6) AS seasonal_naive, round(e, 6) AS ses, round(c, 6) AS croston_sba, round(s - e, 6) + 0.0::DOUBLE AS fva FROM (SELECT level, max(w) FILTER (WHERE method = 'naive') AS n, max(w) FILTER (WHERE method = 'seasonal_naive') AS s, max(w) FILTER (WHERE method = 'ses') AS e, max(w) FILTER (WHERE method = 'croston_sba') AS c
  FROM (SELECT level, method, sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS w FROM backtest WHERE fold > 3 GROUP BY level, method) GROUP BY level)"""))
def A15_pivot_wmape(spark, sf_dir):
    """WMAPE by level and method on the evaluation folds, and the value added over the seasonal naive (positive is good)."""
    b = backtest_of(spark, sf_dir).where("fold > 3").groupBy("level", "method").agg(M.wmape().alias("w"))
    wide = b.groupBy("level").pivot("method", list(B.BASELINES)).agg(F.first("w"))
    return wide.select("level", *[r6(m, m) for m in B.BASELINES], r6(F.col("seasonal_naive") - F.col("ses"), "fva"))


_SCORED = "SELECT key, method, sum(abs(y - yhat)) / greatest(sum(abs(y)), 1e-9::DOUBLE) AS wmape, sum(yhat - y) / greatest(sum(abs(y)), 1e-9::DOUBLE) AS bias FROM backtest WHERE level = 'store' AND fold <= 3 GROUP BY key, method"
_CHAMPIONS = "SELECT key, champion, coalesce(guarded, champion) AS guarded FROM (SELECT key, arg_min(method, (wmape, method)) AS champion, arg_min(method, (wmape, method)) FILTER (WHERE abs(bias) <= 0.15::DOUBLE) AS guarded FROM scored GROUP BY key)"


@C.query(with_("backtest", "SELECT b.key, champion, guarded, round(sum(abs(y - yhat)) FILTER (WHERE method = champion), 6) AS abs_err, round(sum(abs(y - yhat)) FILTER (WHERE method = guarded), 6) AS abs_err_guarded FROM backtest b JOIN champions USING (key) WHERE level = 'store' AND fold > 3 GROUP BY ALL", scored=_SCORED, champions=_CHAMPIONS))
def J6_pick_champion(spark, sf_dir):
    """Each key's champion on folds 1 to 3, with and without the bias guard, and its error on folds 4 to 6."""
    sums = store_sums(backtest_of(spark, sf_dir, "store"), "key")
    met = sums.where("NOT selecting").join(G.champions(sums.where("selecting")), "key")
    return met.groupBy("key", "champion", "guarded").agg(*[r6(F.sum(F.when(F.col("method") == F.col(c), F.col("abs_err"))), n) for c, n in (("champion", "abs_err"), ("guarded", "abs_err_guarded"))])


@C.query(with_("backtest", "SELECT method, coalesce(a.n, 0) AS champion, coalesce(g.n, 0) AS guarded FROM (SELECT champion AS method, count(*) AS n FROM champions GROUP BY 1) a FULL JOIN (SELECT guarded AS method, count(*) AS n FROM champions GROUP BY 1) g USING (method)", scored=_SCORED, champions=_CHAMPIONS))
def C7_champion_mix(spark, sf_dir):
    """How many keys each method wins under both rules."""
    c = G.champions(store_sums(backtest_of(spark, sf_dir, "store"), "key").where("selecting"))
    both = [c.groupBy(F.col(n).alias("method")).agg(F.count("*").alias(n)) for n in ("champion", "guarded")]
    return both[0].join(both[1], "method", "full").select("method", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("champion", "guarded")])


@C.query(with_("backtest", """SELECT level, method, round(sum(abs(y - yhat)) FILTER (WHERE h <= 7) / nullif(sum(y) FILTER (WHERE h <= 7), 0), 6) AS h1_7, round(sum(abs(y - yhat)) FILTER (WHERE h > 7) / nullif(sum(y) FILTER (WHERE h > 7), 0), 6) AS h8_28, BOTH FROM backtest GROUP BY level, method""".replace("BOTH", BOTH)))
def M8_horizon_split(spark, sf_dir):
    """Error of the first week against the rest, with overall WMAPE and bias, over six folds."""
    near, far = F.col("h") <= 7, F.col("h") > 7
    e = F.abs(F.col("y") - F.col("yhat"))
    part = lambda c: F.try_divide(F.sum(F.when(c, e)), F.sum(F.when(c, F.col("y"))))
    return backtest_of(spark, sf_dir).groupBy("level", "method").agg(r6(part(near), "h1_7"), r6(part(far), "h8_28"), r6(M.wmape(), "wmape"), r6(M.bias(), "bias"))


@C.query(with_("backtest classes_before", """SELECT class, method, count(*) AS series, round(avg(mase), 6) AS mase FROM (SELECT level, key, method, avg(abs(y - yhat)) / nullif(max(s.a), 0) AS mase FROM backtest JOIN scale s USING (level, key) WHERE fold = 6 GROUP BY level, key, method) JOIN classes_before USING (level, key) GROUP BY class, method""", scale=SCALE))
def R2_mase_by_class(spark, sf_dir):
    """Mean scaled error by demand class and method over the last fold."""
    g = grid_of(spark, sf_dir, *UPPER)
    scale = M.seasonal_scale(last_fold(g, spark, sf_dir).where("date < origin"), "level", "key")
    each = backtest_of(spark, sf_dir).where("fold = 6").join(scale, ["level", "key"]).groupBy("level", "key", "method").agg(M.mase(F.col("scale_abs")).alias("mase"))
    met = each.join(classes_before(spark, sf_dir), ["level", "key"])
    return met.groupBy("class", "method").agg(F.count("*").alias("series"), r6(F.avg("mase"), "mase"))


def _forecasts(spark, sf_dir, method):
    b = backtest_of(spark, sf_dir, methods=(method,)).where("fold = 6")
    return b.groupBy("level", "key").agg(r6(F.min("yhat"), "first"), r6(F.sum("yhat"), "total"))


def _forecast_sql(method: str) -> str:
    return with_("backtest", f"SELECT level, key, round(min(yhat), 6) + 0.0::DOUBLE AS first, round(sum(yhat), 6) + 0.0::DOUBLE AS total FROM backtest WHERE fold = 6 AND method = '{method}' GROUP BY level, key")


@C.query(_forecast_sql("naive"))
def B1_naive(spark, sf_dir):
    return _forecasts(spark, sf_dir, "naive")


@C.query(_forecast_sql("seasonal_naive"))
def B2_seasonal_naive(spark, sf_dir):
    return _forecasts(spark, sf_dir, "seasonal_naive")


@C.query(with_("ses", "SELECT level, key, round(alpha, 2) AS alpha, round(yhat, 6) AS level_end FROM ses WHERE fold = 6"))
def B3_ses(spark, sf_dir):
    """Exponential smoothing with its alpha by in-sample error."""
    return states_of(spark, sf_dir).where("fold = 6").select("level", "key", F.round("alpha", 2).alias("alpha"), r6("ses", "level_end"))


@C.query(_forecast_sql("croston_sba"))
def B4_croston(spark, sf_dir):
    return _forecasts(spark, sf_dir, "croston_sba")


@C.query(with_("backtest", "SELECT method, count(*) AS n, round(sum(yhat), 4) AS checksum FROM backtest GROUP BY method"))
def U2_method_union(spark, sf_dir):
    """All methods in one long table."""
    return backtest_of(spark, sf_dir).groupBy("method").agg(F.count("*").alias("n"), F.round(F.sum("yhat"), 4).alias("checksum"))


@C.query(with_("grid", """SELECT key, t::INT AS t, round(scale + 3.1e-8::DOUBLE, 6) AS scale, round(list_sum(fut) / scale + 3.1e-8::DOUBLE, 6) AS checksum FROM (SELECT key, t, greatest(list_avg(past), 0.05::DOUBLE) AS scale, fut, past FROM (SELECT key, row_number() OVER s - 1 AS t, list(y) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 56 PRECEDING AND 1 PRECEDING) AS past, list(y) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS fut FROM grid WHERE level = 'state' WINDOW s AS (PARTITION BY key ORDER BY date)) WHERE len(past) = 56 AND len(fut) = 28 AND (t - 56) % 3 = 0)"""))
def B10_windows(spark, sf_dir):
    """Scaled (56 days, 28 days) training windows with stride 3."""
    from demandloom.operators.deep import training_windows

    w = training_windows(grid_of(spark, sf_dir, "state"), stride=3)
    return w.select("key", "t", r6s("scale", "scale"), r6s(F.aggregate("future", F.lit(0.0), lambda a, x: a + x), "checksum"))


@C.query(with_("backtest", "SELECT level, key, h, round(value, 6) + 0.0::DOUBLE AS value, 0.0::DOUBLE AS violation FROM (SELECT 'store' AS level, key, h, yhat AS value FROM b UNION ALL SELECT 'state', state_id, h, sum(yhat) FROM b JOIN m USING (key) GROUP BY ALL UNION ALL SELECT 'total', 'TOTAL', h, sum(yhat) FROM b GROUP BY ALL)",
  b="SELECT key, h, yhat FROM backtest WHERE level = 'store' AND fold = 6 AND method = 'seasonal_naive'", m="SELECT DISTINCT store_id AS key, state_id FROM sales"))
def H5_bottom_up(spark, sf_dir):
    """Store forecasts summed up the tree, and their distance from the directly made ones (linear, so none)."""
    s = sales(spark, sf_dir)
    edge = R.edges(s.select("state_id", "store_id", F.col("store_id").alias("bkey")).distinct(), UPPER)
    b = backtest_of(spark, sf_dir, methods=("seasonal_naive",)).where("fold = 6").select("level", "key", "h", F.col("yhat").alias("value"))
    up = R.bottom_up(edge, b.where("level = 'store'").select(F.col("key").alias("bkey"), "h", "value"), "h")
    return up.crossJoin(R.coherence_error(up, b, "h")).select("level", "key", "h", r6("value", "value"), r6("violation", "violation"))


@C.query(with_("backtest", """SELECT key, h, round(v, 6) AS value FROM (SELECT c.key, h, c.yhat + c.w * (t.yhat - sum(c.yhat) OVER g) / (t.w + sum(c.w) OVER g) AS v FROM c JOIN t USING (h) WINDOW g AS (PARTITION BY h) UNION ALL SELECT 'TOTAL', h, sum(v) FROM (SELECT h, c.yhat + c.w * (t.yhat - sum(c.yhat) OVER g) / (t.w + sum(c.w) OVER g) AS v FROM c JOIN t USING (h) WINDOW g AS (PARTITION BY h)) GROUP BY h)""",
  wts="SELECT level, key, var_pop(d) AS w FROM (SELECT level, key, y - lag(y, 7) OVER (PARTITION BY level, key ORDER BY date) AS d FROM grid, folds WHERE fold = 6 AND date < origin) GROUP BY level, key",
  f="SELECT level, key, h, yhat, w FROM backtest JOIN wts USING (level, key) WHERE fold = 6 AND method = 'ses'", c="SELECT * FROM f WHERE level = 'state'", t="SELECT * FROM f WHERE level = 'total'"))
def H7_mint_two_level(spark, sf_dir):
    """Minimum trace over the total and its states with error variances as weights."""
    g = grid_of(spark, sf_dir, "total", "state")
    d = F.col("y") - F.lag("y", 7).over(Window.partitionBy("level", "key").orderBy("date"))
    w = last_fold(g, spark, sf_dir).where("date < origin").withColumn("d", d).groupBy("level", "key").agg(F.var_pop("d").alias("w"))
    f = backtest_of(spark, sf_dir, "total", "state", methods=("ses",)).where("fold = 6").join(w, ["level", "key"]).select("level", "key", "h", F.col("yhat").alias("value"), "w")
    out = R.mint_two_level(f.where("level = 'total'").select("h", "value", "w"), f.where("level = 'state'").select("key", "h", "value", "w"), "h")
    return out.select("key", "h", r6("value", "value"))


@C.query(with_("backtest", """SELECT key, h, round(yhat * share, 6) AS value FROM (SELECT store_id || '|' || cat_id AS key, store_id, coalesce(sum(units) / nullif(sum(sum(units)) OVER (PARTITION BY store_id), 0), 1.0::DOUBLE / count(*) OVER (PARTITION BY store_id)) AS share FROM sales, folds WHERE fold = 6 AND date < origin GROUP BY store_id, cat_id) JOIN (SELECT key AS store_id, h, yhat FROM backtest WHERE level = 'store' AND fold = 6 AND method = 'seasonal_naive') USING (store_id)"""))
def H9_middle_out(spark, sf_dir):
    """Store forecasts shared out to categories by historical proportions."""
    s = sales(spark, sf_dir).withColumn("key", F.concat_ws("|", "store_id", "cat_id"))
    before = s.crossJoin(F.broadcast(last_origin(spark, sf_dir))).where("date < origin").withColumnRenamed("units", "y")
    shares = R.proportions(before, "key", "store_id")
    f = backtest_of(spark, sf_dir, "store", methods=("seasonal_naive",)).where("fold = 6").select(F.col("key").alias("store_id"), "h", F.col("yhat").alias("value"))
    return R.middle_out(f, shares, "store_id").select("key", "h", r6("value", "value"))


_DRAWS = """SELECT k.key, k.store_id, k.state_id, s AS sample, ys[((s * 1103515245 + k.i * 12345 + 20011) % 2147483648) % 180 + 1] AS v FROM (SELECT key, any_value(split_part(key, '|', 1)) AS store_id, any_value(state_id) AS state_id, list(y ORDER BY date)[-180:] AS ys, ('0x' || substr(md5(key), 1, 7))::BIGINT AS i FROM grid JOIN (SELECT DISTINCT store_id, state_id FROM sales) m ON split_part(key, '|', 1) = m.store_id WHERE level = 'store_cat' GROUP BY key) k, (SELECT unnest(range(0, 400)) AS s)"""


_UP = "SELECT 'total' AS level, 'TOTAL' AS key, sample, sum(v) AS v FROM draws GROUP BY sample UNION ALL SELECT 'state', state_id, sample, sum(v) FROM draws GROUP BY state_id, sample UNION ALL SELECT 'store', store_id, sample, sum(v) FROM draws GROUP BY store_id, sample UNION ALL SELECT 'store_cat', key, sample, v FROM draws"


def bottom_draws(spark, sf_dir):
    """(edge, draws): the tree down to categories in stores, and 400 draws from each one's last 180 days."""
    s = sales(spark, sf_dir)
    g = grid_of(spark, sf_dir, "store_cat")
    ys = g.groupBy("key").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("date", "y"))), lambda x: x["y"]), -180, 180).alias("ys"))
    numbered = ys.withColumn("i", F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 7), 16, 10).cast("long"))
    draw = F.element_at("ys", (((F.col("sample") * 1103515245 + F.col("i") * 12345 + 20011) % 2147483648) % 180 + 1).cast("int"))
    draws = numbered.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(399)).cast("array<bigint>"))).select(F.col("key").alias("bkey"), "sample", draw.alias("value"))
    edge = R.edges(s.select("state_id", "store_id", "cat_id", F.concat_ws("|", "store_id", "cat_id").alias("bkey")).distinct(), P.LEVELS)
    return edge, draws


@C.query(with_("grid", """SELECT level, round(sum(own), 6) AS q95, round(max(child) / nullif(sum(own), 0), 6) AS ratio, round(sum(own) - max(child), 6) + 0.0::DOUBLE AS gap FROM (SELECT level, key, quantile_cont(v, 0.95) AS own FROM up GROUP BY level, key), (SELECT sum(q) AS child FROM (SELECT quantile_cont(v, 0.95) AS q FROM draws GROUP BY key)) GROUP BY level""",
  draws=_DRAWS, up=_UP))
def H13_reconcile_draws(spark, sf_dir):
    """Draws at the bottom summed up the tree: quantiles by level, and how far sums of bottom quantiles are from them."""
    from demandloom.operators import probabilistic as PR

    edge, draws = bottom_draws(spark, sf_dir)
    return PR.level_ratios(PR.reconcile_draws(edge, draws), "store_cat", 0.95).select("level", r6("q95", "q95"), r6("ratio", "ratio"), r6("gap", "gap"))


@C.query(with_("grid", """SELECT round(max(gap), 6) + 0.0::DOUBLE AS max_gap, round(avg(gap), 6) + 0.0::DOUBLE AS mean_gap, round(avg((gap > 1e-9::DOUBLE)::INT), 6) AS share_incoherent FROM (SELECT child - value AS gap FROM q JOIN child USING (level, key))""",
  draws=_DRAWS, up=_UP, q="SELECT level, key, quantile_cont(v, 0.95) AS value FROM up GROUP BY level, key", b="SELECT d.*, value FROM (SELECT DISTINCT key, store_id, state_id FROM draws) d JOIN q ON q.level = 'store_cat' AND q.key = d.key",
  child="SELECT 'total' AS level, 'TOTAL' AS key, sum(value) AS child FROM b UNION ALL SELECT 'state', state_id, sum(value) FROM b GROUP BY state_id UNION ALL SELECT 'store', store_id, sum(value) FROM b GROUP BY store_id UNION ALL SELECT 'store_cat', key, value FROM b"))
def H15_coherence_gap(spark, sf_dir):
    """How far summed bottom quantiles exceed the quantiles of the summed draws."""
    from demandloom.operators import probabilistic as PR

    edge, draws = bottom_draws(spark, sf_dir)
    q = PR.sample_quantiles(PR.reconcile_draws(edge, draws), (0.95,)).select("level", "key", F.col("q")[0].alias("value"))
    out = PR.coherence_gap(edge, written(q, "draw-quantiles"))
    return out.select(*[r6(c, c) for c in ("max_gap", "mean_gap", "share_incoherent")])


_FAN = """SELECT f.key, f.h, f.y, q FROM (SELECT key, h, y FROM future WHERE level = 'store' AND fold = 6) f JOIN (SELECT key, quantile_cont(v, [0.5, 0.75, 0.9, 0.95, 0.98]) AS q FROM (SELECT key, unnest(ys[-180:]) AS v FROM hist WHERE level = 'store' AND fold = 6) GROUP BY key) USING (key)"""
_TAUS = "[0.5, 0.75, 0.9, 0.95, 0.98]::DOUBLE[]"


def fan_of(spark, sf_dir, window: int = 180):
    """(key, h, y, q): the empirical quantiles of each store's last days before the last origin as its fan."""
    g = grid_of(spark, sf_dir, "store", since=last_origin(spark, sf_dir).select(F.date_sub("origin", window).alias("cut")))
    h = B.histories(g, origins_of(spark, sf_dir).where("fold = 6"))
    values = h.select("key", F.explode(F.slice("ys", F.greatest(F.size("ys") - window + 1, F.lit(1)), F.lit(window))).alias("v"))
    q = values.groupBy("key").agg(F.percentile("v", F.array(*[F.lit(t) for t in Q.SERVICE_LEVELS])).alias("q"))
    return h.select("key", F.posexplode("actual").alias("h0", "y")).select("key", (F.col("h0") + 1).alias("h"), "y").join(q, "key")


@C.query(with_("future hist", "SELECT tau, round(avg((y <= f + 1e-9::DOUBLE)::INT), 6) AS coverage, round(avg(f), 6) AS mean, round(tau / (1 - tau), 6) AS cost_ratio, " + ", ".join(f"round(avg(greatest({t}::DOUBLE * (y - f), ({t}::DOUBLE - 1) * (y - f))), 6) AS pinball_{round(100 * t)}" for t in Q.SERVICE_LEVELS) + f" FROM (SELECT y, unnest({_TAUS}) AS tau, unnest(q) AS f FROM fan) GROUP BY tau", fan=_FAN))
def Q1_pinball_table(spark, sf_dir):
    """Every quantile scored under every loss, with coverage and the implied cost ratio."""
    t = Q.cross_scores(fan_of(spark, sf_dir))
    return t.select("tau", r6("coverage", "coverage"), r6("mean", "mean"), r6(Q.implied_cost_ratio(F.col("tau")), "cost_ratio"), *[r6(c, c) for c in t.columns if c.startswith("pinball")])


@C.query(with_("future hist", f"SELECT loss, arg_min(tau, (round(p, 9), tau)) AS best_tau FROM (SELECT l.tau AS loss, s.tau, avg(greatest(l.tau * (y - f), (l.tau - 1) * (y - f))) AS p FROM (SELECT y, unnest({_TAUS}) AS tau, unnest(q) AS f FROM fan) s, (SELECT unnest({_TAUS}) AS tau) l GROUP BY l.tau, s.tau) GROUP BY loss", fan=_FAN))
def Q10_diagonal_winner(spark, sf_dir):
    """Which quantile wins under each loss."""
    t = Q.cross_scores(fan_of(spark, sf_dir))
    losses = F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(f"pinball_{round(100 * x)}").alias("p")) for x in Q.SERVICE_LEVELS])).alias("l")
    return t.select("tau", losses).groupBy("l.loss").agg(F.min_by("tau", F.struct(F.round("l.p", 9), F.col("tau"))).alias("best_tau"))


@C.query(with_("grid", """SELECT key, tau, round(q, 6) AS q, CAST(ceil(greatest(q * 7 - stock, 0) / 12) * 12 AS BIGINT) AS order_quantity, round(tau / (1 - tau), 6) AS cost_ratio FROM (SELECT key, any_value(stock) AS stock, tau, quantile_cont(y, any_value(tau)) AS q FROM x GROUP BY key, tau)""".replace("quantile_cont(y, any_value(tau))", "CASE tau WHEN 0.5 THEN quantile_cont(y, 0.5) WHEN 0.75 THEN quantile_cont(y, 0.75) ELSE quantile_cont(y, 0.9) END"),
  x="SELECT g.key, y, length(g.key)::DOUBLE AS stock, tau FROM grid g, bounds, (SELECT unnest([0.5, 0.75, 0.9]::DOUBLE[]) AS tau) WHERE level = 'store_cat' AND date > b - 180"))
def Q3_newsvendor(spark, sf_dir):
    """Orders in whole cases for a week at the quantile that unit costs imply."""
    g = grid_of(spark, sf_dir, "store_cat", since=last_day(spark, sf_dir).select(F.date_sub("b", 179).alias("cut")))
    costs = ((1.0, 1.0), (3.0, 1.0), (9.0, 1.0))
    taus = [u / (u + o) for u, o in costs]
    q = g.groupBy("key").agg(F.percentile("y", F.array(*[F.lit(t) for t in taus])).alias("qs"))
    rows = q.select("key", F.explode(F.arrays_zip("qs", F.array(*[F.struct(F.lit(u).alias("u"), F.lit(o).alias("o")) for u, o in costs]).alias("c"))).alias("x")).select("key", F.col("x.qs").alias("q"), "x.c.u", "x.c.o")
    tau = Q.newsvendor_quantile(F.col("u"), F.col("o"))
    order = Q.order_up_to(F.col("q") * 7, F.length("key").cast("double"), F.lit(12)).cast("long")
    return rows.select("key", tau.alias("tau"), r6("q", "q"), order.alias("order_quantity"), r6(Q.implied_cost_ratio(tau), "cost_ratio"))


_CROSSED = """SELECT h.key, [quantile_cont(v, 0.5) FILTER (WHERE i <= 28), quantile_cont(v, 0.75) FILTER (WHERE i <= 56), quantile_cont(v, 0.9) FILTER (WHERE i <= 14), quantile_cont(v, 0.95), quantile_cont(v, 0.98) FILTER (WHERE i <= 28)] AS q FROM (SELECT key, unnest(list_reverse(ys)[1:180]) AS v, generate_subscripts(list_reverse(ys)[1:180], 1) AS i FROM hist WHERE level = 'store' AND fold = 6) h GROUP BY h.key"""


@C.query(with_("future hist", """SELECT round(avg(c), 6) AS rate_before, 0.0::DOUBLE AS rate_after, round(avg(p0), 6) AS pinball_before, round(avg(p1), 6) AS pinball_after FROM (SELECT ((q[2] < q[1] - 1e-9::DOUBLE)::INT + (q[3] < q[2] - 1e-9::DOUBLE)::INT + (q[4] < q[3] - 1e-9::DOUBLE)::INT + (q[5] < q[4] - 1e-9::DOUBLE)::INT) / 4.0::DOUBLE AS c, greatest(0.95::DOUBLE * (y - q[4]), -0.05::DOUBLE * (y - q[4])) AS p0, greatest(0.95::DOUBLE * (y - list_sort(q)[4]), -0.05::DOUBLE * (y - list_sort(q)[4])) AS p1 FROM future f JOIN crossed USING (key) WHERE f.level = 'store' AND f.fold = 6)""", crossed=_CROSSED))
def Q7_crossing(spark, sf_dir):
    """A fan whose quantiles come from different windows crosses; rearranged, it does not, and its loss is compared."""
    g = grid_of(spark, sf_dir, "store")
    h = B.histories(g, origins_of(spark, sf_dir).where("fold = 6"))
    back = h.select("key", F.posexplode(F.slice(F.reverse("ys"), 1, 180)).alias("i", "v"))
    parts = ((0.5, 28), (0.75, 56), (0.9, 14), (0.95, 180), (0.98, 28))
    q = back.groupBy("key").agg(F.array(*[F.percentile(F.when(F.col("i") < n, F.col("v")), t) for t, n in parts]).alias("q"))
    fan = h.select("key", F.explode("actual").alias("y")).join(q, "key").withColumn("sorted", Q.rearranged(F.col("q")))
    before = fan.agg(Q.crossing_rate(fan).alias("rate_before"), F.avg(Q.pinball(F.col("y"), F.col("q")[3], 0.95)).alias("pinball_before"))
    after = fan.select("y", F.col("sorted").alias("q"))
    after = after.agg(Q.crossing_rate(after).alias("rate_after"), F.avg(Q.pinball(F.col("y"), F.col("q")[3], 0.95)).alias("pinball_after"))
    return before.crossJoin(after).select(*[r6(c, c) for c in ("rate_before", "rate_after", "pinball_before", "pinball_after")])


_Z90 = repr(Q.normal_quantile(0.9))


@C.query(with_("grid", f"""SELECT key, len::INT AS length, round(q90 * len, 6) AS sum_of_daily, round(m * len + {_Z90}::DOUBLE * sd * sqrt(len), 6) AS iid FROM (SELECT key, avg(y) AS m, stddev_pop(y) AS sd, quantile_cont(y, 0.9) AS q90 FROM grid, bounds WHERE level = 'store_cat' AND date > b - 180 GROUP BY key), (SELECT unnest([7, 14, 28]) AS len)"""))
def L6_leadtime_shortcuts(spark, sf_dir):
    """Summed daily quantiles and the independent normal, for three lead times."""
    g = grid_of(spark, sf_dir, "store_cat", since=last_day(spark, sf_dir).select(F.date_sub("b", 179).alias("cut")))
    s = g.groupBy("key").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("sd"), F.percentile("y", 0.9).alias("q90")).withColumn("length", F.explode(F.array(F.lit(7), F.lit(14), F.lit(28))))
    return s.select("key", "length", r6(F.col("q90") * F.col("length"), "sum_of_daily"), r6(L.iid_normal(F.col("m") * F.col("length"), F.col("sd"), F.col("length"), 0.9), "iid"))


_POOLS = {
    "changes": "SELECT key, date, y, b, lag(y, 7) OVER (PARTITION BY key ORDER BY date) AS p FROM grid, bounds WHERE level = 'store'",
    "errors": "SELECT key, (y - p) / sqrt(greatest(p, 0.25::DOUBLE)) AS z, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS i FROM changes WHERE p IS NOT NULL",
    "pools": "SELECT * FROM (SELECT key, count(*) AS n FROM errors GROUP BY key) JOIN (SELECT key, avg(y) FILTER (WHERE date > b - 28) AS point FROM changes GROUP BY key) USING (key)",
    "drawn": """SELECT p.key, s, point, sum(greatest(0, point + z * sqrt(greatest(point, 0.25::DOUBLE)))) AS d FROM (SELECT key, point, s, ((s * 1103515245 + (day // 7) * 12345 + 20011) % 2147483648) % (n - 6) + day % 7 AS i FROM pools, (SELECT unnest(range(0, 4000)) AS s), (SELECT unnest(range(0, 14)) AS day)) p
      JOIN errors e ON e.key = p.key AND e.i = p.i GROUP BY ALL""",
}


@C.query(with_("grid bounds", "SELECT key, tau, round(CASE WHEN tau = 0.9 THEN quantile_cont(d, 0.9) ELSE quantile_cont(d, 0.95) END, 6) AS quantile, round(max(point) * 14, 6) AS mean_path FROM drawn, (SELECT unnest([0.9, 0.95]::DOUBLE[]) AS tau) GROUP BY key, tau", **_POOLS))
def L2_bootstrap_lcg(spark, sf_dir):
    """Two-week demand by block bootstrap over 4,000 paths, with block starts that SQL can follow."""
    g = grid_of(spark, sf_dir, "store")
    g = g.crossJoin(F.broadcast(last_day(spark, sf_dir))).withColumn("p", F.lag("y", 7).over(Window.partitionBy("key").orderBy("date")))
    z = F.when(F.col("p").isNotNull(), F.struct("date", L.standardised(F.col("y") - F.col("p"), F.col("p")).alias("z")))
    per = g.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(z)), lambda x: x["z"]).alias("pool"), F.avg(F.when(F.col("date") > F.date_sub("b", 28), F.col("y"))).alias("point"))
    per = written(per, "pools")
    s = L.leadtime_totals(per.select("key", "point"), per.select("key", "pool"), 14, L.SAMPLES)
    return L.leadtime_quantiles(s, (0.9, 0.95)).join(per.select("key", "point"), "key").select("key", "tau", r6("quantile", "quantile"), r6(F.col("point") * 14, "mean_path"))


_GATED = """SELECT '{name}' AS gate, (SELECT count(*) FROM g_{name}) AS n_decisions, round(sum(abs(yhat - y)) / greatest(sum(abs(y)), 1e-9::DOUBLE), 6) AS wmape, round(sum(yhat - y) / greatest(sum(abs(y)), 1e-9::DOUBLE), 6) + 0.0::DOUBLE AS bias FROM bk JOIN g_{name} g ON g.gk = {by} AND g.method = bk.method WHERE fold > 3"""
_GATE = "SELECT gk, arg_min(method, (CASE WHEN abs(bias) <= 0.15::DOUBLE THEN 0 ELSE 1 END, CASE WHEN abs(bias) <= 0.15::DOUBLE THEN wmape ELSE abs(bias) END, method)) AS method FROM (SELECT {by} AS gk, method, sum(abs(yhat - y)) / greatest(sum(abs(y)), 1e-9::DOUBLE) AS wmape, sum(yhat - y) / greatest(sum(abs(y)), 1e-9::DOUBLE) AS bias FROM bk WHERE fold <= 3 GROUP BY 1, 2) GROUP BY gk"
_BYS = {"global": "'all'", "klass": "class", "key": "key"}


@C.query(with_("backtest classes_before", " UNION ALL ".join(_GATED.format(name=n, by=b) for n, b in _BYS.items()), bk="SELECT b.*, class FROM backtest b JOIN classes_before c ON b.key = c.key AND b.level = c.level WHERE b.level = 'store'", **{f"g_{n}": _GATE.format(by=b) for n, b in _BYS.items()}))
def C5_gates(spark, sf_dir):
    """One choice for all, one per demand class, one per series: selected on folds 1 to 3, scored on 4 to 6."""
    b = store_sums(backtest_of(spark, sf_dir, "store").join(classes_before(spark, sf_dir, "store"), ["level", "key"]), "key", "class")
    out = G.compare_gates(b.where("selecting"), b.where("NOT selecting"), {"global": F.lit("all"), "klass": F.col("class"), "key": F.col("key")})
    return out.select("gate", "n_decisions", r6("wmape", "wmape"), r6("bias", "bias"))


@C.query(with_("backtest classes_before", """SELECT class, count(*) AS n, round(avg((s < v)::INT), 6) AS win_rate, round(sum(es) / nullif(sum(ya), 0), 6) AS ses_wmape FROM (SELECT b.key, class, sum(abs(y - yhat)) FILTER (WHERE method = 'ses') AS s, sum(abs(y - yhat)) FILTER (WHERE method = 'seasonal_naive') AS v, sum(abs(y - yhat)) FILTER (WHERE method = 'ses') AS es, sum(abs(y)) FILTER (WHERE method = 'ses') AS ya FROM backtest b JOIN classes_before c ON b.key = c.key AND b.level = c.level WHERE b.level = 'store' AND fold > 3 GROUP BY b.key, class) GROUP BY class"""))
def R3_win_rate(spark, sf_dir):
    """By demand class, the share of series on which smoothing beats the seasonal naive."""
    b = backtest_of(spark, sf_dir, "store", methods=("seasonal_naive", "ses")).where("fold > 3").join(classes_before(spark, sf_dir, "store"), ["level", "key"])
    e = F.abs(F.col("y") - F.col("yhat"))
    per = b.groupBy("key", "class").agg(F.sum(F.when(F.col("method") == "ses", e)).alias("s"), F.sum(F.when(F.col("method") == "seasonal_naive", e)).alias("v"), F.sum(F.when(F.col("method") == "ses", F.abs("y"))).alias("a"))
    return per.groupBy("class").agg(F.count("*").alias("n"), r6(F.avg((F.col("s") < F.col("v")).cast("int")), "win_rate"), r6(F.try_divide(F.sum("s"), F.nullif(F.sum("a"), F.lit(0.0))), "ses_wmape"))


_RECON = """SELECT 'base' AS recon, level, key, h, y, yhat FROM f UNION ALL SELECT 'bottom_up', 'store', key, h, y, yhat FROM f WHERE level = 'store' UNION ALL SELECT 'bottom_up', u.level, u.key, u.h, u.y, s.v FROM f u JOIN (SELECT state_id AS key, h, sum(yhat) AS v FROM f JOIN m USING (key) WHERE level = 'store' GROUP BY ALL UNION ALL SELECT 'TOTAL', h, sum(yhat) FROM f WHERE level = 'store' GROUP BY ALL) s ON s.key = u.key AND s.h = u.h
  UNION ALL SELECT 'middle_out', 'state', key, h, y, yhat FROM f WHERE level = 'state' UNION ALL SELECT 'middle_out', 'store', u.key, u.h, u.y, p.yhat * share FROM f u JOIN m USING (key) JOIN shares USING (key) JOIN f p ON p.level = 'state' AND p.key = m.state_id AND p.h = u.h WHERE u.level = 'store' UNION ALL SELECT 'middle_out', 'total', u.key, u.h, u.y, s.v FROM f u JOIN (SELECT h, sum(yhat) AS v FROM f WHERE level = 'state' GROUP BY h) s ON s.h = u.h WHERE u.level = 'total'"""


@C.query(with_("backtest", "SELECT level, round(max(w) FILTER (WHERE recon = 'base'), 6) AS base, round(max(w) FILTER (WHERE recon = 'bottom_up'), 6) AS bottom_up, round(max(w) FILTER (WHERE recon = 'middle_out'), 6) AS middle_out, arg_min(recon, (round(w, 9), recon)) AS best FROM (SELECT recon, level, sum(abs(y - yhat)) / nullif(sum(abs(y)), 0) AS w FROM r GROUP BY recon, level) GROUP BY level",
  m="SELECT DISTINCT store_id AS key, state_id FROM sales", f="SELECT level, key, h, y, yhat FROM backtest WHERE fold = 6 AND method = 'ses'",
  shares="SELECT store_id AS key, sum(units) / sum(sum(units)) OVER (PARTITION BY state_id) AS share FROM sales, folds WHERE fold = 6 AND date < origin GROUP BY store_id, state_id", r=_RECON))
def R5_recon_report(spark, sf_dir):
    """Base, bottom-up and middle-out by level on the last fold, and the best of each level."""
    s = sales(spark, sf_dir)
    f = written(backtest_of(spark, sf_dir, methods=("ses",)).where("fold = 6").select("level", "key", "h", "y", F.col("yhat").alias("value")), "recon-base")
    places = s.select("state_id", "store_id", F.col("store_id").alias("bkey")).distinct()
    edge = R.edges(places, UPPER)
    actual = f.select("level", "key", "h", "y")
    bottom = f.where("level = 'store'").select(F.col("key").alias("bkey"), "h", "value")
    up = R.bottom_up(edge, bottom, "h").join(actual, ["level", "key", "h"])
    before = s.crossJoin(F.broadcast(last_origin(spark, sf_dir))).where("date < origin").withColumnRenamed("units", "y")
    middle = R.middle_out(f.where("level = 'state'").select(F.col("key").alias("state_id"), "h", "value"), R.proportions(before, "store_id", "state_id"), "state_id")
    out = R.bottom_up(edge, middle.select(F.col("store_id").alias("bkey"), "h", "value"), "h").join(actual, ["level", "key", "h"])
    cols = ["level", "y", "value"]
    rows = f.select(F.lit("base").alias("recon"), *cols).union(up.select(F.lit("bottom_up"), *cols)).union(out.select(F.lit("middle_out"), *cols))
    w = written(rows.groupBy("recon", "level").agg(M.wmape("y", "value").alias("w")), "recon-scores")
    wide = w.groupBy("level").pivot("recon", ["base", "bottom_up", "middle_out"]).agg(F.first("w"))
    best = w.groupBy("level").agg(F.min_by("recon", F.struct(F.round("w", 9), F.col("recon"))).alias("best"))
    return wide.join(best, "level").select("level", *[r6(c, c) for c in ("base", "bottom_up", "middle_out")], "best")


#: Six levels in SQL: a node's parent, the fold's last week, Croston's rate from the days with sales, and a sweep per variance.
_NODES = """SELECT 'total' AS level, 'TOTAL' AS key, NULL AS up UNION ALL SELECT DISTINCT 'state', state_id, 'TOTAL' FROM sales UNION ALL SELECT DISTINCT 'store', store_id, state_id FROM sales
  UNION ALL SELECT DISTINCT 'store_cat', store_id || '|' || cat_id, store_id FROM sales UNION ALL SELECT DISTINCT 'store_dept', store_id || '|' || dept_id, store_id || '|' || cat_id FROM sales
  UNION ALL SELECT DISTINCT 'store_item', store_id || '|' || cat_id || '|' || item_id, store_id || '|' || dept_id FROM sales"""
_SPINE = "SELECT n.level, n.key, d.date, coalesce(p.y, 0) AS y FROM nodes n CROSS JOIN (SELECT unnest(generate_series(b - 27 - 28 * 5 - 187, b, INTERVAL 1 DAY))::DATE AS date FROM bounds) d LEFT JOIN panel6 p ON p.level = n.level AND p.key = n.key AND p.date = d.date"
_RATES = """SELECT fold, level, key, CASE WHEN len(pts) = 0 THEN 0 WHEN len(pts) = 1 THEN pts[1].y / n ELSE s.z / greatest(s.p, 1e-9::DOUBLE) * 0.95::DOUBLE END AS rate FROM (SELECT *,
  list_reduce(pts[2:], lambda st, x: {'z': 0.1::DOUBLE * x.y + 0.9::DOUBLE * st.z, 'p': 0.1::DOUBLE * (x.i - st.i) + 0.9::DOUBLE * st.p, 'i': x.i, 'y': x.y}, {'z': pts[1].y, 'p': pts[1].i, 'i': pts[1].i, 'y': pts[1].y}) AS s
  FROM (SELECT f.fold, m.level, m.key, any_value(date_diff('day', a, origin)) AS n, coalesce(list({'z': 0::DOUBLE, 'p': 0::DOUBLE, 'i': date_diff('day', a, p.date) + 1::DOUBLE, 'y': p.y::DOUBLE} ORDER BY p.date) FILTER (WHERE p.y > 0), []) AS pts
    FROM nodes m CROSS JOIN folds f CROSS JOIN bounds LEFT JOIN panel6 p ON p.level = m.level AND p.key = m.key AND p.date < origin GROUP BY f.fold, m.level, m.key))"""
_BACK6 = """SELECT fold, level, key, method, h, y, CASE method WHEN 'naive' THEN ys[7] WHEN 'seasonal_naive' THEN ys[(h - 1) % 7 + 1] ELSE rate END AS yhat FROM (SELECT f.fold, f.origin, s.level, s.key, list(s.y ORDER BY s.date) AS ys FROM spine s JOIN folds f ON s.date >= f.origin - 7 AND s.date < f.origin GROUP BY ALL)
  JOIN (SELECT f.fold, s.level, s.key, date_diff('day', f.origin, s.date)::INT + 1 AS h, s.y FROM spine s JOIN folds f ON s.date >= f.origin AND s.date < f.origin + 28) USING (fold, level, key) JOIN rates USING (fold, level, key), (SELECT unnest(['naive', 'seasonal_naive', 'croston_sba']) AS method)"""
_SIX = {"nodes": _NODES, "spine": _SPINE, "rates": _RATES, "back6": _BACK6}
SIX_METHODS = ("naive", "seasonal_naive", "croston_sba")


def _materialised(sql: str, *names: str) -> str:
    for n in names:
        sql = sql.replace(f"\n{n} AS (", f"\n{n} AS MATERIALIZED (")
    return sql


@C.query(_materialised(with_("panel6 bounds folds", """SELECT level, method, round(sum(abs(y - yhat)) FILTER (WHERE h <= 7) / nullif(sum(y) FILTER (WHERE h <= 7), 0), 6) AS h1_7, round(sum(abs(y - yhat)) FILTER (WHERE h > 7) / nullif(sum(y) FILTER (WHERE h > 7), 0), 6) AS h8_28, BOTH FROM back6 WHERE fold > 3 GROUP BY level, method""".replace("BOTH", BOTH), **_SIX), "spine", "panel6"))
def R1_six_levels(spark, sf_dir):
    """WMAPE, bias and the horizon split of the evaluation folds at all six levels, bottom series included."""
    b = FO.backtest(states_of(spark, sf_dir, P.ALL_LEVELS), SIX_METHODS).where("fold > 3")
    near, e = F.col("h") <= 7, F.abs(F.col("y") - F.col("yhat"))
    part = lambda c: F.try_divide(F.sum(F.when(c, e)), F.nullif(F.sum(F.when(c, F.col("y"))), F.lit(0.0)))
    return b.groupBy("level", "method").agg(r6(part(near), "h1_7"), r6(part(~near), "h8_28"), r6(M.wmape(), "wmape"), r6(M.bias(), "bias"))


def reconciled(spark, sf_dir, method: str = "croston_sba", weights: tuple[str, ...] = ("ols", "wls"), errors: str = "seasonal"):
    """(recon, level, key, h, y, value) of the last fold at six levels: base, bottom_up, middle_out from the stores, and minimum traces."""
    levels = P.ALL_LEVELS
    states = states_of(spark, sf_dir, levels, fold=6, tail=180, errors=errors)
    f = written(FO.backtest(states, (method,)).select("level", "key", "h", "y", F.col("yhat").alias("value")), "recon-base")
    days = days_of(spark, sf_dir)
    nodes = written(R.tree(days.select(*P.FINEST).distinct(), levels), "recon-tree")
    base, actual = f.select("level", "key", "h", "value"), f.select("level", "key", "h", "y")
    bottom = lambda values: R.sum_up(values, nodes, levels, "h")
    origin = P.origins(days.select("date")).where("fold = 6").select("origin")
    before = days.crossJoin(F.broadcast(origin)).where("date < origin").withColumn("key", F.concat_ws("|", "store_id", "cat_id", "item_id"))
    middle = R.middle_out(f.where("level = 'store'").select(F.col("key").alias("store_id"), "h", "value"), R.proportions(before, "key", "store_id"), "store_id").select("key", "h", "value")
    parts = {"base": base, "bottom_up": bottom(base.where("level = 'store_item'").select("key", "h", "value")), "middle_out": bottom(middle)}
    out = None
    for name, df in parts.items():
        named = df.select(F.lit(name).alias("recon"), "level", "key", "h", "value")
        out = named if out is None else out.unionByName(named)
    traced = R.mint(base, nodes, states.select("level", "key", F.col("resid").alias("tail")), levels, weights)
    out = out.unionByName(traced.select(F.concat(F.lit("mint_"), F.col("method")).alias("recon"), "level", "key", "h", "value"))
    return written(out.join(actual, ["level", "key", "h"]), "recon-rows")


def _swept(w: str, name: str) -> dict[str, str]:
    """SQL of one sweep: up from the bottom, down from the top; w: a node's variance."""
    levels = P.ALL_LEVELS
    out = {f"{name}_{levels[-1]}": f"SELECT level, key, up, h, yhat AS v, {w} AS s, 0::DOUBLE AS m, 0::DOUBLE AS cv FROM base6 WHERE level = '{levels[-1]}'"}
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        out[f"{name}_{level}"] = f"""SELECT level, b.key, up, b.h, (yhat * cv + m * {w}) / ({w} + cv) AS v, {w} * cv / ({w} + cv) AS s, m, cv FROM base6 b JOIN (SELECT up AS key, h, sum(v) AS m, sum(s) AS cv FROM {name}_{below} GROUP BY 1, 2) k USING (key, h) WHERE level = '{level}'"""
    out[f"{name}_x_{levels[0]}"] = f"SELECT key, h, v AS x, m, cv FROM {name}_{levels[0]}"
    for level, below in zip(levels, levels[1:], strict=False):
        out[f"{name}_x_{below}"] = f"SELECT c.key, c.h, c.v + c.s * (p.x - p.m) / p.cv AS x, c.m, c.cv FROM {name}_{below} c JOIN {name}_x_{level} p ON p.key = c.up AND p.h = c.h"
    out[name] = " UNION ALL ".join(f"SELECT 'mint_{name}' AS recon, '{v}' AS level, key, h, x AS value FROM {name}_x_{v}" for v in levels)
    return out


def _summed(name: str, bottom: str) -> dict[str, str]:
    levels = P.ALL_LEVELS
    out = {f"{name}_{levels[-1]}": bottom}
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        out[f"{name}_{level}"] = f"SELECT n.up AS key, h, sum(value) AS value FROM {name}_{below} b JOIN nodes n ON n.level = '{below}' AND n.key = b.key GROUP BY 1, 2"
    out[name] = " UNION ALL ".join(f"SELECT '{name}' AS recon, '{v}' AS level, key, h, value FROM {name}_{v}" for v in levels)
    return out


RECONS = ("base", "bottom_up", "middle_out", "mint_ols", "mint_wls")
_RECON6 = {
    "w6": "SELECT level, key, var_pop(d) AS w FROM (SELECT level, key, date, y - lag(y, 7) OVER (PARTITION BY level, key ORDER BY date) AS d FROM spine), folds WHERE fold = 6 AND date < origin AND date >= origin - 180 GROUP BY level, key",
    "base6": "SELECT n.level, n.key, n.up, h, y, yhat, CASE WHEN w > 0 THEN w ELSE 1e-6::DOUBLE END AS w FROM back6 b JOIN nodes n USING (level, key) JOIN w6 USING (level, key) WHERE fold = 6 AND method = 'croston_sba'",
    **_swept("1.0::DOUBLE", "ols"), **_swept("w", "wls"), **_summed("bottom_up", "SELECT key, h, yhat AS value FROM base6 WHERE level = 'store_item'"),
    "shares6": "SELECT store_id || '|' || cat_id || '|' || item_id AS key, store_id, coalesce(sum(units) FILTER (WHERE date < origin), 0) AS u FROM sales, folds WHERE fold = 6 GROUP BY ALL HAVING count(*) FILTER (WHERE date < origin) > 0",
    **_summed("middle_out", "SELECT s.key, h, yhat * coalesce(u / nullif(sum(u) OVER (PARTITION BY s.store_id, h), 0), 1.0::DOUBLE / count(*) OVER (PARTITION BY s.store_id, h)) AS value FROM shares6 s JOIN base6 b ON b.level = 'store' AND b.key = s.store_id"),
    "recon6": "SELECT 'base' AS recon, level, key, h, yhat AS value FROM base6 UNION ALL SELECT * FROM bottom_up UNION ALL SELECT * FROM middle_out UNION ALL SELECT * FROM ols UNION ALL SELECT * FROM wls",
    "scored6": "SELECT r.recon, r.level, sum(abs(b.y - r.value)) / nullif(sum(abs(b.y)), 0) AS w FROM recon6 r JOIN base6 b USING (level, key, h) GROUP BY r.recon, r.level",
}


@C.query(_materialised(with_("panel6 bounds folds", "SELECT level, " + ", ".join(f"round(max(w) FILTER (WHERE recon = '{r}'), 6) AS {r}" for r in RECONS) + " FROM scored6 GROUP BY level", **_SIX, **_RECON6), "spine", "panel6", "base6"))
def R5_recon_six_levels(spark, sf_dir):
    """Base, bottom-up, middle-out and minimum-trace errors of the last fold at all six levels."""
    w = reconciled(spark, sf_dir).groupBy("recon", "level").agg(M.wmape("y", "value").alias("w"))
    return w.groupBy("level").pivot("recon", list(RECONS)).agg(F.first("w")).select("level", *[r6(c, c) for c in RECONS])
