"""Price response, markdown decisions and the planner's requests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from demandloom.catalogue.base import SALES_TABLES, grid_of
from demandloom.catalogue.forecast import backtest_of, fan_of
from demandloom.catalogue.registry import Catalogue, r6
from demandloom.catalogue.sql import with_
from demandloom.functions import metrics as M
from demandloom.operators import elasticity as E
from demandloom.operators import markdown as K
from demandloom.operators import panel as P
from demandloom.plans import service as V
from demandloom.sources.artifacts import stored
from demandloom.sources.sales import sales, table
from demandloom.sources.store import work_path, written

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles

_ITEM_WEEKS = "SELECT {by}, (date_trunc('week', date)::DATE + 6)::DATE AS week, ln(sum(units)) AS y, ln(greatest(avg(revenue / nullif(units, 0)), 0.01::DOUBLE)) AS x FROM sales GROUP BY ALL HAVING sum(units) > 0"
_SLOPE = "SELECT {by}, f.slope, sqrt(sum((x - mx) ** 2 * (y - b - f.slope * x) ** 2)) / max(sxx) AS se, count(*) AS n FROM {rows} JOIN (SELECT {by}, regr_slope(y, x) AS slope, regr_intercept(y, x) AS b, avg(x) AS mx, regr_sxx(y, x) AS sxx FROM {rows} GROUP BY {by}) f USING ({by}) WHERE sxx > 0 GROUP BY ALL"


def log_weeks(spark, sf_dir, *by: str):
    w = P.weekly(sales(spark, sf_dir), *by).where("units > 0")
    return w.select(*by, "week", F.ln("units").alias("y"), F.col("log_p").alias("x"))


@C.query(with_("sales", "SELECT cat_id, round(slope, 6) AS slope, round(se, 6) AS se, n FROM fit", w=_ITEM_WEEKS.format(by="cat_id, store_id"), fit=_SLOPE.format(by="cat_id", rows="w")))
def E1_ols_slope(spark, sf_dir):
    """Log-log slope by category with robust errors."""
    return E.ols_slope(log_weeks(spark, sf_dir, "cat_id", "store_id"), "y", "x", "cat_id").select("cat_id", r6("slope", "slope"), r6("se", "se"), "n")


def item_scores(spark, sf_dir):
    """Scores of item slopes against the item's slope over all categories."""
    raw = E.ols_slope(log_weeks(spark, sf_dir, "cat_id", "item_id"), "y", "x", "cat_id", "item_id").select("cat_id", "item_id", F.col("slope").alias("estimate"), "se")
    truth = E.ols_slope(log_weeks(spark, sf_dir, "item_id", "store_id"), "y", "x", "item_id").select("item_id", F.col("slope").alias("truth"))
    return E.score_estimates(raw.join(truth, "item_id"))


_SCORES = """(SELECT *, e - avg(e) OVER (PARTITION BY cat_id, estimator) AS dev FROM (
  SELECT cat_id, truth, truth - avg(truth) OVER g AS dev_truth, unnest(['raw_per_item', 'shrunk_to_category', 'category_mean_only']) AS estimator, unnest([est, m + CASE WHEN tau2 > 0 THEN tau2 / (tau2 + se ** 2) ELSE 0 END * (est - m), m]) AS e FROM (
  SELECT *, avg(est) OVER g AS m, greatest(coalesce(var_samp(est) OVER g, 0) - avg(se ** 2) OVER g, 0) AS tau2 FROM tab WINDOW g AS (PARTITION BY cat_id)) WINDOW g AS (PARTITION BY cat_id)))"""
_SCORED_SLOPES = dict(w=_ITEM_WEEKS.format(by="cat_id, item_id"), w2=_ITEM_WEEKS.format(by="item_id, store_id"), f1=_SLOPE.format(by="cat_id, item_id", rows="w"), f2=_SLOPE.format(by="item_id", rows="w2"), tab="SELECT cat_id, item_id, f1.slope AS est, f1.se, f2.slope AS truth FROM f1 JOIN f2 USING (item_id)")


@C.query(with_("sales", """SELECT estimator, round(avg(abs(e - truth)), 6) AS mae, round(sqrt(avg((e - truth) ** 2)), 6) AS rmse, round(stddev_pop(e), 6) AS sd, round(avg(abs(dev - dev_truth)), 6) AS within_cat_mae FROM """ + _SCORES + " GROUP BY estimator", **_SCORED_SLOPES))
def E9_shrinkage(spark, sf_dir):
    """Item slopes raw, shrunk and as category means, against the item's slope over all categories."""
    return item_scores(spark, sf_dir).select("estimator", *[r6(c, c) for c in ("mae", "rmse", "sd", "within_cat_mae")])


@C.query(with_("sales", """SELECT estimator, CASE WHEN stddev_pop(e) > 1e-12::DOUBLE AND stddev_pop(truth) > 1e-12::DOUBLE THEN round(corr(e, truth), 6) END AS corr_with_truth, round(CASE WHEN stddev_pop(dev) > 1e-12::DOUBLE AND stddev_pop(dev_truth) > 1e-12::DOUBLE THEN corr(dev, dev_truth) ELSE 0 END, 6) AS within_cat_corr FROM """ + _SCORES + " GROUP BY estimator", **_SCORED_SLOPES))
def E10_estimator_correlations(spark, sf_dir):
    """The same three estimators: how they go with the truth, overall and within categories."""
    return item_scores(spark, sf_dir).select("estimator", r6("corr_with_truth", "corr_with_truth"), r6("within_cat_corr", "within_cat_corr"))


_R = 2.0 ** (-1 / K.HALFLIFE)
_GEO = repr((1 - _R**42) / (1 - _R))
_ITEMS = f"SELECT key, split_part(key, '|', 1) AS dept, split_part(key, '|', 2) AS cat, base_daily, ref_price, ceil(round(base_daily * {_GEO}::DOUBLE * 2.2::DOUBLE, 6)) AS inventory FROM (SELECT key, avg(y) FILTER (WHERE date > b - 56) AS base_daily, sum(revenue) / sum(y) AS ref_price FROM grid, bounds WHERE level = 'store_cat' GROUP BY key) WHERE base_daily > 0.15::DOUBLE"


def items_of(spark, sf_dir):
    """(key, dept, cat, base_daily, ref_price, inventory): the recent daily rate, mean price and a stock that will not clear."""
    s = sales(spark, sf_dir)
    p = P.roll_up(s, ("store_cat",)).crossJoin(F.broadcast(s.agg(F.min("date").alias("a"), F.max("date").alias("b"))))
    # a day without sales adds nothing to either sum, so no grid is needed
    recent = F.sum(F.when(F.col("date") > F.date_sub("b", 56), F.col("y")).otherwise(0.0))
    days = F.least(F.lit(56), F.datediff(F.max("b"), F.min("a")) + 1)
    rate = p.groupBy("key").agg((recent / days).alias("base_daily"), F.try_divide(F.sum("revenue"), F.sum("y")).alias("ref_price")).where("base_daily > 0.15")
    part = F.split("key", "\\|")
    stock = F.ceil(F.round(K.expected_full_price(F.col("base_daily")) * 2.2, 6)).cast("double")
    return rate.select("key", part[0].alias("dept"), part[1].alias("cat"), "base_daily", "ref_price", stock.alias("inventory"))


def _sim(e: str, depths: str) -> str:
    """A season as a list fold: {rev, sold, left} before salvage."""
    take = f"least(base_daily * pow(2.0::DOUBLE, -x.t / 21.0::DOUBLE) * pow(1 - {depths}[floor(x.t / 14)::INT + 1], {e}), s.left_)"
    return f"list_reduce(list_transform(range(0, 42), lambda t: {{'t': t::DOUBLE, 'rev': 0::DOUBLE, 'sold': 0::DOUBLE, 'left_': 0::DOUBLE}}), lambda s, x: {{'t': x.t, 'rev': s.rev + {take} * ref_price * (1 - {depths}[floor(x.t / 14)::INT + 1]), 'sold': s.sold + {take}, 'left_': s.left_ - {take}}}, {{'t': -1::DOUBLE, 'rev': 0::DOUBLE, 'sold': 0::DOUBLE, 'left_': inventory}})"


@C.query(with_("grid", "SELECT key, round(s.rev + s.left_ * ref_price * 0.05::DOUBLE, 4) AS revenue, round(s.sold, 6) AS sold, round(s.left_, 6) + 0.0::DOUBLE AS leftover FROM (SELECT *, SIM AS s FROM items)".replace("SIM", _sim("-1.5::DOUBLE", "([0.0, 0.1, 0.3]::DOUBLE[])")), items=_ITEMS))
def K1_simulate(spark, sf_dir):
    """One schedule for every item."""
    depths = F.array(F.lit(0.0), F.lit(0.1), F.lit(0.3))
    s = K.simulate(F.col("base_daily"), F.col("ref_price"), F.col("inventory"), F.lit(-1.5), depths)
    return items_of(spark, sf_dir).withColumn("s", s).select("key", F.round("s.revenue", 4).alias("revenue"), r6("s.sold", "sold"), r6("s.leftover", "leftover"))


_SCHEDULES = "SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS i, [a, b, c] AS depths FROM (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS a), (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS b), (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS c) WHERE a <= b AND b <= c"


def _best(e: str, where: str = "") -> str:
    return f"SELECT key, arg_min(depths, (-round(rev, 6), i)) AS depths, max(rev) AS rev FROM (SELECT key, i, depths, s.rev + s.left_ * ref_price * 0.05::DOUBLE AS rev FROM (SELECT *, {_sim(e, 'depths')} AS s FROM items, schedules {where})) GROUP BY key"


@C.query(with_("grid", "SELECT key, list_aggregate(list_transform(b.depths, lambda d: round(100 * d)::INT::VARCHAR), 'string_agg', '/') AS schedule, round(b.rev, 4) AS revenue, round(100 * f.depths[1])::INT AS flat, round(f.rev, 4) AS flat_revenue FROM best b JOIN flat f USING (key)", items=_ITEMS, schedules=_SCHEDULES, best=_best("-1.5::DOUBLE"), flat=_best("-1.5::DOUBLE", "WHERE depths[1] = depths[3]")))
def K2_schedules(spark, sf_dir):
    """The best of 56 falling price paths and the best single discount, for every item."""
    items = written(items_of(spark, sf_dir), "items").withColumn("e", F.lit(-1.5))
    best = K.best_schedules(items, "e")
    flat = K.best_schedules(items, "e", [(d,) * K.PHASES for d in K.DEPTHS])
    text = F.array_join(F.transform("depths", lambda d: F.round(100 * d).cast("int").cast("string")), "/")
    return best.select("key", text.alias("schedule"), F.round("revenue", 4).alias("revenue")).join(flat.select("key", F.round(100 * F.col("depths")[0]).cast("int").alias("flat"), F.round("revenue", 4).alias("flat_revenue")), "key")


_WORLDS = {"down": -0.3, "true": 0.0, "up": 0.3}
_TRUE, _GOOD, _BAD = -1.5, -1.4, -0.7
_RUN = "(SELECT key, r.rev + r.left_ * ref_price * 0.05::DOUBLE AS rev FROM (SELECT items.*, {sim} AS r FROM items JOIN {by} USING (key)))"


def _k6_sql() -> str:
    parts, more = [], {"items": _ITEMS, "schedules": _SCHEDULES, "good": _best(f"{_GOOD}::DOUBLE"), "bad": _best(f"{_BAD}::DOUBLE"), "flat": _best(f"{_GOOD}::DOUBLE", "WHERE depths[1] = depths[3]"), "none": "SELECT key, [0, 0, 0]::DOUBLE[] AS depths FROM items"}
    for name, m in _WORLDS.items():
        e = f"{_TRUE * (1 + m)!r}::DOUBLE"
        more[f"oracle_{name}"] = _best(e)
        runs = " ".join(f"JOIN {_RUN.format(sim=_sim(e, f'{by}.depths'), by=by)} r_{x} ON r_{x}.key = items.key" for x, by in (("none", "none"), ("flat", "flat"), ("bad", "bad"), ("good", "good"), ("oracle", f"oracle_{name}")))
        parts.append(f"SELECT cat, '{name}' AS world, " + ", ".join(f"round(sum(r_{x}.rev), 2) AS rev_{x}" for x in ("none", "flat", "bad", "good", "oracle")) + f", round(100 * (1 - sum(r_bad.rev) / sum(r_oracle.rev)), 6) + 0.0::DOUBLE AS bad_cost_pct FROM items {runs} GROUP BY cat")
    return with_("grid", " UNION ALL ".join(parts), **more)


@C.query(_k6_sql())
def K6_decision_table(spark, sf_dir):
    """Decided on one elasticity, scored in a world with another: revenue by category, world and policy."""
    from demandloom.plans.pricing import decision_table

    t = decision_table(written(items_of(spark, sf_dir), "items"), _GOOD, _BAD, {n: _TRUE * (1 + m) for n, m in _WORLDS.items()})
    return t.select("cat", "world", *[F.round(f"rev_{p}", 2).alias(f"rev_{p}") for p in ("none", "flat", "bad", "good", "oracle")], r6("bad_cost_pct", "bad_cost_pct"))


_LAM = repr(math.log(2.0) / K.HALFLIFE)
_DECAY = f"exp(-{_LAM}::DOUBLE * p * 14) * (1 - exp(-{_LAM}::DOUBLE * 14)) / (1 - exp(-{_LAM}::DOUBLE))"


@C.query(with_("grid", """SELECT key, round(sum(q * ref_price * (1 - d)) + 0.05::DOUBLE * max(ref_price) * (max(inventory) - sum(q)), 4) AS revenue, round(sum(q), 6) AS units, round(sum(q * ref_price * d), 4) AS spend, round(max(inventory) - sum(q), 6) + 0.0::DOUBLE AS leftover FROM (SELECT *, greatest(0, least(demand, inventory - coalesce(sum(demand) OVER (PARTITION BY key ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS q FROM (
  SELECT *, base_daily * DECAY * pow(1 - d, -1.5::DOUBLE) * exp(0.35::DOUBLE * CASE WHEN count(*) OVER g > 1 THEN (sum(ln(1 - d)) OVER g - ln(1 - d)) / (count(*) OVER g - 1) ELSE 0 END) AS demand FROM plan WINDOW g AS (PARTITION BY dept, p))) GROUP BY key""".replace("DECAY", _DECAY), items=_ITEMS, plan="SELECT *, least(0.5::DOUBLE, 0.1::DOUBLE * p * (length(cat) % 3)) AS d FROM items, (SELECT unnest(range(0, 3)) AS p)"))
def K7_phase_demand(spark, sf_dir):
    """A plan with different depths by item: demand with rivals in the store, cut by the stock, scored."""
    plan = items_of(spark, sf_dir).withColumn("e", F.lit(-1.5)).withColumn("phase", F.explode(F.array(*[F.lit(p) for p in range(3)]))).withColumn("depth", F.least(F.lit(0.5), F.lit(0.1) * F.col("phase") * (F.length("cat") % 3)))
    out = K.evaluate(plan, "e", 0.35)
    return out.select("key", F.round("revenue", 4).alias("revenue"), r6("units", "units"), F.round("spend", 4).alias("spend"), r6("leftover", "leftover"))


_FANS = """SELECT f.key, f.h, list_sort(q) AS q, mean FROM (SELECT key, h FROM future WHERE level = 'store' AND fold = 6) f JOIN (SELECT key, quantile_cont(v, [0.5, 0.75, 0.9, 0.95, 0.98]) AS q FROM (SELECT key, unnest(ys[-180:]) AS v FROM hist WHERE level = 'store' AND fold = 6) GROUP BY key) USING (key) JOIN (SELECT key, h, yhat AS mean FROM backtest WHERE level = 'store' AND fold = 6 AND method = 'seasonal_naive') m ON m.key = f.key AND m.h = f.h"""


def fans_of(spark, sf_dir):
    """(key, h, q, mean): the service's stored artifact: empirical fans and the seasonal naive as the mean."""

    def build():
        mean = backtest_of(spark, sf_dir, "store", methods=("seasonal_naive",)).where("fold = 6").select("key", "h", F.col("yhat").alias("mean"))
        return fan_of(spark, sf_dir).select("key", "h", "q").join(mean, ["key", "h"])

    return stored(spark, "fans", [f"{sf_dir}/{t}.parquet" for t in SALES_TABLES], {}, build)


@C.query(with_("backtest classes", """SELECT key, count(*) AS days, round(sum(mean), 6) + 0.0::DOUBLE AS mean_total, round(sum(q[1]), 6) AS p50_total, round(sum(q[4]), 6) AS p95_total, any_value(class) AS class, round(max(s.w - s.v), 6) + 0.0::DOUBLE AS vs_seasonal_naive FROM fans JOIN (SELECT key, class FROM classes WHERE level = 'store') USING (key)
  JOIN (SELECT key, sum(abs(y - yhat)) FILTER (WHERE method = 'croston_sba') / greatest(sum(abs(y)) FILTER (WHERE method = 'croston_sba'), 1e-9::DOUBLE) AS w, sum(abs(y - yhat)) FILTER (WHERE method = 'seasonal_naive') / greatest(sum(abs(y)) FILTER (WHERE method = 'seasonal_naive'), 1e-9::DOUBLE) AS v FROM backtest WHERE level = 'store' GROUP BY key) s USING (key) GROUP BY key""", fans=_FANS))
def V3_forecast_lookup(spark, sf_dir):
    """The forecast answer of every key: path, class and error against the seasonal naive over all six folds."""
    b = backtest_of(spark, sf_dir, "store", methods=("seasonal_naive", "croston_sba"))
    ratio = lambda m: F.sum(F.when(F.col("method") == m, F.abs(F.col("y") - F.col("yhat")))) / F.greatest(F.sum(F.when(F.col("method") == m, F.abs("y"))), F.lit(1e-9))
    scores = b.groupBy("key").agg(ratio("croston_sba").alias("wmape"), ratio("seasonal_naive").alias("seasonal_wmape"))
    classes = M.adi_cv2(grid_of(spark, sf_dir, "store"), "key").select("key", "class")
    out = V.forecast(fans_of(spark, sf_dir), scores, classes)
    total = lambda f: F.aggregate("path", F.lit(0.0), lambda a, d: a + f(d))
    return out.select("key", F.size("path").cast("long").alias("days"), r6(total(lambda d: d["mean"]), "mean_total"), r6(total(lambda d: d["q"][0]), "p50_total"), r6(total(lambda d: d["q"][3]), "p95_total"), "class", r6("vs_seasonal_naive", "vs_seasonal_naive"))


@C.query(with_("backtest", "SELECT (SELECT CASE WHEN count(*) > 0 THEN 'ok' ELSE 'missing' END FROM fans) AS status, (SELECT count(DISTINCT key) FROM fans) AS series, key FROM (SELECT DISTINCT key FROM fans ORDER BY key LIMIT 50)", fans=_FANS))
def V2_health_series(spark, sf_dir):
    """The service's state and the first 50 keys that it knows."""
    f = fans_of(spark, sf_dir)
    return V.series(f, 50).crossJoin(F.broadcast(V.health(f))).select("status", "series", "key")


_LEVEL = "CASE WHEN sl = 0.9 THEN 3 WHEN sl = 0.97 THEN 5 ELSE 1 END"


@C.query(with_("backtest", """SELECT key, lead AS lead_time_days, sl AS service_level, case_pack, ([0.5, 0.75, 0.9, 0.95, 0.98]::DOUBLE[])[n] AS service_level_used, round(cover, 6) AS cover_units, round(mean, 6) + 0.0::DOUBLE AS mean_units, round(cover - mean, 6) + 0.0::DOUBLE AS buffer_over_mean, CAST(ceil(greatest(round(cover, 9) - 20, 0) / case_pack) * case_pack AS BIGINT) AS order_quantity FROM (
  SELECT key, lead, sl, case_pack, n, sum(q[n]) AS cover, sum(mean) AS mean FROM (SELECT key, h, q, mean, lead, sl, case_pack, LEVEL AS n FROM fans, (SELECT unnest([7, 28]) AS lead), (SELECT unnest([0.6, 0.9, 0.97]::DOUBLE[]) AS sl), (SELECT unnest([6, 24]) AS case_pack)) WHERE h <= lead GROUP BY ALL)""".replace("LEVEL", _LEVEL), fans=_FANS))
def V4_orders(spark, sf_dir):
    """Orders for a grid of requests, one of which is refused."""
    f = fans_of(spark, sf_dir)
    lists = {"lead_time_days": (7, 28, 40), "service_level": (0.6, 0.9, 0.97), "case_pack": (6, 24)}
    r = f.select("key").distinct()
    for c, values in lists.items():
        r = r.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    out = V.orders(f, r.withColumn("on_hand", F.lit(20.0)))
    return out.select("key", "lead_time_days", "service_level", "case_pack", "service_level_used", *[r6(c, c) for c in ("cover_units", "mean_units", "buffer_over_mean")], "order_quantity")


@C.query(with_("backtest", """SELECT key, lead AS lead_time_days, sl AS service_level, case_pack, on_hand, reason = 'ok' AS accepted, reason, CASE WHEN reason = 'ok' THEN round(cover, 6) END AS cover_units, CASE WHEN reason = 'ok' THEN CAST(ceil(greatest(round(cover, 9) - on_hand, 0) / case_pack) * case_pack AS BIGINT) END AS order_quantity FROM (
  SELECT r.*, CASE WHEN lead NOT BETWEEN 1 AND 28 THEN 'lead_time_days' WHEN case_pack < 1 THEN 'case_pack' WHEN sl <= 0 OR sl >= 1 THEN 'service_level' WHEN on_hand IS NULL OR on_hand < 0 THEN 'on_hand' WHEN k.key IS NULL THEN 'unknown key' ELSE 'ok' END AS reason,
    (SELECT sum(q[CASE WHEN sl = 0.9 THEN 3 ELSE 5 END]) FROM fans f WHERE f.key = r.key AND h <= lead) AS cover
  FROM asked r LEFT JOIN (SELECT DISTINCT key FROM fans) k ON k.key = r.key)""", fans=_FANS,
  asked="SELECT key, lead, sl, case_pack, on_hand FROM (SELECT DISTINCT key FROM fans UNION ALL SELECT 'NOWHERE'), (SELECT unnest([0, 7, 29]) AS lead), (SELECT unnest([0.9, 0.97, 1.0]::DOUBLE[]) AS sl), (SELECT unnest([0, 6]) AS case_pack), (SELECT unnest([-1.0, 20.0, NULL]::DOUBLE[]) AS on_hand)"))
def V8_answers(spark, sf_dir):
    """An answer to every request, with the first reason of those that are refused or unknown."""
    f = fans_of(spark, sf_dir)
    r = f.select("key").distinct().unionByName(spark.range(1).select(F.lit("NOWHERE").alias("key")))
    for c, values in {"lead_time_days": (0, 7, 29), "service_level": (0.9, 0.97, 1.0), "case_pack": (0, 6)}.items():
        r = r.withColumn(c, F.explode(F.array(*[F.lit(v) for v in values])))
    r = r.withColumn("on_hand", F.explode(F.array(F.lit(-1.0), F.lit(20.0), F.lit(None).cast("double"))))
    return V.answers(f, r).select("key", "lead_time_days", "service_level", "case_pack", "on_hand", "accepted", "reason", r6("cover_units", "cover_units"), "order_quantity")


_OVERRIDES = "SELECT 'U' || user_id AS key, (event_id % 30)::INT AS horizon_day, round(arg_max(value, (ts, event_id)), 6) AS value, arg_max(event_type, (ts, event_id)) AS reason FROM events WHERE event_id % 30 <= 27 AND value >= 0 AND length(event_type) >= 4 GROUP BY 1, 2"


def override_log(spark, sf_dir):
    """The events as entries of an override log."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("key"), (F.col("event_id") % 30).cast("int").alias("horizon_day"), "value", F.col("event_type").alias("reason"), F.lit("planner").alias("author"), "ts", F.col("event_id").alias("entry"))


@C.query(_OVERRIDES)
def V5_override_latest(spark, sf_dir):
    """The latest valid entry by key and day of an override log made of the events."""
    return V.latest_overrides(override_log(spark, sf_dir)).select("key", "horizon_day", r6("value", "value"), "reason")


@C.query(_OVERRIDES)
def V5_override_append(spark, sf_dir):
    """The same from a log on files, to which two requests append; entries that are not valid are not written."""
    log, path = override_log(spark, sf_dir), work_path(spark, "overrides")
    for odd in (0, 1):
        V.append_overrides(log.where(F.col("entry") % 2 == odd), path)
    kept = spark.read.schema(log.schema).parquet(path)
    return V.latest_overrides(kept).select("key", "horizon_day", r6("value", "value"), "reason")


_D42 = repr(sum(math.exp(-math.log(2.0) / 21.0 * t) for t in range(42)))


@C.query(with_("grid", f"SELECT key, depth, round(units, 6) AS units, round(rev, 6) AS revenue_index, arg_min(depth, (-round(rev, 6), depth)) OVER (PARTITION BY key) AS recommended FROM (SELECT *, units * (1 - depth) + 0.05::DOUBLE * (inventory - units) AS rev FROM (SELECT key, depth, inventory, least(base_daily * {_D42}::DOUBLE * pow(1 - depth, -1.8::DOUBLE), inventory) AS units FROM items, (SELECT unnest([0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS depth)))", items=_ITEMS))
def V6_markdown_grid(spark, sf_dir):
    """Six depths for every item, and the recommended one."""
    g = V.markdown_grid(items_of(spark, sf_dir).withColumn("elasticity", F.lit(-1.8)))
    return g.select("key", "depth", r6("units", "units"), r6("revenue_index", "revenue_index"), "recommended")
