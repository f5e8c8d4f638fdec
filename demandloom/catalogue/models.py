"""Files, fitted models, constrained plans, joint samples, the generator and streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from demandloom.catalogue.base import ALL, SALES_TABLES, days_of, grid_of, last_day, last_origin, origins_of, panel_of, states_of
from demandloom.catalogue.decide import items_of
from demandloom.catalogue.forecast import reconciled
from demandloom.catalogue.registry import Catalogue, r6, r6s
from demandloom.catalogue.sql import with_
from demandloom.functions import leadtime as L
from demandloom.functions import metrics as M
from demandloom.functions import quantiles as Q
from demandloom.operators import absorbed as AB
from demandloom.operators import baselines as B
from demandloom.operators import boosting as GB
from demandloom.operators import deep as D
from demandloom.operators import features as X
from demandloom.operators import folds as FO
from demandloom.operators import markdown as K
from demandloom.operators import panel as P
from demandloom.operators import probabilistic as PR
from demandloom.operators import reconcile as R
from demandloom.operators import regression as RG
from demandloom.plans import sections as SC
from demandloom.sources import generator as GN
from demandloom.sources import sales as S
from demandloom.sources.artifacts import stored
from demandloom.sources.sales import sales, table
from demandloom.sources.store import work_path, written

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles


_MONTHS = with_("panel", "SELECT level, key, date_trunc('month', date)::DATE AS month, sum(y)::BIGINT AS y FROM panel GROUP BY 1, 2, 3")


def months_of(spark, sf_dir):
    return P.roll_up(sales(spark, sf_dir)).groupBy("level", "key", F.trunc("date", "month").alias("month")).agg(F.sum("y").cast("long").alias("y"))


_MONTH_SCHEMA = "level string, key string, month date, y long"


@C.query(_MONTHS, dates="month")
def S2_csv(spark, sf_dir):
    """Written as CSV and read with a declared schema."""
    S.write_csv(months_of(spark, sf_dir), path := work_path(spark, "csv"))
    return S.read_csv(spark, path, _MONTH_SCHEMA)


@C.query(_MONTHS, dates="month")
def S4_gzip_csv(spark, sf_dir):
    """The same, compressed."""
    S.write_csv(months_of(spark, sf_dir), path := work_path(spark, "csv-gz"), gzip=True)
    return S.read_csv(spark, path, _MONTH_SCHEMA)


@C.query(with_("panel", "SELECT level, key, list_sum(ys)::BIGINT AS total, len(ys)::INT AS n FROM (SELECT level, key, list(y) AS ys FROM panel GROUP BY level, key)"))
def S6_nested_parquet(spark, sf_dir):
    """Arrays as stage files, partitioned by level."""
    rows = P.roll_up(sales(spark, sf_dir)).groupBy("level", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("date", "y"))), lambda r: r["y"]).alias("ys"))
    S.write_parquet(rows, path := work_path(spark, "stage"), ("level",))
    return spark.read.parquet(path).select("level", "key", F.aggregate("ys", F.lit(0.0), lambda a, y: a + y).cast("long").alias("total"), F.size("ys").alias("n"))


@C.query(_MONTHS, dates="month")
def S13_json(spark, sf_dir):
    """Written as JSON lines and read back."""
    S.write_json(months_of(spark, sf_dir), path := work_path(spark, "json"))
    return spark.read.schema(_MONTH_SCHEMA).json(path)


@C.query(with_("sales", "SELECT cat_id, round(sum(units), 2) AS units, any_value(n) AS n_rows, any_value(a) AS date_min, any_value(z) AS date_max, false AS before, true AS after FROM sales, (SELECT count(*)::INT AS n, CAST(min(date) AS VARCHAR) AS a, CAST(max(date) AS VARCHAR) AS z FROM sales) GROUP BY cat_id"))
def S5_json_document(spark, sf_dir):
    """One JSON document with a map, written, asked for before and after, and read with a declared schema."""
    s = sales(spark, sf_dir)
    by_cat = s.groupBy("cat_id").agg(F.sum("units").alias("units"), F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("z"))
    by_category = F.map_from_entries(F.sort_array(F.collect_list(F.struct("cat_id", "units")))).alias("units_by_category")
    doc = by_cat.agg(by_category, F.sum("n").cast("int").alias("n_rows"), F.min("a").cast("string").alias("date_min"), F.max("z").cast("string").alias("date_max"))
    path = work_path(spark, "document")
    before = S.available(spark, path)
    S.write_json(doc, path)
    read = S.read_json_document(spark, path, doc.schema).withColumns({"before": F.lit(before), "after": F.lit(S.available(spark, path))})
    return read.select(F.explode("units_by_category").alias("cat_id", "units"), "n_rows", "date_min", "date_max", "before", "after").withColumn("units", F.round("units", 2))


@C.query(_MONTHS.replace("SELECT level, key, date_trunc('month', date)::DATE AS month, sum(y)::BIGINT AS y FROM panel GROUP BY 1, 2, 3", """, m AS (SELECT level, key, date_trunc('month', date)::DATE AS month, sum(y)::BIGINT AS y FROM panel GROUP BY 1, 2, 3)
SELECT '## Months' AS line UNION ALL SELECT level || chr(9) || key || chr(9) || month || chr(9) || y FROM m UNION ALL SELECT '## Series' UNION ALL SELECT level || chr(9) || count(DISTINCT key) FROM m GROUP BY level"""))
def S14_text_report(spark, sf_dir):
    """A report of two sections as text lines."""
    m = months_of(spark, sf_dir)
    S.write_report({"Months": (m, ["level", "key", "month"]), "Series": (m.groupBy("level").agg(F.count_distinct("key").alias("n")), ["level"])}, path := work_path(spark, "report"))
    return spark.read.text(path).withColumnRenamed("value", "line")


@C.query(with_("panel", "SELECT level, key, count(*) AS n, round(sum(y), 2) AS total, round(max(step), 2) AS largest_step FROM (SELECT level, key, y, abs(y - lag(y) OVER (PARTITION BY level, key ORDER BY date)) AS step FROM panel) GROUP BY level, key"))
def S9_panel_cache(spark, sf_dir):
    """Series of the cached panel: a window and a sum by series over the bucketed table, which exchanges nothing."""
    p = panel_of(spark, sf_dir)
    step = F.abs(F.col("y") - F.lag("y").over(X.by_date()))
    return p.withColumn("step", step).groupBy("level", "key").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"), F.round(F.max("step"), 2).alias("largest_step"))


_SAMPLED = "SELECT key FROM (SELECT DISTINCT key FROM panel WHERE level = 'store_cat') ORDER BY md5('s1:' || key) LIMIT 20"


@C.query(with_("panel", "SELECT key, count(*) AS n, sum(y)::BIGINT AS y FROM panel WHERE level = 'store_cat' AND key IN (SELECT key FROM sampled) GROUP BY key", sampled=_SAMPLED))
def P19_series_sample(spark, sf_dir):
    """Whole series of a seeded sample of 20 keys: keys are sampled, never rows."""
    p = P.roll_up(sales(spark, sf_dir), ("store_cat",))
    keys = p.select("key").distinct().orderBy(F.md5(F.concat(F.lit("s1:"), "key").cast("binary"))).limit(20)
    return p.join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("y"))


_WINDOWS = """SELECT key, t, greatest(list_avg(past), 0.05::DOUBLE) AS scale FROM (SELECT key, (row_number() OVER s - 1)::INT AS t, list(y) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN 56 PRECEDING AND 1 PRECEDING) AS past, count(*) OVER (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND 27 FOLLOWING) AS ahead FROM grid WHERE level = 'store' WINDOW s AS (PARTITION BY key ORDER BY date)) WHERE len(past) = 56 AND ahead = 28 AND (t - 56) % 7 = 0"""


@C.query(with_("grid", "SELECT key, t, round(scale + 3.1e-8::DOUBLE, 6) AS scale FROM w ORDER BY substr(md5(key || '|' || t), 1, 13), key, t LIMIT 2000", w=_WINDOWS))
def P20_window_budget(spark, sf_dir):
    """Training windows cut to exactly a budget by a hash."""
    w = D.training_windows(grid_of(spark, sf_dir, "store"), stride=7)
    return D.sample_windows(w, 2_000).select("key", "t", r6s("scale", "scale"))


@C.query(with_("sales", "SELECT store_id, " + ", ".join(f"sum((cat_id = '{c}')::INT)::BIGINT AS cat_id_{c}" for c in ("LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM sales GROUP BY store_id"))
def F12_dummies(spark, sf_dir):
    """Indicator columns without the first level, summed by store."""
    d = RG.dummies(sales(spark, sf_dir).select("store_id", "cat_id"), "cat_id", ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
    return d.groupBy("store_id").agg(*[F.sum(c).alias(c) for c in d.columns if c.startswith("cat_id_")])


def _span(df, date: str):
    """First and last date of a table: two values, for the calendar that all series share."""
    r = df.agg(F.min(date).alias("a"), F.max(date).alias("b")).first()
    return r["a"], r["b"]


SERIES = ["store_id", "cat_id", "item_id"]


def week_stretches(spark, sf_dir):
    """(pieces, first week, weeks): every item x store by week, weeks without sales at the carried price."""
    days = days_of(spark, sf_dir)
    w = P.weekly_days(days, *SERIES)
    first, last = _span(days.select(P.week_end(F.col("date")).alias("week")), "week")
    n = (last - first).days // 7 + 1 if first else 0
    pieces = AB.stretches(w.withColumn("t", (F.datediff("week", F.lit(first)) / 7).cast("int")), SERIES, n)
    return pieces.withColumn("log_p", F.ln(F.greatest("price", F.lit(0.01)))), F.lit(first), n


def day_stretches(spark, sf_dir):
    """(pieces, first day, days): every item x store by day, days without sales at the carried price."""
    price, promo = P.day_means()
    keys = ["store_id", "cat_id", "dept_id", "item_id"]
    days = days_of(spark, sf_dir)
    d = days.groupBy(*keys, "date").agg(F.sum("y").alias("units"), price.alias("price"), promo.alias("promo"))
    first, last = _span(days, "date")
    n = (last - first).days + 1 if first else 0
    pieces = AB.stretches(d.withColumn("t", F.datediff("date", F.lit(first))), keys, n)
    return pieces.withColumns({"log_p": F.ln(F.greatest("price", F.lit(0.01))), "log_q": F.log1p("units")}), F.lit(first), n


def _fits(df, *keys: str):
    return df.select(*keys, *[r6(c, c) for c in ("estimate", "se")], "n", "status")


def _specs(fits):
    out = None
    for name, fit in fits:
        named = fit.withColumn("spec", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


@C.query()
def E3_poisson_by_category(spark, sf_dir):
    """Weekly Poisson price response by category, without (E) and with (F) the promotion; series and week effects."""
    w, first, n = week_stretches(spark, sf_dir)
    w, c = written(w, "weeks"), AB.calendar_effects(spark, first, n, 7, ("woy",))
    fits = [(name, AB.fit_groups(w, ["cat_id"], SERIES, c, regressors=x)) for name, x in (("E", ("log_p",)), ("F", ("log_p", "promo")))]
    return _fits(_specs(fits), "cat_id", "spec")


@C.query()
def E4_daily_specs(spark, sf_dir):
    """log(1 + units) by day on log price: A alone, B with promotion, C with series, weekday and week effects, D as C on unpromoted days."""
    d, first, n = day_stretches(spark, sf_dir)
    d, c = written(d, "days"), AB.calendar_effects(spark, first, n, 1, ("dow", "woy"))
    none = AB.calendar_effects(spark, first, n, 1, ())
    both = ("log_p", "promo")
    specs = (("A", d, ("log_p",), none, False), ("B", d, both, none, False), ("C", d, both, c, True), ("D", d.where("promo = 0"), ("log_p",), c, True))
    fits = [(name, AB.fit_groups(rows, ["cat_id"], SERIES, e, "log_q", x, family="gaussian", absorb=absorb)) for name, rows, x, e, absorb in specs]
    return _fits(_specs(fits), "cat_id", "spec")


#: Days of an item x store: each sale, and the days to the next one, or before the first, at the carried price.
DAY_PIECES = {
    "day_sales": "SELECT store_id, cat_id, dept_id, item_id, date, sum(units) AS units, avg(CASE WHEN units = 0 THEN NULL ELSE revenue / units END) AS price, avg(promo::INT) AS promo FROM sales GROUP BY ALL",
    "placed": """SELECT s.*, ln(greatest(price, 0.01)) AS x, lag(date) OVER w AS before, coalesce(lead(date) OVER w, b + 1) AS next, a FROM day_sales s, (SELECT min(date) AS a, max(date) AS b FROM day_sales)
      WHERE price IS NOT NULL WINDOW w AS (PARTITION BY store_id, cat_id, dept_id, item_id ORDER BY date)""",
    "pieces": """SELECT cat_id, x, promo AS p, ln(1 + units) AS y, 1 AS d FROM placed UNION ALL SELECT cat_id, x, 0, 0, (next - date)::INT - 1 FROM placed
      UNION ALL SELECT cat_id, x, 0, 0, (date - a)::INT FROM placed WHERE before IS NULL""",
}
#: Least squares on one and on two regressors, in centred sums, with robust errors.
SPECS_A_B = {
    "means": "SELECT cat_id, sum(d) AS n, sum(d * x) / sum(d) AS mx, sum(d * p) / sum(d) AS mp, sum(d * y) / sum(d) AS my FROM pieces GROUP BY cat_id",
    "centred": "SELECT cat_id, x - mx AS x, p - mp AS p, y - my AS y, d, n FROM pieces JOIN means USING (cat_id)",
    "sums": "SELECT cat_id, any_value(n) AS n, sum(d * x * x) AS xx, sum(d * x * p) AS xp, sum(d * p * p) AS pp, sum(d * x * y) AS xy, sum(d * p * y) AS py FROM centred GROUP BY cat_id",
    "slopes": """SELECT cat_id, n, 'A' AS spec, xy / xx AS b, 0 AS g, xx AS h, 0 AS k FROM sums
      UNION ALL SELECT cat_id, n, 'B', (xy * pp - py * xp) / (xx * pp - xp * xp), (py * xx - xy * xp) / (xx * pp - xp * xp), xx - xp * xp / pp, xp / pp FROM sums""",
}
_A_B = """SELECT s.cat_id, spec, round(any_value(b), 6) AS estimate, round(sqrt(sum(d * ((x - k * p) * (y - b * x - g * p)) ** 2)) / any_value(h), 6) AS se, any_value(s.n)::BIGINT AS n
  FROM centred c JOIN slopes s ON c.cat_id = s.cat_id GROUP BY s.cat_id, spec"""


@C.query(with_("sales", _A_B, **DAY_PIECES, **SPECS_A_B))
def E4_naive_specs(spark, sf_dir):
    """Specs A and B of E4, whose sums SQL can write down."""
    d, first, n = day_stretches(spark, sf_dir)
    d, none = written(d, "days"), AB.calendar_effects(spark, first, n, 1, ())
    fits = [(name, AB.fit_groups(d, ["cat_id"], SERIES, none, "log_q", x, family="gaussian", absorb=False)) for name, x in (("A", ("log_p",)), ("B", ("log_p", "promo")))]
    return _fits(_specs(fits), "cat_id", "spec").drop("status")


def _stored_fit(spark, sf_dir, name: str, build):
    """A table of fits, made once for these sales and kept for the sections that read it."""
    return stored(spark, name, [f"{sf_dir}/{t}.parquet" for t in SALES_TABLES], {}, build)


def item_fits(spark, sf_dir):
    def build():
        w, first, n = week_stretches(spark, sf_dir)
        return AB.fit_each(w, ["cat_id", "item_id"], ["store_id"], AB.calendar_effects(spark, first, n, 7, ("woy",)))

    return _stored_fit(spark, sf_dir, "item-fits", build)


@C.query()
def E8_per_item(spark, sf_dir):
    """Weekly Poisson fit of every item (a category's brand) with store and week effects and robust errors."""
    return _fits(item_fits(spark, sf_dir), "cat_id", "item_id")


def segments(w):
    """Stretches by dimension and segment: promoted or shelf weeks, and items above or below the items' median of mean weekly units."""
    volume = w.groupBy("cat_id", "item_id").agg((F.sum("units") / F.sum(F.col("t1") - F.col("t0"))).alias("volume"))
    cut = volume.crossJoin(F.broadcast(volume.agg(F.median("volume").alias("median"))))
    tier = F.when(F.col("volume") >= F.col("median"), "high_volume").otherwise("low_volume")
    kind = F.when(F.col("promo") > 0.3, "promo_weeks").otherwise("shelf_weeks")
    both = F.array(F.struct(F.lit("segment_promo").alias("dimension"), kind.alias("segment")), F.struct(F.lit("segment_tier").alias("dimension"), tier.alias("segment")))
    return w.join(cut, ["cat_id", "item_id"]).withColumn("s", F.explode(both)).select(*w.columns, "s.*")


def segment_fits(spark, sf_dir):
    def build():
        w, first, n = week_stretches(spark, sf_dir)
        c = AB.calendar_effects(spark, first, n, 7, ("woy",))
        return AB.fit_groups(segments(written(w, "weeks")), ["cat_id", "dimension", "segment"], SERIES, c)

    return _stored_fit(spark, sf_dir, "segment-fits", build)


@C.query()
def E11_by_segment(spark, sf_dir):
    """Weekly price response by category and segment, with promotion, series and week effects."""
    return _fits(segment_fits(spark, sf_dir), "cat_id", "dimension", "segment")


def cross_fits(spark, sf_dir):
    def build():
        d, first, n = day_stretches(spark, sf_dir)
        d = d.withColumn("item", F.concat_ws("|", "cat_id", "item_id"))
        d = written(AB.with_rivals(written(d, "days"), ["store_id", "cat_id", "dept_id"], "item", n), "rivals")
        full, weeks = [AB.calendar_effects(spark, first, n, 1, e) for e in (("woy", "event", "dow"), ("woy",))]
        specs = (("G", full, "rival_log_rel"), ("H", weeks, "rival_log_rel"), ("I", full, None))
        return _specs([(name, AB.fit_groups(d, ["cat_id"], SERIES, c, rival=rival)) for name, c, rival in specs])

    return _stored_fit(spark, sf_dir, "cross-fits", build)


@C.query()
def E13_cross_price(spark, sf_dir):
    """Daily own and rivals' price by category with series, week, event and weekday effects (G), without the last two (H), and without the rivals (I)."""
    return cross_fits(spark, sf_dir).select("cat_id", "spec", *[r6(c, c) for c in ("estimate", "se", "cross", "cross_se")], "n", "status")


@C.query()
def K12_sections(spark, sf_dir):
    """The pricing report's sections on heterogeneity, segments and rivals, from the stored fits: a row per section, category and figure."""
    out = SC.heterogeneity(item_fits(spark, sf_dir)).unionByName(SC.segments(segment_fits(spark, sf_dir))).unionByName(SC.rivals(cross_fits(spark, sf_dir)))
    return out.select("section", "cat_id", "figure", r6("value", "value"))


def _feature_rows(spark, sf_dir, level: str = "store"):
    g = X.exogenous(grid_of(spark, sf_dir, level, measures=ALL))
    f = X.add_features(g.withColumn("event", P.event_of(F.col("date"))))
    return f.crossJoin(F.broadcast(last_origin(spark, sf_dir)))


@C.query()
def B6_boosted_mean(spark, sf_dir):
    """Boosted Poisson trees on the features of all stores: last fold's error next to the seasonal naive's."""
    f = written(_feature_rows(spark, sf_dir), "f")
    names = list(X.FEATURES)
    models = GB.fit_models(X.training_rows(f, F.col("origin")), names, (None,), GB.TREES, 0)
    p = GB.predict(f.where("date >= origin"), models, names, ["key", "date", "y", "lag_28"])
    return p.groupBy("key").agg(r6(M.wmape("y", "mean"), "wmape"), r6(M.bias("y", "mean"), "bias"), r6(M.wmape("y", "lag_28"), "naive_wmape"))


@C.query()
def B7_boosted_quantiles(spark, sf_dir):
    """Boosted quantiles, rearranged: coverage and loss by quantile on the last fold."""
    f = written(_feature_rows(spark, sf_dir), "f")
    names = list(X.FEATURES)
    models = GB.fit_models(X.training_rows(f, F.col("origin")), names, Q.SERVICE_LEVELS, 0, GB.QUANTILE_TREES)
    p = GB.predict(f.where("date >= origin"), models, names, ["key", "date", "y"])
    fan = p.select("y", Q.rearranged(F.array(*[F.col(f"q_{round(100 * t)}") for t in Q.SERVICE_LEVELS])).alias("q"))
    t = Q.cross_scores(fan)
    return t.select("tau", *[r6(c, c) for c in t.columns if c != "tau"])


@C.query()
def B12_deep_forecast(spark, sf_dir):
    """The residual network on windows of all stores before the last origin: its error by store."""
    g = written(grid_of(spark, sf_dir, "store"), "g")
    o = origins_of(spark, sf_dir).where("fold = 6")
    before = g.crossJoin(F.broadcast(o.select("origin"))).where("date < origin").drop("origin")
    net = D.fit_network(D.training_windows(before))
    h = B.histories(g, o)
    actual = h.select("key", F.posexplode("actual").alias("h0", "y")).select("key", (F.col("h0") + 1).alias("h"), "y")
    return D.forecast(h, net).join(actual, ["key", "h"]).groupBy("key").agg(r6(M.wmape(), "wmape"), r6(M.bias(), "bias"))


@C.query()
def R7_series_sweep(spark, sf_dir):
    """Error over growing numbers of series: seasonal naive, network, and the value added.

    All arms train on the same number of windows, so that only the number of series they come from grows.
    """
    g = written(grid_of(spark, sf_dir, "store_cat"), "g")
    o = origins_of(spark, sf_dir).where("fold = 6")
    before = g.crossJoin(F.broadcast(o.select("origin"))).where("date < origin").drop("origin")
    keys = g.select("key").distinct().withColumn("r", F.row_number().over(Window.orderBy(F.md5(F.col("key").cast("binary")))))
    size = before.agg(F.count_distinct("key").alias("series"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days")).first()
    arms, budget = D.sweep_arms(size["series"], size["days"])
    out = None
    for n in arms:
        some = keys.where(F.col("r") <= n).select("key")
        net = D.fit_network(D.training_windows(before.join(some, "key", "left_semi"), D.fixed_stride(size["days"], n, budget)), budget)
        h = written(B.histories(g.join(some, "key", "left_semi"), o), "h")
        actual = h.select("key", F.posexplode("actual").alias("h0", "y"), B.seasonal_naive(F.col("ys"), F.lit(1)).alias("x")).select("key", (F.col("h0") + 1).alias("h"), "y")
        naive = B.backtest(g.join(some, "key", "left_semi"), ("seasonal_naive",), starts=origins_of(spark, sf_dir)).where("fold = 6").select("key", "h", F.col("yhat").alias("naive"))
        row = D.forecast(h, net).join(actual, ["key", "h"]).join(naive, ["key", "h"]).agg(F.lit(n).alias("series"), r6(M.wmape("y", "naive"), "seasonal_naive"), r6(M.wmape(), "deep"), r6(M.wmape("y", "naive") - M.wmape(), "fva"))
        out = row if out is None else out.unionByName(row)
    return out


@C.query()
def H7_mint(spark, sf_dir):
    """Minimum trace by all three covariances over six levels, from smoothing and its one-step errors: largest incoherence and error by level."""
    rows = reconciled(spark, sf_dir, "ses", ("ols", "wls", "shrink"), "ses").where("recon LIKE 'mint%'")
    nodes = written(R.tree(sales(spark, sf_dir).select("state_id", "store_id", "cat_id", "dept_id", "item_id").distinct(), P.ALL_LEVELS), "tree")
    kids = rows.join(nodes, ["level", "key"]).groupBy("recon", F.col("up_key").alias("key"), "h", F.coalesce(*[F.when(F.col("level") == b, F.lit(a)) for a, b in zip(P.ALL_LEVELS, P.ALL_LEVELS[1:])]).alias("level")).agg(F.sum("value").alias("child"))
    gap = rows.join(kids, ["recon", "level", "key", "h"]).groupBy("recon").agg(F.max(F.abs(F.col("value") - F.col("child"))).alias("violation"))
    out = rows.groupBy("recon", "level").agg(r6(M.wmape("y", "value"), "wmape")).join(gap, "recon")
    return out.select(F.substring("recon", 6, 10).alias("method"), "level", "wmape", F.round("violation", 4).alias("violation"))


@C.query(with_("grid folds", """SELECT round(greatest(0.05::DOUBLE, least(1.0::DOUBLE, 1 - avg(r) ** 2 / avg(r * r))), 6) AS weight, round((SELECT avg(v) FROM (SELECT var_samp(d) AS v FROM errors GROUP BY level, key)), 6) AS variance, (SELECT count(*) FROM (SELECT DISTINCT level, key FROM errors)) AS nodes FROM (
  SELECT corr(a.d, b.d) AS r FROM errors a JOIN errors b ON a.date = b.date AND (a.level != b.level OR a.key != b.key) GROUP BY a.level, a.key, b.level, b.key)""",
  errors="SELECT level, key, date, d FROM (SELECT level, key, date, y - lag(y, 7) OVER (PARTITION BY level, key ORDER BY date) AS d FROM grid WHERE level != 'store_cat'), folds WHERE fold = 6 AND date < origin AND date >= origin - 180"))
def H6_shrinkage(spark, sf_dir):
    """The weight of the diagonal in the shrunk covariance of the seasonal errors of stores and above, the mean variance and the nodes."""
    states = states_of(spark, sf_dir, fold=6, tail=180, errors="seasonal")
    weight, variance, n = R.shrinkage(states.select(F.col("resid").alias("tail")), 180)
    return spark.createDataFrame([(round(weight, 6), round(variance, 6), n)], "weight double, variance double, nodes long")


@C.query()
def H12_joint_samples(spark, sf_dir):
    """Joint draws for categories in stores, summed up: quantiles of a week by level, and the gap to summed bottom quantiles."""
    states = states_of(spark, sf_dir, P.LEVELS, fold=6, tail=180, errors="seasonal").where("level = 'store_cat'")
    points = FO.backtest(states, ("seasonal_naive",)).where("h <= 7").select(F.col("key").alias("bkey"), "h", F.col("yhat").alias("value"))
    draws = PR.bottom_samples(points, states.select(F.col("key").alias("bkey"), F.col("resid").alias("tail")))
    week = draws.groupBy("bkey", "sample").agg(F.sum("value").alias("value"))
    nodes = written(R.tree(sales(spark, sf_dir).select("state_id", "store_id", "cat_id").distinct(), P.LEVELS), "tree")
    up = R.sum_up(week.select(F.col("bkey").alias("key"), "sample", "value"), nodes, P.LEVELS, "sample")
    return PR.level_ratios(up, "store_cat", 0.95).select("level", r6("q95", "q95"), r6("ratio", "ratio"), r6("gap", "gap"))


_DRAWN = """SELECT p.key, len, s, sum(greatest(0, point + z * sqrt(greatest(point, 0.25::DOUBLE)))) AS d FROM (SELECT key, n, point, len, s, day, ((s * 1103515245 + (day // 7) * 12345 + 20011) % 2147483648) % (n - 6) + day % 7 AS i
  FROM pools, (SELECT unnest([7, 14, 28]) AS len), (SELECT unnest(range(0, 4000)) AS s), (SELECT unnest(range(0, 28)) AS day) WHERE day < len) p JOIN errors e ON e.key = p.key AND e.i = p.i GROUP BY ALL"""


def _normal(tau: float) -> str:
    return repr(Q.normal_quantile(tau))


@C.query(with_("grid bounds", f"""SELECT key, len::INT AS length, tau, round(CASE tau WHEN 0.9 THEN q[1] WHEN 0.95 THEN q[2] ELSE q[3] END, 6) AS bootstrap, round(len * CASE tau WHEN 0.9 THEN daily[1] WHEN 0.95 THEN daily[2] ELSE daily[3] END, 6) AS sum_of_daily,
  round(point * len + CASE tau WHEN 0.9 THEN {_normal(0.9)}::DOUBLE WHEN 0.95 THEN {_normal(0.95)}::DOUBLE ELSE {_normal(0.98)}::DOUBLE END * sigma * sqrt(greatest(point, 0.25::DOUBLE)) * sqrt(len), 6) AS iid
  FROM (SELECT key, len, quantile_cont(d, [0.9, 0.95, 0.98]) AS q FROM drawn GROUP BY key, len) JOIN pools USING (key), (SELECT unnest([0.9, 0.95, 0.98]::DOUBLE[]) AS tau)""",
  changes="SELECT key, date, y, b, lag(y, 7) OVER (PARTITION BY key ORDER BY date) AS p FROM grid, bounds WHERE level = 'store'",
  errors="SELECT key, (y - p) / sqrt(greatest(p, 0.25::DOUBLE)) AS z, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS i FROM changes WHERE p IS NOT NULL",
  pools="SELECT * FROM (SELECT key, count(*) AS n, sqrt(avg(z * z)) AS sigma FROM errors GROUP BY key) JOIN (SELECT key, avg(y) FILTER (WHERE date > b - 28) AS point, quantile_cont(y, [0.9, 0.95, 0.98]) FILTER (WHERE date > b - 180) AS daily FROM changes GROUP BY key) USING (key)", drawn=_DRAWN))
def L9_compare_methods(spark, sf_dir):
    """Bootstrap, summed daily quantiles and the independent normal for three lead times and levels, by store."""
    taus = (0.90, 0.95, 0.98)
    g = grid_of(spark, sf_dir, "store")
    g = g.crossJoin(F.broadcast(last_day(spark, sf_dir))).withColumn("p", F.lag("y", 7).over(Window.partitionBy("key").orderBy("date")))
    z = F.when(F.col("p").isNotNull(), F.struct("date", L.standardised(F.col("y") - F.col("p"), F.col("p")).alias("z")))
    recent = F.when(F.col("date") > F.date_sub("b", 28), F.col("y"))
    per = written(g.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(z)), lambda x: x["z"]).alias("pool"), F.avg(recent).alias("point"), F.percentile(F.when(F.col("date") > F.date_sub("b", 180), F.col("y")), F.array(*[F.lit(t) for t in taus])).alias("daily")), "per")
    out = None
    for days in (7, 14, 28):
        q = L.leadtime_quantiles(L.leadtime_totals(per.select("key", "point"), per.select("key", "pool"), days, L.SAMPLES), taus)
        met = q.join(per, "key").withColumn("length", F.lit(days))
        sigma = F.sqrt(F.aggregate("pool", F.lit(0.0), lambda a, x: a + x * x) / F.size("pool")) * F.sqrt(F.greatest("point", F.lit(0.25)))
        iid = F.coalesce(*[F.when(F.col("tau") == t, L.iid_normal(F.col("point") * days, sigma, F.col("length"), t)) for t in taus])
        daily = F.coalesce(*[F.when(F.col("tau") == t, F.col("daily")[i] * days) for i, t in enumerate(taus)])
        row = met.select("key", "length", "tau", r6("quantile", "bootstrap"), r6(daily, "sum_of_daily"), r6(iid, "iid"))
        out = row if out is None else out.unionByName(row)
    return out


@C.query()
def K9_constrained_plans(spark, sf_dir):
    """For every store, four plans over its items: rivals ignored, rivals in, a shared pool, and a discount budget."""
    columns = "dept string, policy string, status string, converged boolean, iterations int, value double, depths array<array<double>>"

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        items = [{"item_id": r.key, "dept": r.dept, "base_daily": r.base_daily, "ref_price": r.ref_price, "elasticity": -1.6, "inventory": r.inventory} for r in pdf.itertuples()]
        ticket = sum(i["base_daily"] * i["ref_price"] * K.PHASES * K.PHASE_DAYS for i in items)
        policies = {"ignore": dict(cross=0.0), "cross": dict(cross=0.35), "pool": dict(cross=0.35, pools=[[0, 1]] if len(items) > 1 else []), "budget": dict(cross=0.35, budget=0.12 * ticket)}
        got = {n: K.solve_plan(items, **kw) for n, kw in policies.items()}
        return pd.DataFrame([{"dept": items[0]["dept"], "policy": n, "status": r["status"], "converged": r["converged"], "iterations": r["iterations"], "value": round(r["value"], 4), "depths": [list(d) for d in r["depths"]]} for n, r in got.items()])

    # a plan is minutes of search on few rows: stores are dealt out by number, not by size
    return items_of(spark, sf_dir).repartition(64, "dept").groupBy("dept").applyInPandas(plan, columns)


def generated(spark, sf_dir, days: int = 364):
    """The generator over the catalogue's brands (priced by their parts) and the regions as stores."""
    part = table(spark, sf_dir, "part")
    items = part.groupBy(F.concat_ws("-", "p_type", "p_brand").alias("item_id"), F.concat_ws("-", "p_type", F.pmod(F.crc32(F.col("p_brand").cast("binary")), F.lit(2))).alias("dept_id"), F.col("p_type").alias("cat_id")).agg(F.round(F.avg("p_retailprice") / 100, 2).alias("base_price"))
    stores = table(spark, sf_dir, "region").select(F.col("r_name").alias("store_id"), F.col("r_name").alias("state_id"))
    return items, GN.panel(items, stores, "2023-01-01", days)


@C.query()
def G4_generated_panel(spark, sf_dir):
    """The synthetic panel summed by category and month."""
    _, p = generated(spark, sf_dir)
    return p.groupBy("cat_id", F.trunc("date", "month").cast("string").alias("month")).agg(F.sum("sales").alias("sales"), r6(F.avg("sell_price"), "price"), r6(F.avg("promo"), "promo_share"), r6(F.avg((F.col("sales") == 0).cast("int")), "zero_share"))


@C.query()
def G5_truth(spark, sf_dir):
    """The truth record of the synthetic panel."""
    items, p = generated(spark, sf_dir)
    t = GN.truth(items, p)
    return t.select(F.size("elasticity_by_category").alias("categories"), F.size("elasticity_by_item").alias("items"), r6("zero_share", "zero_share"), "n_series", "n_rows", "days", "date_min", "date_max", "cross_elasticity")


@C.query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def ST1_daily_events(spark, sf_dir):
    """The event stream's daily counts, read to its present end."""
    from demandloom.streaming import events as SE

    path = work_path(spark, "stream")
    SE.run_available(SE.daily_counts(SE.event_stream(spark, sf_dir)), path, work_path(spark, "stream-checkpoint"))
    return spark.read.parquet(path).select(F.col("day").cast("string").alias("day"), "event_type", "n", F.round("value", 4).alias("value"))
