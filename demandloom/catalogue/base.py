"""Scans, projections, joins, aggregates, windows and the feature pipeline."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandloom.catalogue.registry import Catalogue, r6, r6s
from demandloom.catalogue.sql import with_
from demandloom.functions import metrics as M
from demandloom.functions.leadtime import finite
from demandloom.functions.selection import quantiles
from demandloom.operators import baselines as B
from demandloom.operators import features as X
from demandloom.operators import folds as FO
from demandloom.operators import panel as P
from demandloom.operators import sparse as SP
from demandloom.sources.artifacts import stored
from demandloom.sources.sales import sales, table
from demandloom.sources.store import written

C = Catalogue()
QUERIES, ORACLES = C.queries, C.oracles
ALL = ("y", "revenue", "promo_units", "price_sum", "promo_sum", "n")


def grid_of(spark: SparkSession, sf_dir: str, *levels: str, measures: tuple[str, ...] = ("y",), since: DataFrame | None = None) -> DataFrame:
    # a grid asks its panel for the days, the series and the rows: written, so that the sales are read once
    panel = written(P.roll_up(sales(spark, sf_dir), levels or P.LEVELS).select("level", "key", "date", *measures), "panel")
    return P.dense(panel, *measures, since=since)


def origins_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of the folds from the days of the sales: a grid ends on the same day, and would be built twice to be asked."""
    return P.origins(sales(spark, sf_dir).select("date"))


#: The tables that the sales view reads.
SALES_TABLES = ("lineitem", "supplier", "nation", "region", "part")
UPPER = ("total", "state", "store")


def days_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P.daily of every item x store, stored: the sales are read and joined once for all that is made of a row per series and day."""
    return stored(spark, "days", [f"{sf_dir}/{t}.parquet" for t in SALES_TABLES], {}, lambda: P.daily(sales(spark, sf_dir), *P.FINEST))


def states_of(spark: SparkSession, sf_dir: str, levels: tuple[str, ...] = UPPER, fold: int | None = None, tail: int = 0, errors: str = "ses") -> DataFrame:
    """folds.fold_states of these levels for all folds or one, built once for these tables and stored."""

    def build() -> DataFrame:
        # levels below the category have about as many rows as the stored days; the others fewer, so they come from the sales
        fine = not set(levels) <= set(P.LEVELS)
        rows = days_of(spark, sf_dir) if fine else written(P.roll_up(sales(spark, sf_dir), levels), "panel")
        span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        starts = [(r["fold"], r["origin"]) for r in P.origins(rows.select("date")).collect() if r["origin"] is not None and fold in (None, r["fold"])]
        return FO.fold_states(P.roll_up_days(rows, levels) if fine else rows, span["a"], span["b"], starts, tail, errors)

    paths = [f"{sf_dir}/{t}.parquet" for t in SALES_TABLES]
    return stored(spark, "fold-states", paths, {"levels": levels, "fold": fold, "tail": tail, "errors": errors}, build)


def panel_of(spark: SparkSession, sf_dir: str, levels: tuple[str, ...] = P.LEVELS) -> DataFrame:
    """P.roll_up of the sales, kept as a table bucketed and sorted by series."""
    paths = [f"{sf_dir}/{t}.parquet" for t in SALES_TABLES]
    return stored(spark, "panel", paths, {"levels": levels}, lambda: P.roll_up(sales(spark, sf_dir), levels), ("level", "key"), ("date",))


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """b: the last day of the sales, which every grid ends on."""
    return sales(spark, sf_dir).agg(F.max("date").alias("b"))


def last_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins_of(spark, sf_dir).where("fold = 6").select("origin")


def last_fold(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with the last fold's origin on each."""
    return rows.crossJoin(F.broadcast(last_origin(spark, sf_dir)))


@C.query("SELECT l_orderkey, CAST(l_shipdate AS DATE) AS ship_date, l_quantity::BIGINT AS qty, round(l_extendedprice * (1 - l_discount) + 3.1e-8::DOUBLE, 6) AS net FROM lineitem", dates="ship_date")
def S1_scan_project(spark, sf_dir):
    """Pruned, typed projection of the fact table."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship_date"), F.col("l_quantity").cast("long").alias("qty"), r6s(F.col("l_extendedprice") * (1 - F.col("l_discount")), "net"))


@C.query(with_("grid", "SELECT key, count(*) FILTER (WHERE date >= b - 27) AS in_horizon, count(*) FILTER (WHERE date > b - 56) AS last_56, count(*) FILTER (WHERE date >= b - 90) AS last_91, count(*) FILTER (WHERE isodow(date) IN (6, 7)) AS weekend, count(*) FILTER (WHERE date BETWEEN b - 13 AND b - 7 AND y > 0) AS week_before_last FROM grid, bounds WHERE level = 'store_cat' GROUP BY key"))
def P4_date_filters(spark, sf_dir):
    """Date, membership, range and conjunction filters as conditional counts over the dense grid."""
    g = grid_of(spark, sf_dir, "store_cat")
    g = g.crossJoin(F.broadcast(last_day(spark, sf_dir)))
    d = F.col("date")
    tests = {"in_horizon": d >= F.date_sub("b", 27), "last_56": d > F.date_sub("b", 56), "last_91": d >= F.date_sub("b", 90), "weekend": F.weekday(d).isin(5, 6), "week_before_last": d.between(F.date_sub("b", 13), F.date_sub("b", 7)) & (F.col("y") > 0)}
    return g.groupBy("key").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


_WEEK_GRID = "SELECT k.key, w.week, x.units, x.price, x.promo FROM (SELECT DISTINCT key FROM weekly) k CROSS JOIN (SELECT DISTINCT week FROM weekly) w LEFT JOIN weekly x ON x.key = k.key AND x.week = w.week"


@C.query(with_("weekly", """SELECT key, week, round(coalesce(last_value(price IGNORE NULLS) OVER (PARTITION BY key ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(price IGNORE NULLS) OVER (PARTITION BY key ORDER BY week ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) + 3.1e-8::DOUBLE, 6) AS price,
  round(coalesce(promo, 0), 6) AS promo, CASE WHEN units > 100 THEN 'high' WHEN units > 0 THEN 'low' ELSE 'none' END AS band, round(least(greatest(coalesce(units, 0), 5), 200), 6) AS clipped, round(price / nullif(units, 0) + 3.1e-8::DOUBLE, 6) AS per_unit, CASE WHEN units >= 50 THEN round(units, 6) END AS masked FROM wg""", wg=_WEEK_GRID), dates="week")
def P11_null_fills(spark, sf_dir):
    """Forward then backward fill, constant fill, conditionals, clipping, masking and division by a nulled zero."""
    w = P.weekly(sales(spark, sf_dir).withColumn("key", F.concat_ws("|", "store_id", "cat_id")), "key")
    rows = w.select("key").distinct().crossJoin(F.broadcast(w.select("week").distinct())).join(w, ["key", "week"], "left").withColumnRenamed("week", "date").withColumn("level", F.lit("store_cat"))
    units = F.col("units")
    return rows.select(
        "key", F.col("date").alias("week"), r6s(X.fill_price(), "price"), r6(F.coalesce("promo", F.lit(0.0)), "promo"), F.when(units > 100, "high").when(units > 0, "low").otherwise("none").alias("band"),
        r6(F.least(F.greatest(F.coalesce(units, F.lit(0.0)), F.lit(5.0)), F.lit(200.0)), "clipped"), r6s(F.col("price") / F.nullif(units, F.lit(0.0)), "per_unit"), r6(F.when(units >= 50, units), "masked"),
    )


@C.query(with_("sales", "SELECT DISTINCT store_id || '|' || cat_id || '|' || item_id AS bkey, store_id || '|' || cat_id AS dkey, item_id AS leaf, starts_with(cat_id, 'P') AS is_p FROM sales"))
def P18_series_meta(spark, sf_dir):
    """Series and their parents: distinct keys, concatenated and split again."""
    s = sales(spark, sf_dir).select(F.concat_ws("|", "store_id", "cat_id", "item_id").alias("bkey")).distinct()
    part = F.split("bkey", "\\|")
    return s.select("bkey", F.concat_ws("|", part[0], part[1]).alias("dkey"), F.element_at(part, -1).alias("leaf"), F.startswith(part[1], F.lit("P")).alias("is_p"))


_CALENDAR = """SELECT date, isodow(date)::INT - 1 AS dow, dayofyear(date)::INT AS doy, year(date)::INT AS year, month(date)::INT AS month, day(date)::INT AS day FROM (SELECT DISTINCT date FROM grid)"""
_EVENTS = """SELECT *, CASE WHEN date >= tg - 6 AND date < tg THEN 'ThanksgivingRunup' WHEN date = tg THEN 'Thanksgiving' WHEN date = tg + 1 THEN 'BlackFriday' WHEN month = 12 AND day BETWEEN 18 AND 24 THEN 'ChristmasRunup' WHEN month = 12 AND day = 25 THEN 'Christmas'
  WHEN month = 12 AND day = 31 THEN 'NewYearEve' WHEN month = 7 AND day = 4 THEN 'July4' WHEN date = sb THEN 'SuperBowl' ELSE 'none' END AS event FROM cal
  LEFT JOIN (SELECT year, date AS tg FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY date) AS k FROM days WHERE month = 11 AND dow = 3) WHERE k = 4) USING (year)
  LEFT JOIN (SELECT year, min(date) AS sb FROM days WHERE month = 2 AND dow = 6 GROUP BY year) USING (year)"""
_DAYS = "SELECT date, isodow(date)::INT - 1 AS dow, year(date) AS year, month(date) AS month FROM (SELECT unnest(generate_series(date_trunc('year', a), date_trunc('year', b) + INTERVAL 364 DAY, INTERVAL 1 DAY))::DATE AS date FROM bounds)"
_FULL_CALENDAR = {"cal": _CALENDAR, "days": _DAYS, "events": _EVENTS}


@C.query(with_("grid", """SELECT g.date, e.dow, e.doy, e.year, e.month, e.day, weekofyear(g.date)::INT AS woy, e.event, round(sin(2 * pi() * e.doy / 365.25::DOUBLE), 6) + 0.0::DOUBLE AS doy_sin, (e.dow >= 5)::INT AS is_weekend, least(45, abs(360 - e.doy))::INT AS days_to_xmas, y
  FROM grid g JOIN events e ON g.date = e.date WHERE level = 'total'""", **_FULL_CALENDAR), dates="date")
def J1_calendar_join(spark, sf_dir):
    """The grid with its calendar: date parts, events (N-th weekday of a month), cyclic and distance features."""
    g = grid_of(spark, sf_dir, "total")
    cal = P.calendar(g.select("date").distinct())
    d = F.col("date")
    return g.join(cal, "date").select(d, "dow", "doy", "year", "month", "day", F.weekofyear(d).alias("woy"), "event", r6(X.calendar_features()["doy_sin"], "doy_sin"), X.calendar_features()["is_weekend"].alias("is_weekend"), X.calendar_features()["days_to_xmas"].alias("days_to_xmas"), "y")


@C.query(with_("grid", "SELECT level, count(*) AS n_rows, count(DISTINCT key) AS n_series, round(avg((y = 0)::INT), 6) AS zero_share, round(sum(y), 2) AS total FROM grid GROUP BY level"))
def J10_dense_grid(spark, sf_dir):
    """Every series on every day at all levels."""
    return grid_of(spark, sf_dir).groupBy("level").agg(F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_series"), r6(F.avg((F.col("y") == 0).cast("int")), "zero_share"), F.round(F.sum("y"), 2).alias("total"))


@C.query(with_("panel6", "SELECT level, key, date_trunc('month', date)::DATE AS month, round(sum(y), 2) AS y FROM panel6 GROUP BY 1, 2, 3"), dates="month")
def A1_level_rollup(spark, sf_dir):
    """Monthly sums of all levels from one pass."""
    return P.roll_up(sales(spark, sf_dir), P.ALL_LEVELS).groupBy("level", "key", F.trunc("date", "month").alias("month")).agg(F.round(F.sum("y"), 2).alias("y"))


@C.query(with_("sales", "SELECT store_id || '|' || cat_id AS key, count(*) AS n, round(sum(units), 2) AS units, round(avg(revenue) + 3.1e-8::DOUBLE, 6) AS mean_revenue, max(units) AS most, count(DISTINCT item_id) AS items, round(avg(promo::INT), 6) AS promo_share, min(item_id) AS first_item, max(promo::INT)::INT AS any_promo FROM sales GROUP BY 1"))
def A2_multi_agg(spark, sf_dir):
    """Sums, means, counts, distinct counts, maxima, shares and a deterministic first."""
    s = sales(spark, sf_dir).groupBy(F.concat_ws("|", "store_id", "cat_id").alias("key"))
    promo = F.col("promo").cast("int")
    return s.agg(F.count("*").alias("n"), F.round(F.sum("units"), 2).alias("units"), r6s(F.avg("revenue"), "mean_revenue"), F.max("units").alias("most"), F.count_distinct("item_id").alias("items"), r6(F.avg(promo), "promo_share"), F.min("item_id").alias("first_item"), F.max(promo).alias("any_promo"))


@C.query(with_("sales", """SELECT a.*, m.mode_units FROM (SELECT store_id || '|' || cat_id AS key, round(median(units), 6) AS median, round(quantile_cont(units, 0.95), 6) AS p95, round(corr(units, revenue), 6) AS corr, round(stddev_pop(units), 6) AS sd0, round(stddev_samp(units), 6) AS sd1 FROM sales GROUP BY 1) a
  JOIN (SELECT key, units AS mode_units FROM (SELECT store_id || '|' || cat_id AS key, units, row_number() OVER (PARTITION BY store_id || '|' || cat_id ORDER BY count(*) DESC, units) AS k FROM sales GROUP BY 1, 2) WHERE k = 1) m USING (key)"""))
def A9_ordered_stats(spark, sf_dir):
    """Median, interpolated quantile, correlation, both deviations, and the mode with ties to the smaller value."""
    s = sales(spark, sf_dir).withColumn("key", F.concat_ws("|", "store_id", "cat_id"))
    order = quantiles(s, "units", (0.5, 0.95), "key").select("key", r6(F.col("q")[0], "median"), r6(F.col("q")[1], "p95"))
    stats = order.join(s.groupBy("key").agg(r6(F.corr("units", "revenue"), "corr"), r6(F.stddev_pop("units"), "sd0"), r6(F.stddev_samp("units"), "sd1")), "key")
    mode = s.groupBy("key", "units").count().groupBy("key").agg(F.min_by("units", F.struct(-F.col("count"), F.col("units"))).alias("mode_units"))
    return stats.join(mode, "key")


@C.query(with_("weekly", "SELECT key, week, round(units, 2) AS units, round(price + 3.1e-8::DOUBLE, 6) AS price, round(promo, 6) AS promo, weekofyear(week)::INT AS woy, round(ln(greatest(price, 0.01::DOUBLE)), 6) AS log_p FROM weekly"), dates="week")
def A17_weekly(spark, sf_dir):
    """Weeks labelled by their Sunday."""
    w = P.weekly(sales(spark, sf_dir).withColumn("key", F.concat_ws("|", "store_id", "cat_id")), "key")
    return w.select("key", "week", F.round("units", 2).alias("units"), r6s("price", "price"), r6("promo", "promo"), "woy", r6("log_p", "log_p"))


@C.query(with_("weekly", "SELECT key, week, round(ln(greatest(price, 0.01::DOUBLE)) - avg(ln(greatest(price, 0.01::DOUBLE))) OVER (PARTITION BY key), 6) + 0.0::DOUBLE AS within_log_p, round(units / avg(units) OVER (PARTITION BY key), 6) AS rel_units FROM weekly"), dates="week")
def A18_group_transform(spark, sf_dir):
    """Demeaned by series (fixed effects without dummies)."""
    w = P.weekly(sales(spark, sf_dir).withColumn("key", F.concat_ws("|", "store_id", "cat_id")), "key")
    by = Window.partitionBy("key")
    return w.select("key", "week", r6(F.col("log_p") - F.avg("log_p").over(by), "within_log_p"), r6(F.col("units") / F.avg("units").over(by), "rel_units"))


@C.query(with_("sales", """SELECT store_id, cat_id, item_id, week, round(log_rel, 6) + 0.0::DOUBLE AS log_rel, round(CASE WHEN count(*) OVER g > 1 THEN (sum(log_rel) OVER g - log_rel) / (count(*) OVER g - 1) ELSE 0 END, 6) + 0.0::DOUBLE AS rival_log_rel
  FROM (SELECT *, ln(greatest(price, 0.01::DOUBLE) / median(greatest(price, 0.01::DOUBLE)) OVER (PARTITION BY item_id)) AS log_rel FROM iw) WINDOW g AS (PARTITION BY week, store_id, cat_id)""",
  iw="SELECT store_id, cat_id, item_id, (date_trunc('week', date)::DATE + 6)::DATE AS week, avg(revenue / nullif(units, 0)) AS price FROM sales GROUP BY 1, 2, 3, 4"), dates="week")
def A19_leave_one_out(spark, sf_dir):
    """Mean log relative price of an item's siblings in the same store, category and week."""
    from demandloom.operators.elasticity import rival_index

    w = P.weekly(sales(spark, sf_dir), "store_id", "cat_id", "item_id").withColumn("price", F.greatest("price", F.lit(0.01)))
    out = rival_index(w, item="item_id", price="price", group=("week", "store_id", "cat_id"))
    return out.select("store_id", "cat_id", "item_id", "week", r6("log_rel", "log_rel"), r6("rival_log_rel", "rival_log_rel"))


@C.query(with_("grid", """SELECT key, len(t)::INT AS n, round(list_sum(t), 6) AS total, round(t[1], 6) + 0.0::DOUBLE AS first_r, round(t[-1], 6) + 0.0::DOUBLE AS last_r FROM (SELECT key, list(r ORDER BY date)[-180:] AS t FROM (SELECT key, date, y - lag(y) OVER (PARTITION BY key ORDER BY date) AS r FROM grid WHERE level = 'store_cat') WHERE r IS NOT NULL GROUP BY key)"""))
def A21_residual_tail(spark, sf_dir):
    """The last 180 one-step residuals of each series as an array, padded in front with zeros."""
    from demandloom.operators.reconcile import residual_tail

    g = grid_of(spark, sf_dir, "store_cat")
    r = g.withColumn("r", F.col("y") - F.lag("y").over(X.by_date())).where("r IS NOT NULL")
    t = residual_tail(r, "r", 180, "key")
    total = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x)
    return t.select("key", F.size("tail").alias("n"), r6(total, "total"), r6(F.element_at("tail", 1), "first_r"), r6(F.element_at("tail", -1), "last_r"))


@C.query(with_("grid", "SELECT key, count(*) AS n, round(sum(lag_28), 2) AS lag_28, round(sum(lag_364), 2) AS lag_364 FROM lagged WHERE " + " AND ".join(f"lag_{k} IS NOT NULL" for k in X.LAGS) + " GROUP BY key",
  lagged="SELECT key, " + ", ".join(f"lag(y, {k}) OVER s AS lag_{k}" for k in X.LAGS) + " FROM grid WHERE level = 'store_cat' WINDOW s AS (PARTITION BY key ORDER BY date)"))
def P7_complete_rows(spark, sf_dir):
    """The rows of each series that have all lags."""
    lags = X.lags()
    rows = grid_of(spark, sf_dir, "store_cat").withColumns(lags).dropna(subset=list(lags))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.round(F.sum("lag_28"), 2).alias("lag_28"), F.round(F.sum("lag_364"), 2).alias("lag_364"))


@C.query(with_("grid", "SELECT key, count(*) FILTER (WHERE coalesce(isfinite(e), false)) AS n, count(*) FILTER (WHERE NOT coalesce(isfinite(e), false)) AS left_out, round(sum(e) FILTER (WHERE isfinite(e)), 6) + 0.0::DOUBLE AS total FROM ratios GROUP BY key",
  ratios="SELECT key, (y - lag(y, 7) OVER (PARTITION BY key ORDER BY date)) * pow(y, -1.0::DOUBLE) AS e FROM grid WHERE level = 'store_cat'"))
def P17_finite_filter(spark, sf_dir):
    """Relative weekly changes that are finite; days without sales give infinities, no numbers or nulls."""
    e = (F.col("y") - F.lag("y", 7).over(X.by_date())) * F.pow("y", F.lit(-1.0))
    rows = grid_of(spark, sf_dir, "store_cat").withColumn("e", e).withColumn("ok", finite(F.col("e")))
    total = F.sum(F.when(F.col("ok"), F.col("e")))
    return rows.groupBy("key").agg(F.count_if("ok").alias("n"), F.count_if(~F.col("ok")).alias("left_out"), r6(total, "total"))


def last_fold_days(spark, sf_dir, measures: tuple[str, ...] = ("y",)):
    """(panel, asked, first): categories in stores on their days with sales, all of them on the last fold's days, the first day."""
    s = sales(spark, sf_dir)
    span = s.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    first, last = span["a"] or datetime.date(1970, 1, 1), span["b"] or datetime.date(1970, 1, 1)
    panel = P.roll_up(s, ("store_cat",)).select("level", "key", "date", *measures)
    return panel, SP.asked_days(panel, last - datetime.timedelta(days=P.HORIZON - 1), last), first


def last_fold_features(spark, sf_dir):
    """Target features of every category in a store on the last fold's days, from the days with sales."""
    return SP.target_features(*last_fold_days(spark, sf_dir))


_LAST = "SELECT * FROM ({q}) WHERE date >= (SELECT b - 27 FROM bounds)"


@C.query(with_("grid", "SELECT * FROM w WHERE date >= (SELECT b - 27 FROM bounds)", w="SELECT key, date, " + ", ".join(f"lag(y, {k}) OVER s AS lag_{k}" for k in X.LAGS) + " FROM grid WHERE level = 'store_cat' WINDOW s AS (PARTITION BY key ORDER BY date)"), dates="date")
def W1_lags(spark, sf_dir):
    """Target lags of the horizon and more, for the last fold's days."""
    return last_fold_features(spark, sf_dir).select("key", "date", *[f"lag_{k}" for k in X.LAGS])


def _rolling_sql(key: str = "key") -> str:
    out = []
    for n in X.WINDOWS:
        f = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN {27 + n} PRECEDING AND 28 PRECEDING)"
        least = max(2, n // 4)
        out += [f"CASE WHEN count(y) {f} >= {least} THEN round(avg(y) {f}, 6) END AS rmean_{n}", f"CASE WHEN count(y) {f} >= {least} THEN round(stddev_samp(y) {f}, 6) END AS rstd_{n}"]
    f = f"OVER (PARTITION BY {key} ORDER BY date ROWS BETWEEN 83 PRECEDING AND 28 PRECEDING)"
    out.append(f"CASE WHEN count(y) {f} >= 14 THEN round(sum((y = 0)::INT) {f} / least(56, row_number() OVER (PARTITION BY {key} ORDER BY date))::DOUBLE, 6) END AS zero_share_56")
    f = f"OVER (PARTITION BY {key}, isodow(date) ORDER BY date ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)"
    out.append(f"CASE WHEN count(y) {f} >= 2 THEN round(avg(y) {f}, 6) END AS dow_mean_4w")
    return ", ".join(out)


@C.query(with_("grid", "SELECT * FROM w WHERE date >= (SELECT b - 27 FROM bounds)", w=f"SELECT key, date, {_rolling_sql()} FROM grid WHERE level = 'store_cat'"), dates="date")
def W2_rolling(spark, sf_dir):
    """Rolling means, deviations, zero share and the same-weekday mean, for the last fold's days."""
    names = (*[f"{kind}_{n}" for n in X.WINDOWS for kind in ("rmean", "rstd")], "zero_share_56", "dow_mean_4w")
    return last_fold_features(spark, sf_dir).select("key", "date", *[r6(c, c) for c in names])


_FILLED = """SELECT level, key, date, y, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY level, key ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY level, key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price, coalesce(promo_sum / nullif(n, 0), 0) AS promo
  FROM (SELECT *, price_sum / nullif(n, 0) * coalesce((lag(revenue, 28) OVER s / nullif(lag(y, 28) OVER s, 0)) / (lag(price_sum, 28) OVER s / nullif(lag(n, 28) OVER s, 0)), 1) AS p FROM grid WINDOW s AS (PARTITION BY level, key ORDER BY date))"""
_PRICE = "round(CASE WHEN count(price) OVER (PARTITION BY level, key ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW) >= 7 THEN price / avg(price) OVER (PARTITION BY level, key ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW) END, 6) AS price_rel_56, round(price / lag(price, 7) OVER (PARTITION BY level, key ORDER BY date) - 1, 6) + 0.0::DOUBLE AS price_chg_7, round(ln(greatest(price, 0.01::DOUBLE)), 6) + 0.0::DOUBLE AS log_price"


@C.query(with_("grid", "SELECT * FROM w WHERE date >= (SELECT b - 27 FROM bounds)", filled=_FILLED, w=f"SELECT key, date, {_PRICE} FROM filled WHERE level = 'store_cat'"), dates="date")
def W6_price_windows(spark, sf_dir):
    """Price relative to its own recent mean, and its weekly change."""
    f = SP.price_features(*last_fold_days(spark, sf_dir, ALL))
    return f.select("key", "date", *[r6(c, c) for c in ("price_rel_56", "price_chg_7", "log_price")])


SCALE = "SELECT level, key, avg(abs(d)) AS a, avg(d * d) AS q FROM (SELECT level, key, y - lag(y, 7) OVER (PARTITION BY level, key ORDER BY date) AS d FROM grid, folds WHERE fold = 6 AND date < origin) GROUP BY level, key"


@C.query(with_("backtest", """SELECT b.level, b.key, round(avg(abs(y - yhat)) / nullif(max(s.a), 0), 6) AS mase, round(sqrt(avg((y - yhat) ** 2) / nullif(max(s.q), 0)), 6) AS rmsse FROM backtest b JOIN scale s USING (level, key) WHERE fold = 6 AND method = 'seasonal_naive' GROUP BY b.level, b.key""",
  scale=SCALE))
def W9_scale(spark, sf_dir):
    """MASE and RMSSE of the seasonal naive over the last fold."""
    g = grid_of(spark, sf_dir, "total", "state", "store")
    scale = M.seasonal_scale(last_fold(g, spark, sf_dir).where("date < origin"), "level", "key")
    b = FO.backtest(states_of(spark, sf_dir).where("fold = 6"), ("seasonal_naive",)).join(scale, ["level", "key"])
    return b.groupBy("level", "key").agg(r6(M.mase(F.col("scale_abs")), "mase"), r6(M.rmsse(F.col("scale_sq")), "rmsse"))


@C.query(with_("grid", """SELECT round(z.zero_share, 6) AS zero_share, z.series, z.days, round(median(adi), 6) AS median_adi, round(median(cv2), 6) AS median_cv2 FROM (SELECT avg((y = 0)::INT) AS zero_share, count(DISTINCT key) AS series, count(DISTINCT date) AS days FROM grid WHERE level = 'store_cat') z,
  (SELECT key, avg(gap) AS adi, (stddev_pop(y) / avg(y)) ** 2 AS cv2 FROM (SELECT key, y, i - lag(i) OVER (PARTITION BY key ORDER BY date) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS i FROM grid WHERE level = 'store_cat') WHERE y > 0) GROUP BY key HAVING count(*) >= 2) GROUP BY ALL"""))
def W10_gaps(spark, sf_dir):
    """The panel's intermittency by gaps between sales."""
    s = M.gap_summary(grid_of(spark, sf_dir, "store_cat"), "key")
    return s.select(r6("zero_share", "zero_share"), "series", "days", r6("median_adi", "median_adi"), r6("median_cv2", "median_cv2"))


@C.query(with_("grid", """SELECT key, round(corr(e, l), 6) AS rho FROM (SELECT key, date, e, lag(e) OVER (PARTITION BY key ORDER BY date) AS l FROM (SELECT key, date, (y - p) / sqrt(greatest(p, 0.25::DOUBLE)) AS e FROM (SELECT key, date, y, lag(y, 7) OVER (PARTITION BY key ORDER BY date) AS p FROM grid WHERE level = 'store') WHERE p IS NOT NULL)) GROUP BY key"""))
def W11_autocorr(spark, sf_dir):
    """Lag-1 autocorrelation of standardised seasonal-naive errors, in explicit time order."""
    from demandloom.functions.leadtime import standardised

    w = Window.partitionBy("key").orderBy("date")
    g = grid_of(spark, sf_dir, "store").withColumn("p", F.lag("y", 7).over(w)).where("p IS NOT NULL")
    e = g.select("key", "date", standardised(F.col("y") - F.col("p"), F.col("p")).alias("e"))
    return e.withColumn("e_lag1", F.lag("e").over(w)).groupBy("key").agg(r6(M.autocorrelation("e", 1), "rho"))


@C.query(with_("panel", "SELECT key, round(sum(y), 2) AS y FROM panel WHERE level = 'store_cat' GROUP BY key ORDER BY key LIMIT 50"))
def O4_top_keys(spark, sf_dir):
    """The first 50 keys in order: a top-k without a full sort."""
    return P.roll_up(sales(spark, sf_dir), ("store_cat",)).groupBy("key").agg(F.round(F.sum("y"), 2).alias("y")).orderBy("key").limit(50)


#: The six levels over the last 35 days.
_RECENT_SIX = """SELECT k.level, k.key, d.date, coalesce(p.y, 0) AS y FROM (SELECT DISTINCT level, key FROM panel6) k CROSS JOIN (SELECT unnest(generate_series(b - 34, b, INTERVAL 1 DAY))::DATE AS date FROM bounds) d LEFT JOIN panel6 p ON p.level = k.level AND p.key = k.key AND p.date = d.date"""


@C.query(with_("panel6 bounds", """SELECT level, round(sum(abs(y - p)) / nullif(sum(abs(y)), 0), 6) AS wmape, round(sum(p - y) / nullif(sum(abs(y)), 0), 6) AS bias FROM
  (SELECT level, key, date, y, CASE WHEN date < b - 20 THEN lag(y, 7) OVER s WHEN date < b - 13 THEN lag(y, 14) OVER s WHEN date < b - 6 THEN lag(y, 21) OVER s ELSE lag(y, 28) OVER s END AS p FROM recent, bounds WINDOW s AS (PARTITION BY level, key ORDER BY date)) , bounds WHERE date > b - 28 GROUP BY level""", recent=_RECENT_SIX))
def M1_wmape_by_level(spark, sf_dir):
    """Seasonal-naive WMAPE and bias by level, all six, over the last fold: a season before it is all that is read of the past."""
    s = sales(spark, sf_dir)
    last = s.agg(F.max("date")).first()[0] or datetime.date(1970, 1, 1)
    origin = last - datetime.timedelta(days=P.HORIZON - 1)
    cut = origin - datetime.timedelta(days=B.SEASON)
    # a series without a sale since the cut has no error and no demand there
    states = FO.fold_states(P.roll_up(s.where(F.col("date") >= F.lit(cut)), P.ALL_LEVELS), cut, last, [(P.FOLDS, origin)])
    b = FO.backtest(states, ("seasonal_naive",))
    return b.groupBy("level").agg(r6(M.wmape(), "wmape"), r6(M.bias(), "bias"))


@C.query(with_("classes", "SELECT level, key, round(adi, 6) AS adi, round(cv2, 6) AS cv2, class FROM classes"))
def M5_intermittency(spark, sf_dir):
    """Demand classes of all series."""
    c = M.adi_cv2(grid_of(spark, sf_dir), "level", "key")
    return c.select("level", "key", r6("adi", "adi"), r6("cv2", "cv2"), "class")


@C.query(with_("grid", "SELECT level, key, date, round(price + 3.1e-8::DOUBLE, 6) AS price, round(promo + 3.1e-8::DOUBLE, 6) AS promo FROM filled", filled=_FILLED), dates="date")
def H3_exog(spark, sf_dir):
    """Price and promo share at every level, weighted by the units of the horizon's lag, filled forward then backward."""
    g = X.exogenous(grid_of(spark, sf_dir, measures=ALL))
    return g.select("level", "key", "date", r6s("price", "price"), r6s("promo", "promo"))


_B15 = "SELECT key, f.date, " + ", ".join(f"lag(y, {k}) OVER (PARTITION BY key ORDER BY f.date) AS lag_{k}" for k in X.LAGS) + f", {_rolling_sql().replace('ORDER BY date', 'ORDER BY f.date').replace('isodow(date)', 'isodow(f.date)')}, {_PRICE.replace('ORDER BY date', 'ORDER BY f.date')}, e.dow, e.month, round(sin(2 * pi() * e.doy / 365.25::DOUBLE), 6) + 0.0::DOUBLE AS doy_sin, round(cos(2 * pi() * e.doy / 365.25::DOUBLE), 6) + 0.0::DOUBLE AS doy_cos, (e.dow >= 5)::INT AS is_weekend, round(promo, 6) AS promo, 0 AS snap, least(45, abs(360 - e.doy))::INT AS days_to_xmas, " + ", ".join(f"(event = '{x}')::TINYINT AS ev_{x}" for x in P.EVENTS) + " FROM filled f JOIN events e ON f.date = e.date WHERE level = 'store_cat'"


@C.query(with_("grid", "SELECT * FROM w WHERE date >= (SELECT b - 27 FROM bounds)", filled=_FILLED, **_FULL_CALENDAR, w=_B15), dates="date")
def B15_feature_matrix(spark, sf_dir):
    """All 34 features for the last fold's days."""
    panel, asked, first = last_fold_days(spark, sf_dir, ALL)
    panel = written(panel, "panel")
    f = SP.target_features(panel, asked, first).join(SP.price_features(panel, asked, first), ["level", "key", "date"])
    # the event follows from the date: a join with a calendar would shuffle the panel by date and back
    f = f.withColumn("event", P.event_of(F.col("date"))).withColumns({**X.calendar_features(), "snap": F.lit(0)})
    exact = {*[f"lag_{k}" for k in X.LAGS], "dow", "month", "is_weekend", "snap", "days_to_xmas", *[f"ev_{e}" for e in P.EVENTS]}
    return f.select("key", "date", *[c if c in exact else r6(c, c) for c in X.FEATURES])


@C.query("SELECT coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), 'none') AS k, count(*) AS n FROM events GROUP BY 1")
def F15_json(spark, sf_dir):
    """JSON fields of the event properties."""
    p = F.coalesce(F.get_json_object("props", "$.k"), F.get_json_object("props", "$.page"), F.lit("none"))
    return table(spark, sf_dir, "events").groupBy(p.alias("k")).agg(F.count("*").alias("n"))
