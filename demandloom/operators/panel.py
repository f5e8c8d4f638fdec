"""Panels: the sales hierarchy, dense daily grids, calendars and weekly buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("total", "state", "store", "store_cat")
#: With the bottom of the hierarchy.
ALL_LEVELS = (*LEVELS, "store_dept", "store_item")
HORIZON = 28
FOLDS = 6


def series_keys(levels: tuple[str, ...] = LEVELS) -> Column:
    """Array of (level, key): every ancestor of a bottom row, so a roll-up needs no join."""
    keys = {
        "total": F.lit("TOTAL"),
        "state": F.col("state_id"),
        "store": F.col("store_id"),
        "store_cat": F.concat_ws("|", "store_id", "cat_id"),
        "store_dept": F.concat_ws("|", "store_id", "dept_id"),
        "store_item": F.concat_ws("|", "store_id", "cat_id", "item_id"),
        "state_cat_item": F.concat_ws("|", "state_id", "cat_id", "item_id"),
    }
    return F.array(*[F.struct(F.lit(n).alias("level"), keys[n].alias("key")) for n in levels])


SUMS = ("y", "revenue", "promo_units", "price_sum", "promo_sum", "n")
FINEST = ("state_id", "store_id", "cat_id", "dept_id", "item_id")


def daily(sales: DataFrame, *keys: str) -> DataFrame:
    """(date, keys, y, revenue, promo_units, price_sum, promo_sum, n, priced, marked): sums by day; priced, marked: rows with a price, a promotion mark."""
    price = F.col("revenue") / F.nullif("units", F.lit(0.0))
    return sales.groupBy("date", *keys).agg(
        F.sum("units").alias("y"), F.sum("revenue").alias("revenue"), F.sum(F.when(F.col("promo"), F.col("units")).otherwise(0.0)).alias("promo_units"),
        F.sum(price).alias("price_sum"), F.sum(F.col("promo").cast("int")).alias("promo_sum"), F.count("*").alias("n"), F.count(price).alias("priced"), F.count("promo").alias("marked"),
    )


def day_means() -> tuple[Column, Column]:
    """(mean price, promo share) of daily() rows summed; null without any."""
    return F.sum("price_sum") / F.nullif(F.sum("priced"), F.lit(0)), F.sum("promo_sum") / F.nullif(F.sum("marked"), F.lit(0))


def roll_up_days(days: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """roll_up from daily() of keys fine enough for the levels."""
    return days.withColumn("s", F.explode(series_keys(levels))).groupBy("s.level", "s.key", "date").agg(*[F.sum(c).alias(c) for c in SUMS])


def roll_up(sales: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(level, key, date, y, revenue, promo_units, price_sum, promo_sum, n): sums by day of every level.

    Rows are summed at the finest key first: what the explode multiplies is small, and the key 'TOTAL' is already
    combined before the shuffle.
    """
    by_item = {"store_item", "state_cat_item"}
    needed = {"cat_id": {"store_cat", *by_item}, "dept_id": {"store_dept"}, "item_id": by_item}
    return roll_up_days(daily(sales, *[c for c in FINEST if c not in needed or needed[c] & set(levels)]), levels)


def dense(panel: DataFrame, *measures: str, since: DataFrame | None = None) -> DataFrame:
    """Every series on every day between the first and the last day of the panel; missing days are 0.

    since: one row (cut); the days from then on only, of all the panel's series.

    Zero rows are added and summed in: one shuffle by series serves this sum and all windows over a series. Its number
    of partitions is the session's and stays: judged by their bytes, which zeros hardly have, adaptive execution would
    merge what costs much to compute into a few tasks.
    """
    measures = measures or ("y",)
    days = panel.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    series = panel.select("level", "key").distinct()
    if since is not None:
        days = days.crossJoin(F.broadcast(since)).select(F.greatest("a", "cut").alias("a"), "b")
        panel = panel.crossJoin(F.broadcast(since)).where("date >= cut")
    spine = series.crossJoin(F.broadcast(days)).where("a IS NOT NULL").select("level", "key", F.explode(F.sequence("a", "b")).alias("date"), *[F.lit(0.0).alias(m) for m in measures])
    rows = panel.select("level", "key", "date", *measures).unionByName(spine).repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "level", "key")
    return rows.groupBy("level", "key", "date").agg(*[F.sum(m).alias(m) for m in measures])


def origins(panel: DataFrame, folds: int = FOLDS, horizon: int = HORIZON) -> DataFrame:
    """(fold, origin): the first day of each of the last so many horizons."""
    last = panel.agg(F.max("date").alias("b"))
    k = F.explode(F.sequence(F.lit(1), F.lit(folds)))
    return last.select("b", k.alias("fold")).select("fold", F.date_add("b", 1 - horizon * (folds + 1 - F.col("fold"))).alias("origin"))


def weekday(date: Column) -> Column:
    """Monday is 0."""
    return F.weekday(date)


#: The events of the calendar and their demand multipliers.
EVENTS = ("ThanksgivingRunup", "Thanksgiving", "BlackFriday", "ChristmasRunup", "Christmas", "NewYearEve", "July4", "SuperBowl")
EVENT_MULTIPLIERS = {"ThanksgivingRunup": 1.9, "Thanksgiving": 0.55, "BlackFriday": 1.45, "ChristmasRunup": 1.8, "Christmas": 0.05, "NewYearEve": 1.3, "July4": 1.35, "SuperBowl": 1.5}


def event_of(d: Column) -> Column:
    """Name of the event on a date, or 'none'; no two events share a day. It follows from the date, so no day looks at others."""
    month, day = F.month(d), F.dayofmonth(d)
    november = F.make_date(F.year(d), F.lit(11), F.lit(1))
    thanks = F.date_add(november, F.pmod(F.lit(3) - weekday(november), F.lit(7)) + 21)
    return (
        F.when((d >= F.date_sub(thanks, 6)) & (d < thanks), "ThanksgivingRunup")
        .when(d == thanks, "Thanksgiving")
        .when(d == F.date_add(thanks, 1), "BlackFriday")
        .when((month == 12) & day.between(18, 24), "ChristmasRunup")
        .when((month == 12) & (day == 25), "Christmas")
        .when((month == 12) & (day == 31), "NewYearEve")
        .when((month == 7) & (day == 4), "July4")
        .when((month == 2) & (weekday(d) == 6) & (day <= 7), "SuperBowl")
        .otherwise("none")
    )


def calendar(days: DataFrame) -> DataFrame:
    """date, dow, doy, year, month, day, event, event_mult of a table of dates."""
    d = F.col("date")
    named = days.select(d, weekday(d).alias("dow"), F.dayofyear(d).alias("doy"), F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), event_of(d).alias("event"))
    multiplier = F.coalesce(*[F.when(F.col("event") == e, F.lit(m)) for e, m in EVENT_MULTIPLIERS.items()], F.lit(1.0))
    return named.withColumn("event_mult", multiplier)


def week_end(date: Column) -> Column:
    """The Sunday that ends a Monday-to-Sunday week."""
    return F.date_add(F.date_trunc("week", date).cast("date"), 6)


def weekly(sales: DataFrame, *keys: str) -> DataFrame:
    """Per series and week: units, mean price, promo share, ISO week of the week's Sunday and log price (floored at 0.01)."""
    price = F.col("revenue") / F.nullif("units", F.lit(0.0))
    week = sales.groupBy(*keys, week_end(F.col("date")).alias("week")).agg(F.sum("units").alias("units"), F.avg(price).alias("price"), F.avg(F.col("promo").cast("double")).alias("promo"))
    return week.withColumn("woy", F.weekofyear("week")).withColumn("log_p", F.ln(F.greatest("price", F.lit(0.01))))


def weekly_days(days: DataFrame, *keys: str) -> DataFrame:
    """Per series and week units, mean price and promo share, from daily() of these keys or finer ones."""
    price, promo = day_means()
    return days.groupBy(*keys, week_end(F.col("date")).alias("week")).agg(F.sum("y").alias("units"), price.alias("price"), promo.alias("promo"))
