"""Exact order statistics of groups of any size, by narrowing ranges: no group is ever held, or sorted, in one place.

A rank is first known to lie between its group's smallest and largest value. Each pass counts, combined before the
shuffle, the values of every open range in a fixed number of equal parts, and keeps of each range the part with the rank.
A range that has become one value is the answer. A pass narrows by the number of parts, so a few passes are enough.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.sources.store import written

PARTS = 1024
#: A range of doubles that is narrowed by PARTS each time is one value after fewer passes than this.
MOST_PASSES = 120


def ranked(rows: DataFrame, value: str, ranks: DataFrame, *by: str) -> DataFrame:
    """(by..., rank, value): the value of each (by..., rank), from 0, among the rows of its group; nulls and NaN take no part.

    Ranks outside a group have no row. Groups without by: pass no names. Few ranks per group are asked for.
    """
    kept = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("v"))
    kept = written(kept, "selection-rows")
    whole = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    met = ranks.join(whole, list(by)) if by else ranks.crossJoin(F.broadcast(whole))
    open_ = written(met.where((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("before")), "selection")
    done = open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("value"))
    for _ in range(MOST_PASSES):
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            return done
        spans = open_.select(*by, "lo", "hi").distinct()
        inside = kept.join(spans, list(by)) if by else kept.crossJoin(F.broadcast(spans))
        # halves, so that the width of a range of very large values stays finite
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1))
        counted = inside.where("v >= lo AND v <= hi").groupBy(*by, "lo", "hi", part.alias("part")).agg(F.count("*").alias("k"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("k").over(Window.partitionBy(*by, "lo", "hi").orderBy("part"))
        placed = counted.withColumn("upto", upto)
        found = open_.join(placed, [*by, "lo", "hi"]).where((F.col("rank") - F.col("before") < F.col("upto")) & (F.col("rank") - F.col("before") >= F.col("upto") - F.col("k")))
        open_ = written(found.select(*by, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("upto") - F.col("k")).alias("before")), "selection")
        done = done.unionByName(open_.where("lo = hi").select(*by, "rank", F.col("lo").alias("value")))
    raise RuntimeError("selection did not settle")


def quantiles(rows: DataFrame, value: str, taus: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., q): interpolated quantiles of each group in the order of taus, exact; a group without values has no row."""
    sizes = written(rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"), "selection-sizes")
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(t) * (F.col("n") - 1)).alias("p")) for i, t in enumerate(taus)])).alias("x")
    asked = sizes.select(*by, places).select(*by, "x.i", "x.p", F.explode(F.array_distinct(F.array(F.floor("x.p"), F.ceil("x.p")))).alias("rank"))
    found = asked.join(ranked(rows, value, asked.select(*by, "rank").distinct(), *by), [*by, "rank"])
    weight = F.when(F.floor("p") == F.ceil("p"), 1.0).when(F.col("rank") == F.floor("p"), F.ceil("p") - F.col("p")).otherwise(F.col("p") - F.floor("p"))
    per = found.groupBy(*by, "i").agg(F.sum(weight * F.col("value")).alias("q"))
    return per.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


def smallest(rows: DataFrame, draw: str, k: int, *ties: str) -> DataFrame:
    """Exactly the k rows (all, if fewer) of the smallest draw, a column of doubles; equal draws by ties, which tell rows apart."""
    # the rows are asked for their draws, for how many lie below, and for themselves: what makes them runs once
    rows = written(rows, "selection-of") if k > 0 else rows
    edge = ranked(rows, draw, rows.sparkSession.createDataFrame([(k - 1,)], "rank long")).select(F.col("value").alias("edge"))
    cut = edge.first() if k > 0 else None
    if cut is None:
        return rows if k > 0 else rows.limit(0)
    below = rows.where(F.col(draw) < F.lit(cut["edge"]))
    at = rows.where(F.col(draw) == F.lit(cut["edge"]))
    return below.unionByName(at.orderBy(*ties).limit(k - below.count()))
