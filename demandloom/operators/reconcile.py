"""Reconciliation over the hierarchy as an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.sources.store import written


def residual_tail(residuals: DataFrame, value: str, length: int, *keys: str) -> DataFrame:
    """(keys, tail): the last `length` values of each series in date order, zeros in front of a shorter one."""
    rows = residuals.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("date", F.col(value).alias("v")))), lambda x: x["v"]).alias("all"))
    kept = F.slice("all", F.greatest(F.size("all") - length + 1, F.lit(1)), F.least(F.size("all"), F.lit(length)))
    return rows.select(*keys, F.concat(F.array_repeat(F.lit(0.0), F.greatest(length - F.size("all"), F.lit(0))), kept).alias("tail"))


def edges(bottom: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The summing matrix as rows (level, key, bkey): which bottom series belong to which node. bottom has the level columns and bkey."""
    from demandloom.operators.panel import series_keys

    return bottom.select("bkey", F.explode(series_keys(levels)).alias("s")).select("s.level", "s.key", "bkey").distinct()


def bottom_up(edge: DataFrame, bottom: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """(level, key, by..., value): sums of the bottom rows (bkey, by..., value)."""
    return edge.join(bottom, "bkey").groupBy("level", "key", *by).agg(F.sum(value).alias(value))


def coherence_error(summed: DataFrame, forecasts: DataFrame, *by: str) -> DataFrame:
    """Largest absolute gap between forecasts (level, key, by..., value) and the sums of their bottom rows."""
    met = forecasts.withColumnRenamed("value", "own").join(summed, ["level", "key", *by])
    return met.agg(F.max(F.abs(F.col("own") - F.col("value"))).alias("violation"))


def proportions(history: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent, share): a child's part of its parent's whole history; equal parts if the parent sold nothing."""
    from pyspark.sql import Window

    w = Window.partitionBy(parent)
    per = history.groupBy(child, parent).agg(F.sum("y").alias("y"))
    return per.select(child, parent, F.coalesce(F.try_divide(F.col("y"), F.nullif(F.sum("y").over(w), F.lit(0.0))), 1.0 / F.count("*").over(w)).alias("share"))


def middle_out(parents: DataFrame, shares: DataFrame, parent: str) -> DataFrame:
    """Parent forecasts (parent, ..., value) shared out by proportions: (child, ..., value)."""
    return parents.join(shares, parent).withColumn("value", F.col("value") * F.col("share")).drop("share")


def mint_two_level(top: DataFrame, children: DataFrame, *by: str) -> DataFrame:
    """Minimum trace over a total and its children with diagonal weights, in closed form.

    top: (by..., value, w); children: (key, by..., value, w). The gap between the total and the children's sum is
    shared in proportion to the variances; the reconciled total is the children's new sum. Returns (key, by..., value).
    """
    sums = children.groupBy(*by).agg(F.sum("value").alias("s"), F.sum("w").alias("sw"))
    gap = top.withColumnRenamed("value", "v0").withColumnRenamed("w", "w0").join(sums, list(by)).select(*by, ((F.col("v0") - F.col("s")) / (F.col("w0") + F.col("sw"))).alias("step"))
    new = children.join(gap, list(by)).select("key", *by, (F.col("value") + F.col("w") * F.col("step")).alias("value"))
    return new.unionByName(new.groupBy(*by).agg(F.sum("value").alias("value")).withColumn("key", F.lit("TOTAL")))


def tree(bottom: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(level, key, up_key, leaf): every node of a hierarchy whose levels nest, with its parent on the level before (null at the top)."""
    from demandloom.operators.panel import series_keys

    path = bottom.select(series_keys(levels).alias("s"))

    def node(x, i):
        up = F.when(i > 0, F.get("s", i - 1)["key"])
        return F.struct(x["level"].alias("level"), x["key"].alias("key"), up.alias("up_key"), (i == F.size("s") - 1).alias("leaf"))

    pairs = F.transform("s", node)
    return path.select(F.explode(pairs).alias("n")).select("n.*").distinct()


def sum_up(bottom: DataFrame, nodes: DataFrame, levels: tuple[str, ...], *by: str) -> DataFrame:
    """(level, key, by..., value): bottom rows (key, by..., value) of the last level summed level by level up a tree()."""
    at = written(bottom.select("key", *by, "value"), "sum-up")
    out = at.withColumn("level", F.lit(levels[-1]))
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        parent = nodes.where(F.col("level") == below).select("key", "up_key")
        at = written(at.join(parent, "key").groupBy(F.col("up_key").alias("key"), *by).agg(F.sum("value").alias("value")), "sum-up")
        out = out.unionByName(at.withColumn("level", F.lit(level)))
    return out.select("level", "key", *by, "value")


def sweep(rows: DataFrame, nodes: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(run, level, key, col, value): minimum trace with one variance per node, in one sweep up the tree and one down.

    rows: (run, level, key, col, value, w), complete for every run and col; nodes: tree(). On the way up each node's own
    value is weighed against the sum of its children's by their variances; on the way down what a parent gained over its
    children's sum is shared out in proportion to their variances. Work and shuffles are linear in the rows.
    """
    by = ["run", "key", "col"]
    own = written(rows.join(nodes, ["level", "key"]), "sweep-rows")
    at = lambda level: own.where(F.col("level") == level)
    up: dict[str, DataFrame] = {levels[-1]: at(levels[-1]).select(*by, "up_key", "value", "w")}
    sums: dict[str, DataFrame] = {}
    for level, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        kids = up[below].groupBy("run", F.col("up_key").alias("key"), "col").agg(F.sum("value").alias("m"), F.sum("w").alias("v"))
        met = written(at(level).join(kids, by), "sweep-up")
        sums[level] = met.select(*by, "m", "v")
        both = F.col("w") + F.col("v")
        up[level] = met.select(*by, "up_key", ((F.col("value") * F.col("v") + F.col("m") * F.col("w")) / both).alias("value"), (F.col("w") * F.col("v") / both).alias("w"))
    down = up[levels[0]].select(*by, "value")
    out = down.withColumn("level", F.lit(levels[0]))
    for level, below in zip(levels, levels[1:], strict=False):
        gain = down.join(sums[level], by).select("run", F.col("key").alias("up_key"), "col", ((F.col("value") - F.col("m")) / F.col("v")).alias("step"))
        down = written(up[below].join(gain, ["run", "up_key", "col"]).select(*by, (F.col("value") + F.col("w") * F.col("step")).alias("value")), "sweep-down")
        out = out.unionByName(down.withColumn("level", F.lit(below)))
    return out.select("run", "level", "key", "col", "value")


#: The ridge of the shrunk covariance, by its mean variance, and the smallest variance of the diagonal one.
RIDGE, LEAST_VARIANCE = 1e-6, 1e-6


def shrinkage(tails: DataFrame, length: int) -> tuple[float, float, int]:
    """(weight of the diagonal, mean variance, series) of the shrunk covariance of residual tails of one length.

    The published weight reduces to the spread of the off-diagonal correlations relative to their size. The sums of all
    correlations and of their squares follow from two sums over the series: of the standardised residuals by day, and of
    their products by pair of days. So the matrix of all pairs of series is never formed.
    """
    import pandas as pd

    def run(batches):
        total = np.zeros(length * length + length + 3)
        for pdf in batches:
            r = np.array(pdf["tail"].to_list(), float).reshape(-1, length)
            r = r - r.mean(1, keepdims=True)
            var = (r**2).sum(1) / max(length - 1, 1)
            z = np.where(var[:, None] > 0, r / np.sqrt(np.where(var > 0, var, 1.0))[:, None], 0.0)
            total += np.concatenate(((z.T @ z).ravel(), z.sum(0), [len(r), (var > 0).sum(), var.sum()]))
        yield pd.DataFrame({"at": np.arange(len(total)), "value": total})

    got = tails.select("tail").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas().sort_values("at")["value"].to_numpy()
    gram, summed, (n, some, var) = got[: length**2], got[length**2 : -3], got[-3:]
    if n < 2:
        return 1.0, float(var / max(n, 1)), int(n)
    pairs = n * (n - 1)
    mean, square = ((summed**2).sum() / (length - 1) - some) / pairs, ((gram**2).sum() / (length - 1) ** 2 - some) / pairs
    weight = 1.0 if square <= 1e-15 else float(np.clip(1 - mean**2 / square, 0.05, 1.0))
    return weight, float(var / n), int(n)


def mint(base: DataFrame, nodes: DataFrame, tails: DataFrame, levels: tuple[str, ...], methods: tuple[str, ...] = ("ols", "wls", "shrink"), length: int = 180) -> DataFrame:
    """(method, level, key, h, value): base (level, key, h, value) reconciled by minimum trace, for a tree of any size.

    nodes: tree(); tails: (level, key, tail) residuals of `length` days of every node. ols weighs all nodes alike, wls by
    the variance of their residuals: one sweep each. shrink adds to a diagonal the residuals themselves as that many common
    factors: the sweep of the diagonal takes the factors along as further columns, sums over the nodes give the equations
    of the factors' scores, and these, a matrix of days by days, are all that reaches the driver.
    """
    import pandas as pd

    centred = F.transform("tail", lambda x: x - F.aggregate("tail", F.lit(0.0), lambda a, v: a + v) / length)
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    node = written(tails.select("level", "key", centred.alias("r")).withColumn("ss", square("r")), "mint-nodes")
    rows = None
    for method in methods:
        factors = None
        if method == "ols":
            weighed = node.select("level", "key", F.lit(1.0).alias("w"))
        elif method == "wls":
            weighed = node.select("level", "key", F.when(F.col("ss") > 0, F.col("ss") / length).otherwise(LEAST_VARIANCE).alias("w"))
        else:
            weight, variance, _ = shrinkage(tails, length)
            ridge = max(RIDGE * variance, 1e-12)
            weighed = node.select("level", "key", (weight * F.col("ss") / max(length - 1, 1) + ridge).alias("w"))
            scale = float(np.sqrt((1 - weight) / max(length - 1, 1)))
            if scale > 0:
                factors = node.select("level", "key", F.posexplode("r").alias("d", "v")).select("level", "key", (-1 - F.col("d")).alias("col"), (F.col("v") * scale).alias("value"))
        columns = base.select("level", "key", F.col("h").cast("int").alias("col"), "value")
        columns = columns if factors is None else columns.unionByName(factors)
        run = columns.join(weighed, ["level", "key"]).withColumn("run", F.lit(method))
        rows = run if rows is None else rows.unionByName(run)
    rows = written(rows, "mint-rows")
    swept = written(sweep(rows, nodes, levels), "mint-swept")
    plain = swept.where("run != 'shrink' AND col > 0")
    out = plain.select(F.col("run").alias("method"), "level", "key", F.col("col").alias("h"), "value")
    if "shrink" not in methods:
        return out
    pair = F.struct("col", F.col("own.value").alias("f"), F.col("swept.value").alias("p"))
    met = rows.where("run = 'shrink'").alias("own").join(swept.where("run = 'shrink'").alias("swept"), ["level", "key", "col"])
    per = met.groupBy("level", "key").agg(F.first("w").alias("w"), F.sort_array(F.collect_list(pair)).alias("c"))
    wide = written(per.select("level", "key", "w", *[F.col(f"c.{c}").alias(c) for c in ("col", "f", "p")]), "mint-wide")
    some = wide.select("col").first()
    cols = np.array(some["col"] if some else [], int)
    factor, days = np.flatnonzero(cols < 0), np.flatnonzero(cols > 0)

    def products(batches):
        total = np.zeros((len(factor), len(cols)))
        for pdf in batches:
            f, p = (np.array(pdf[c].to_list(), float).reshape(-1, len(cols)) for c in ("f", "p"))
            total += f[:, factor].T @ ((f - p) / pdf["w"].to_numpy()[:, None])
        yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})

    added = wide.mapInPandas(products, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    k = np.zeros(len(factor) * len(cols))
    k[added["at"].to_numpy()] = added["value"].to_numpy()
    k = k.reshape(len(factor), len(cols))
    scores = np.linalg.solve(np.eye(len(factor)) + k[:, factor], k[:, days]) if len(factor) else np.zeros((0, len(days)))

    def combined(batches):
        for pdf in batches:
            p = np.array(pdf["p"].to_list(), float).reshape(-1, len(cols))
            value = p[:, days] - p[:, factor] @ scores
            level, key = (np.repeat(pdf[c].to_numpy(), len(days)) for c in ("level", "key"))
            yield pd.DataFrame({"method": "shrink", "level": level, "key": key, "h": np.tile(cols[days], len(pdf)).astype(np.int32), "value": value.ravel()})

    return out.unionByName(wide.mapInPandas(combined, "method string, level string, key string, h int, value double"))
