"""Connected components of an edge table, without collecting it: alternating large-star and small-star steps.

Each step replaces a node's edges by edges to the smallest node it knows (Kiveris et al., Connected Components in
MapReduce and Beyond, 2014). The minima are sums with map-side combine; they are written before they are joined back,
and the edges of nodes with very many of them are not shuffled for that join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import durable, spread_join

MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b longs): the smallest node that it reaches, itself included.

    Loops and repeated edges change nothing; null ends are ignored; no edges give no rows.
    """
    e = durable(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _is_star(e):
            return e.select(F.col("v").alias("node"), F.col("m").alias("component")).union(e.select(F.col("m").alias("node"), F.col("m").alias("component"))).distinct()
        e = _small_star(_large_star(e))
    raise RuntimeError("components did not settle")


def _is_star(e: DataFrame) -> bool:
    """Each node has one edge to a smaller one, and no such target has one itself."""
    if e.count() != e.select("v").distinct().count():
        return False
    return e.select("m").distinct().join(e.select(F.col("v").alias("m")), "m", "left_semi").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("v").alias("u"), F.col("m").alias("w")).union(e.select(F.col("m").alias("u"), F.col("v").alias("w")))
    least = durable(both.groupBy("u").agg(F.min("w").alias("w"), F.count("*").alias("n")).select("u", F.least("u", "w").alias("least"), "n"), "edges-min")
    return durable(spread_join(both, least, ["u"], "n").where("w > u AND w != least").select(F.col("w").alias("v"), F.col("least").alias("m")).distinct(), "edges-large")


def _small_star(e: DataFrame) -> DataFrame:
    least = durable(e.groupBy("v").agg(F.min("m").alias("least"), F.count("*").alias("n")), "edges-min")
    met = spread_join(e, least, ["v"], "n")
    pairs = F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("least").alias("m")), F.struct(F.col("m").alias("v"), F.col("least").alias("m")))).alias("e")
    return durable(met.select(pairs).select("e.v", "e.m").where("v != m").distinct(), "edges-small")
