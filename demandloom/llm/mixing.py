"""Mixing sources to target weights: token totals, repetition rates, floor(rate) copies plus one Bernoulli copy.

All of it is DataFrame functions. Sources are one row each after a map-side-combined sum, so the two windows that
rank them and fill the targets run over that summary only, never over documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandloom.llm.common import bounded_rows, durable, word_count

#: A source summary of up to this many rows is broadcast; a longer one is joined with salted keys.
BROADCAST_SOURCES = 20_000
SALTS = 64


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0) -> DataFrame:
    """Per source of (source, size): source_size, target and rate.

    Sources in code-point order, null last, take the weights in turn and share the total size in their proportion.
    No target exceeds max_repeat times its source's size; what is cut is shared by weight among the others until
    none exceeds it. In the order of cap / weight the capped sources come first, so one pass of running sums finds
    the level: a source is capped if its cap is at most its share of what the capped ones before it leave over.
    A source without tokens has target and rate 0; an empty table gives no rows.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, everyone = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    filled = (
        weighed.withColumn("left", F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(after))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    )
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    free_size = F.sum("source_size").over(everyone) - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0.0))
    return filled.select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * free_size / free_weight).alias("target"),
    ).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def _with_targets(rows: DataFrame, sized: DataFrame, weights: tuple[float, ...], max_repeat: float, seed: str) -> DataFrame:
    """rows (with doc_id and source) and __mix_size, __mix_target, __mix_copies: of the source the first two, of the row the last."""
    targets = durable(source_targets(sized, weights, max_repeat), "mix-targets")
    named = targets.select(F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_size"), F.col("target").alias("__mix_target"), F.col("rate").alias("__mix_rate"))
    same = F.col("source").eqNullSafe(F.col("__mix_source"))
    if bounded_rows(targets.select("source"), BROADCAST_SOURCES) is not None:
        joined = rows.join(F.broadcast(named), same, "left")
    else:
        salted = named.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__mix_of", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("__mix_of") == F.col("__mix_salt")), "left").drop("__mix_of", "__mix_salt")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("__mix_rate")
    return joined.withColumn("__mix_copies", (whole + (draw < F.col("__mix_rate") - whole).cast("int")).cast("int")).drop("__mix_source", "__mix_rate")


def copy_counts(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies.

    copies is floor(rate) plus 1 with probability rate - floor(rate); the draw is the first 13 hex digits of
    md5(seed:doc_id), so reruns agree and rows that repeat a doc_id draw alike. A null text has size 0; a null
    source is a source; a null doc_id draws as the text 'null'.
    """
    sized = durable(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    met = _with_targets(sized, sized.select("source", "size"), weights, max_repeat, seed)
    return met.select("doc_id", "size", F.col("__mix_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_copies").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), max_repeat: float = 3.0, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as copy_counts says, with the columns of docs, whatever their names."""
    # the columns travel as one, so that none can clash with those added on the way
    packed = docs.select("doc_id", "source", F.struct("*").alias("__mix_row"))
    met = _with_targets(packed, docs.select("source", word_count(F.col("text")).alias("size")), weights, max_repeat, seed)
    return met.where("__mix_copies > 0").select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies")))).select("__mix_row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, size, source_size, target, taken (size times copies), copies."""
    return copy_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
total AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS cap FROM total),
filled AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS everything, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM weighed),
marked AS (SELECT *, cap * weight_left <= weight * rest AS capped FROM filled),
targets AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * (everything - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN weight END) OVER () END AS target FROM marked),
rated AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  list_reduce(list_transform(string_split(substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT), lambda a, b: a * 16 + b)::DOUBLE / 4503599627370496 AS draw
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken, (floor(rate) + (draw < rate - floor(rate))::INT)::INT AS copies FROM rated
"""
