"""Model selection with a bias screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIAS_LIMIT = 0.15


def method_sums(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., method, abs_err, err, actual, n): what every score at these keys or above them is made of."""
    e = F.col("yhat") - F.col("y")
    return rows.groupBy(*by, "method").agg(F.sum(F.abs(e)).alias("abs_err"), F.sum(e).alias("err"), F.sum(F.abs("y")).alias("actual"), F.count("*").alias("n"))


def score_methods(sums: DataFrame, *by: str) -> DataFrame:
    """(by..., method, wmape, bias, n) from method_sums; a group without sales divides by a floor, so it stays comparable."""
    denominator = F.greatest(F.sum("actual"), F.lit(1e-9))
    return sums.groupBy(*by, "method").agg((F.sum("abs_err") / denominator).alias("wmape"), (F.sum("err") / denominator).alias("bias"), F.sum("n").alias("n"))


def choose(scored: DataFrame, *by: str, limit: float | None = BIAS_LIMIT) -> DataFrame:
    """(by..., method): the lowest WMAPE among methods within the bias limit, else the lowest absolute bias; ties by name.

    limit None leaves the screen out.
    """
    within = F.lit(True) if limit is None else F.abs("bias") <= limit
    order = F.struct(F.when(within, 0).otherwise(1), F.when(within, F.col("wmape")).otherwise(F.abs("bias")), F.col("method"))
    return scored.groupBy(*by).agg(F.min_by("method", order).alias("method"))


def fit_gate(selection: DataFrame, by: Column | str, limit: float | None = BIAS_LIMIT) -> DataFrame:
    """(gate_key, method) from the sums of the selection window; by: the column that decides, or a literal for one gate."""
    rows = selection.withColumn("gate_key", by if isinstance(by, Column) else F.col(by))
    return choose(score_methods(rows, "gate_key"), "gate_key", limit=limit)


def apply_gate(evaluation: DataFrame, gate: DataFrame, by: Column | str, fallback: DataFrame) -> DataFrame:
    """Evaluation sums of each group's chosen method; a group without a choice takes the fallback's (one row: method).

    The fallback is the selection window's global choice: it knows nothing of the evaluation window.
    """
    rows = evaluation.withColumn("gate_key", by if isinstance(by, Column) else F.col(by))
    met = rows.join(gate.withColumnRenamed("method", "chosen"), "gate_key", "left").crossJoin(F.broadcast(fallback.select(F.col("method").alias("otherwise"))))
    return met.where(F.col("method") == F.coalesce("chosen", "otherwise")).drop("chosen", "otherwise", "gate_key")


def compare_gates(selection: DataFrame, evaluation: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(gate, n_decisions, wmape, bias) of each way to group; both sides are method_sums at keys that every gate can use."""
    top = fit_gate(selection, F.lit("all"))
    out = None
    for name, by in gates.items():
        gate = fit_gate(selection, by)
        rows = apply_gate(evaluation, gate, by, top)
        row = score_methods(rows.withColumn("method", F.lit("gate"))).crossJoin(gate.agg(F.count("*").alias("n_decisions"))).select(F.lit(name).alias("gate"), "n_decisions", "wmape", "bias")
        out = row if out is None else out.unionByName(row)
    return out


def champions(selection: DataFrame, limit: float = BIAS_LIMIT, default: str = "seasonal_naive") -> DataFrame:
    """(key, champion, guarded) from method_sums by key: lowest WMAPE by key, and the same among methods within the bias limit.

    A key with no method within the limit keeps its unguarded champion, and one without any the default; none is lost.
    """
    scored = score_methods(selection, "key")
    plain = choose(scored, "key", limit=None).withColumnRenamed("method", "champion")
    guarded = choose(scored.where(F.abs("bias") <= limit), "key", limit=None).withColumnRenamed("method", "guarded")
    return plain.join(guarded, "key", "left").select("key", F.coalesce("champion", F.lit(default)).alias("champion"), F.coalesce("guarded", "champion", F.lit(default)).alias("guarded"))
