"""Symmetric positive definite systems as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import stored


def solved(matrix: DataFrame, right: DataFrame, by: list[str], tolerance: float = 1e-12, rounds: int = 1000) -> DataFrame:
    """by, i and x with matrix x = right in each group, by conjugate gradients with the diagonal as preconditioner.

    matrix: by, i, j, v (each entry once, both halves); right: by, i, v, with a row for each i. A round multiplies the
    matrix by one vector, a join on j and a sum by i, so a task holds neither matrix nor vector; its vectors are written to
    the shared folder. Groups stop by themselves once their residual is `tolerance` times the right side. A group that
    is not done after `rounds` is an error.
    """
    matrix = stored(matrix, "matrix")
    diagonal = matrix.where("i = j").select(*by, "i", F.col("v").alias("d"))
    state = right.join(diagonal, [*by, "i"]).select(*by, "i", "d", F.lit(0.0).alias("x"), F.col("v").alias("r"), (F.col("v") / F.col("d")).alias("p"))
    state = stored(state, "gradients")
    limits = stored(state.groupBy(*by).agg((F.sum(F.col("r") * F.col("r")) * tolerance**2).alias("least")), "limits")
    done = None
    for _ in range(rounds):
        size = state.groupBy(*by).agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("r") / F.col("d")).alias("rz")).join(limits, by)
        ended = state.join(size.where("rr <= least").select(*by), by, "left_semi").select(*by, "i", "x")
        done = ended if done is None else done.unionByName(ended)
        open_ = state.join(size.where("rr > least").select(*by, "rz"), by)
        if open_.isEmpty():
            return done
        moved = matrix.join(open_.select(*by, F.col("i").alias("j"), F.col("p").alias("pj")), [*by, "j"]).groupBy(*by, "i").agg(F.sum(F.col("v") * F.col("pj")).alias("q"))
        step = open_.join(moved, [*by, "i"])
        alpha = step.groupBy(*by).agg((F.first("rz") / F.sum(F.col("p") * F.col("q"))).alias("alpha"))
        step = step.join(alpha, by).withColumns({"x": F.col("x") + F.col("alpha") * F.col("p"), "r": F.col("r") - F.col("alpha") * F.col("q")})
        step = stored(step.select(*by, "i", "d", "x", "r", "p", "rz"), "gradients")
        beta = step.groupBy(*by).agg((F.sum(F.col("r") * F.col("r") / F.col("d")) / F.first("rz")).alias("beta"))
        state = stored(step.join(beta, by).select(*by, "i", "d", "x", "r", (F.col("r") / F.col("d") + F.col("beta") * F.col("p")).alias("p")), "gradients")
    raise RuntimeError(f"a system is not solved after {rounds} rounds")
