"""Sparse symmetric systems by conjugate gradients, on tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.operators.lineage import checkpoint

#: Entries of a system (24 bytes each) up to which it is solved in one place; beyond, every product is a join and a sum in Spark.
HELD = 1_000_000


def conjugate_gradient(entries: DataFrame, right: DataFrame, tolerance: float = 1e-9, rounds: int = 500, held: int = HELD) -> DataFrame:
    """(i, x) of the system with entries (i, j, a), both triangles and a positive diagonal, and right side (i, b).

    Preconditioned by the diagonal; ends when the residual has shrunk by the tolerance. Both ways do the same rounds. No row
    of the system is ever dense: a round costs as much as the entries.
    """
    entries = checkpoint(entries.groupBy("i", "j").agg(F.sum("a").alias("a")))
    right = right.groupBy("i").agg(F.sum("b").alias("b"))
    if entries.count() <= held:
        return _here(entries, right, tolerance, rounds)
    start = entries.where("i = j").select("i", F.col("a").alias("d")).join(right, "i", "left")
    state = checkpoint(start.select("i", "d", F.lit(0.0).alias("x"), F.coalesce("b", F.lit(0.0)).alias("r")).withColumn("p", F.col("r") / F.col("d")))
    first = now = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0] or 0.0
    for _ in range(rounds):
        if now <= tolerance**2 * first:
            break
        product = entries.join(state.select(F.col("i").alias("j"), "p"), "j").groupBy("i").agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        state = checkpoint(state.join(product, "i"))
        step = now / state.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        state = state.withColumns({"x": F.col("x") + step * F.col("p"), "r": F.col("r") - step * F.col("q")})
        later = state.agg(F.sum(F.col("r") * F.col("r") / F.col("d"))).first()[0]  # of the residual itself: differences of sums would lose it
        state = state.withColumn("p", F.col("r") / F.col("d") + later / now * F.col("p")).drop("q")
        now = later
    return checkpoint(state.select("i", "x"))


def _here(entries: DataFrame, right: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    spark, kind = entries.sparkSession, entries.schema["i"].dataType
    rows = entries.collect()
    names = list(dict.fromkeys(e["i"] for e in rows))
    at = {n: k for k, n in enumerate(names)}
    i, j = (np.array([at[e[c]] for e in rows], np.int64) for c in ("i", "j"))
    a, b = np.array([e["a"] for e in rows], float), np.zeros(len(names))
    for e in right.collect():  # a row for each of the unknowns at most
        if e["i"] in at:
            b[at[e["i"]]] = e["b"]
    d = np.bincount(i[i == j], a[i == j], len(names)) if len(names) else np.zeros(0)
    x, r = np.zeros(len(names)), b
    p = r / d if len(names) else r
    now = first = float((r * r / d).sum()) if len(names) else 0.0
    for _ in range(rounds):
        if now <= tolerance**2 * first:
            break
        q = np.bincount(i, a * p[j], len(names))
        step = now / float(p @ q)
        x, r = x + step * p, r - step * q
        later = float((r * r / d).sum())
        p, now = r / d + later / now * p, later
    from pyspark.sql import types as T

    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, x, strict=True)], T.StructType().add("i", kind).add("x", T.DoubleType()))
