"""Scaling-law analytics: best run of a budget, power-law fits, extrapolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_runs(runs: DataFrame) -> DataFrame:
    """``compute_budget, n_opt, loss, d_opt``: least loss of each budget (fewest parameters on ties); D = C / 6N."""
    best = runs.groupBy("compute_budget").agg(F.min(F.struct("final_loss", "parameters")).alias("x"))
    return best.select("compute_budget", F.col("x.parameters").alias("n_opt"), F.col("x.final_loss").alias("loss"), (F.col("compute_budget") / (6.0 * F.col("x.parameters"))).alias("d_opt"))


def power_law_fit(points: DataFrame, x: str, y: str) -> DataFrame:
    """``k, a`` of y = k * x**a by least squares on logarithms; only positive points count."""
    ok = points.where((F.col(x) > 0) & (F.col(y) > 0))
    return ok.agg(F.exp(F.regr_intercept(F.log(y), F.log(x))).alias("k"), F.regr_slope(F.log(y), F.log(x)).alias("a"))


def power_law(k: Column, a: Column, c: Column) -> Column:
    return k * F.pow(c, a)


def logspace(spark, low: float, high: float, n: int) -> DataFrame:
    """``i, c``: n points from 10**low to 10**high."""
    return spark.range(n).select(F.col("id").alias("i"), F.pow(F.lit(10.0), F.lit(low) + F.col("id") * ((high - low) / max(1, n - 1))).alias("c"))
