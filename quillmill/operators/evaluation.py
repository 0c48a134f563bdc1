"""Evaluation and rollout analytics over reward columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eval_metrics(scored: DataFrame) -> DataFrame:
    """n, format_rate, answer_accuracy, reward_mean; 0 for no rows."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return scored.agg(F.count("*").alias("n"), mean("format_reward").alias("format_rate"), mean("answer_reward").alias("answer_accuracy"), mean("reward").alias("reward_mean"))


def contingency(scored: DataFrame) -> DataFrame:
    """Four rows ``format_ok, answer_ok, n``, zero cells included."""
    f, a = F.col("format_reward") >= 0.5, F.col("answer_reward") >= 0.5
    cells = scored.agg(*[F.count(F.when((f == bool(i)) & (a == bool(j)), 1)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)])
    return cells.select(F.inline(F.array(*[F.struct(F.lit(i).alias("format_ok"), F.lit(j).alias("answer_ok"), F.col(f"c{i}{j}").alias("n")) for i in (0, 1) for j in (0, 1)])))


def group_advantages(rollouts: DataFrame, group: str = "group_id", reward: str = "reward", eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Adds ``advantage``: reward less its group's mean, over the sample deviation plus eps; null in groups of one."""
    w = Window.partitionBy(group)
    centred = F.col(reward) - F.avg(reward).over(w)
    return rollouts.withColumn("advantage", centred / (F.stddev_samp(reward).over(w) + eps) if by_std else centred)


def reward_metadata(rollouts: DataFrame, group: str = "group_id", reward: str = "reward") -> DataFrame:
    """Raw and per-group statistics in one row."""
    groups = rollouts.groupBy(group).agg(
        F.avg(reward).alias("m"), F.stddev_pop(reward).alias("s"), F.stddev_samp(reward).alias("ss"), F.count(reward).alias("n"),
        F.sum(reward).alias("t"), F.sum(F.col(reward) * F.col(reward)).alias("q"), F.min(reward).alias("lo"), F.max(reward).alias("hi"),
    )
    mean = F.sum("t") / F.sum("n")
    return groups.agg(
        mean.alias("reward_mean"), F.sqrt(F.greatest(F.sum("q") / F.sum("n") - mean * mean, F.lit(0.0))).alias("reward_std"), F.min("lo").alias("reward_min"), F.max("hi").alias("reward_max"),
        F.avg("m").alias("group_mean_mean"), F.stddev_pop("m").alias("group_mean_std"), F.avg("s").alias("group_std_mean"),
        F.count(F.when(F.col("ss") == 0, 1)).alias("zero_std_groups"), F.count("*").alias("n_groups"),
    )


def generation_stats(log: DataFrame) -> DataFrame:
    """Counts, mean lengths (all, correct, incorrect) and mean entropy without NaN, from length, is_correct, entropy."""
    ok = F.col("is_correct")
    return log.agg(
        F.count("*").alias("n"), F.count(F.when(ok, 1)).alias("n_correct"), F.count(F.when(~ok, 1)).alias("n_incorrect"),
        F.avg("length").alias("avg_length"), F.avg(F.when(ok, F.col("length"))).alias("avg_length_correct"), F.avg(F.when(~ok, F.col("length"))).alias("avg_length_incorrect"),
        F.avg(F.when(~F.isnan("entropy"), F.col("entropy"))).alias("avg_entropy"),
    )


def correctness(is_correct: Column, answer_reward: Column, response: Column, truth: Column) -> Column:
    """Falls back from the flag to the reward to equality of the trimmed texts."""
    return F.coalesce(is_correct, answer_reward > 0, F.trim(response) == F.trim(truth))


def microbatch_loss(tokens: DataFrame, accumulation: int, constant: float | None = None) -> DataFrame:
    """Forward loss of a micro-batch from ``row_id, loss, mask``: masked mean (or sum over ``constant``) a row, batch mean, over the accumulation steps."""
    total = F.sum(F.col("loss") * F.col("mask"))
    rows = tokens.groupBy("row_id").agg((F.try_divide(total, F.sum("mask")) if constant is None else total / constant).alias("x"))
    return rows.agg((F.avg("x") / accumulation).alias("loss"))


def top_p(logits: DataFrame, group: str, token: str, logit: str, p: float, temperature: float = 1.0) -> DataFrame:
    """Tokens of the nucleus with their probabilities: the first token over ``p`` is kept."""
    w = Window.partitionBy(group)
    z = F.exp((F.col(logit) - F.max(logit).over(w)) / temperature)
    probs = logits.withColumn("_z", z).withColumn("prob", F.col("_z") / F.sum("_z").over(w)).drop("_z")
    order = Window.partitionBy(group).orderBy(F.desc("prob"), token).rowsBetween(Window.unboundedPreceding, 0)
    return probs.withColumn("_c", F.sum("prob").over(order)).where(F.col("_c") - F.col("prob") <= p).drop("_c")


def top_k(logits: DataFrame, group: str, token: str, logit: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.desc(logit), token)
    return logits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
