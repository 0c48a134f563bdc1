"""Answer extraction and rewards as columns: native where a regular expression will do, Arrow batches for grading."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmill.functions import answers

REWARD = T.StructType([T.StructField(c, T.DoubleType()) for c in ("format_reward", "answer_reward", "reward")])


def reward_udf(reward: Callable[[str, object], dict[str, float]]):
    """A vectorised column function of (response, truth) from a plain reward function."""

    @F.pandas_udf(REWARD)
    def apply(response: pd.Series, truth: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([reward(r, t) for r, t in zip(response, truth, strict=True)], columns=["format_reward", "answer_reward", "reward"])

    return apply


think_answer_reward = reward_udf(answers.think_answer_reward)
boxed_reward = reward_udf(answers.boxed_reward)


@F.pandas_udf(T.StringType())
def boxed_answer(text: pd.Series) -> pd.Series:
    return text.map(answers.boxed_answer)


@F.pandas_udf(T.StringType())
def normalize_latex(text: pd.Series) -> pd.Series:
    return text.map(answers.normalize_latex)


@F.pandas_udf(T.BooleanType())
def repeatness(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else answers.repeatness(t))


def register(spark) -> None:
    """Make the graders callable from SQL text."""
    for name, f in (("think_answer_reward", think_answer_reward), ("boxed_reward", boxed_reward), ("boxed_answer", boxed_answer), ("normalize_latex", normalize_latex), ("repeatness", repeatness)):
        spark.udf.register(name, f)


_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"


def answer_tag(response: Column) -> Column:
    """First ``<answer>...</answer>``, any case, trimmed; empty without one."""
    return F.regexp_extract(response, r"(?is)<answer>\s*(.*?)\s*</answer>", 1)


def format_ok(response: Column) -> Column:
    return response.contains("</think> <answer>") & response.contains("</answer>")


def last_number(text: Column) -> Column:
    """Last number, thousands' commas off; null without one."""
    return F.replace(F.try_element_at(F.regexp_extract_all(text, F.lit(_NUMBER), 0), F.lit(-1)), F.lit(","), F.lit(""))


def gsm8k_gold(text: Column) -> Column:
    """What follows ``####``, else the last number; commas off."""
    marked = F.regexp_extract(text, r"####\s*([^\n]+)", 1)
    return F.when(marked != "", F.trim(F.replace(marked, F.lit(","), F.lit("")))).otherwise(last_number(text))


def mmlu_letter(text: Column) -> Column:
    """The answer letter A to D, from an explicit statement or a lone letter; null without one."""
    stated = F.regexp_extract(text, r"(?i:answer\s*(?:is|:)?)\s*\(?([ABCD])\b", 1)
    lone = F.regexp_extract(text, r"(?:^|[\s(])([ABCD])(?:[).:]|\s*$)", 1)
    return F.nullif(F.when(stated != "", stated).otherwise(lone), F.lit(""))


def safe(response: Column) -> Column:
    """0 if the judge says true (unsafe), else 1."""
    return F.when(F.lower(F.regexp_replace(response, r"^\s+", "")).startswith("true"), 0).otherwise(1)


def toxic_score(label: Column, score: Column) -> Column:
    """Score of the positive class whatever the label's polarity."""
    plain = F.lower(label)
    negative = plain.rlike("non|not|clean|safe|neutral")
    return F.when(negative, 1 - score).otherwise(score)


def dpo_loss(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float) -> Column:
    """-ln(sigmoid(beta * margin)), stable for large margins."""
    margin = F.lit(beta) * ((chosen - ref_chosen) - (rejected - ref_rejected))
    return F.greatest(-margin, F.lit(0.0)) + F.log1p(F.exp(-F.abs(margin)))


def policy_gradient_loss(kind: str, log_prob: Column, old_log_prob: Column | None = None, advantage: Column | None = None, cliprange: float = 0.2) -> Column:
    """Loss of a token: no_baseline and reinforce_with_baseline -A*logp; grpo_clip and grpo_no_clip by ratio."""
    if kind in ("no_baseline", "reinforce_with_baseline"):
        return -advantage * log_prob
    ratio = F.exp(log_prob - old_log_prob)
    if kind == "grpo_no_clip":
        return -ratio * advantage
    if kind == "grpo_clip":
        return -F.least(ratio * advantage, F.greatest(F.least(ratio, F.lit(1 + cliprange)), F.lit(1 - cliprange)) * advantage)
    raise ValueError(f"unknown loss {kind}")


def is_clipped(log_prob: Column, old_log_prob: Column, advantage: Column, cliprange: float = 0.2) -> Column:
    ratio = F.exp(log_prob - old_log_prob)
    held = F.greatest(F.least(ratio, F.lit(1 + cliprange)), F.lit(1 - cliprange))
    return held * advantage < ratio * advantage
