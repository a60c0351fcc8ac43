"""Reward shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(predicted: Column, expected: Column) -> Column:
    """1 for the expected value, else 0."""
    return F.coalesce((predicted == expected).cast("double"), F.lit(0.0))


def graded(predicted: Column, expected: Column, explicit: Column) -> Column:
    """1 for the expected value, up to 0.4 by relative closeness, 0.05 more for an explicit label."""
    scale = F.greatest(F.lit(1), F.abs(expected))
    near = 0.4 * (1.0 / (1.0 + F.abs(predicted - expected) / scale))
    bonus = F.when(explicit, 0.05).otherwise(0.0)
    return F.when(predicted.isNull(), 0.0).when(predicted == expected, 1.0 + bonus).otherwise(near + bonus)


def consistent_only(predicted: Column, expected: Column, consistent: Column) -> Column:
    """1 for the expected value, next to nothing for close ones, 0 for contradictions."""
    near = 0.05 / (1.0 + F.abs(predicted - expected))
    return F.when(predicted.isNull() | ~consistent, 0.0).when(predicted == expected, 1.0).otherwise(near)


def correct_and_format(correct: Column, format_ok: Column, format_weight: float = 0.02) -> Column:
    """Correctness plus a weighted format part; weight 0 leaves correctness alone."""
    return correct.cast("int") * 1.0 + format_ok.cast("int") * F.lit(format_weight)


def reward_list(completions: list, expected: list, reward) -> list[float]:
    """The callback form of a trainer: a reward for each completion; lists of other lengths raise."""
    if len(completions) != len(expected):
        raise ValueError(f"{len(completions)} completions for {len(expected)} expected values")
    return [float(reward(c, e)) for c, e in zip(completions, expected, strict=True)]
