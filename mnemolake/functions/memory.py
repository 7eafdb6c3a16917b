"""Memory lifecycle arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class LifecyclePolicy:
    """Score thresholds of the middle and upper tier, what a useful recall adds, and days per decay step."""

    middle_from: float = 3.0
    upper_from: float = 10.0
    useful_gain: float = 2.5
    strength_gain: int = 1
    cycle_days: int = 3

    def __post_init__(self) -> None:
        scores = (self.middle_from, self.upper_from, self.useful_gain)
        if not all(map(math.isfinite, scores)) or not 0 < self.middle_from < self.upper_from:
            raise ValueError("tier thresholds must be finite, positive and rising")
        if self.useful_gain <= 0 or self.strength_gain < 1 or self.cycle_days < 1:
            raise ValueError("gains and cycles must be positive")

    @property
    def cycle_us(self) -> int:
        return self.cycle_days * DAY_US


def tier(score: Column, policy: LifecyclePolicy) -> Column:
    return F.when(score >= policy.upper_from, 2).when(score >= policy.middle_from, 1).otherwise(0)


def decay_steps(at_us: Column, since_us: Column, policy: LifecyclePolicy) -> Column:
    """Whole cycles from ``since_us`` to ``at_us``, toward zero."""
    apart = at_us - since_us
    return ((apart - apart % F.lit(policy.cycle_us)) / F.lit(policy.cycle_us)).cast("long")
