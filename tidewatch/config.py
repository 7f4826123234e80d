"""Validated detector settings."""

from __future__ import annotations

import math
from dataclasses import dataclass


def check_threshold(value: float) -> float:
    if not math.isfinite(value) or value <= 0:
        raise ValueError("z-score threshold must be a finite number > 0")
    return float(value)


def check_contamination(value: float) -> float:
    if not math.isfinite(value) or not 0 < value < 0.5:
        raise ValueError("contamination must satisfy 0 < contamination < 0.5")
    return float(value)


@dataclass(frozen=True)
class DetectorConfig:
    """Settings of one detection run; checked when the object is built."""

    zscore_threshold: float = 2.5
    iforest_contamination: float = 0.05
    min_group_size: int = 5
    random_state: int = 42
    n_trees: int = 200

    def __post_init__(self) -> None:
        check_threshold(self.zscore_threshold)
        check_contamination(self.iforest_contamination)
        if self.min_group_size < 3:
            raise ValueError("min_group_size must be at least 3")
        # The forest is broadcast to every task, so its size has a hard bound.
        if not 1 <= self.n_trees <= 2000:
            raise ValueError("n_trees must be between 1 and 2000")
