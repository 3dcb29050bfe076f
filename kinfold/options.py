"""Run options, limits and the kinds of failure a caller can tell apart."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed values of the grouping contract.
MAX_COLLECTION = 2_000
INFERENCE_BATCH = 8
MAX_CLUSTERS = 9_999
MAX_MEMBERS = 99_999_999
MAX_HAMMING = 4
MAX_ASPECT = 1.05
MAX_THUMB_ERROR = 0.08
EMBEDDING_SIZE = 576
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


class UsageError(ValueError):
    """The request cannot be met as asked (exit code 2)."""


class GroupingError(ValueError):
    """Rows that cannot be grouped (exit code 2)."""


class ModelError(RuntimeError):
    """The model cannot be used (exit code 3)."""


class WriteError(OSError):
    """Output could not be written (exit code 4)."""


@dataclass(frozen=True)
class GroupingOptions:
    """Settings of a grouping run, checked when they are made."""

    threshold: float = 0.35
    alpha: float = 0.80
    recursive: bool = False
    max_files: int | None = MAX_COLLECTION

    def __post_init__(self) -> None:
        if not math.isfinite(self.threshold) or self.threshold < 0:
            raise GroupingError("threshold must be a finite nonnegative number")
        if not math.isfinite(self.alpha) or not 0 <= self.alpha <= 1:
            raise ValueError("alpha must be a finite number in [0, 1]")


def alpha_of(color_weight: float) -> float:
    """The content share that leaves ``color_weight`` percent to colour."""
    if not math.isfinite(color_weight) or not 0 <= color_weight <= 100:
        raise ValueError("color weight must be a finite percentage in [0, 100]")
    return 1.0 - color_weight / 100.0
