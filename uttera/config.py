"""Frozen parameter objects. They are checked when made, before any plan is built."""

from __future__ import annotations

import math
from dataclasses import dataclass

INF = math.inf
#: Thresholds that come in pairs, in the order in which they are checked.
BOUNDS = (
    ("min_chars", "max_chars"),
    ("min_duration", "max_duration"),
    ("min_chars_per_second", "max_chars_per_second"),
    ("min_words_per_second", "max_words_per_second"),
    ("min_duration_per_char", "max_duration_per_char"),
    ("min_duration_per_word", "max_duration_per_word"),
)


@dataclass(frozen=True)
class FilterConfig:
    """Quality thresholds; a bound of 0 or infinity switches its check off."""

    min_chars: int = 1
    max_chars: int = 400
    max_symbol_ratio: float = 0.5
    min_duration: float = 0.01
    max_duration: float = 30.0
    min_chars_per_second: float = 0.0
    max_chars_per_second: float = INF
    min_words_per_second: float = 0.0
    max_words_per_second: float = INF
    min_duration_per_char: float = 0.0
    max_duration_per_char: float = INF
    min_duration_per_word: float = 0.0
    max_duration_per_word: float = INF
    lowercase: bool = True

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        if self.min_chars < 0:
            raise ValueError("min_chars must be >= 0")
        if not 0.0 <= self.max_symbol_ratio <= 1.0:
            raise ValueError("max_symbol_ratio must be within [0, 1]")
        for low, high in BOUNDS:
            lo, hi = getattr(self, low), getattr(self, high)
            if math.isnan(lo) or math.isnan(hi):
                raise ValueError(f"{low} and {high} must be numbers")
            if lo < 0:
                raise ValueError(f"{low} must be >= 0")
            if hi < lo:
                raise ValueError(f"{high} must be >= {low}")


TRAINING = FilterConfig()
EVALUATION = FilterConfig(max_chars=5000, max_symbol_ratio=1.0)
WARMING = FilterConfig(max_chars=5000, max_symbol_ratio=0.5)


@dataclass(frozen=True)
class SplitConfig:
    seed: int = 13
    validation: float = 0.1
    test: float = 0.1

    def __post_init__(self) -> None:
        for name in ("validation", "test"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} fraction must be within [0, 1]")
        if self.validation + self.test > 1.0:
            raise ValueError("validation and test fractions must not exceed 1 together")

    @property
    def train_cutoff(self) -> float:
        return max(0.0, 1.0 - self.validation - self.test)

    @property
    def validation_cutoff(self) -> float:
        return self.train_cutoff + self.validation


@dataclass(frozen=True)
class FrontendConfig:
    """Feature front end. The defaults are the fixed values shared by all presets."""

    sample_rate: int = 16_000
    n_fft: int = 400
    win_length: int = 400
    hop_length: int = 160
    n_mels: int = 80
    preemphasis: float = 0.97
    normalize_signal: bool = True
    normalize_feature: bool = True
    normalize_per_frame: bool = False

    def __post_init__(self) -> None:
        if min(self.n_fft, self.win_length, self.hop_length, self.sample_rate, self.n_mels) <= 0:
            raise ValueError("front end sizes must be positive")
        if self.win_length > self.n_fft:
            raise ValueError("win_length must not exceed n_fft")

    def describe(self) -> str:
        """Stable text form, hashed into feature keys."""
        return ";".join(f"{k}={getattr(self, k)!r}" for k in sorted(self.__dataclass_fields__))


RAW_FRONTEND = FrontendConfig(preemphasis=0.0, normalize_signal=False, normalize_feature=False)


@dataclass(frozen=True)
class BatchConfig:
    """At most one budget may be set; the first one in the order below decides the mode."""

    batch_size: int = 8
    adaptive_budget: int | None = None
    adaptive_unit: str = "frames"
    max_duration_sec: float | None = None
    max_frames: int | None = None
    bucket_by_length: bool = False

    def __post_init__(self) -> None:
        if self.batch_size <= 0:
            raise ValueError("batch_size must be > 0")
        if self.adaptive_unit not in ("frames", "tokens"):
            raise ValueError("adaptive_unit must be 'frames' or 'tokens'")
        budgets = [b for b in (self.adaptive_budget, self.max_duration_sec, self.max_frames) if b is not None]
        if len(budgets) > 1:
            raise ValueError("adaptive, duration and frame budgets exclude each other")
        if any(b <= 0 for b in budgets):
            raise ValueError("budgets must be > 0")

    @property
    def mode(self) -> str:
        if self.adaptive_budget is not None:
            return "adaptive"
        if self.max_duration_sec is not None:
            return "duration"
        if self.max_frames is not None:
            return "frames"
        return "length" if self.bucket_by_length else "fixed"
