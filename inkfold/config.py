"""Options of the engine; their values become literals of the plans."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Config:
    """Four of the options are carried but change nothing, as existing users expect (T1): dilation_size,
    exclude_long_lines, matching_threshold and max_processing_time_ms."""

    dilation_size: int = 22
    exclude_long_lines: bool = True
    attempt_character_splitting: bool = True
    apply_dictionary_correction: bool = False
    matching_threshold: float = 0.4
    max_processing_time_ms: int = 30_000
    compat: bool = True

    def __post_init__(self) -> None:
        if self.dilation_size <= 0:
            raise ValueError("dilation_size must be positive")
        if not 0 <= self.matching_threshold <= 1:
            raise ValueError("matching_threshold must be between 0 and 1")
        if self.max_processing_time_ms <= 0:
            raise ValueError("max_processing_time_ms must be positive")

    def copy(self, **changes: Any) -> Config:
        return replace(self, **changes)


BALANCED = Config()
FAST = Config(15, False, False, False, 0.3)
ACCURATE = Config(30, True, True, True, 0.6)
ROBUST = Config(35, True, True, True, 0.5)
