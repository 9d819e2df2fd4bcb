"""Run settings with the defaults of the job being rebuilt.

Fixed values (they define the results and must stay as they are):
categories cs.CL, cs.CV, cs.AI, cs.LG, stat.ML, cs.IR, cs.CY;
background start year 2024, preference start year 2023;
seed 42; 5.0 pseudo-negatives per like; C = 1; 1000 iterations;
last 7 days; high threshold 0.85; boundary threshold 0.6; sampling rate 0.004;
accepted cache models grok*, deepseek*, gemini*; language zh.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    categories: tuple[str, ...] = ("cs.CL", "cs.CV", "cs.AI", "cs.LG", "stat.ML", "cs.IR", "cs.CY")
    embedding_columns: tuple[str, ...] = ("jasper_v1", "conan_v1")
    background_start_year: int = 2024
    preference_start_year: int = 2023
    seed: int = 42
    bg_sample_rate: float = 5.0
    C: float = 1.0
    max_iter: int = 1000
    last_n_days: int = 7
    start_date: str = ""
    end_date: str = ""
    high_threshold: float = 0.85
    boundary_threshold: float = 0.6
    sample_rate: float = 0.004
    acceptable_cache_models: tuple[str, ...] = ("grok*", "deepseek*", "gemini*")
    language: str = "zh"
    workers: int | None = None  # calls of the per-paper function in flight at a time, over all tasks; None: one a core
    required_text: tuple[str, ...] = ()  # fields that a digest record must have (E4)
    required_lists: tuple[str, ...] = ()

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)
