"""Settings that change results, as one frozen value passed to the operators."""

from __future__ import annotations

from dataclasses import dataclass

from . import fixed_values as fixed


@dataclass(frozen=True)
class AnalysisConfig:
    excluded_dirs: tuple[str, ...] = fixed.EXCLUDED_DIRS
    excluded_prefixes: tuple[str, ...] = fixed.EXCLUDED_PREFIXES
    max_chunk_lines: int = 80
    min_chunk_lines: int = 3
    similarity_threshold: float = 0.75
    contamination: float = 0.05
    forest_trees: int = 100
    forest_sample: int = 256
    forest_seed: int = 42
    high_confidence: float = 0.80
    min_confidence: float = 0.0
    # Issues to investigate in each repo, in order of detection; all if None.
    archaeology_cap: int | None = None
    neighbours: int = 3
    provider: str = "llamacpp"
    # A source file above this size goes to the error table instead of a parser; none if None.
    max_file_bytes: int | None = None


DEFAULT_CONFIG = AnalysisConfig()
