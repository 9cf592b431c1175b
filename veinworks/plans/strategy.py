"""How much of the data a search looks at, from what scoring costs."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..config import SearchConfig
from ..operators.folds import sample
from ..operators.scoring import Candidate, fold_sums

#: Seconds under which the whole data is searched.
FULL_SECONDS = 300.0
#: Samples of at least this share need one scout only.
ONE_SCOUT_RATIO = 0.1
LEAST_RATIO = 0.001
HEADROOM = 0.9
MODES = ("full", "aggressive", "ensemble")


@dataclass
class Strategy:
    mode: str
    subsample_ratio: float
    n_scouts: int
    estimated_time: float
    load_factor: float


def estimated_seconds(evaluations: int, n_rows: int, throughput: float) -> float:
    """``throughput``: candidate evaluations a second, on a small table."""
    return evaluations / max(throughput, 1e-9) * (1 + 0.1 * n_rows / 100_000)


def choose(evaluations: int, n_rows: int, throughput: float, target_seconds: float = FULL_SECONDS) -> Strategy:
    seconds = estimated_seconds(evaluations, n_rows, throughput)
    load = seconds / target_seconds if target_seconds > 0 else float("inf")
    if seconds < FULL_SECONDS:
        return Strategy("full", 1.0, 1, seconds, load)
    ratio = min(1.0, max(LEAST_RATIO, HEADROOM * target_seconds / seconds))
    scouts = 1 if ratio >= ONE_SCOUT_RATIO else 3
    return Strategy("aggressive" if scouts == 1 else "ensemble", ratio, scouts, seconds, load)


def calibrate(df: DataFrame, row_id: str, y: Column, candidates: list[Candidate], rows: int = 1000) -> float:
    """Evaluations a second, from scoring on at most ``rows`` rows."""
    small = sample(df, row_id, rows, 0)
    fold_sums(small, candidates[:1], y).collect()
    began = time.perf_counter()
    fold_sums(small, candidates, y).collect()
    return len(candidates) / max(time.perf_counter() - began, 1e-6)


def settings(strategy: Strategy, n_rows: int, base: SearchConfig | None = None) -> SearchConfig:
    """The search settings of a mode."""
    c = base or SearchConfig()
    keep = {"operators": c.operators, "interactions": c.interactions, "min_correlation": c.min_correlation, "overfit_threshold": c.overfit_threshold, "max_arity": c.max_arity, "n_folds": c.n_folds}
    if strategy.mode == "full":
        return SearchConfig(n_scouts=1, subsample_ratio=1.0, top_k_per_scout=10_000, min_votes=1, min_samples=c.min_samples, **keep)
    if strategy.mode == "aggressive":
        return SearchConfig(n_scouts=1, subsample_ratio=strategy.subsample_ratio, min_samples=max(1000, n_rows // 100), top_k_per_scout=1000, min_votes=1, **keep)
    return SearchConfig(n_scouts=strategy.n_scouts, subsample_ratio=strategy.subsample_ratio, min_samples=c.min_samples, top_k_per_scout=500, min_votes=max(2, (strategy.n_scouts + 1) // 2), **keep)
