"""Settings; the defaults are part of the behaviour."""

from __future__ import annotations

from dataclasses import dataclass, field

METRICS = ("pearson", "spearman", "mutual_info", "r2")


@dataclass(frozen=True)
class ComputeBudget:
    max_comb_size: int = 2
    max_combinations_per_k: int = 5000
    top_features_for_higher_k: int = 50

    def problems(self, n_features: int) -> list[str]:
        """Warnings; raises on settings that cannot work."""
        if self.max_comb_size < 1:
            raise ValueError("max_comb_size must be at least 1")
        if self.max_combinations_per_k < 1:
            raise ValueError("max_combinations_per_k must be at least 1")
        out = []
        if self.top_features_for_higher_k < 1:
            out.append("top_features_for_higher_k under 1: no higher-order combinations")
        if self.max_comb_size > n_features:
            out.append("max_comb_size exceeds the number of features")
        return out


@dataclass(frozen=True)
class EngineConfig:
    budget: ComputeBudget = ComputeBudget()
    metric_names: tuple[str, ...] = METRICS
    num_repeats: int = 3
    permutation_tests: int = 25
    random_seed: int = 7
    stability_std_threshold: float = 0.10
    permutation_p_threshold: float = 0.05
    mi_bins: int = 16
    #: Scoring strategy: auto, native (Catalyst expressions) or arrow.
    backend: str = "auto"


@dataclass
class SearchConfig:
    n_scouts: int = 3
    subsample_ratio: float = 0.01
    min_samples: int = 1000
    top_k_per_scout: int = 1000
    min_correlation: float = 0.05
    min_votes: int = 2
    overfit_threshold: float = 0.05
    max_arity: int = 2
    operators: list[int] = field(default_factory=lambda: [0, 1, 3, 6, 4])
    interactions: list[int] = field(default_factory=lambda: [0, 1])
    n_folds: int = 5


@dataclass
class TimeSeriesConfig:
    group_col: str = "cust_id"
    time_col: str = "date"
    windows: list[int] = field(default_factory=lambda: [7, 14, 30, 60, 90, 180, 360])
    lags: list[int] = field(default_factory=lambda: [1, 7, 14, 30])
    differentials: list[int] = field(default_factory=lambda: [1, 7, 14, 30])
    rolling_windows: list[int] = field(default_factory=lambda: [7, 14, 30, 60, 90])
    enable_calculus: bool = True
    feature_cols: list[str] | None = None
    max_cols: int = 10
    #: Columns that break ties of time.
    tiebreak: tuple[str, ...] = ()
