"""Operator search: scouts on samples, votes, verification on all rows, recipes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..operators import folds, recipes
from ..operators.scoring import KEY, Candidate, fold_sums, train_and_validation
from . import strategy
from .candidates import grid, grid_size

#: The verifier's folds do not depend on a scout.
VERIFY_SEED = 42


@dataclass
class Found:
    candidate: Candidate
    train_r: float
    val_r: float
    votes: int

    @property
    def overfit_gap(self) -> float:
        return abs(self.train_r - self.val_r)


def scout_scores(df: DataFrame, candidates: Sequence[Candidate], y: Column, row_id: str, config: SearchConfig, n_rows: int, backend: str = "auto") -> DataFrame:
    """(scout, candidate, train_r, val_r) of each scout's best: its own sample and
    folds, correlation of at least the least, the first top_k by |train_r|."""
    size = folds.sample_size(n_rows, config.subsample_ratio, config.min_samples)
    every = None
    for scout in range(config.n_scouts):
        part = df if size >= n_rows else folds.sample(df, row_id, size, scout)
        sums = fold_sums(part, candidates, y, folds.fold_of(F.col(row_id), config.n_folds, scout), backend)
        one = train_and_validation(sums, 0).select(F.lit(scout).alias("scout"), KEY, "train_r", "val_r")
        every = one if every is None else every.unionByName(one)
    w = Window.partitionBy("scout").orderBy(F.desc(F.abs("train_r")), KEY)
    kept = every.where(F.abs("train_r") >= config.min_correlation)
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.top_k_per_scout).drop("place")


def vote(scores: DataFrame, min_votes: int) -> DataFrame:
    """(candidate, votes, avg_correlation), strongest first."""
    counted = scores.groupBy(KEY).agg(F.count("*").alias("votes"), F.avg(F.abs("train_r")).alias("avg_correlation"))
    return counted.where(F.col("votes") >= min_votes).orderBy(F.desc("avg_correlation"), KEY)


def verify(df: DataFrame, candidates: Sequence[Candidate], y: Column, row_id: str, config: SearchConfig, backend: str = "auto") -> DataFrame:
    """(candidate, train_r, val_r): means of absolute correlations over all folds,
    from one pass (train = all folds less one); gaps over the threshold go."""
    sums = fold_sums(df, candidates, y, folds.fold_of(F.col(row_id), config.n_folds, VERIFY_SEED), backend)
    means = train_and_validation(sums).groupBy(KEY).agg(F.avg(F.abs("train_r")).alias("train_r"), F.avg(F.abs("val_r")).alias("val_r"))
    return means.where(F.abs(F.col("train_r") - F.col("val_r")) <= config.overfit_threshold).orderBy(F.desc("val_r"), KEY)


class Search:
    def __init__(self, config: SearchConfig | None = None, backend: str = "auto"):
        self.config, self.backend = config or SearchConfig(), backend
        self.found: list[Found] = []

    def search(self, df: DataFrame, features: Sequence[str], y: Column, row_id: str) -> list[Found]:
        """As many rows as candidates come to the driver, never data."""
        cfg = self.config
        candidates = list(grid(features, cfg.operators, cfg.interactions, cfg.max_arity))
        n_rows = df.count()
        scores = scout_scores(df, candidates, y, row_id, cfg, n_rows, self.backend)
        elected = {r[KEY]: r["votes"] for r in vote(scores, cfg.min_votes).collect()}
        if not elected:
            self.found = []
            return []
        numbers = list(elected)
        rows = verify(df, [candidates[i] for i in numbers], y, row_id, cfg, self.backend).collect()
        self.found = [Found(candidates[numbers[r[KEY]]], r["train_r"], r["val_r"], elected[numbers[r[KEY]]]) for r in rows]
        return self.found

    def create_recipes(self, top: int | None = None) -> list[recipes.Recipe]:
        return recipes.create([(f.candidate, f.train_r, f.val_r, f.votes) for f in self.found[:top]])


class Orchestrator:
    """Chooses the mode from a calibration run, then searches."""

    def __init__(self, target_seconds: float = strategy.FULL_SECONDS, config: SearchConfig | None = None, throughput: float | None = None):
        self.target_seconds, self.config, self.throughput = target_seconds, config or SearchConfig(), throughput
        self.strategy: strategy.Strategy | None = None

    def run(self, df: DataFrame, features: Sequence[str], y: Column, row_id: str) -> list[Found]:
        cfg = self.config
        n_rows = df.count()
        speed = self.throughput
        if speed is None:
            some = [c for _, c in zip(range(25), grid(features, cfg.operators, cfg.interactions, cfg.max_arity), strict=False)]
            speed = strategy.calibrate(df, row_id, y, some)
        self.strategy = strategy.choose(grid_size(len(features), len(cfg.operators), len(cfg.interactions), cfg.max_arity), n_rows, speed, self.target_seconds)
        return Search(strategy.settings(self.strategy, n_rows, cfg)).search(df, features, y, row_id)


def quick_search(df: DataFrame, features: Sequence[str], y: Column, row_id: str, top: int = 20, **settings) -> list[Found]:
    return Search(SearchConfig(**settings)).search(df, features, y, row_id)[:top]


def auto_plan(n_rows: int, n_features: int, throughput: float, target_seconds: float = strategy.FULL_SECONDS, config: SearchConfig | None = None) -> strategy.Strategy:
    """The mode that a search of this size would run in, without any data."""
    cfg = config or SearchConfig()
    return strategy.choose(grid_size(n_features, len(cfg.operators), len(cfg.interactions), cfg.max_arity), n_rows, throughput, target_seconds)


def results_frame(spark: SparkSession, found: Sequence[Found]) -> DataFrame:
    rows = [(f.candidate.describe(), list(f.candidate.columns), f.train_r, f.val_r, f.votes) for f in found]
    return spark.createDataFrame(rows, "description string, columns array<string>, train_r double, val_r double, votes int")
