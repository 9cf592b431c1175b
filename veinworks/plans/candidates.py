"""Which combinations to score."""

from __future__ import annotations

import math
import random
import warnings
from collections.abc import Iterator, Sequence
from itertools import combinations, islice, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ComputeBudget
from ..functions.interactions import COMMUTATIVE
from ..operators.scoring import Candidate

#: A batch never holds more.
MOST_BLOCKS = 1024


def unary_plan(n_features: int, budget: ComputeBudget, rng: random.Random) -> list[tuple[int, ...]]:
    every = list(range(n_features))
    if n_features > budget.max_combinations_per_k:
        warnings.warn("more features than the budget of combinations: a random part is taken", stacklevel=2)
        rng.shuffle(every)
        every = every[: budget.max_combinations_per_k]
    return [(i,) for i in every]


def top_features(strengths: dict[int, float], n: int) -> list[int]:
    """Strongest first, ties to the smaller index."""
    return sorted(strengths, key=lambda i: (-strengths[i], i))[: max(0, n)]


def higher_order_plan(features: Sequence[int], budget: ComputeBudget, rng: random.Random) -> list[tuple[int, ...]]:
    """Combinations of 2 to max_comb_size, of shuffled features so that a cap takes
    no side; each one in ascending order."""
    mixed = list(features)
    rng.shuffle(mixed)
    out: list[tuple[int, ...]] = []
    for k in range(2, budget.max_comb_size + 1):
        found = [tuple(sorted(c)) for c in islice(combinations(mixed, k), budget.max_combinations_per_k)]
        if math.comb(len(mixed), k) > len(found):
            warnings.warn(f"combinations of {k} cut at the budget", stacklevel=2)
        out += found
    return out


def full_plan(n_features: int, strengths: dict[int, float], budget: ComputeBudget, seed: int = 7) -> list[tuple[int, ...]]:
    rng = random.Random(seed)
    first = unary_plan(n_features, budget, rng)
    return first + higher_order_plan(top_features(strengths, budget.top_features_for_higher_k), budget, rng)


def grid(features: Sequence[str], ops: Sequence[int], kinds: Sequence[int], max_arity: int = 2) -> Iterator[Candidate]:
    """Every combination of features, an operator for each and one kind."""
    for arity in range(2, max_arity + 1):
        for columns in combinations(features, arity):
            for own in product(ops, repeat=arity):
                for kind in kinds:
                    yield Candidate(columns, own, (kind,) * (arity - 1))


def grid_size(n_features: int, n_ops: int, n_kinds: int, max_arity: int = 2) -> int:
    return sum(math.comb(n_features, k) * n_ops**k * n_kinds for k in range(2, max_arity + 1))


def grid_frame(features: DataFrame, ops: DataFrame, kinds: DataFrame) -> DataFrame:
    """The pair grid as rows, from (i), (op), (kind): metadata only. What is
    broadcast are lists of features, operators and kinds, which a driver typed."""
    small = F.broadcast
    pairs = features.select(F.col("i").alias("a")).join(small(features.select(F.col("i").alias("b"))), F.col("a") < F.col("b"))
    return pairs.crossJoin(small(ops.select(F.col("op").alias("op_a")))).crossJoin(small(ops.select(F.col("op").alias("op_b")))).crossJoin(small(kinds))


def canonical(rows: DataFrame) -> DataFrame:
    """One row of each candidate (a, b, op_a, op_b, kind): commutative kinds do not
    tell their sides apart."""
    swap = F.col("kind").isin(*sorted(COMMUTATIVE)) & (F.col("a") > F.col("b"))
    flip = {"a": "b", "b": "a", "op_a": "op_b", "op_b": "op_a"}
    return rows.select(*[F.when(swap, F.col(v)).otherwise(F.col(k)).alias(k) for k, v in flip.items()], "kind").distinct()


def window_pairs(n_features: int, window: int) -> list[tuple[int, int, int]]:
    """(i, j, first feature of j's window): pairs less than ``window`` apart."""
    return [(i, j, max(0, j - window + 1)) for j in range(n_features) for i in range(max(0, j - window + 1), j)]


def batches(rows: DataFrame, order: list[str], max_blocks: int = 96) -> DataFrame:
    """``rows`` with a batch number of at most ``max_blocks`` (and 1024) each."""
    size = max(1, min(max_blocks, MOST_BLOCKS))
    place = F.row_number().over(Window.orderBy(*order)) - 1  # candidates, not data
    return rows.withColumn("batch", F.floor(place / size).cast("int"))


def batch_sizes(max_blocks: int) -> list[int]:
    return [max_blocks, 2 * max_blocks, 4 * max_blocks, MOST_BLOCKS]
