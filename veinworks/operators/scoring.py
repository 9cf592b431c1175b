"""Train and validation sums of many candidates in one pass.

Two strategies give the same sums. `native`: conditional aggregates of Column
expressions, for up to `NATIVE_LIMIT` candidates. `arrow`: each task computes
every (column, operator) once per batch in numpy and adds all candidates' sums;
what is shuffled is one row for each task, candidate and fold. There a block of
candidates is a matrix, and its sums with every target and weight are products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import interactions, unary
from ..functions.statistics import SUMS, pearson_of, sums_of

NATIVE_LIMIT = 30
BACKENDS = ("auto", "native", "arrow")
KEY = "candidate"
#: Rows and candidates of a matrix, and candidates whose sums a task holds.
ROWS_AT_ONCE, BLOCK, CANDIDATES_A_PASS = 4096, 128, 50_000


@dataclass(frozen=True)
class Candidate:
    """op(column) combined left to right; ``kinds`` has one kind for each join."""

    columns: tuple[str, ...]
    ops: tuple[int, ...]
    kinds: tuple[int, ...] = ()

    def __post_init__(self):
        if len(self.ops) != len(self.columns) or len(self.kinds) != len(self.columns) - 1:
            raise ValueError("a candidate needs an operator for each column and a kind for each join")

    @property
    def signature(self) -> str:
        return f"{','.join(self.columns)}|{','.join(map(str, self.ops))}|{','.join(map(str, self.kinds))}"

    def column(self) -> Column:
        return interactions.candidate(self.columns, self.ops, list(self.kinds))

    def describe(self) -> str:
        terms = [unary.describe(o, c) for c, o in zip(self.columns, self.ops, strict=True)]
        out = terms[0]
        for kind, term in zip(self.kinds, terms[1:], strict=True):
            sign = interactions.SIGNS[kind] if 0 <= kind < len(interactions.SIGNS) else "*"
            out = f"{sign}({out}, {term})" if sign.isalpha() else f"{out} {sign} {term}"
        return out


def numpy_unary(op: int, x: np.ndarray) -> np.ndarray:
    off_zero = lambda v: np.where(np.abs(v) < unary.EPS, np.where(v < 0, -unary.EPS, unary.EPS), v)
    made = {
        unary.LOG: lambda: np.log(np.abs(x) + unary.EPS), unary.EXP: lambda: np.exp(np.clip(x, -20, 20)), unary.SQRT: lambda: np.sqrt(np.abs(x)),
        unary.TANH: lambda: np.tanh(np.clip(x, -10, 10)), unary.SIGMOID: lambda: 1 / (1 + np.exp(-np.clip(x, -20, 20))), unary.SQUARE: lambda: x * x,
        unary.NEGATE: lambda: -x, unary.ABS: lambda: np.abs(x), unary.INVERSE: lambda: 1 / off_zero(x), unary.CUBE: lambda: x * x * x,
        unary.ROLLING_MEAN: lambda: np.full_like(x, np.nan), unary.ROLLING_STD: lambda: np.full_like(x, np.nan),
    }
    return made[op]() if op in made else x


def numpy_combine(a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
    if kind == interactions.ADD:
        return a + b
    if kind == interactions.SUB:
        return a - b
    if kind == interactions.DIV:
        return a / np.where(np.abs(b) < unary.EPS, np.where(b < 0, -unary.EPS, unary.EPS), b)
    if kind == interactions.MAX:
        return np.fmax(a, b)
    if kind == interactions.MIN:
        return np.fmin(a, b)
    return a * b


def choose(backend: str, n_candidates: int) -> str:
    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}")
    return backend if backend != "auto" else "native" if n_candidates <= NATIVE_LIMIT else "arrow"


def fold_sums(df: DataFrame, candidates: Sequence[Candidate], y: Column, fold: Column | None = None, backend: str = "auto", weights: Sequence[Column] = (), targets: Column | None = None) -> DataFrame:
    """(candidate number, fold, draw, SUMS): draw 0 is the target itself, 1.. the
    weights (bootstrap counts) and then the ``targets`` (array of other targets).
    Rows where a candidate or the target is null or NaN do not count for it."""
    fold = F.lit(0) if fold is None else fold
    if choose(backend, len(candidates)) == "native" and not len(weights) and targets is None:
        return _native(df, candidates, y, fold)
    return _arrow(df, candidates, y, fold, weights, targets)


def _native(df: DataFrame, candidates: Sequence[Candidate], y: Column, fold: Column) -> DataFrame:
    base = df.select(*[c.column().cast("double").alias(f"c{i}") for i, c in enumerate(candidates)], y.cast("double").alias("y"), fold.cast("int").alias("fold"))
    sums = [a for i in range(len(candidates)) for a in sums_of(F.col(f"c{i}"), F.col("y"), prefix=f"c{i}_")]
    wide = base.groupBy("fold").agg(*sums)
    cells = F.array(*[F.struct(F.lit(i).alias(KEY), *[F.col(f"c{i}_{k}").cast("double").alias(k) for k in SUMS]) for i in range(len(candidates))])
    return wide.select("fold", F.explode(cells).alias("c")).select(f"c.{KEY}", "fold", F.lit(0).alias("draw"), *[f"c.{k}" for k in SUMS])


def _arrow(df: DataFrame, candidates: Sequence[Candidate], y: Column, fold: Column, weights: Sequence[Column], targets: Column | None) -> DataFrame:
    """In passes of at most CANDIDATES_A_PASS, whose sums every task holds."""
    out = None
    for start in range(0, max(1, len(candidates)), CANDIDATES_A_PASS):
        one = _arrow_pass(df, candidates[start : start + CANDIDATES_A_PASS], start, y, fold, weights, targets)
        out = one if out is None else out.unionByName(one)
    return out


def block_sums(value: np.ndarray, weight: np.ndarray, pulled: np.ndarray, squared: np.ndarray) -> np.ndarray:
    """SUMS of candidates (rows of ``value``) with draws, by matrix products:
    ``weight`` (rows x draws, or x 1 for all), ``pulled`` = weight * target,
    ``squared`` = weight * target**2. NaN values do not count."""
    gaps = np.isnan(value)
    shape = (len(value), pulled.shape[1])
    if gaps.any():
        ok = (~gaps).astype(np.float64)
        value = np.where(gaps, 0.0, value)
        n, sy, syy = ok @ weight, ok @ pulled, ok @ squared
    else:
        n, sy, syy = (m.sum(axis=0)[None] for m in (weight, pulled, squared))
    cells = (n, value @ weight, sy, (value * value) @ weight, syy, value @ pulled)
    return np.stack([np.broadcast_to(c, shape) for c in cells], axis=2)


def _arrow_pass(df: DataFrame, candidates: Sequence[Candidate], first: int, y: Column, fold: Column, weights: Sequence[Column], targets: Column | None) -> DataFrame:
    names = sorted({c for x in candidates for c in x.columns})
    plan = [(tuple(names.index(c) for c in x.columns), x.ops, x.kinds) for x in candidates]
    base = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)], y.cast("double").alias("y"), fold.cast("int").alias("fold"), *[w.cast("double").alias(f"w{i}") for i, w in enumerate(weights)], *([targets.alias("t")] if targets is not None else []))
    # A few large row groups would leave most cores idle.
    cores = df.sparkSession.sparkContext.defaultParallelism
    if base.rdd.getNumPartitions() < cores:
        base = base.repartition(cores)
    n_weights = len(weights)

    def values(xs: list[np.ndarray], made: dict, block: list) -> np.ndarray:
        out = np.empty((len(block), len(xs[0])))
        for at, (columns, ops, kinds) in enumerate(block):
            terms = []
            for c, o in zip(columns, ops, strict=True):
                if (c, o) not in made:
                    made[c, o] = numpy_unary(o, xs[c])
                terms.append(made[c, o])
            value = terms[0]
            for kind, term in zip(kinds, terms[1:], strict=True):
                value = numpy_combine(value, term, kind)
            out[at] = value
        return out

    def draws(batch: pa.RecordBatch, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights and targets of all draws (rows x draws each; a target of NaN has
        weight 0)."""
        read = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
        w = [np.ones(len(target)), *[read(f"w{i}") for i in range(n_weights)]]
        t = np.repeat(target[:, None], len(w), axis=1)
        w = np.stack(w, axis=1)
        if "t" in batch.schema.names:
            others = batch.column("t").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(target), -1)
            w, t = np.hstack([w, np.ones_like(others)]), np.hstack([t, others])
        lost = np.isnan(t)
        return np.where(lost, 0.0, w), np.where(lost, 0.0, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                folds = batch.column("fold").to_numpy(zero_copy_only=False)
                order = np.argsort(folds, kind="stable")
                batch, folds = batch.take(pa.array(order)), folds[order]
                xs = [batch.column(f"x{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(names))]
                w, t = draws(batch, batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64))
                pulled = w * t
                squared = pulled * t
                if (w == 1).all():
                    w = w[:, :1]
                cuts = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
                made: dict[tuple[int, int], np.ndarray] = {}
                with np.errstate(all="ignore"):
                    for at in range(0, len(plan), BLOCK):
                        block = values(xs, made, plan[at : at + BLOCK])
                        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                            own = int(folds[a])
                            if own not in held:
                                held[own] = np.zeros((len(plan), pulled.shape[1], len(SUMS)))
                            held[own][at : at + BLOCK] += block_sums(block[:, a:b], w[a:b], pulled[a:b], squared[a:b])
        for own, sums in held.items():
            number, draw = (x.ravel().astype(np.int32) for x in np.indices(sums.shape[:2]))
            flat = sums.reshape(-1, len(SUMS))
            yield pa.RecordBatch.from_arrays([pa.array(number + np.int32(first)), pa.array(np.full(len(flat), own, np.int32)), pa.array(draw), *[pa.array(np.ascontiguousarray(flat[:, i])) for i in range(len(SUMS))]], names=[KEY, "fold", "draw", *SUMS])

    partial = base.mapInArrow(run, f"{KEY} int, fold int, draw int, " + ", ".join(f"{k} double" for k in SUMS))
    return partial.groupBy(KEY, "fold", "draw").agg(*[F.sum(k).alias(k) for k in SUMS])


def train_and_validation(sums: DataFrame, fold: int | None = None) -> DataFrame:
    """(candidate, fold, train_r, val_r, 12 sums): train is all folds less one."""
    total = sums.groupBy(KEY, "draw").agg(*[F.sum(k).alias(f"all_{k}") for k in SUMS])
    val = sums if fold is None else sums.where(F.col("fold") == fold)
    both = total.join(val, [KEY, "draw"])
    train = {k: F.col(f"all_{k}") - F.col(k) for k in SUMS}
    return both.select(KEY, "fold", "draw", pearson_of(*[train[k] for k in SUMS]).alias("train_r"), pearson_of(*[F.col(k) for k in SUMS]).alias("val_r"), *[train[k].alias(f"train_{k}") for k in SUMS], *[F.col(k).alias(f"val_{k}") for k in SUMS])


def pearson_scores(sums: DataFrame) -> DataFrame:
    """(candidate, draw, pearson) over all folds."""
    total = sums.groupBy(KEY, "draw").agg(*[F.sum(k).alias(k) for k in SUMS])
    return total.select(KEY, "draw", pearson_of(*[F.col(k) for k in SUMS]).alias("pearson"))
