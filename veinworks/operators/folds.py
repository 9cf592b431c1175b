"""Folds, samples, bootstrap weights and permuted targets, all keyed by a row id:
what a row draws depends on its id and the seed, not on its partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import dense_index, running_total

#: Fixed values of the linear congruential generator.
FACTOR, SHIFT, MODULUS = 1103515245, 12345, 2**31
#: Hash digits counted at a time, and rows of a prefix that may be sorted in one task.
PREFIX, FEW = 3, 100_000
#: Cumulative Poisson(1) probabilities: a uniform draw's weight is how many it passes.
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]


def lcg(row_id: Column, seed: int = 0, rounds: int = 1) -> Column:
    """A whole number in [0, 2**31) of id and seed."""
    x = row_id.cast("long") + F.lit(seed).cast("long")
    for _ in range(rounds):
        x = F.pmod(F.pmod(x, F.lit(MODULUS).cast("long")) * F.lit(FACTOR).cast("long") + F.lit(SHIFT).cast("long"), F.lit(MODULUS).cast("long"))
    return x


def fold_of(row_id: Column, n_folds: int, seed: int = 0) -> Column:
    """The high bits are used: the low ones of the generator run in short cycles."""
    return F.floor(lcg(row_id, seed, 2) * F.lit(n_folds) / F.lit(float(MODULUS))).cast("int")


def hash_order(row_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", row_id.cast("string"), F.lit(str(seed))))


def sample_size(n: int, ratio: float, least: int) -> int:
    return min(n, max(least, int(n * ratio)))


def sample(df: DataFrame, row_id: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows (all, if fewer), those first in hash order. Counts by
    hash prefix tell which prefixes are in; only the one that the size cuts is
    sorted, and it is refined until it holds few rows."""
    order = hash_order(F.col(row_id), seed)
    inside, left, rows = "", size, df
    while True:
        digits = len(inside) + PREFIX
        prefix = F.substring(order, 1, digits)
        # At most 16 ** PREFIX rows come to the driver.
        counts = sorted((r["p"], r["n"]) for r in rows.groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).collect())
        cut = None
        for p, n in counts:
            if n > left:
                cut = (p, n)
                break
            left -= n
        if cut is None:
            return df
        inside = cut[0]
        rows = df.where(F.substring(order, 1, digits) == inside)
        if cut[1] <= FEW or digits >= 32:
            break
    taken = df.where(order < F.lit(inside))
    return taken.unionByName(rows.orderBy(order, row_id).limit(left)) if left else taken


def bootstrap_weight(row_id: Column, repeat: int, seed: int) -> Column:
    """How often the row is drawn in a repeat: Poisson(1) of a hashed uniform. The
    draws of all rows sum to the row count on average."""
    u = lcg(row_id, seed + 7919 * (repeat + 1), 3) / F.lit(float(MODULUS))
    return sum((F.when(u >= p, 1).otherwise(0) for p in _POISSON), F.lit(0))


def permuted_targets(df: DataFrame, row_id: str, y: str, seeds: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """(row_id, keep, y, permuted array<double>): for each seed the targets in
    another order. Rows are numbered by id and by hash order, over ranges, and
    each number's target meets its row in one shuffle for all seeds."""
    base = dense_index(df.select(row_id, *keep, F.col(y).cast("double").alias("y")), [row_id], "place")
    if not seeds:
        return base.select(row_id, *keep, "y", F.array().cast("array<double>").alias("permuted"))
    # All seeds' orders are numbered in one pass over rows x seeds.
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), hash_order(F.col("__id"), s).alias("h")) for k, s in enumerate(seeds)]))
    spread = df.select(F.col(row_id).alias("__id"), F.col(y).cast("double").alias("py")).select("__id", "py", every.alias("d")).select("__id", "py", "d.k", "d.h")
    moved = running_total(spread, ["h", "__id"], F.lit(1).cast("long"), "place", within=("k",)).select((F.col("place") - 1).alias("place"), "k", "py")
    held = moved.groupBy("place").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "py"))), lambda s: s["py"]).alias("permuted"))
    return base.join(held, "place").select(row_id, *keep, "y", "permuted")


def exceeds(null: Column, actual: Column, metric: str) -> Column:
    """Whether a permuted score is as extreme as the actual one."""
    return F.abs(null) >= F.abs(actual) if metric in ("pearson", "spearman") else null >= actual


def p_value(n_exceeding: Column, n_tests: int) -> Column:
    return (n_exceeding + 1) / F.lit(n_tests + 1)
