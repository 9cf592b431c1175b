"""Binary and n-ary combinations as Column expressions, by id."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .unary import off_zero, unary

#: Interaction ids, names and signs.
MULT, ADD, SUB, DIV, MAX, MIN = range(6)
NAMES = ["mult", "add", "sub", "div", "max", "min"]
SIGNS = ["*", "+", "-", "/", "max", "min"]
COMMUTATIVE = {MULT, ADD, MAX, MIN}
#: Added to the selector's divisor, which is not kept off zero otherwise.
SELECTOR_EPS = 1e-8


def combine(a: Column, b: Column, kind: int) -> Column:
    """``a`` with ``b``; unknown kinds multiply. Maximum and minimum pass over NaN."""
    if kind == ADD:
        return a + b
    if kind == SUB:
        return a - b
    if kind == DIV:
        return a / off_zero(b)
    if kind in (MAX, MIN):
        pick = F.greatest if kind == MAX else F.least
        return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(pick(a, b))
    return a * b


def fold(values: Sequence[Column], kinds: int | Sequence[int]) -> Column:
    """Left to right; one kind for all or one for each join."""
    if not values:
        raise ValueError("no values to combine")
    kinds = [kinds] * (len(values) - 1) if isinstance(kinds, int) else list(kinds)
    if len(kinds) != len(values) - 1:
        raise ValueError(f"{len(values)} values need {len(values) - 1} interactions")
    return reduce(lambda acc, x: combine(acc, x[0], x[1]), zip(values[1:], kinds, strict=True), values[0])


def candidate(columns: Sequence[str], ops: Sequence[int], kinds: int | Sequence[int]) -> Column:
    """op(x_i) combined with op(x_j) and so on."""
    if len(columns) != len(ops):
        raise ValueError("one operator for each column")
    return fold([unary(o, F.col(c)) for c, o in zip(columns, ops, strict=True)], kinds)


def centred_product(columns: Sequence[str], means: dict[str, float]) -> Column:
    """A single column as it is; of several the product of deviations from means."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("double")
    return reduce(lambda a, b: a * b, [F.col(c).cast("double") - F.lit(float(means[c])) for c in columns])


def selector_pair(a: Column, b: Column, operator: str) -> Column:
    made = {"multiply": lambda: a * b, "add": lambda: a + b, "subtract": lambda: a - b, "divide": lambda: a / (b + F.lit(SELECTOR_EPS))}
    if operator not in made:
        raise ValueError(f"operator must be one of {', '.join(made)}")
    return made[operator]()
