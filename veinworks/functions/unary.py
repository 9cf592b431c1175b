"""Element-wise operators as Column expressions, by id."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Operator ids and names.
IDENTITY, LOG, EXP, SQRT, TANH, SIGMOID, SQUARE, NEGATE, ABS, INVERSE, CUBE, ROLLING_MEAN, ROLLING_STD = range(13)
NAMES = ["identity", "log", "exp", "sqrt", "tanh", "sigmoid", "square", "negate", "abs", "inverse", "cube", "rolling_mean", "rolling_std"]
EPS = 1e-8


def op_id(name: str) -> int:
    try:
        return NAMES.index(name.lower())
    except ValueError:
        raise ValueError(f"no unary operator {name!r}; known: {', '.join(NAMES)}") from None


def clamp(c: Column, limit: float) -> Column:
    """Within the limits; null and NaN stay (least and greatest would not let them)."""
    return F.when(F.isnan(c), c).when(c > limit, F.lit(limit)).when(c < -limit, F.lit(-limit)).otherwise(c)


def off_zero(c: Column) -> Column:
    """``c``, or EPS of its sign where it is nearer to zero."""
    return F.when(F.abs(c) < EPS, F.when(c < 0, F.lit(-EPS)).otherwise(F.lit(EPS))).otherwise(c)


def unary(op: int, c: Column) -> Column:
    """Operator ``op`` of ``c``; unknown ids are the identity. The rolling ones
    have no element-wise value (NaN): see `rolling`."""
    c = c.cast("double")
    if op == LOG:
        return F.log(F.abs(c) + EPS)
    if op == EXP:
        return F.exp(clamp(c, 20.0))
    if op == SQRT:
        return F.sqrt(F.abs(c))
    if op == TANH:
        return F.tanh(clamp(c, 10.0))
    if op == SIGMOID:
        return 1 / (1 + F.exp(-clamp(c, 20.0)))
    if op == SQUARE:
        return c * c
    if op == NEGATE:
        return -c
    if op == ABS:
        return F.abs(c)
    if op == INVERSE:
        return 1 / off_zero(c)
    if op == CUBE:
        return c * c * c
    if op in (ROLLING_MEAN, ROLLING_STD):
        return F.lit(float("nan"))
    return c


def rolling(op: int, column: str, width: int, group: list[str], order: list[str]) -> Column:
    """Rolling mean or standard deviation, to be projected before a search; null
    until ``width`` values are there."""
    frame = Window.partitionBy(*group).orderBy(*order).rowsBetween(-(width - 1), 0)
    value = F.avg(column) if op == ROLLING_MEAN else F.stddev_samp(column)
    return F.when(F.count(column).over(frame) == width, value.over(frame))


def describe(op: int, name: str) -> str:
    return name if op == IDENTITY else f"{NAMES[op]}({name})" if 0 <= op < len(NAMES) else name
