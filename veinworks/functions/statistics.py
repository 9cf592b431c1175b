"""Scores from additive sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sums that every correlation of a candidate with the target needs.
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def usable(x: Column, y: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)


def sums_of(x: Column, y: Column, where: Column | None = None, prefix: str = "") -> list[Column]:
    """The aggregates SUMS over usable rows (of ``where``)."""
    ok = usable(x, y) if where is None else usable(x, y) & where
    terms = {"n": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    return [F.coalesce(F.sum(F.when(ok, t)), F.lit(0)).alias(prefix + k) for k, t in terms.items()]


def pearson_of(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r; 0 with fewer than two rows or without variance."""
    var_x, var_y = n * sxx - sx * sx, n * syy - sy * sy
    # Cancellation leaves about 1e-16 of the larger term where there is no variance.
    flat = (n < 2) | (var_x <= F.abs(n * sxx) * 1e-14) | (var_y <= F.abs(n * syy) * 1e-14)
    return F.when(flat, F.lit(0.0)).otherwise((n * sxy - sx * sy) / F.sqrt(F.when(flat, 1.0).otherwise(var_x * var_y)))


def pearson_columns(prefix: str = "") -> Column:
    return pearson_of(*[F.col(prefix + k).cast("double") for k in SUMS])


def pearson_number(n: float, sx: float, sy: float, sxx: float, syy: float, sxy: float) -> float:
    var_x, var_y = n * sxx - sx * sx, n * syy - sy * sy
    if n < 2 or var_x <= 1e-14 * abs(n * sxx) or var_y <= 1e-14 * abs(n * syy):
        return 0.0
    return (n * sxy - sx * sy) / (var_x * var_y) ** 0.5


def strength(pearson: Column, spearman: Column, mutual_info: Column, r2: Column) -> Column:
    return F.greatest(F.abs(pearson), F.abs(spearman), mutual_info, r2)
