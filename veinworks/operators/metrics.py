"""Metrics of one or more candidate columns against a target.

Candidates are long rows (candidate, x, y): one plan scores them all, each
candidate's sums combine on the map side, and ranks come from counts of distinct
values by running totals over ranges, never from one sorted task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import METRICS
from ..functions.statistics import SUMS, pearson_columns, strength, sums_of, usable
from ..storage import running_total

KEY = "candidate"


def long_form(df: DataFrame, columns: dict[str, Column], y: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Rows (candidate, x, y) of the named expressions; unusable ones go."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias(KEY), c.cast("double").alias("x")) for k, c in columns.items()]))
    rows = df.select(*keep, y.cast("double").alias("y"), cells.alias("cell")).select(*keep, f"cell.{KEY}", "cell.x", "y")
    return rows.where(usable(F.col("x"), F.col("y")))


def pearson(rows: DataFrame) -> DataFrame:
    """Centred in a second pass over the means, so that large offsets cancel."""
    means = rows.groupBy(KEY).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    # One row for each candidate, which the driver planned.
    centred = rows.join(F.broadcast(means), KEY).select(KEY, (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    return centred.groupBy(KEY).agg(*sums_of(F.col("x"), F.col("y"))).select(KEY, pearson_columns().alias("pearson"))


def average_ranks(rows: DataFrame, value: str, output: str) -> DataFrame:
    """(candidate, value, output) with 0-based ranks, ties averaged, of each
    distinct value: a value's rank follows from how many rows are below it."""
    counts = rows.groupBy(KEY, value).agg(F.count("*").alias("__n"))
    upto = running_total(counts, [value], F.col("__n"), "__upto", within=(KEY,))
    return upto.select(KEY, value, (F.col("__upto") - F.col("__n") + (F.col("__n") - 1) / 2).alias(output))


def spearman(rows: DataFrame) -> DataFrame:
    ranked = rows.join(average_ranks(rows, "x", "rx"), [KEY, "x"]).join(average_ranks(rows, "y", "ry"), [KEY, "y"])
    return pearson(ranked.select(KEY, F.col("rx").alias("x"), F.col("ry").alias("y"))).withColumnRenamed("pearson", "spearman")


def spearman_shared(df: DataFrame, columns: dict[str, Column], y: Column) -> DataFrame:
    """`spearman` of `long_form`, where the target is ranked once for all candidates
    whose every row is usable; the others go by themselves."""
    target = y.cast("double")
    fine = df.where(usable(F.lit(0.0), target))
    holes = fine.agg(*[F.count_if(~usable(c.cast("double"), F.lit(0.0))).alias(f"h{i}") for i, c in enumerate(columns.values())]).first()
    shared = {k: c for i, (k, c) in enumerate(columns.items()) if not holes[f"h{i}"]}
    alone = {k: c for k, c in columns.items() if k not in shared}
    out = spearman(long_form(df, alone, y)) if alone or not columns else None
    if shared:
        wide = fine.select(target.alias("y"), *[c.cast("double").alias(f"x{i}") for i, c in enumerate(shared.values())])
        ranks = average_ranks(wide.select(F.lit("").alias(KEY), "y"), "y", "ry").select("y", "ry")
        rows = long_form(wide.join(ranks, "y"), {k: F.col(f"x{i}") for i, k in enumerate(shared)}, F.col("ry"))
        ranked = rows.join(average_ranks(rows, "x", "rx"), [KEY, "x"]).select(KEY, F.col("rx").alias("x"), "y")
        found = pearson(ranked).withColumnRenamed("pearson", "spearman")
        out = found if out is None else out.unionByName(found)
    return out


def bin_of(c: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width cell, the last one closed; 0 where all values are equal."""
    spread = high - low
    cell = F.floor((c - low) / F.when(spread > 0, spread).otherwise(1.0) * bins)
    return F.least(cell, F.lit(bins - 1)).cast("int")


def histogram(rows: DataFrame, bins: int) -> DataFrame:
    """(candidate, bin_x, bin_y, n) of non-empty cells."""
    ends = rows.groupBy(KEY).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    placed = rows.join(F.broadcast(ends), KEY)
    cells = placed.select(KEY, bin_of(F.col("x"), F.col("x0"), F.col("x1"), bins).alias("bin_x"), bin_of(F.col("y"), F.col("y0"), F.col("y1"), bins).alias("bin_y"))
    return cells.groupBy(KEY, "bin_x", "bin_y").agg(F.count("*").alias("n"))


def mutual_info(rows: DataFrame, bins: int = 16) -> DataFrame:
    """In nats, of the joint histogram; 0 with fewer than two bins or where a side
    is constant."""
    cells = histogram(rows, max(1, bins))
    whole, by_x, by_y = Window.partitionBy(KEY), Window.partitionBy(KEY, "bin_x"), Window.partitionBy(KEY, "bin_y")
    marked = cells.withColumns({"t": F.sum("n").over(whole), "nx": F.sum("n").over(by_x), "ny": F.sum("n").over(by_y)})
    term = F.col("n") / F.col("t") * F.log(F.col("n").cast("double") * F.col("t") / (F.col("nx").cast("double") * F.col("ny")))
    return marked.groupBy(KEY).agg(F.sum(term).alias("mutual_info"))


def score(rows: DataFrame, metrics: Sequence[str] = METRICS, mi_bins: int = 16, ranked: DataFrame | None = None) -> DataFrame:
    """(candidate, one column for each metric); ``ranked``: Spearman's, if known."""
    unknown = set(metrics) - set(METRICS)
    if unknown:
        raise ValueError(f"unsupported metrics: {', '.join(sorted(unknown))}")
    out = pearson(rows)
    if "spearman" in metrics:
        out = out.join(spearman(rows) if ranked is None else ranked, KEY, "left")
    if "mutual_info" in metrics:
        out = out.join(mutual_info(rows, mi_bins), KEY, "left")
    if "r2" in metrics:
        out = out.withColumn("r2", F.col("pearson") * F.col("pearson"))
    return out.select(KEY, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])


def with_strength(scores: DataFrame) -> DataFrame:
    there = [F.col(m) if m in scores.columns else F.lit(0.0) for m in METRICS]
    return scores.withColumn("strength", strength(*there))


__all__ = ["KEY", "SUMS", "average_ranks", "bin_of", "histogram", "long_form", "mutual_info", "pearson", "score", "spearman", "spearman_shared", "with_strength"]
