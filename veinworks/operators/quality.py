"""Data-quality profile of numeric columns: missing, NaN and infinite counts,
cleaning, entropy and feature types."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values are told apart to a millionth.
RESOLUTION = 1e6
CLEANERS = ("replace", "mean", "median", "remove", "interpolate")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def missing_by_feature(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, n, null, nan, pos_inf, neg_inf, missing (null or NaN), missing_pct,
    mean and median of finite values; one pass."""
    v = F.col("value")

    def count(condition: Column):
        return F.count_if(condition).alias

    ok = F.when(finite(v), v)
    return (
        unpivoted(df, columns)
        .groupBy("feature")
        .agg(
            F.count("*").alias("n"),
            count(v.isNull())("n_null"),
            count(F.coalesce(F.isnan(v), F.lit(False)))("n_nan"),
            count(v == float("inf"))("n_pos_inf"),
            count(v == -float("inf"))("n_neg_inf"),
            count(v.isNull() | F.isnan(v))("n_missing"),
            (100.0 * F.count_if(v.isNull() | F.isnan(v)) / F.count("*")).alias("missing_pct"),
            F.avg(ok).alias("mean"),
        )
    )


def missing_by_row(df: DataFrame, columns: Sequence[str], output: str = "n_missing") -> DataFrame:
    """``df`` with the number of null or NaN cells in each row."""
    one = lambda c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)
    return df.withColumn(output, sum((one(c) for c in columns), F.lit(0)))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, complete rows, complete features, missing cells."""
    rows = missing_by_row(df, columns).agg(F.count("*").alias("n_rows"), F.count_if(F.col("n_missing") == 0).alias("complete_rows"), F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing_cells"))
    features = missing_by_feature(df, columns).agg(F.count_if(F.col("n_missing") == 0).alias("complete_features"))
    return rows.crossJoin(F.broadcast(features))  # one row each


def clean(df: DataFrame, columns: Sequence[str], how: str, value: float = 0.0, order: Sequence[str] = (), group: Sequence[str] = ()) -> DataFrame:
    """NaN, infinite and null cells replaced by ``value``, the mean or the median of
    finite ones; `remove` drops such rows; `interpolate` averages the neighbours
    in ``order`` within ``group`` (the nearer end's value outside them)."""
    if how not in CLEANERS:
        raise ValueError(f"how must be one of {', '.join(CLEANERS)}")
    num = {c: F.col(c).cast("double") for c in columns}
    if how == "remove":
        keep = F.lit(True)
        for c in num.values():
            keep = keep & finite(c)
        return df.where(keep)
    if how == "interpolate":
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        after = Window.partitionBy(*group).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)

        def between(c: Column) -> Column:
            ok = F.when(finite(c), c)
            left, right = F.last(ok, ignorenulls=True).over(before), F.first(ok, ignorenulls=True).over(after)
            return F.when(finite(c), c).otherwise(F.coalesce((left + right) / 2, left, right))

        return df.withColumns({k: between(c) for k, c in num.items()})
    fill: dict[str, float] = dict.fromkeys(columns, value)
    if how in ("mean", "median"):
        one = F.avg if how == "mean" else F.median
        row = df.agg(*[one(F.when(finite(c), c)).alias(f"m{i}") for i, c in enumerate(num.values())]).first()
        fill = {c: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}
    return df.withColumns({k: F.when(finite(c), c).otherwise(F.lit(float(fill[k]))) for k, c in num.items()})


@dataclass
class QualityProfile:
    low_entropy: float = 0.1
    high_cardinality: float = 0.95
    categorical_most: int = 50

    def entropy(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """feature, n, n_unique, entropy (normalised by log2 of all rows, also those
        that are not finite), feature_type. Values are counted by key first, so a
        constant column is one row for each task."""
        rows = unpivoted(df, columns)
        key = F.when(finite(F.col("value")), F.round(F.col("value") * RESOLUTION).cast("decimal(38,0)"))
        counts = rows.withColumn("key", key).groupBy("feature", "key").agg(F.count("*").alias("c"))
        # The row count comes with the counts: no second pass.
        per = counts.groupBy("feature").agg(F.sum("c").alias("n"), F.count("key").alias("n_unique"), F.sum(F.when(F.col("key").isNotNull(), F.col("c") * F.log2("c"))).alias("clog"), F.sum(F.when(F.col("key").isNotNull(), F.col("c"))).alias("known"))
        log_n = F.log2("n")
        # -sum c/n log2(c/n) = (known log2 n - sum c log2 c) / n
        raw = (F.coalesce("known", F.lit(0)) * log_n - F.coalesce("clog", F.lit(0.0))) / F.col("n")
        value = F.when(F.col("n") > 1, F.abs(raw / F.when(log_n > 0, log_n).otherwise(1.0))).otherwise(0.0)
        out = per.select("feature", "n", "n_unique", value.alias("entropy"))
        ratio = F.col("n_unique") / F.col("n")
        kind = F.when(F.col("n_unique") <= 1, "constant").when(F.col("n_unique") == F.col("n"), "unique_id").when(F.col("entropy") < self.low_entropy, "low_variance").when(ratio > self.high_cardinality, "high_cardinality").when(F.col("n_unique") <= self.categorical_most, "categorical").otherwise("normal")
        return out.withColumn("feature_type", kind)

    def lists(self, profile: DataFrame) -> dict[str, list[str]]:
        """Columns to drop, ids and categoricals; one row for each column comes in."""
        wanted = {"drop": ("constant", "low_variance"), "id": ("unique_id", "high_cardinality"), "categorical": ("categorical",)}
        rows = [(r["feature"], r["feature_type"]) for r in profile.orderBy("feature").collect()]
        return {k: [f for f, t in rows if t in kinds] for k, kinds in wanted.items()}

    def report(self, df: DataFrame, columns: Sequence[str]) -> str:
        lines = [f"{r['feature']}: {r['feature_type']}, {r['n_unique']} distinct of {r['n']}, entropy {r['entropy']:.3f}" for r in self.entropy(df, columns).orderBy("feature").collect()]
        total = completeness(df, columns).first()
        return "\n".join([f"{total['n_rows']} rows, {total['complete_rows']} complete, {total['missing_cells']} cells missing", *lines])
