"""Ordered target statistics: a category's encoding of a row uses only rows that
come before it in a hashed order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import running_totals
from .folds import hash_order

#: Between the seeds of permutations.
STRIDE = 2654435769


@dataclass
class OrderedTargetEncoder:
    prior: float = 0.5
    prior_weight: float = 1.0
    seed: int = 42
    n_permutations: int = 4

    def smoothed(self, total: Column, count: Column) -> Column:
        """The category's mean, drawn to the prior; the prior where both are 0."""
        weight = F.lit(float(self.prior_weight))
        below = count + weight
        return F.when(below > 0, (total + F.lit(float(self.prior)) * weight) / F.when(below > 0, below).otherwise(1.0)).otherwise(F.lit(float(self.prior)))

    def encode(self, df: DataFrame, category: str, target: str, row_id: str, output: str = "encoded") -> DataFrame:
        """``df`` with the mean encoding over the permutations; ``row_id`` is unique.
        All permutations are summed in one pass over rows x permutations, and a hot
        category is split over ranges of the order (see `running_totals`)."""
        value = F.col(target).cast("double")
        orders = F.array(*[F.struct(F.lit(p).alias("p"), hash_order(F.col(row_id), self.seed + p * STRIDE).alias("h")) for p in range(self.n_permutations)])
        rows = df.select(F.col(row_id).alias("__id"), F.col(category).alias("__cat"), F.coalesce(value, F.lit(0.0)).alias("__v"), F.when(value.isNotNull(), 1).otherwise(0).cast("long").alias("__n"), F.explode(orders).alias("__o")).select("__id", "__cat", "__v", "__n", "__o.p", "__o.h")
        summed = running_totals(rows, ["h", "__id"], {"__total": F.col("__v"), "__count": F.col("__n")}, within=("p", "__cat"))
        means = summed.groupBy("__id").agg(F.avg(self.smoothed(F.col("__total") - F.col("__v"), F.col("__count") - F.col("__n"))).alias(output))
        return df.join(means, df[row_id] == means["__id"], "left").drop("__id")

    def fit(self, df: DataFrame, category: str, target: str) -> DataFrame:
        """(category, total, count) over all rows."""
        return df.groupBy(category).agg(F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)).alias("total"), F.count(target).alias("count"))

    def transform(self, df: DataFrame, stats: DataFrame, category: str, output: str = "encoded") -> DataFrame:
        """``df`` with full-data means; unseen categories get the prior. Whether
        the statistics are broadcast is left to their measured size."""
        held = stats.select(F.col(category).alias("__cat"), F.col("total").alias("__total"), F.col("count").alias("__count"))
        joined = df.join(held, df[category].eqNullSafe(held["__cat"]), "left")
        value = F.when(F.col("__count").isNull(), F.lit(float(self.prior))).otherwise(self.smoothed(F.col("__total"), F.col("__count")))
        return joined.withColumn(output, value).drop("__cat", "__total", "__count")
