"""Online correlation: the additive sums as a Structured Streaming aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import SUMS, pearson_columns, usable
from ..operators.scoring import Candidate


def online_correlation(stream: DataFrame, candidates: Sequence[Candidate], y: Column, time: str, window: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window, candidate, n, pearson) of each event-time window. The state of a
    window is six sums for each candidate; it goes with the watermark. Works on a
    batch DataFrame as well."""
    cells = F.array(*[F.struct(F.lit(c.signature).alias("candidate"), c.column().cast("double").alias("x")) for c in candidates])
    rows = stream.withWatermark(time, late).select(F.col(time).alias("t"), y.cast("double").alias("y"), F.explode(cells).alias("c")).select("t", "y", "c.candidate", "c.x")
    rows = rows.where(usable(F.col("x"), F.col("y")))
    x, v = F.col("x"), F.col("y")
    terms = dict(zip(SUMS, (F.lit(1), x, v, x * x, v * v, x * v), strict=True))
    sums = rows.groupBy(F.window("t", window, slide or window), "candidate").agg(*[F.sum(t).alias(k) for k, t in terms.items()])
    return sums.select("window", "candidate", F.col("n").cast("long").alias("n"), pearson_columns().alias("pearson"))
