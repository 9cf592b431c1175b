"""Where intermediate tables go, and numbering rows without a single task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: str | None = None
#: No table is cut into more ranges than this, so per-range summaries are bounded.
MAX_RANGES = 200_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, which all executors share; only where
    that is unset (a local session) in a temporary folder."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder")
    if not root:
        _own = _own or tempfile.mkdtemp(prefix="veinworks-")
        root = f"file://{_own}"
    return f"{root.rstrip('/')}/veinworks/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: later readers agree on its rows and a lost
    executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranges_for(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """By the size of the tables that ``df`` reads (over a petabyte: unknown)."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    floor = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return floor if size > 10**15 else max(floor, min(MAX_RANGES, size // bytes_each + 1))


def running_totals(df: DataFrame, order: list[str | Column], amounts: dict[str, Column], within: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with sums of the named amounts over the rows up to and with each, in
    ``order`` (which must be total), in each group of ``within``: ranged by group
    and order, so that a hot group is split; then offsets of ranges are added."""
    n = ranges_for(df)
    rows = df.withColumns({f"__amount_{k}": c for k, c in amounts.items()})
    rows = rows.repartitionByRange(n, *within, *order).withColumn("__range", F.spark_partition_id())
    local = Window.partitionBy("__range", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = written(rows.withColumns({f"__local_{k}": F.sum(f"__amount_{k}").over(local) for k in amounts}), "running")
    # One row for each range and group in it.
    totals = rows.groupBy("__range", *within).agg(*[F.sum(f"__amount_{k}").alias(f"__sum_{k}") for k in amounts])
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", *within, *[F.coalesce(F.sum(f"__sum_{k}").over(before), F.lit(0)).alias(f"__before_{k}") for k in amounts])
    joined = rows.join(offsets, ["__range", *within])
    made = joined.withColumns({k: F.col(f"__local_{k}") + F.col(f"__before_{k}") for k in amounts})
    return made.drop("__range", *[f"__{x}_{k}" for x in ("local", "before", "amount") for k in amounts])


def running_total(df: DataFrame, order: list[str | Column], amount: Column, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    return running_totals(df, order, {name: amount}, within)


def dense_index(df: DataFrame, order: list[str | Column], name: str = "row_index") -> DataFrame:
    """``df`` with 0-based places in ``order``."""
    return running_total(df, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)
