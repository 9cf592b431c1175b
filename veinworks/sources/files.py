"""Table scans in chunks, and checked in-memory sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import dense_index

GIB = 1 << 30
#: Share of a memory budget that a chunk may take, and the chunk's grain.
BUDGET_SHARE, GRAIN = 0.8, 1024
COMBINATIONS = 256


def chunk_rows(n_features: int, budget_gb: float = 6.0, n_combinations: int = COMBINATIONS) -> int:
    """Rows of a chunk whose features and combination values fit the budget."""
    room = budget_gb * GIB * BUDGET_SHARE - n_features * 4
    rows = int(room / (n_features * 4 + n_combinations * 4))
    return max(GRAIN, rows // GRAIN * GRAIN)


class TableSource:
    """A Parquet or CSV table of features and, perhaps, a target."""

    def __init__(self, spark: SparkSession, path: str, target: str | None = None, features: Sequence[str] | None = None):
        if not path.endswith((".parquet", ".csv")):
            raise ValueError(f"only .parquet and .csv are read: {path}")
        try:
            self.df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from e
            raise
        self.target = target
        if target is not None and target not in self.df.columns:
            raise ValueError(f"no column {target}")
        self.features = list(features) if features else [c for c in self.df.columns if c != target]
        self._rows: int | None = None

    @property
    def schema(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    def __len__(self) -> int:
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def project(self, with_target: bool = False, kind: str = "float") -> DataFrame:
        """Only the columns asked for reach the scan."""
        if with_target and self.target is None:
            raise ValueError("no target column was named")
        columns = self.features + ([self.target] if with_target else [])
        return self.df.select(*[F.col(c).cast(kind).alias(c) for c in columns])

    def chunk_ids(self, order: Sequence[str], size: int | None = None) -> DataFrame:
        """Features with row_index in ``order`` and chunk_id; numbered over ranges."""
        size = size or chunk_rows(len(self.features))
        return dense_index(self.df, list(order)).withColumn("chunk_id", F.floor(F.col("row_index") / size))

    def map_chunks(self, function: Callable[[np.ndarray, np.ndarray | None], pa.RecordBatch], schema: str, with_target: bool = False) -> DataFrame:
        """``function(X, y)`` on the executors, for each batch of rows."""
        rows, n = self.project(with_target), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                whole = np.ascontiguousarray(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]), dtype=np.float32)
                yield function(whole[:, :n], whole[:, n] if with_target else None)

        return rows.mapInArrow(run, schema)

    def stream(self, size: int | None = None, with_target: bool = False) -> Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]:
        """Chunks on the driver, in scan order, one partition at a time."""
        if with_target and self.target is None:
            raise ValueError("no target column was named")
        size = size or chunk_rows(len(self.features))
        held: list = []
        made = lambda rows: self._chunk(np.array(rows, dtype=np.float32), with_target)
        for row in self.project(with_target).toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            if len(held) == size:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def _chunk(self, whole: np.ndarray, with_target: bool):
        n = len(self.features)
        return (np.ascontiguousarray(whole[:, :n]), np.ascontiguousarray(whole[:, n])) if with_target else whole


def open_source(spark: SparkSession, path: str, target: str | None = None, features: Sequence[str] | None = None, budget_gb: float = 6.0) -> tuple[TableSource, int]:
    """The table at ``path`` and the rows of a chunk that fit the budget."""
    source = TableSource(spark, path, target, features)
    return source, chunk_rows(len(source.features), budget_gb)


def from_frame(spark: SparkSession, frame) -> DataFrame:
    """A DataFrame of a pandas, Polars or Arrow table, or of Spark itself."""
    if isinstance(frame, DataFrame):
        return frame
    return spark.createDataFrame(frame.to_arrow() if hasattr(frame, "to_arrow") else frame)


def from_arrays(spark: SparkSession, x, y, names: Sequence[str] | None = None) -> DataFrame:
    """row_id, features and y from array-likes, checked for shape and numbers."""
    x, y = np.asarray(x), np.asarray(y)
    if x.ndim != 2 or y.ndim != 1 or len(x) != len(y):
        raise ValueError("X must have two dimensions and y one, of equal length")
    if not (np.issubdtype(x.dtype, np.number) and np.issubdtype(y.dtype, np.number)):
        raise ValueError("X and y must be numeric")
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("X and y must be finite")
    names = list(names) if names is not None else [f"f{i}" for i in range(x.shape[1])]
    if len(names) != x.shape[1]:
        raise ValueError("one name for each feature")
    table = pa.table({"row_id": np.arange(len(x)), **{n: x[:, i].astype(np.float64) for i, n in enumerate(names)}, "y": y.astype(np.float64)})
    return spark.createDataFrame(table)


def finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, n_bad): cells that `from_arrays` would refuse."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"b{i}") for i, c in enumerate(columns)]
    row = df.agg(F.count("*").alias("n"), *bad)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col("n"), F.col(f"b{i}").alias("n_bad")) for i, c in enumerate(columns)])
    return row.select(F.explode(cells).alias("c")).select("c.*")
