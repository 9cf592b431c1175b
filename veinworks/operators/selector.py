"""A pyspark.ml estimator that appends the best pairwise interactions."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import METRICS, ComputeBudget
from ..functions.interactions import selector_pair
from ..plans.candidates import higher_order_plan
from ..plans.engine import combo_columns, validate
from . import metrics

OPERATORS = ("multiply", "add", "subtract", "divide")


class _Settings(Params):
    inputCols = Param(Params._dummy(), "inputCols", "features", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "target", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "pairs to append", TypeConverters.toInt)
    metric = Param(Params._dummy(), "metric", "pearson, spearman, mutual_info or r2", TypeConverters.toString)
    operator = Param(Params._dummy(), "operator", "multiply, add, subtract or divide", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(k=10, metric="pearson", operator="multiply", labelCol="label")


class InteractionSelector(Estimator, _Settings):
    """fit scores all pairs' centred products against the label and keeps the k of
    largest absolute metric; operands stand in column order."""

    def __init__(self, inputCols: Sequence[str] = (), labelCol: str = "label", k: int = 10, metric: str = "pearson", operator: str = "multiply"):
        super().__init__()
        self._set(inputCols=list(inputCols), labelCol=labelCol, k=k, metric=metric, operator=operator)

    def _fit(self, df: DataFrame) -> InteractionModel:
        metric, operator = self.getOrDefault("metric"), self.getOrDefault("operator")
        if metric not in METRICS:
            raise ValueError(f"metric must be one of {', '.join(METRICS)}")
        if operator not in OPERATORS:
            raise ValueError(f"operator must be one of {', '.join(OPERATORS)}")
        features, y = self.getOrDefault("inputCols"), self.getOrDefault("labelCol")
        means = validate(df, features, y)
        pairs = higher_order_plan(range(len(features)), ComputeBudget(), random.Random(7))
        pairs = [p for p in pairs if len(p) == 2]
        if not pairs:
            return InteractionModel([], operator, features)
        rows = metrics.long_form(df, combo_columns(pairs, features, means), F.col(y))
        scored = metrics.score(rows, (metric,) if metric == "pearson" else ("pearson", metric))
        best = scored.orderBy(F.desc(F.abs(metric)), metrics.KEY).limit(self.getOrDefault("k")).collect()
        chosen = [tuple(int(i) for i in r[metrics.KEY].split(",")) for r in best]
        return InteractionModel([(features[i], features[j]) for i, j in chosen], operator, features)


class InteractionModel(Transformer):
    def __init__(self, pairs: list[tuple[str, str]], operator: str, features: list[str]):
        super().__init__()
        self.pairs, self.operator, self.features = pairs, operator, features

    def _transform(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"features missing: {', '.join(missing)}")
        made = {f"{a}_{self.operator}_{b}": selector_pair(F.col(a).cast("double"), F.col(b).cast("double"), self.operator) for a, b in self.pairs}
        return df.withColumns(made) if made else df
