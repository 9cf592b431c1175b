"""Recipes: candidates that can be applied to any DataFrame, and stored."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.interactions import ADD, DIV, SUB, fold
from ..functions.unary import EXP, SIGMOID, clamp, unary
from .scoring import Candidate

VERSION = "1.0"


@dataclass
class Recipe:
    name: str
    columns: list[str]
    ops: list[int]
    kinds: list[int]
    train_r: float = 0.0
    val_r: float = 0.0
    scout_votes: int = 0

    @property
    def candidate(self) -> Candidate:
        return Candidate(tuple(self.columns), tuple(self.ops), tuple(self.kinds))

    def describe(self) -> str:
        return self.candidate.describe()

    def column(self, compat: bool = False) -> Column:
        """The value that the search scored. ``compat``: clamps at 10 and divides
        by b + 1e-8, as older stored recipes were applied."""
        if not compat:
            return self.candidate.column()

        def one(op: int, c: Column) -> Column:
            c = c.cast("double")
            if op == EXP:
                return F.exp(clamp(c, 10.0))
            if op == SIGMOID:
                return 1 / (1 + F.exp(-clamp(c, 10.0)))
            return unary(op, c)

        out = one(self.ops[0], F.col(self.columns[0]))
        for c, o, k in zip(self.columns[1:], self.ops[1:], self.kinds, strict=True):
            value = one(o, F.col(c))
            out = out / (value + 1e-8) if k == DIV else fold([out, value], k if k in (ADD, SUB) else 0)
        return out


def create(candidates: Sequence[tuple[Candidate, float, float, int]]) -> list[Recipe]:
    """From (candidate, train r, validation r, votes), in order."""
    return [Recipe(f"vein_{i}_{'_'.join(c.columns)}", list(c.columns), list(c.ops), list(c.kinds), t, v, n) for i, (c, t, v, n) in enumerate(candidates)]


def apply(df: DataFrame, recipes: Sequence[Recipe], compat: bool = False) -> DataFrame:
    """``df`` with a column for each recipe whose columns it has."""
    made: dict[str, Column] = {}
    for r in recipes:
        if missing := set(r.columns) - set(df.columns):
            warnings.warn(f"recipe {r.name} skipped: no column {', '.join(sorted(missing))}", stacklevel=2)
        else:
            made[r.name] = r.column(compat)
    return df.withColumns(made) if made else df


def save(path: str, recipes: Sequence[Recipe], feature_names: Sequence[str], n_samples: int) -> None:
    body = {"version": VERSION, "n_features": len(feature_names), "n_samples": n_samples, "n_recipes": len(recipes), "feature_names": list(feature_names), "recipes": [asdict(r) for r in recipes]}
    Path(path).write_text(json.dumps(body, indent=2))


def load(path: str) -> tuple[list[Recipe], dict]:
    body = json.loads(Path(path).read_text())
    return [Recipe(**r) for r in body.pop("recipes")], body


def save_enhanced(df: DataFrame, recipes: Sequence[Recipe], path: str, features: Sequence[str], row_id: str | None = None, target: str | None = None, fmt: str = "csv") -> None:
    """Features and the given recipes' columns, id first and target last."""
    out = apply(df, recipes)
    made = [r.name for r in recipes if r.name in out.columns]
    out = out.select(*([row_id] if row_id else []), *features, *made, *([target] if target else []))
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
