"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veinworks import catalogue
from veinworks.functions.unary import IDENTITY, LOG, SQRT, SQUARE, TANH
from veinworks.operators import folds, scoring
from veinworks.plans import candidates as plans
from veinworks.plans import search

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def grid300(spark):
    """300 candidates over lineitem, five folds, in one pass."""
    grid = list(plans.grid(catalogue.FEATURES, [IDENTITY, LOG, SQRT, SQUARE, TANH], [0, 1]))
    return scoring.fold_sums(catalogue.lineitem(spark, SF_DIR), grid, F.col("charge"), folds.fold_of(F.col("l_orderkey"), 5, 42), "arrow")


def verify50(spark):
    """Five-fold verification of 50 candidates."""
    grid = list(plans.grid(catalogue.FEATURES, [IDENTITY, LOG, SQRT, SQUARE, TANH], [0, 1]))[:50]
    return search.verify(catalogue.lineitem(spark, SF_DIR), grid, F.col("charge"), "l_orderkey", catalogue._S_CONFIG, "arrow")


def permute25x50(spark):
    """25 permuted targets for 50 candidates, in one scoring pass."""
    grid = list(plans.grid(["f0", "f1", "f2"], [IDENTITY, LOG, SQRT, SQUARE, TANH], [0, 1]))[:50]
    rows = folds.permuted_targets(catalogue.signals(spark, SF_DIR), "event_id", "y", list(range(25)), ["f0", "f1", "f2"])
    return scoring.pearson_scores(scoring.fold_sums(rows, grid, F.col("y"), backend="arrow", targets=F.col("permuted")))


NAMED = ["stats12_fold", "candidate_scores", "all_metrics", "spearman_unary", "ts_window_stats", "ts_calculus", "ots_encode_multi", "quality_entropy_types", "scout_votes", "bootstrap_stability"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    jobs = {f.__name__: (lambda f=f: f(spark)) for f in (grid300, verify50, permute25x50)}
    jobs |= {n: (lambda n=n: catalogue.QUERIES[n](spark, SF_DIR)) for n in NAMED}
    spark.range(1000).selectExpr("sum(id)").collect()
    grid300(spark).collect()  # Python workers start, code is compiled
    took = {}
    for name, job in jobs.items():
        began = time.perf_counter()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    out = {"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "row_candidates_per_sec": round(rows * 300 / took["grid300"])}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
