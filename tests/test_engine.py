"""Closed forms, planted signals, edge cases and properties."""

import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veinworks.config import ComputeBudget, EngineConfig, SearchConfig, TimeSeriesConfig
from veinworks.functions import interactions, unary
from veinworks.functions.statistics import pearson_number
from veinworks.operators import encoding, folds, metrics, quality, recipes, scoring, timeseries
from veinworks.operators.scoring import Candidate
from veinworks.operators.selector import InteractionSelector
from veinworks.plans import candidates as plans
from veinworks.plans import engine, search, strategy
from veinworks.sources import files
from veinworks.sources.files import TableSource, chunk_rows, from_arrays
from veinworks.storage import dense_index, running_total
from veinworks.streaming.online import online_correlation


def planted(spark, n=4000, f=6, noise=0.3, seed=42):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, f))
    return from_arrays(spark, x, x[:, 1] * x[:, 3] + noise * rng.standard_normal(n)), x


def test_search_finds_the_planted_product(spark):
    df, _ = planted(spark)
    found = search.Search(SearchConfig(operators=[0, 6], subsample_ratio=0.5)).search(df, [f"f{i}" for i in range(6)], F.col("y"), "row_id")
    assert found[0].candidate == Candidate(("f1", "f3"), (0, 0), (0,)) and found[0].val_r > 0.9 and found[0].overfit_gap < 0.05


def test_engine_end_to_end(spark):
    df, _ = planted(spark, n=600, f=4)
    config = EngineConfig(budget=ComputeBudget(top_features_for_higher_k=4), num_repeats=2, permutation_tests=19, metric_names=("pearson", "r2"))
    report = engine.Engine(config).analyze(df, [f"f{i}" for i in range(4)], "y", "row_id")
    best = report.interactions.orderBy(F.desc("strength")).first()
    assert best["combo"] == [1, 3] and list(best["features"]) == ["f1", "f3"] and report.decision.signal
    assert json.dumps(report.to_dict())
    p = report.permutations.collect()
    assert all(1 / 20 <= r["p_value"] <= 1 for r in p)


def test_strategies_agree(spark):
    df, _ = planted(spark, n=500)
    df = df.withColumn("f0", F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("f0"))).withColumn("f2", F.when(F.col("row_id") % 5 == 0, F.lit(None)).otherwise(F.col("f2")))
    grid = [Candidate(("f0", "f1"), (a, b), (k,)) for a in (0, 1, 4, 9) for b in (0, 5, 10) for k in range(6)][:20] + [Candidate(("f0", "f2", "f3"), (2, 3, 6), (3, 1)), Candidate(("f1", "f2"), (11, 0), (0,))]
    fold = folds.fold_of(F.col("row_id"), 5, 1)
    sums = [{(r["candidate"], r["fold"]): [r[k] for k in scoring.SUMS] for r in scoring.fold_sums(df, grid, F.col("y"), fold, b).collect()} for b in ("native", "arrow")]
    for key, value in sums[0].items():
        assert np.allclose(value, sums[1].get(key, [0] * 6), rtol=1e-9, atol=1e-9), key
    whole = scoring.fold_sums(df, grid, F.col("y"), backend="native").collect()
    for r in whole:  # folds add up to the whole
        assert np.isclose(r["sxy"], sum(v[5] for (c, _), v in sums[0].items() if c == r["candidate"]), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError, match="backend"):
        scoring.choose("cuda", 3)


def test_operators_by_closed_form(spark):
    xs = [-30.0, -1.5, -1e-9, 0.0, 1e-9, 0.5, 2.0, 30.0, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    with np.errstate(all="ignore"):
        for op in range(11):
            got = [r[0] for r in df.select(unary.unary(op, F.col("x"))).collect()]
            assert np.allclose(got, scoring.numpy_unary(op, np.array(xs)), equal_nan=True, rtol=1e-12), op
        a, b = F.col("x"), F.reverse(F.array(F.col("x")))[0] + 1
        for kind in range(6):
            got = [r[0] for r in df.select(interactions.combine(a, b, kind)).collect()]
            assert np.allclose(got, scoring.numpy_combine(np.array(xs), np.array(xs) + 1, kind), equal_nan=True, rtol=1e-12), kind
    with pytest.raises(ValueError, match="no unary"):
        unary.op_id("cosine")
    with pytest.raises(ValueError, match="interactions"):
        interactions.fold([a, a, a], [0])


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 300) / 3, rng.standard_normal(300)
    df = from_arrays(spark, np.column_stack([x, np.ones(300), 1e9 + x]), y)
    rows = metrics.long_form(df, {c: F.col(c) for c in ("f0", "f1", "f2")}, F.col("y"))
    got = {r["candidate"]: r for r in metrics.with_strength(metrics.score(rows)).collect()}

    def ranks(v):
        return np.array([(v < w).sum() + ((v == w).sum() - 1) / 2 for w in v])

    assert math.isclose(got["f0"]["pearson"], np.corrcoef(x, y)[0, 1], rel_tol=1e-9)
    assert math.isclose(got["f2"]["pearson"], np.corrcoef(x, y)[0, 1], rel_tol=1e-5)
    assert math.isclose(got["f0"]["spearman"], np.corrcoef(ranks(x), ranks(y))[0, 1], rel_tol=1e-9)
    h = np.histogram2d(x, y, 16)[0] / 300
    p = h[h > 0] * np.log(h[h > 0] / (h.sum(1, keepdims=True) @ h.sum(0, keepdims=True))[h > 0])
    assert math.isclose(got["f0"]["mutual_info"], p.sum(), rel_tol=1e-9)
    assert got["f1"]["pearson"] == got["f1"]["spearman"] == got["f1"]["strength"] == 0 and abs(got["f1"]["mutual_info"]) < 1e-12
    with pytest.raises(ValueError, match="unsupported"):
        metrics.score(rows, ("kendall",))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-50, 50), st.floats(-50, 50)), min_size=3, max_size=30), st.floats(0.1, 9), st.floats(-9, 9))
def test_pearson_is_affine(points, a, b):
    x, y = np.array(points).T
    sums = lambda x: (len(x), x.sum(), y.sum(), x @ x, y @ y, x @ y)
    if np.var(x) > 1e-3 and np.var(y) > 1e-3:
        assert math.isclose(pearson_number(*sums(x)), pearson_number(*sums(a * x + b)), abs_tol=1e-6)
    assert pearson_number(1, 2, 3, 4, 9, 6) == 0.0


def test_running_totals_over_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("aab"), rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, g string, v int")
    got = {r["i"]: r["t"] for r in running_total(df, ["v", "i"], F.col("v"), "t", within=("g",)).collect()}
    for g in "ab":
        total = 0
        for v, i in sorted((v, i) for i, h, v in rows if h == g):
            total += v
            assert got[i] == total
    assert sorted(r["row_index"] for r in dense_index(df, ["v", "i"]).collect()) == list(range(400))


def test_permutations_are_permutations(spark):
    df = spark.createDataFrame([(i, float(i % 11)) for i in range(200)], "id long, y double")
    rows = folds.permuted_targets(df, "id", "y", [1, 2]).collect()
    ys = sorted(r["y"] for r in rows)
    assert len(rows) == 200
    for k in range(2):
        assert sorted(r["permuted"][k] for r in rows) == ys and [r["permuted"][k] for r in rows] != [r["y"] for r in rows]
    weights = df.select(folds.bootstrap_weight(F.col("id"), 0, 7).alias("w")).agg(F.sum("w")).first()[0]
    assert 140 < weights < 260
    assert folds.sample(df, "id", 500, 1).count() == 200


def test_other_targets_in_the_same_pass(spark):
    df, _ = planted(spark, n=300)
    df = df.withColumn("f0", F.when(F.col("row_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("f0")))
    rows = folds.permuted_targets(df, "row_id", "y", [3, 4], ["f0", "f1"])
    grid = [Candidate(("f0", "f1"), (0, 1), (0,)), Candidate(("f1",), (6,))]
    got = {(r["candidate"], r["draw"]): r["pearson"] for r in scoring.pearson_scores(scoring.fold_sums(rows, grid, F.col("y"), backend="arrow", targets=F.col("permuted"))).collect()}
    assert len(got) == 6
    for k in range(2):
        alone = rows.withColumn("y", F.col("permuted")[k])
        for r in scoring.pearson_scores(scoring.fold_sums(alone, grid, F.col("y"), backend="native")).collect():
            assert math.isclose(r["pearson"], got[r["candidate"], k + 1], rel_tol=1e-9)


def test_plans():
    assert len(plans.window_pairs(5, 3)) == 7 and len(plans.window_pairs(5, 5)) == 10
    assert plans.grid_size(4, 5, 2) == len(list(plans.grid("abcd", range(5), range(2)))) == 300
    assert len(list(plans.grid("abcd", [0], [0], 3))) == 10
    assert plans.top_features({0: 0.1, 1: 0.5, 2: 0.5}, 2) == [1, 2] and plans.top_features({0: 1}, 0) == []
    with pytest.warns(UserWarning, match="budget"):
        assert len(plans.higher_order_plan(range(6), ComputeBudget(max_combinations_per_k=4), random.Random(1))) == 4
    assert len(plans.higher_order_plan(range(4), ComputeBudget(max_combinations_per_k=6), random.Random(1))) == 6
    with pytest.raises(ValueError, match="at least 1"):
        ComputeBudget(max_comb_size=0).problems(3)
    assert [strategy.choose(n, 10**6, 1000.0).mode for n in (10**4, 10**6, 10**7)] == ["full", "aggressive", "ensemble"]
    assert chunk_rows(4, 0.000001) == 1024


def test_time_series_edges(spark):
    rows = [(1, d, float(d * d), d) for d in range(6)] + [(2, 0, 5.0, 9)]
    df = spark.createDataFrame(rows, "cust_id int, d int, v double, k int").select("cust_id", F.expr("timestamp'2024-01-01' + make_interval(0,0,0,d)").alias("date"), "v", "k")
    cfg = TimeSeriesConfig(windows=[1, 2, 4], tiebreak=("k",), lags=[1], differentials=[1], rolling_windows=[2])
    out = {r["cust_id"]: r for r in timeseries.TimeSeries(cfg).aggregate_to_entity(df.select("cust_id", "date", "v", "k")).collect()}
    assert out[1]["v_w2_sum"] == 9 + 16 + 25 and out[1]["v_w4_first"] == 1 and out[1]["v_velocity_4"] == 6.0
    assert out[1]["v_accel_long"] == 0.0 and out[2]["v_w1_std"] == 0  # equal windows; one row
    with pytest.raises(ValueError, match="30"):
        timeseries.TimeSeries(TimeSeriesConfig(windows=[1, 2])).aggregate_to_entity(df)
    assert {"v_lag1", "v_diff1", "v_rmean2", "v_rstd2"} <= set(timeseries.TimeSeries(cfg).transform(df).columns)
    assert "v_rmean2" not in timeseries.differential_features(df, cfg).columns


def test_encoder(spark):
    rows = [(i, i % 5, float((i + 1) % 2)) for i in range(100)]
    df = spark.createDataFrame(rows, "i long, c int, y double")
    own = encoding.OrderedTargetEncoder()
    got = own.encode(df, "c", "y", "i").collect()
    assert len(got) == 100 and all(0 <= r["encoded"] <= 1 for r in got)
    seen = own.transform(spark.createDataFrame([(7, 99)], "i int, c int"), own.fit(df, "c", "y"), "c").first()
    assert seen["encoded"] == 0.5


def test_quality(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, float("inf")), (float("nan"), 3.0), (4.0, 4.0), (None, 5.0)], "a double, b double").withColumn("i", F.monotonically_increasing_id())
    got = {r["feature"]: r for r in quality.missing_by_feature(df, ["a", "b"]).collect()}
    assert (got["a"]["n_nan"], got["a"]["n_null"], got["b"]["n_pos_inf"]) == (1, 1, 1)
    assert sorted(r["a"] for r in quality.clean(df, ["a"], "median").collect()) == [1, 2, 2, 2, 4]
    assert [r["a"] for r in quality.clean(df, ["a"], "interpolate", order=["i"]).orderBy("i").collect()] == [1, 2, 3, 4, 4]
    assert quality.clean(df, ["a", "b"], "remove").count() == 2
    profile = quality.QualityProfile().entropy(spark.range(100).select(F.lit(1.0).alias("c"), F.col("id").cast("double").alias("u")), ["c", "u"])
    assert {r["feature"]: r["feature_type"] for r in profile.collect()} == {"c": "constant", "u": "unique_id"}
    assert quality.QualityProfile().lists(profile) == {"drop": ["c"], "id": ["u"], "categorical": []}
    assert "constant" in quality.QualityProfile().report(df.withColumn("c", F.lit(1.0)), ["a", "c"])


def test_recipes_round_trip(spark, tmp_path):
    df, _ = planted(spark, n=50)
    made = recipes.create([(Candidate(("f1", "f3"), (1, 0), (0,)), 0.5, 0.4, 3)])
    assert made[0].describe() == "log(f1) * f3"
    recipes.save(str(tmp_path / "r.json"), made, ["f1", "f3"], 50)
    back, meta = recipes.load(str(tmp_path / "r.json"))
    assert back == made and meta["n_recipes"] == 1
    scored = scoring.pearson_scores(scoring.fold_sums(df, [made[0].candidate], F.col("y"))).first()["pearson"]
    out = recipes.apply(df, back)
    assert math.isclose(out.select(F.corr(made[0].name, "y")).first()[0], scored, rel_tol=1e-9)
    with pytest.warns(UserWarning, match="skipped"):
        assert recipes.apply(df.drop("f1"), back).columns == df.drop("f1").columns
    recipes.save_enhanced(df, back, str(tmp_path / "out"), ["f1", "f3"], "row_id", "y")
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["row_id", "f1", "f3", made[0].name, "y"]


def test_selector(spark):
    df, _ = planted(spark, n=300)
    cols = [f"f{i}" for i in range(6)]
    model = InteractionSelector(cols, "y", k=3).fit(df)
    assert model.pairs[0] == ("f1", "f3") and len(model.transform(df).columns) == len(df.columns) + 3
    with pytest.raises(ValueError, match="operator"):
        InteractionSelector(cols, "y", operator="power").fit(df)
    with pytest.raises(ValueError, match="missing"):
        model.transform(df.drop("f0"))


def test_sources(spark, tmp_path):
    df, x = planted(spark, n=3000)
    df.write.csv(str(tmp_path / "t.csv"), header=True)
    df.write.parquet(str(tmp_path / "t.parquet"))
    source = TableSource(spark, str(tmp_path / "t.parquet"), target="y", features=["f0", "f1"])
    chunks = list(source.stream(1024, with_target=True))
    assert [len(c[0]) for c in chunks] == [1024, 1024, 952] and len(source) == 3000
    assert np.allclose(np.sort(np.concatenate([c[0][:, 0] for c in chunks])), np.sort(x[:, 0].astype(np.float32)))
    assert TableSource(spark, str(tmp_path / "t.csv")).schema["f0"] == "double"
    with pytest.raises(ValueError, match="only"):
        TableSource(spark, "t.orc")
    with pytest.raises(ValueError, match="target"):
        next(TableSource(spark, str(tmp_path / "t.parquet")).stream(with_target=True))
    with pytest.raises(ValueError, match="finite"):
        from_arrays(spark, [[float("nan")]], [1.0])
    with pytest.raises(ValueError, match="infinite"):
        engine.validate(df.withColumn("f0", F.lit(float("nan"))), ["f0"], "y")


def test_stream_equals_batch(spark, tmp_path):
    df, _ = planted(spark, n=400)
    df = df.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 600))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    wanted = [Candidate(("f1", "f3"), (0, 0), (0,)), Candidate(("f0", "f1"), (1, 0), (1,))]
    stream = online_correlation(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), wanted, F.col("y"), "ts")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("online").start()
    query.processAllAvailable()
    query.stop()
    key = lambda r: (r["window"]["start"], r["candidate"])
    got, want = (sorted(d.collect(), key=key) for d in (spark.table("online"), online_correlation(df, wanted, F.col("y"), "ts")))
    assert len(got) == len(want) and all(key(a) == key(b) and math.isclose(a["pearson"], b["pearson"], abs_tol=1e-9) for a, b in zip(got, want, strict=True))


def test_missing_file_and_sources(spark, sf_dir):
    import pandas as pd

    with pytest.raises(FileNotFoundError):
        files.TableSource(spark, f"{sf_dir}/none.parquet")
    source, size = files.open_source(spark, f"{sf_dir}/lineitem.parquet", "l_tax", ["l_quantity"])
    assert size == files.chunk_rows(1) and len(source) > 0
    assert files.from_frame(spark, pd.DataFrame({"a": [1, 2]})).count() == 2
    assert files.from_frame(spark, source.df) is source.df


def test_auto_plan():
    assert search.auto_plan(1000, 4, 1e9).mode == "full"
    assert search.auto_plan(10**9, 400, 10.0).mode != "full"


def test_sample_is_the_first_in_hash_order(spark, monkeypatch):
    monkeypatch.setattr(folds, "FEW", 3)
    df = spark.range(2000).withColumnRenamed("id", "k")
    for size in (0, 1, 700, 2000, 5000):
        want = df.orderBy(folds.hash_order(F.col("k"), 5), "k").limit(size)
        assert sorted(folds.sample(df, "k", size, 5).collect()) == sorted(want.collect())


def test_candidates_in_passes_with_gaps(spark, monkeypatch):
    """Blocks, passes, weights and targets give what plain sums give."""
    monkeypatch.setattr(scoring, "CANDIDATES_A_PASS", 2)
    rows = [(float(i % 7) if i % 5 else float("nan"), float(i % 11), float(i), i % 3, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int, w int")
    asked = [scoring.Candidate(("a", "b"), (0, 6), (0,)), scoring.Candidate(("a",), (0,)), scoring.Candidate(("a", "b", "b"), (0, 0, 3), (1, 2))]
    got = {(r.candidate, r.fold, r.draw): r for r in scoring.fold_sums(df, asked, F.col("y"), F.col("fold"), "arrow", [F.col("w")], F.array(-F.col("y"))).collect()}
    assert len(got) == 3 * 3 * 3
    for fold in range(3):
        own = [(a * b * b, y, w) for a, b, y, f, w in rows if f == fold and a == a]
        for draw, (sign, weigh) in enumerate(((1, False), (1, True), (-1, False))):
            r, n = got[0, fold, draw], [w if weigh else 1 for _, _, w in own]
            assert r.n == sum(n) and abs(r.sxy - sum(k * x * y * sign for k, (x, y, _) in zip(n, own, strict=True))) < 1e-6
