"""The registered queries over the driver's tables, each with its SQL.

Floats are rounded on both sides: sums depend on the order of addition. Random
choices (folds, samples, weights, orders) are functions of row id and seed, so
SQL can state them too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ComputeBudget, EngineConfig, SearchConfig, TimeSeriesConfig
from .functions import interactions, unary
from .operators import encoding, folds, metrics, quality, recipes, scoring, selector, timeseries
from .plans import candidates as plans
from .plans import engine, search, strategy
from .sources.files import TableSource, chunk_rows, finite_counts
from .streaming.online import online_correlation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHARGE_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
WINDOWS = [1, 3, 7, 14, 30]


def register(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: Column, digits: int = 6) -> Column:
    """Rounded by the same arithmetic as `q` (a value half-way goes up, whatever the
    last digits of its sum); -0.0 as 0.0."""
    scale = 10.0**digits
    x = c.cast("double")
    return F.when(F.isnan(x), x).otherwise(F.floor(x * F.lit(scale) + 0.500001).cast("double") / F.lit(scale) + F.lit(0.0))


def q(sql: str, digits: int = 6) -> str:
    scale = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(CAST({sql} AS DOUBLE) * {scale} + 0.500001) / {scale} + 0.0)"


# --- inputs -----------------------------------------------------------------


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *FEATURES).withColumn("charge", F.expr(CHARGE_SQL))


LINEITEM_SQL = f"SELECT l_orderkey, {', '.join(FEATURES)}, {CHARGE_SQL} AS charge FROM lineitem"


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with three features and a target that is the product of two."""
    e = table(spark, sf_dir, "events")
    made = e.select("event_id", "user_id", "ts", "event_type", (F.col("value") / 100).alias("f0"), ((F.col("event_id") * 37 % 101) / 50.0).alias("f1"), (F.hour("ts") / 24.0).alias("f2"))
    return made.withColumn("y", F.col("f0") * F.col("f1") + 0.1 * ((F.col("event_id") * 7919 % 211) / 211.0))


SIGNALS_SQL = """SELECT *, f0 * f1 + 0.1 * ((event_id * 7919 % 211) / CAST(211.0 AS DOUBLE)) AS y FROM (
  SELECT event_id, user_id, ts, event_type, value / 100 AS f0, (event_id * 37 % 101) / CAST(50.0 AS DOUBLE) AS f1, extract(hour FROM ts) / CAST(24.0 AS DOUBLE) AS f2 FROM events)"""


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with NaN, infinite and null values, a constant, an id and a category."""
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).when(F.col("event_id") % 19 == 0, F.lit(float("inf"))).when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(F.col("value"))
    return e.select("event_id", "ts", v.cast("double").alias("holed"), F.lit(3.0).alias("fixed"), F.col("event_id").cast("double").alias("ident"), (F.col("event_id") % 7).cast("double").alias("kind"), (F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(1.5)).cast("double").alias("gappy"))


HOLED_SQL = """SELECT event_id, ts, CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 19 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 23 = 0 THEN NULL ELSE value END AS holed,
  CAST(3.0 AS DOUBLE) AS fixed, CAST(event_id AS DOUBLE) AS ident, CAST(event_id % 7 AS DOUBLE) AS kind, CAST(CASE WHEN event_id % 3 = 0 THEN NULL ELSE 1.5 END AS DOUBLE) AS gappy FROM events"""
HOLED = ["holed", "fixed", "ident", "kind", "gappy"]

# --- SQL of the expressions -------------------------------------------------


def op_sql(op: int, x: str) -> str:
    clamp = lambda n: f"least(greatest({x}, -{n}.0), {n}.0)"
    return {
        0: x, 1: f"ln(abs({x}) + 1e-8)", 2: f"exp({clamp(20)})", 3: f"sqrt(abs({x}))", 4: f"((exp(2 * {clamp(10)}) - 1) / (exp(2 * {clamp(10)}) + 1))", 5: f"(1 / (1 + exp(-({clamp(20)}))))",
        6: f"({x}) * ({x})", 7: f"-({x})", 8: f"abs({x})", 9: f"(1 / ({off_zero_sql(x)}))", 10: f"({x}) * ({x}) * ({x})",
    }[op]


def off_zero_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) < 1e-8 THEN CASE WHEN {x} < 0 THEN -1e-8 ELSE 1e-8 END ELSE {x} END"


def kind_sql(kind: int, a: str, b: str) -> str:
    if kind in (4, 5):
        return f"CASE WHEN isnan({a}) THEN {b} WHEN isnan({b}) THEN {a} ELSE {'greatest' if kind == 4 else 'least'}({a}, {b}) END"
    return {0: f"({a}) * ({b})", 1: f"({a}) + ({b})", 2: f"({a}) - ({b})", 3: f"({a}) / ({off_zero_sql(b)})"}[kind]


def lcg_sql(x: str, seed: int, rounds: int = 1) -> str:
    out = f"(CAST({x} AS BIGINT) + {seed})"
    for _ in range(rounds):
        out = f"((({out} % 2147483648) * 1103515245 + 12345) % 2147483648)"
    return out


def fold_sql(x: str, n: int, seed: int) -> str:
    return f"CAST(floor({lcg_sql(x, seed, 2)} * {n} / CAST(2147483648.0 AS DOUBLE)) AS INTEGER)"


def pearson_sql(n: str, sx: str, sy: str, sxx: str, syy: str, sxy: str) -> str:
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return f"CASE WHEN {n} < 2 OR {vx} <= abs({n} * {sxx}) * 1e-14 OR {vy} <= abs({n} * {syy}) * 1e-14 THEN 0.0 ELSE ({n} * {sxy} - {sx} * {sy}) / sqrt({vx} * {vy}) END"


SUMS_SQL = "CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy"
R_SQL = pearson_sql("n", "sx", "sy", "sxx", "syy", "sxy")


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


# --- sources ----------------------------------------------------------------


@register("SELECT count(*) AS n_rows, CAST(sum(l_quantity) AS BIGINT) AS quantity, CAST(6 AS INTEGER) AS n_columns FROM lineitem")
def scan_project_count(spark, sf_dir):
    source = TableSource(spark, f"{sf_dir}/lineitem.parquet", target="l_tax", features=["l_quantity", "l_extendedprice", "l_discount", "l_orderkey", "l_partkey"])
    return source.project(True, "double").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").cast("long").alias("quantity")).withColumn("n_columns", F.lit(len(source.features) + 1))


@register(f"SELECT CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 1000) AS BIGINT) AS chunk_id, event_id, {q('value', 4)} AS value FROM events")
def chunk_ids(spark, sf_dir):
    rows = TableSource(spark, f"{sf_dir}/events.parquet", features=["value"]).chunk_ids(["event_id"], 1000)
    return rows.select("chunk_id", "event_id", r(F.col("value"), 4).alias("value"))


@register("SELECT CAST(rows AS INTEGER) AS rows, n FROM (VALUES (3934208, 1), (1024, 2)) t(rows, n)")
def batch_size_estimate(spark, sf_dir):
    made = [(chunk_rows(4, 4.764), 1), (chunk_rows(100, 0.0001), 2)]
    return spark.createDataFrame(made, "rows int, n int")


@register("SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v) OR abs(v) = CAST('Infinity' AS DOUBLE)) AS n_bad FROM (" + union([f"SELECT '{c}' AS feature, {c} AS v FROM ({HOLED_SQL})" for c in HOLED]) + ") GROUP BY feature")
def validate_finite(spark, sf_dir):
    return finite_counts(holed(spark, sf_dir), HOLED)


# --- expressions ------------------------------------------------------------

_X = "(value / 100 - 2)"


@register(union([f"SELECT event_id, '{unary.NAMES[o]}' AS op, {q(op_sql(o, _X))} AS v FROM events" for o in range(11)]))
def unary_ops_all(spark, sf_dir):
    x = F.col("value") / 100 - 2
    cells = F.array(*[F.struct(F.lit(unary.NAMES[o]).alias("op"), r(unary.unary(o, x)).alias("v")) for o in range(11)])
    return table(spark, sf_dir, "events").select("event_id", F.explode(cells).alias("c")).select("event_id", "c.*")


_A, _B = "(value / 100 - 2)", "CASE WHEN event_id % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 7 - 3 AS DOUBLE) END"


@register(union([f"SELECT event_id, '{interactions.NAMES[k]}' AS kind, {q(kind_sql(k, 'a', 'b'), 4)} AS v FROM (SELECT event_id, {_A} AS a, {_B} AS b FROM events)" for k in range(6)]))
def interactions_all(spark, sf_dir):
    a = F.col("value") / 100 - 2
    b = F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(0.0)).otherwise((F.col("event_id") % 7 - 3).cast("double"))
    cells = F.array(*[F.struct(F.lit(interactions.NAMES[k]).alias("kind"), r(interactions.combine(F.col("a"), F.col("b"), k), 4).alias("v")) for k in range(6)])
    return table(spark, sf_dir, "events").select("event_id", a.alias("a"), b.alias("b")).select("event_id", F.explode(cells).alias("c")).select("event_id", "c.*")


@register(union([f"SELECT event_id, '{interactions.NAMES[k]}' AS kind, {q(kind_sql(k, '(' + kind_sql(k, 'f0', 'f1') + ')', '(f2 + 1)'))} AS v FROM ({SIGNALS_SQL})" for k in range(4)]))
def nary_fold_same(spark, sf_dir):
    values = [F.col("f0"), F.col("f1"), F.col("f2") + 1]
    cells = F.array(*[F.struct(F.lit(interactions.NAMES[k]).alias("kind"), r(interactions.fold(values, k)).alias("v")) for k in range(4)])
    return signals(spark, sf_dir).select("event_id", F.explode(cells).alias("c")).select("event_id", "c.*")


@register(f"SELECT event_id, {q('(ln(abs(f0) + 1e-8) * f1 + f2) - f0')} AS v FROM ({SIGNALS_SQL})")
def nary_fold_mixed(spark, sf_dir):
    made = interactions.candidate(["f0", "f1", "f2", "f0"], [1, 0, 0, 0], [0, 1, 2])
    return signals(spark, sf_dir).select("event_id", r(made).alias("v"))


_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]
_PRODUCTS = {f"{i},{j}": f"({FEATURES[i]} - m{i}) * ({FEATURES[j]} - m{j})" for i, j in _PAIRS}
_MEANS = ", ".join(f"avg({c}) OVER () AS m{i}" for i, c in enumerate(FEATURES))


@register(union([f"SELECT '{k}' AS combo, count(*) AS n, {q(f'avg({v})', 4)} AS mean FROM (SELECT *, {_MEANS} FROM ({LINEITEM_SQL}))" for k, v in _PRODUCTS.items()]))
def centered_product_pairs(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    means = engine.validate(df, FEATURES, "charge")
    cols = engine.combo_columns(_PAIRS, FEATURES, means)
    rows = metrics.long_form(df, cols, F.col("charge"))
    return rows.groupBy(F.col(metrics.KEY).alias("combo")).agg(F.count("*").alias("n"), r(F.avg("x"), 4).alias("mean"))


# --- sums and correlations --------------------------------------------------

_CANDIDATES = list(plans.grid(["l_extendedprice", "l_discount"], [0, 1, 3, 6], [0, 1]))


def _candidate_sql(i: int) -> str:
    c = _CANDIDATES[i]
    x = kind_sql(c.kinds[0], op_sql(c.ops[0], c.columns[0]), op_sql(c.ops[1], c.columns[1]))
    return f"SELECT {i} AS candidate, {fold_sql('l_orderkey', 5, 42)} AS fold, CAST({x} AS DOUBLE) AS x, charge AS y FROM ({LINEITEM_SQL})"


def _folded(n: int) -> str:
    return f"SELECT candidate, fold, {SUMS_SQL} FROM ({union([_candidate_sql(i) for i in range(n)])}) GROUP BY candidate, fold"


_TRAIN = {k: f"(t.{k} - f.{k})" for k in ("n", "sx", "sy", "sxx", "syy", "sxy")}
_TV = f"""WITH f AS ({{folded}}), t AS (SELECT candidate, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(syy) AS syy, sum(sxy) AS sxy FROM f GROUP BY candidate),
tv AS (SELECT f.candidate, f.fold, {pearson_sql(*_TRAIN.values())} AS train_r, {pearson_sql(*['f.' + k for k in _TRAIN])} AS val_r, {_TRAIN['n']} AS train_n, f.n AS val_n FROM f JOIN t USING (candidate))
"""


def _sums(spark, sf_dir, n, backend) -> DataFrame:
    return scoring.fold_sums(lineitem(spark, sf_dir), _CANDIDATES[:n], F.col("charge"), folds.fold_of(F.col("l_orderkey"), 5, 42), backend)


@register(f"SELECT CAST(candidate AS INTEGER) AS candidate, fold, CAST(n AS BIGINT) AS n, {q('sx / n', 4)} AS mean_x, {q('sy / n', 4)} AS mean_y, {q('sxy / n / 1000', 3)} AS mean_xy FROM ({_folded(6)})")
def stats12_fold(spark, sf_dir):
    s = _sums(spark, sf_dir, 6, "native")
    return s.select("candidate", "fold", F.col("n").cast("long").alias("n"), r(F.col("sx") / F.col("n"), 4).alias("mean_x"), r(F.col("sy") / F.col("n"), 4).alias("mean_y"), r(F.col("sxy") / F.col("n") / 1000, 3).alias("mean_xy"))


@register(_TV.format(folded=_folded(6)) + f"SELECT CAST(candidate AS INTEGER) AS candidate, fold, {q('train_r')} AS train_r, {q('val_r')} AS val_r, CAST(train_n AS BIGINT) AS train_n, CAST(val_n AS BIGINT) AS val_n FROM tv")
def pearson_train_val(spark, sf_dir):
    tv = scoring.train_and_validation(_sums(spark, sf_dir, 6, "native"))
    return tv.select("candidate", "fold", r(F.col("train_r")).alias("train_r"), r(F.col("val_r")).alias("val_r"), F.col("train_n").cast("long").alias("train_n"), F.col("val_n").cast("long").alias("val_n"))


@register(_TV.format(folded=_folded(32)) + f"SELECT CAST(candidate AS INTEGER) AS candidate, {q('train_r')} AS train_r, {q('val_r')} AS val_r FROM tv WHERE fold = 0")
def candidate_scores(spark, sf_dir):
    tv = scoring.train_and_validation(_sums(spark, sf_dir, 32, "arrow"), 0)
    return tv.select("candidate", r(F.col("train_r")).alias("train_r"), r(F.col("val_r")).alias("val_r"))


_LONG = union([f"SELECT '{i}' AS c, CAST({f} AS DOUBLE) AS x, charge AS y FROM ({LINEITEM_SQL})" for i, f in enumerate(FEATURES)])
_R_BY = f"SELECT c, {R_SQL} AS pearson FROM (SELECT c, {SUMS_SQL} FROM (SELECT c, x - avg(x) OVER (PARTITION BY c) AS x, y - avg(y) OVER (PARTITION BY c) AS y FROM ({{rows}})) GROUP BY c)"
_RANKED = "SELECT c, x AS x0, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / CAST(2.0 AS DOUBLE) - 1 AS x, rank() OVER (PARTITION BY c ORDER BY y) + (count(*) OVER (PARTITION BY c, y) - 1) / CAST(2.0 AS DOUBLE) - 1 AS y FROM ({rows})"
_CELLS = """SELECT c, bin_x, bin_y, count(*) AS n FROM (SELECT c, least(CASE WHEN x1 > x0 THEN CAST(floor((x - x0) / (x1 - x0) * 16) AS INTEGER) ELSE 0 END, 15) AS bin_x, least(CASE WHEN y1 > y0 THEN CAST(floor((y - y0) / (y1 - y0) * 16) AS INTEGER) ELSE 0 END, 15) AS bin_y
  FROM (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM ({rows}) WINDOW w AS (PARTITION BY c))) GROUP BY c, bin_x, bin_y"""
_MI = "SELECT c, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT c, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY c) AS DOUBLE) AS t, CAST(sum(n) OVER (PARTITION BY c, bin_x) AS DOUBLE) AS nx, CAST(sum(n) OVER (PARTITION BY c, bin_y) AS DOUBLE) AS ny FROM (" + _CELLS + ")) GROUP BY c"


def _metrics_sql(rows: str) -> str:
    return f"""SELECT p.c AS candidate, {q('pearson')} AS pearson, {q('spearman')} AS spearman, {q('mi')} AS mutual_info, {q('pearson * pearson')} AS r2, {q('greatest(abs(pearson), abs(spearman), mi, pearson * pearson)')} AS strength
FROM ({_R_BY.format(rows=rows)}) p JOIN (SELECT c, pearson AS spearman FROM ({_R_BY.format(rows=_RANKED.format(rows=rows))})) s USING (c) JOIN ({_MI.format(rows=rows)}) m USING (c)"""


def unary_rows(spark, sf_dir) -> DataFrame:
    return metrics.long_form(lineitem(spark, sf_dir), {str(i): F.col(c) for i, c in enumerate(FEATURES)}, F.col("charge"))


@register(f"SELECT c AS candidate, {q('pearson')} AS pearson FROM ({_R_BY.format(rows=_LONG)})")
def pearson_unary(spark, sf_dir):
    return metrics.pearson(unary_rows(spark, sf_dir)).select("candidate", r(F.col("pearson")).alias("pearson"))


@register(f"SELECT c AS candidate, {q('x0', 4)} AS x, {q('min(x)', 1)} AS rx FROM ({_RANKED.format(rows=_LONG)}) GROUP BY c, x0")
def rank_avg(spark, sf_dir):
    ranks = metrics.average_ranks(unary_rows(spark, sf_dir), "x", "rx")
    return ranks.select("candidate", r(F.col("x"), 4).alias("x"), r(F.col("rx"), 1).alias("rx"))


@register(f"SELECT c AS candidate, {q('pearson')} AS spearman FROM ({_R_BY.format(rows=_RANKED.format(rows=_LONG))})")
def spearman_unary(spark, sf_dir):
    found = metrics.spearman_shared(lineitem(spark, sf_dir), {str(i): F.col(c) for i, c in enumerate(FEATURES)}, F.col("charge"))
    return found.select("candidate", r(F.col("spearman")).alias("spearman"))


@register(f"SELECT c AS candidate, bin_x, bin_y, n FROM ({_CELLS.format(rows=_LONG)})")
def hist2d(spark, sf_dir):
    return metrics.histogram(unary_rows(spark, sf_dir), 16)


@register(f"SELECT c AS candidate, {q('mi')} AS mutual_info FROM ({_MI.format(rows=_LONG)})")
def mutual_info(spark, sf_dir):
    return metrics.mutual_info(unary_rows(spark, sf_dir)).select("candidate", r(F.col("mutual_info")).alias("mutual_info"))


@register(f"SELECT c AS candidate, {q('pearson * pearson')} AS r2 FROM ({_R_BY.format(rows=_LONG)})")
def r2(spark, sf_dir):
    return metrics.score(unary_rows(spark, sf_dir), ("r2",)).select("candidate", r(F.col("r2")).alias("r2"))


@register(f"SELECT candidate, strength FROM ({_metrics_sql(_LONG)}) ORDER BY strength DESC, candidate LIMIT 3")
def strength_top_features(spark, sf_dir):
    scored = metrics.with_strength(metrics.score(unary_rows(spark, sf_dir)))
    return scored.select("candidate", r(F.col("strength")).alias("strength")).orderBy(F.desc("strength"), "candidate").limit(3)


_PAIR_ROWS = union([f"SELECT '{k}' AS c, {v} AS x, charge AS y FROM (SELECT *, {_MEANS} FROM ({LINEITEM_SQL}))" for k, v in _PRODUCTS.items()])
_PAIR_R = f"SELECT c AS candidate, pearson FROM ({_R_BY.format(rows=_PAIR_ROWS)})"


@register(f"SELECT candidate, {q('pearson')} AS pearson, {q('pearson * pearson')} AS r2 FROM ({_PAIR_R})")
def pair_scores(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    cols = engine.combo_columns(_PAIRS, FEATURES, engine.validate(df, FEATURES, "charge"))
    scored = metrics.score(metrics.long_form(df, cols, F.col("charge")), ("pearson", "r2"))
    return scored.select("candidate", r(F.col("pearson")).alias("pearson"), r(F.col("r2")).alias("r2"))


_SIGNAL_ROWS = union([f"SELECT '{i}' AS c, CAST(f{i} AS DOUBLE) AS x, y FROM ({SIGNALS_SQL})" for i in range(3)])


@register(_metrics_sql(_SIGNAL_ROWS))
def all_metrics(spark, sf_dir):
    scored = engine.Engine().score(signals(spark, sf_dir), _e_columns(), "y")
    return scored.select("candidate", *[r(F.col(c)).alias(c) for c in ("pearson", "spearman", "mutual_info", "r2", "strength")])


# --- plans ------------------------------------------------------------------

_GRID = "SELECT CAST(a.i AS INTEGER) AS a, CAST(b.i AS INTEGER) AS b, CAST(o.op AS INTEGER) AS op_a, CAST(p.op AS INTEGER) AS op_b, CAST(k.kind AS INTEGER) AS kind FROM (SELECT unnest(range(4)) AS i) a JOIN (SELECT unnest(range(4)) AS i) b ON a.i < b.i CROSS JOIN (VALUES (0), (1), (3), (6), (4)) o(op) CROSS JOIN (VALUES (0), (1), (3), (6), (4)) p(op) CROSS JOIN (VALUES (0), (1)) k(kind)"


@register(_GRID)
def candidate_grid(spark, sf_dir):
    one = lambda values, name: spark.createDataFrame([(v,) for v in values], f"{name} int")
    rows = plans.grid_frame(one(range(4), "i"), one([0, 1, 3, 6, 4], "op"), one([0, 1], "kind"))
    return plans.canonical(rows)


@register("SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CAST(greatest(0, j - 2) AS INTEGER) AS first FROM (SELECT unnest(range(5)) AS j) b JOIN (SELECT unnest(range(5)) AS i) a ON i < j AND j - i < 3")
def window_pairs(spark, sf_dir):
    return spark.createDataFrame(plans.window_pairs(5, 3), "i int, j int, first int")


@register("SELECT CAST(floor(i / 96) AS INTEGER) AS batch, count(*) AS n FROM (SELECT unnest(range(200)) AS i) GROUP BY 1")
def batches(spark, sf_dir):
    rows = spark.range(200).withColumnRenamed("id", "i")
    return plans.batches(rows, ["i"], 96).groupBy("batch").agg(F.count("*").alias("n"))


@register("SELECT n_features, n_pairs FROM (VALUES (4, CAST(300 AS BIGINT)), (100, CAST(4276800 AS BIGINT))) t(n_features, n_pairs)")
def combination_count(spark, sf_dir):
    return spark.createDataFrame([(4, plans.grid_size(4, 5, 2)), (100, plans.grid_size(100, 12, 6))], "n_features int, n_pairs long")


@register("SELECT mode, CAST(scouts AS INTEGER) AS scouts, CAST(ratio AS DOUBLE) AS ratio, CAST(seconds AS DOUBLE) AS seconds FROM (VALUES ('full', 1, 1.0, 20.0), ('aggressive', 1, 0.135, 2000.0), ('ensemble', 3, 0.0135, 20000.0)) t(mode, scouts, ratio, seconds)")
def strategy_cost(spark, sf_dir):
    made = [strategy.choose(n, 1_000_000, 1000.0) for n in (10_000, 1_000_000, 10_000_000)]
    return spark.createDataFrame([(s.mode, s.n_scouts, round(s.subsample_ratio, 6), round(s.estimated_time, 6)) for s in made], "mode string, scouts int, ratio double, seconds double")


# --- scouts, votes, verification --------------------------------------------

_S_CANDIDATES = list(plans.grid(["f0", "f1", "f2"], [0, 1, 3], [0, 1]))
_S_CONFIG = SearchConfig(n_scouts=3, subsample_ratio=0.3, min_samples=200, top_k_per_scout=20, min_correlation=0.05, min_votes=2, operators=[0, 1, 3], interactions=[0, 1])


def _s_rows(source: str, fold_seed: int) -> str:
    parts = []
    for i, c in enumerate(_S_CANDIDATES):
        x = kind_sql(c.kinds[0], op_sql(c.ops[0], c.columns[0]), op_sql(c.ops[1], c.columns[1]))
        parts.append(f"SELECT {i} AS candidate, {fold_sql('event_id', 5, fold_seed)} AS fold, CAST({x} AS DOUBLE) AS x, y FROM ({source})")
    return f"SELECT candidate, fold, {SUMS_SQL} FROM ({union(parts)}) GROUP BY candidate, fold"


def _scout_sql(s: int) -> str:
    size = "(SELECT CAST(least(count(*), greatest(200, floor(count(*) * 0.3))) AS BIGINT) FROM events)"
    source = f"SELECT * FROM ({SIGNALS_SQL}) ORDER BY md5(concat(event_id, ':', {s})), event_id LIMIT {size}"
    return f"SELECT {s} AS scout, candidate, train_r, val_r FROM ({_TV.format(folded=_s_rows(source, s))} SELECT * FROM tv WHERE fold = 0)"


_SCOUTS = f"SELECT scout, candidate, train_r, val_r FROM (SELECT *, row_number() OVER (PARTITION BY scout ORDER BY abs(train_r) DESC, candidate) AS place FROM ({union([_scout_sql(s) for s in range(3)])}) WHERE abs(train_r) >= 0.05) WHERE place <= 20"


def _scouts(spark, sf_dir) -> DataFrame:
    df = signals(spark, sf_dir)
    return search.scout_scores(df, _S_CANDIDATES, F.col("y"), "event_id", _S_CONFIG, df.count(), "arrow")


@register(f"SELECT CAST(scout AS INTEGER) AS scout, CAST(candidate AS INTEGER) AS candidate, {q('train_r')} AS train_r, {q('val_r')} AS val_r FROM ({_SCOUTS})")
def topk_candidates(spark, sf_dir):
    return _scouts(spark, sf_dir).select("scout", "candidate", r(F.col("train_r")).alias("train_r"), r(F.col("val_r")).alias("val_r"))


@register(f"SELECT CAST(candidate AS INTEGER) AS candidate, count(*) AS votes, {q('avg(abs(train_r))')} AS avg_correlation FROM ({_SCOUTS}) GROUP BY candidate HAVING count(*) >= 2")
def scout_votes(spark, sf_dir):
    return search.vote(_scouts(spark, sf_dir), 2).select("candidate", "votes", r(F.col("avg_correlation")).alias("avg_correlation"))


@register(_TV.format(folded=_s_rows(SIGNALS_SQL, 42)) + f"SELECT CAST(candidate AS INTEGER) AS candidate, {q('avg(abs(train_r))')} AS train_r, {q('avg(abs(val_r))')} AS val_r FROM tv GROUP BY candidate HAVING abs(avg(abs(train_r)) - avg(abs(val_r))) <= 0.05")
def verify_folds(spark, sf_dir):
    found = search.verify(signals(spark, sf_dir), _S_CANDIDATES, F.col("y"), "event_id", _S_CONFIG, "arrow")
    return found.select("candidate", r(F.col("train_r")).alias("train_r"), r(F.col("val_r")).alias("val_r"))


# --- bootstrap, permutations, decision --------------------------------------

_E_CONFIG = EngineConfig(metric_names=("pearson", "r2"), num_repeats=3, permutation_tests=5, permutation_p_threshold=0.2)


def _e_columns() -> dict[str, Column]:
    return {str(i): F.col(f"f{i}") for i in range(3)}


def _weight_sql(repeat: int, seed: int) -> str:
    u = f"({lcg_sql('event_id', seed + 7919 * (repeat + 1), 3)} / CAST(2147483648.0 AS DOUBLE))"
    return " + ".join(f"CASE WHEN {u} >= {p!r} THEN 1 ELSE 0 END" for p in folds._POISSON)


_BOOT = union([f"SELECT concat(c, '#', {k}) AS c, x, y FROM (SELECT c, x, y, unnest(range(w)) AS one FROM (SELECT s.c, s.x, s.y, {_weight_sql(k, 7)} AS w FROM ({union([f'SELECT {chr(39)}{i}{chr(39)} AS c, event_id, CAST(f{i} AS DOUBLE) AS x, y FROM ({SIGNALS_SQL})' for i in range(3)])}) s))" for k in range(3)])
_BOOT_R = f"SELECT split_part(c, '#', 1) AS candidate, pearson FROM ({_R_BY.format(rows=_BOOT)})"


@register(union([f"SELECT candidate, '{m}' AS metric, {q(f'avg({v})')} AS mean, {q(f'stddev_pop({v})')} AS std FROM ({_BOOT_R}) GROUP BY candidate" for m, v in (("pearson", "pearson"), ("r2", "pearson * pearson"))]))
def bootstrap_stability(spark, sf_dir):
    out = engine.Engine(_E_CONFIG).stability(signals(spark, sf_dir), _e_columns(), "y", "event_id")
    return out.select("candidate", "metric", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"))


_PLACED = f"SELECT event_id, f0, f1, f2, row_number() OVER (ORDER BY event_id) AS place FROM ({SIGNALS_SQL})"
_NULLS = union([f"SELECT concat(v.c, '#', {k}) AS c, v.x, p.y FROM ({union([f'SELECT {chr(39)}{i}{chr(39)} AS c, place, CAST(f{i} AS DOUBLE) AS x FROM ({_PLACED})' for i in range(3)])}) v JOIN (SELECT y, row_number() OVER (ORDER BY md5(concat(event_id, ':', {7000 + k})), event_id) AS place FROM ({SIGNALS_SQL})) p USING (place)" for k in range(5)])
_NULL_R = f"SELECT split_part(c, '#', 1) AS candidate, pearson AS null_r FROM ({_R_BY.format(rows=_NULLS)})"
_ACTUAL_R = f"SELECT c AS candidate, pearson AS actual FROM ({_R_BY.format(rows=_SIGNAL_ROWS)})"
_P_VALUES = union([f"SELECT candidate, '{m}' AS metric, (count(*) FILTER ({hit}) + 1) / CAST(6.0 AS DOUBLE) AS p_value FROM ({_NULL_R}) JOIN ({_ACTUAL_R}) USING (candidate) GROUP BY candidate" for m, hit in (("pearson", "abs(null_r) >= abs(actual)"), ("r2", "null_r * null_r >= actual * actual"))])


def _p_values(spark, sf_dir) -> tuple[engine.Engine, DataFrame, DataFrame, DataFrame]:
    own = engine.Engine(_E_CONFIG)
    df = signals(spark, sf_dir)
    actual = own.score(df, _e_columns(), "y")
    return own, df, actual, own.permutations(df, _e_columns(), "y", "event_id", actual)


@register(f"SELECT candidate, metric, {q('p_value')} AS p_value FROM ({_P_VALUES})")
def permutation_pvalues(spark, sf_dir):
    return _p_values(spark, sf_dir)[3].select("candidate", "metric", r(F.col("p_value")).alias("p_value"))


@register(f"SELECT bool_or(p_value <= 0.2 AND std <= 0.1) AS signal FROM ({_P_VALUES}) JOIN ({SQL['bootstrap_stability']}) USING (candidate, metric)")
def decision(spark, sf_dir):
    own, df, actual, p = _p_values(spark, sf_dir)
    found = own.decide(actual, own.stability(df, _e_columns(), "y", "event_id"), p)
    return spark.createDataFrame([(found.signal,)], "signal boolean")


# --- time series ------------------------------------------------------------

_TS = TimeSeriesConfig(group_col="user_id", time_col="ts", windows=WINDOWS, lags=[1, 3], differentials=[1, 2], rolling_windows=[3, 5], tiebreak=("event_id",), feature_cols=["value"])
_OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"


def _frame(k: int) -> str:
    return f"OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")


def _ts_columns(spark, sf_dir, names: list[str]) -> DataFrame:
    made = timeseries.TimeSeries(_TS).transform(events(spark, sf_dir))
    return made.select("event_id", *[r(F.col(n)).alias(n) for n in names])


@register(f"SELECT event_id, {q(f'lag(value, 1) {_OVER}')} AS value_lag1, {q(f'lag(value, 3) {_OVER}')} AS value_lag3 FROM events")
def ts_lag(spark, sf_dir):
    return _ts_columns(spark, sf_dir, ["value_lag1", "value_lag3"])


@register(f"SELECT event_id, {q(f'value - lag(value, 1) {_OVER}')} AS value_diff1, {q(f'value - lag(value, 2) {_OVER}')} AS value_diff2 FROM events")
def ts_diff(spark, sf_dir):
    return _ts_columns(spark, sf_dir, ["value_diff1", "value_diff2"])


def _rolling(f: str) -> list[str]:
    return [f"CASE WHEN count(value) {_frame(k)} = {k} THEN {f}(value) {_frame(k)} END" for k in (3, 5)]


@register("SELECT event_id, " + ", ".join(f"{q(e)} AS value_rmean{k}" for e, k in zip(_rolling("avg"), (3, 5), strict=True)) + " FROM events")
def ts_rolling_mean(spark, sf_dir):
    return _ts_columns(spark, sf_dir, ["value_rmean3", "value_rmean5"])


@register("SELECT event_id, " + ", ".join(f"{q(e, 4)} AS value_rstd{k}" for e, k in zip(_rolling("stddev_samp"), (3, 5), strict=True)) + " FROM events")
def ts_rolling_std(spark, sf_dir):
    made = timeseries.TimeSeries(_TS).transform(events(spark, sf_dir))
    return made.select("event_id", *[r(F.col(f"value_rstd{k}"), 4).alias(f"value_rstd{k}") for k in (3, 5)])


_DAYS = "SELECT event_id, user_id, ts, value, CAST(floor((epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts)) / 86400000000.0) AS INTEGER) AS days_before FROM events"


@register(f"SELECT event_id, days_before FROM ({_DAYS})")
def ts_days_before(spark, sf_dir):
    return timeseries.TimeSeries(_TS).days_before(events(spark, sf_dir)).select("event_id", "days_before")


_STATS = {"mean": "avg(value) {f}", "std": "stddev_samp(value) {f}", "sum": "sum(value) {f}", "min": "min(value) {f}", "max": "max(value) {f}", "last": "arg_max(value, (ts, event_id)) {f}", "first": "arg_min(value, (ts, event_id)) {f}", "cnt": "count(value) {f}"}
_WIDE = "SELECT user_id, " + ", ".join(f"{e.format(f=f'FILTER (days_before <= {w})')} AS w{w}_{n}" for w in WINDOWS for n, e in _STATS.items()) + f" FROM ({_DAYS}) GROUP BY user_id"
_STAT_NAMES = [f"w{w}_{n}" for w in WINDOWS for n in _STATS]


@register("SELECT user_id, " + ", ".join(f"{q(n, 4)} AS value_{n}" for n in _STAT_NAMES) + f" FROM ({_WIDE})")
def ts_window_stats(spark, sf_dir):
    made = timeseries.TimeSeries(_TS).window_stats(events(spark, sf_dir), ["value"])
    return made.select("user_id", *[r(F.col(f"value_{n}"), 4).alias(f"value_{n}") for n in _STAT_NAMES])


_V = {w: f"((w{w}_last - w{w}_first) / {w}.0)" for w in (1, 7, 30)}
_CALCULUS = {f"velocity_{w}": v for w, v in _V.items()} | {
    "accel_short": f"(({_V[1]} - {_V[7]}) / 6.0)", "accel_long": f"(({_V[7]} - {_V[30]}) / 23.0)", "momentum": f"(({_V[1]} - {_V[7]}) / 6.0 - ({_V[7]} - {_V[30]}) / 23.0)",
    "integral_7": "w7_sum", "integral_30": "w30_sum", "predict_7d": f"(w1_last + {_V[1]} * 7)", "predict_30d": f"(w1_last + {_V[1]} * 30)",
    "vol_ratio_1vs30": "(w1_std / (w30_std + 0.001))", "trend_1vs30": "(w1_mean / (w30_mean + 0.001))", "range_1": "(w1_max - w1_min)", "range_7": "(w7_max - w7_min)",
}


@register("SELECT user_id, " + ", ".join(f"{q(f'coalesce({v}, 0)', 4)} AS value_{n}" for n, v in _CALCULUS.items()) + f" FROM ({_WIDE})")
def ts_calculus(spark, sf_dir):
    made = timeseries.TimeSeries(_TS).aggregate_to_entity(events(spark, sf_dir))
    return made.select("user_id", *[r(F.col(f"value_{n}"), 4).alias(f"value_{n}") for n in _CALCULUS])


@register(f"SELECT user_id, target, {q('w7_sum', 4)} AS value_w7_sum FROM ({_WIDE}) JOIN (SELECT user_id, count(*) AS target FROM events WHERE event_type = 'purchase' GROUP BY user_id) USING (user_id)")
def ts_join_target(spark, sf_dir):
    target = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("target"))
    made = timeseries.TimeSeries(_TS).aggregate_to_entity(events(spark, sf_dir), target)
    return made.select("user_id", "target", r(F.col("value_w7_sum"), 4).alias("value_w7_sum"))


@register()
def ts_calculus_features(spark, sf_dir):
    """Transform and aggregate: lags, differences and rolling columns by window."""
    return timeseries.calculus_features(events(spark, sf_dir), _TS)


# --- encoding ---------------------------------------------------------------


def _ots(p: int) -> str:
    w = f"OVER (PARTITION BY event_type ORDER BY md5(concat(event_id, ':', {42 + p * encoding.STRIDE})), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"((coalesce(sum(value) {w}, 0) + 0.5) / (count(value) {w} + 1.0))"


def _encoded(spark, sf_dir, n) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    made = encoding.OrderedTargetEncoder(n_permutations=n).encode(rows, "event_type", "value", "event_id")
    return made.select("event_id", r(F.col("encoded"), 4).alias("encoded"))


@register(f"SELECT event_id, {q(_ots(0), 4)} AS encoded FROM events")
def ots_encode(spark, sf_dir):
    return _encoded(spark, sf_dir, 1)


@register(f"SELECT event_id, {q('(' + ' + '.join(_ots(p) for p in range(4)) + ') / 4', 4)} AS encoded FROM events")
def ots_encode_multi(spark, sf_dir):
    return _encoded(spark, sf_dir, 4)


@register(f"WITH s AS (SELECT event_type, sum(value) AS t, count(value) AS n FROM events WHERE event_type <> 'purchase' GROUP BY event_type) SELECT event_id, {q('CASE WHEN n IS NULL THEN 0.5 ELSE (t + 0.5) / (n + 1.0) END', 4)} AS encoded FROM events LEFT JOIN s USING (event_type)")
def ots_fit_transform(spark, sf_dir):
    own = encoding.OrderedTargetEncoder()
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stats = own.fit(rows.where("event_type <> 'purchase'"), "event_type", "value")
    return own.transform(rows, stats, "event_type").select("event_id", r(F.col("encoded"), 4).alias("encoded"))


# --- quality ----------------------------------------------------------------

_HOLED_LONG = union([f"SELECT '{c}' AS feature, {c} AS v FROM ({HOLED_SQL})" for c in HOLED])
_FINITE = "v IS NOT NULL AND NOT isnan(v) AND abs(v) <> CAST('Infinity' AS DOUBLE)"


@register(f"SELECT feature, count(*) AS n, count(*) FILTER (isnan(v)) AS n_nan, count(*) FILTER (v = CAST('Infinity' AS DOUBLE)) AS n_pos_inf, count(*) FILTER (v = CAST('-Infinity' AS DOUBLE)) AS n_neg_inf FROM ({_HOLED_LONG}) GROUP BY feature")
def quality_nan_inf(spark, sf_dir):
    return quality.missing_by_feature(holed(spark, sf_dir), HOLED).select("feature", "n", "n_nan", "n_pos_inf", "n_neg_inf")


_FILL = f"SELECT avg(holed) AS m, median(holed) AS d FROM (SELECT holed FROM ({HOLED_SQL}) WHERE {_FINITE.replace('v ', 'holed ').replace('(v)', '(holed)')})"
_BAD = "holed IS NULL OR isnan(holed) OR abs(holed) = CAST('Infinity' AS DOUBLE)"


@register(f"SELECT event_id, {q(f'CASE WHEN {_BAD} THEN m ELSE holed END')} AS by_mean, {q(f'CASE WHEN {_BAD} THEN d ELSE holed END')} AS by_median FROM ({HOLED_SQL}), ({_FILL})")
def quality_clean_mean_median(spark, sf_dir):
    df = holed(spark, sf_dir).select("event_id", "holed", F.col("holed").alias("other"))
    made = quality.clean(quality.clean(df, ["holed"], "mean"), ["other"], "median")
    return made.select("event_id", r(F.col("holed")).alias("by_mean"), r(F.col("other")).alias("by_median"))


@register(f"SELECT event_id, {q('holed')} AS holed FROM ({HOLED_SQL}) WHERE NOT ({_BAD})")
def quality_clean_remove(spark, sf_dir):
    return quality.clean(holed(spark, sf_dir), ["holed"], "remove").select("event_id", r(F.col("holed")).alias("holed"))


@register(f"SELECT feature, count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS n_missing, {q('100.0 * count(*) FILTER (v IS NULL OR isnan(v)) / count(*)')} AS missing_pct FROM ({_HOLED_LONG}) GROUP BY feature")
def quality_missing(spark, sf_dir):
    return quality.missing_by_feature(holed(spark, sf_dir), HOLED).select("feature", "n", "n_missing", r(F.col("missing_pct")).alias("missing_pct"))


_ROW_MISSING = " + ".join(f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 1 ELSE 0 END" for c in HOLED)


@register(f"SELECT count(*) AS n_rows, count(*) FILTER (m = 0) AS complete_rows, CAST(sum(m) AS BIGINT) AS missing_cells, CAST(3 AS BIGINT) AS complete_features FROM (SELECT {_ROW_MISSING} AS m FROM ({HOLED_SQL}))")
def quality_completeness(spark, sf_dir):
    return quality.completeness(holed(spark, sf_dir), HOLED)


_KEYS = f"SELECT feature, CASE WHEN {_FINITE} THEN CAST(round(v * 1000000) AS HUGEINT) END AS k FROM ({_HOLED_LONG})"
_ENTROPY = f"SELECT feature, sum(c) AS n, count(k) AS u, abs(coalesce(-sum(CASE WHEN k IS NOT NULL THEN c / n0 * log2(c / n0) END), 0) / log2(max(n0))) AS e FROM (SELECT feature, k, CAST(count(*) AS DOUBLE) AS c, CAST(sum(count(*)) OVER (PARTITION BY feature) AS DOUBLE) AS n0 FROM ({_KEYS}) GROUP BY feature, k) GROUP BY feature"


@register(f"SELECT feature, CAST(n AS BIGINT) AS n, u AS n_unique, {q('e')} AS entropy, CASE WHEN u <= 1 THEN 'constant' WHEN u = n THEN 'unique_id' WHEN e < 0.1 THEN 'low_variance' WHEN u / n > 0.95 THEN 'high_cardinality' WHEN u <= 50 THEN 'categorical' ELSE 'normal' END AS feature_type FROM ({_ENTROPY})")
def quality_entropy_types(spark, sf_dir):
    return quality.QualityProfile().entropy(holed(spark, sf_dir), HOLED).select("feature", "n", "n_unique", r(F.col("entropy")).alias("entropy"), "feature_type")


# --- selector and recipes ---------------------------------------------------


@register(f"SELECT candidate FROM ({_PAIR_R}) ORDER BY abs(pearson) DESC, candidate LIMIT 3")
def selector_fit(spark, sf_dir):
    model = selector.InteractionSelector(FEATURES, "charge", k=3).fit(lineitem(spark, sf_dir))
    return spark.createDataFrame([(f"{FEATURES.index(a)},{FEATURES.index(b)}",) for a, b in model.pairs], "candidate string")


_SELECT_SQL = {"multiply": "{a} * {b}", "add": "{a} + {b}", "subtract": "{a} - {b}", "divide": "{a} / ({b} + 1e-8)"}


def _selector_query(operator: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = selector.InteractionModel([("f0", "f1"), ("f1", "f2")], operator, ["f0", "f1", "f2"])
        made = model.transform(signals(spark, sf_dir).withColumn("f2", F.col("f2") + 1).withColumn("f1", F.col("f1") + 1))
        return made.select("event_id", r(F.col(f"f0_{operator}_f1")).alias("first"), r(F.col(f"f1_{operator}_f2")).alias("second"))

    formula = _SELECT_SQL[operator]
    register(f"SELECT event_id, {q(formula.format(a='f0', b='g1'))} AS first, {q(formula.format(a='g1', b='g2'))} AS second FROM (SELECT event_id, f0, f1 + 1 AS g1, f2 + 1 AS g2 FROM ({SIGNALS_SQL}))", f"selector_transform_{operator}")(run)


for _operator in selector.OPERATORS:
    _selector_query(_operator)

_RECIPES = [recipes.Recipe("a", ["f0", "f1"], [1, 3], [0]), recipes.Recipe("b", ["f0", "f2"], [4, 6], [1]), recipes.Recipe("c", ["f1", "f2", "f0"], [0, 5, 0], [2, 0])]
_RECIPE_SQL = [kind_sql(0, op_sql(1, "f0"), op_sql(3, "f1")), kind_sql(1, op_sql(4, "f0"), op_sql(6, "f2")), kind_sql(0, kind_sql(2, "f1", op_sql(5, "f2")), "f0")]


@register("SELECT event_id, " + ", ".join(f"{q(e)} AS {x.name}" for e, x in zip(_RECIPE_SQL, _RECIPES, strict=True)) + f" FROM ({SIGNALS_SQL})")
def recipe_apply(spark, sf_dir):
    made = recipes.apply(signals(spark, sf_dir), _RECIPES)
    return made.select("event_id", *[r(F.col(x.name)).alias(x.name) for x in _RECIPES])


# --- whole runs and the stream ----------------------------------------------


@register(f"SELECT day, candidate, CAST(n AS BIGINT) AS n, {q(R_SQL, 5)} AS pearson FROM (SELECT day, candidate, {SUMS_SQL} FROM ({union([f'SELECT CAST(ts AS DATE) AS day, {chr(39)}{c.signature}{chr(39)} AS candidate, {kind_sql(c.kinds[0], op_sql(c.ops[0], c.columns[0]), op_sql(c.ops[1], c.columns[1]))} AS x, y FROM ({SIGNALS_SQL})' for c in _S_CANDIDATES[:4]])}) GROUP BY day, candidate)")
def online_pearson(spark, sf_dir):
    made = online_correlation(signals(spark, sf_dir), _S_CANDIDATES[:4], F.col("y"), "ts")
    return made.select(F.to_date("window.start").alias("day"), "candidate", "n", r(F.col("pearson"), 5).alias("pearson"))


@register()
def engine_report(spark, sf_dir):
    """The diagnostic engine end to end."""
    config = EngineConfig(budget=ComputeBudget(top_features_for_higher_k=3), num_repeats=2, permutation_tests=3)
    report = engine.Engine(config).analyze(signals(spark, sf_dir), ["f0", "f1", "f2"], "y", "event_id")
    return report.interactions.select("candidate", "combo", "features", *[r(F.col(c)).alias(c) for c in ("pearson", "spearman", "mutual_info", "r2", "strength")])


@register()
def search_recipes(spark, sf_dir):
    """Search end to end: mode by cost, scouts, votes, verification."""
    found = search.Orchestrator(throughput=1e6, config=SearchConfig(operators=[0, 1, 3])).run(signals(spark, sf_dir), ["f0", "f1", "f2"], F.col("y"), "event_id")
    return search.results_frame(spark, found)


def flagship(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """The 300-candidate grid over lineitem, best 20 by training correlation."""
    grid = list(plans.grid(FEATURES, [0, 1, 3, 6, 4], [0, 1]))
    sums = scoring.fold_sums(lineitem(spark, sf_dir), grid, F.col("charge"), folds.fold_of(F.col("l_orderkey"), 5, 42))
    scores = scoring.train_and_validation(sums, 0)
    names = spark.createDataFrame([(i, c.describe()) for i, c in enumerate(grid)], f"{scoring.KEY} int, description string")
    best = scores.orderBy(F.desc(F.abs("train_r")), scoring.KEY).limit(top)
    return best.join(F.broadcast(names), scoring.KEY).select("description", "train_r", "val_r")


QUERIES["flagship"] = flagship

