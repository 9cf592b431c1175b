"""Exact top-k inner products by the three-phase uniform threshold method.

Vectors are cut into blocks of dimensions; a block is a node with a list of
partial scores of every candidate, and a score is the sum over the nodes.
Phase 1 gathers the k best partial scores of each node and resolves those
candidates: the k-th best full score found, tau, is a lower bound of the answer.
Phase 2 broadcasts a cutoff for each query and node: the node's best partial
less an equal share of (sum of the nodes' bests - tau). The cutoffs sum to tau,
so whoever lies under all of them scores under tau; the nodes report every entry
on or over. Phase 3 bounds each reported candidate by its known partials and the
cutoffs of nodes that did not report it, drops those under tau, adds up the
missing partials of the rest and ranks them. A task holds all nodes' lists of
its rows, so only entries that reach tau leave it.

Queries go in blocks of at most `QUERY_BLOCK`, each broadcast, against all rows:
no cross join and no pair that was not reported. Equal vectors are one
candidate: of a class of copies only its k + 1 smallest ids can be in any answer
(one may be the query itself), so the rest are set aside before scoring; that is
exact for every query.

Components become floor(scale * x). Sums are exact: in float64 while a bound on
them stays under 2**53, else in Python integers, clipped to the range of long.

Defined cases: vectors that are null, hold null or non-finite components take no
part; an empty vector has score 0 with all; vectors of unlike length are padded
with zeros; rows of equal id are one row (the one of least vector); null ids
take no part; fewer than k candidates give fewer rows; no query, no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

QUERY_BLOCK = 2048
ROWS_AT_ONCE = 1024


def integer_vectors(df: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """Valid rows as (vec_id, v array<double> of whole numbers), one per id."""
    fine = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def whole(x):
        # floor() gives a long; doubles beyond 2**62 are whole already.
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < 2.0**62, F.floor(y).cast("double")).otherwise(y)

    rows = df.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, whole).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros to ``width``."""
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width))
    if len(sizes) and (sizes == width).all():
        return values[offsets[0] : offsets[-1]].reshape(-1, width)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values[offsets[0] : offsets[-1]]
    return out


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b.T, in float64 where that is exact, else in clipped Python integers."""
    if exact:
        return a @ b.T
    whole = np.vectorize(int, otypes=[object])
    return np.clip((whole(a) @ whole(b).T) if a.size and b.size else np.zeros((len(a), len(b)), object), -(2**63), 2**63 - 1).astype(np.int64)


def top_k(df: DataFrame, queries: DataFrame | None = None, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, every: int = 100, blocks: int = 2) -> DataFrame:
    """Per query (rows of id divisible by ``every``, or ``queries``) its k best:
    query_id, rank, vec_id, score; ties to the smaller id."""
    spark = df.sparkSession
    rows = materialise(integer_vectors(df, key, vector, scale), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else integer_vectors(queries, key, vector, scale)
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    n_queries = asked.count()
    if not n_queries or facts["width"] is None:
        return spark.createDataFrame([], schema)
    width = max(1, facts["width"])
    exact = (facts["most"] or 0) ** 2 * width < 2**52
    edges = np.linspace(0, width, min(blocks, width) + 1).astype(int)
    nodes = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    w = Window.partitionBy(F.xxhash64("v"), "v").orderBy("vec_id")
    candidates = materialise(rows.withColumn("copy", F.row_number().over(w)).where(F.col("copy") <= k + 1).drop("copy"), "candidates")
    n_blocks = -(-n_queries // QUERY_BLOCK)
    whole = None
    for i in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == i).orderBy("vec_id").collect()
        if not block:
            continue
        ids = np.array([r["vec_id"] for r in block], np.int64)
        vectors = np.zeros((len(ids), width))
        for j, r in enumerate(block):
            vectors[j, : len(r["v"])] = r["v"]
        part = _block(spark, candidates, ids, vectors, nodes, width, k, exact)
        whole = part if whole is None else whole.unionByName(part)
    return whole if whole is not None else spark.createDataFrame([], schema)


def _block(spark, candidates: DataFrame, ids: np.ndarray, vectors: np.ndarray, nodes: list, width: int, k: int, exact: bool) -> DataFrame:
    held = spark.sparkContext.broadcast((ids, vectors))

    def lists(batches: Iterator[pa.RecordBatch]):
        """Candidate ids and each node's partial scores (queries x candidates)."""
        q = held.value[1]
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(start, ROWS_AT_ONCE)
                m = matrix(batch.column("v"), width)
                yield batch.column("vec_id").to_numpy(), [products(q[:, a:b], m[:, a:b], exact) for a, b in nodes]

    def phase1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each node's k + 1 best of all rows of the task (one may be the query)."""
        qids = held.value[0]
        best: list[tuple | None] = [None] * len(nodes)  # partial, full score, id
        for own, parts in lists(batches):
            total = sum(parts)
            for n, scores in enumerate(parts):
                told = [scores, total, np.broadcast_to(own, scores.shape)]
                if best[n] is not None:
                    told = [np.concatenate([a, b], axis=1) for a, b in zip(best[n], told, strict=True)]
                most = min(k + 1, told[0].shape[1])
                at = np.argpartition(-told[0], most - 1, axis=1)[:, :most]
                best[n] = tuple(np.take_along_axis(x, at, axis=1) for x in told)
        for n, found in enumerate(best):
            if found is not None:
                part, total, own = (x.ravel().astype(np.int64) for x in found)
                at_q = np.repeat(qids, found[0].shape[1])
                keep = at_q != own
                yield pa.RecordBatch.from_arrays([pa.array(at_q[keep]), pa.array(np.full(int(keep.sum()), n, np.int32)), pa.array(own[keep]), pa.array(part[keep]), pa.array(total[keep])], names=["query_id", "node", "vec_id", "part", "score"])

    local = candidates.mapInArrow(phase1, "query_id long, node int, vec_id long, part long, score long")
    w = Window.partitionBy("query_id", "node").orderBy(F.desc("part"), "vec_id")
    local = local.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    # At most k rows for each node and query of the block come to the driver.
    scores: dict[int, dict[int, int]] = {}
    tops: dict[tuple[int, int], int] = {}
    for r in local.collect():
        scores.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
        at = (r["query_id"], r["node"])
        tops[at] = max(tops.get(at, r["part"]), r["part"])
    cutoffs = np.full((len(nodes), len(ids)), -(2**63), dtype=object)
    taus = np.full(len(ids), -(2**63), dtype=object)
    for j, q in enumerate(ids.tolist()):
        best = sorted(scores.get(q, {}).values(), reverse=True)
        if len(best) >= k:
            taus[j] = best[k - 1]
            slack = sum(tops[q, n] for n in range(len(nodes))) - taus[j]
            for n in range(len(nodes)):
                # Whole shares, rounded up: the cutoffs sum to tau at most.
                cutoffs[n, j] = tops[q, n] - -(-slack // len(nodes))
    if exact:
        cutoffs, taus = cutoffs.astype(np.float64), taus.astype(np.float64)
    cut = spark.sparkContext.broadcast((cutoffs, taus))

    def phases2and3(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, (limits, lower) = held.value[0], cut.value
        for own, parts in lists(batches):
            some = np.zeros(parts[0].shape, bool)
            upper = np.zeros(parts[0].shape, limits.dtype)
            for n, scores in enumerate(parts):
                told = np.asarray(scores >= limits[n][:, None], bool)
                some |= told
                upper = upper + np.where(told, scores, limits[n][:, None])
            at_q, at_r = np.nonzero(some & np.asarray(upper >= lower[:, None], bool))
            total = sum(p[at_q, at_r] for p in parts)
            keep = (qids[at_q] != own[at_r]) & np.asarray(total >= lower[at_q], bool)
            at_q, at_r, total = at_q[keep], at_r[keep], total[keep]
            yield pa.RecordBatch.from_arrays([pa.array(qids[at_q]), pa.array(own[at_r]), pa.array(total.astype(np.int64))], names=["query_id", "vec_id", "score"])

    found = candidates.mapInArrow(phases2and3, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
