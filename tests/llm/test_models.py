"""Operators 3, 6 and 7: held-out accuracy and brute force."""

import math
import zlib

import duckdb
import numpy as np
import pytest

from tests.llm.fixtures import awkward_documents, empty_documents
from veinworks.llm import language_id, topk, toxicity
from veinworks.llm.entries import OP6_SQL, op3_language_id, op6_uniform_threshold, op7_toxicity


def held_out(doc_id, modulus):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % modulus == 0


def test_language_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == held_out(r.doc_id, 5) and 0 <= r.score <= 1 for r in got)
    fold = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in fold]) > 0.95


def test_language_awkward(spark):
    df = awkward_documents(spark, long_words=3000)
    net = language_id.train(df)
    got = language_id.predict(df, net).collect()
    assert len(got) == df.count()
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und" and r.score == 0) if not letters else r.lang_pred in net.languages
    assert language_id.train(empty_documents(spark)) is None
    assert {r.lang_pred for r in language_id.predict(df, None).collect()} == {"und"}
    assert language_id.predict(empty_documents(spark), net).count() == 0


def test_gradient():
    """Backpropagation through time against finite differences."""
    net = language_id.Network(["a", "b", "c"], hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    steps, y = rng.integers(0, 4, (6, 5)), rng.integers(0, 3, 5)

    def loss():
        p = net.position_probabilities(steps, None)[0]
        return -np.log(p[:, np.arange(5), y]).mean()

    probs, states, sf, sb = net.position_probabilities(steps, None, keep=True)
    probs[:, np.arange(5), y] -= 1
    probs /= steps.size
    grad = {k: np.zeros_like(v) for k, v in net.p.items()}
    ds = probs @ net.p["v"].T
    net._backward("f", steps, sf, ds[:, :, :3], grad)
    net._backward("b", steps[::-1], sb, ds[::-1, :, 3:], grad)
    for name, at in (("uf", (1, 2)), ("ub", (0, 4)), ("xf", (2, 7)), ("xb", (1, 0)), ("uf", (2, 8))):
        before = net.p[name][at]
        eps = 1e-3
        net.p[name][at] = before + eps
        up = loss()
        net.p[name][at] = before - eps
        down = loss()
        net.p[name][at] = before
        assert math.isclose((up - down) / (2 * eps), grad[name][at], rel_tol=0.03, abs_tol=2e-5), (name, at)


def test_pooled_is_the_mean_of_positions():
    net = language_id.Network(["a", "b"], seed=3)
    texts = [b"x", b"hello there" * 30, b"y" * 128, b"z" * 129]
    probs, votes = net.pooled(texts, batch=2)
    for t, p, v in zip(texts, probs, votes, strict=True):
        each = []
        for i in range(0, len(t), language_id.WINDOW):
            each += list(net.position_probabilities(np.frombuffer(t, np.uint8)[i : i + language_id.WINDOW, None], None)[0][:, 0])
        assert np.allclose(np.mean(each, axis=0), p, atol=1e-4) and v.sum() == len(t)
        assert len(net.labels(t.decode())) == len(t)


def test_toxicity_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op7_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == held_out(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    fold = [r for r in got if r.held_out and r.doc_id in truth]
    hits = [r.predicted for r in fold if truth[r.doc_id]]
    false = [r.predicted for r in fold if not truth[r.doc_id]]
    # A tenth of the held-out toxic labels stands on junk without a toxic word.
    assert np.mean(hits) > 0.85 and np.mean(false) < 0.01


def test_toxicity_awkward(spark):
    df = awkward_documents(spark, long_words=3000)
    labels = spark.createDataFrame([(1, 0), (9, 1), (10, 1), (11, 0), (None, 1), (12, None), (12, 1), (6, 0), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    scored = toxicity.score(df, model)
    assert scored.columns == [*df.columns, "score"] and scored.count() == df.count()
    assert all(0 <= r.score <= 1 for r in scored.collect())
    flat = toxicity.train(df, labels.where("toxic = 0"))
    assert all(r.score < 0.5 for r in toxicity.score(df, flat).collect())
    assert toxicity.score(empty_documents(spark), model).count() == 0


def test_batch_scores_equal_single_scores():
    texts = ["you idiot", "fine day", None, "", "idiot", "the moron and the day", "fine idiots\0idiot"]
    model = toxicity.fit(["you idiot", "a fine day", "such an idiot he", "what a day"] * 5, [1, 0, 1, 0] * 5)
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts])
    assert model.scores(["idiot"])[0] > 0.5 > model.scores(["day"])[0]


def brute(rows, k, every, scale=1024):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            own = [math.floor(scale * x) for x in v]
            valid[i] = min(valid.get(i, own), own)
    out = []
    for q in sorted(valid):
        if q % every == 0:
            best = sorted((-sum(a * b for a, b in zip(valid[q], valid[c], strict=False)), c) for c in valid if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return out


def test_topk_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert sorted(map(tuple, op6_uniform_threshold(spark, sf_dir).collect())) == sorted(con.execute(OP6_SQL).fetchall())


@pytest.mark.parametrize("blocks", [1, 2, 3])
@pytest.mark.parametrize("big", [1.0, 1e6])
def test_topk_awkward(spark, blocks, big, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 3, 5) / 8 * big).tolist()) for i in range(90)]
    rows += [(100 + i, [0.5 * big] * 5) for i in range(40)]
    rows += [(200, None), (201, []), (202, [1.0, None]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, [1.0] * 7), (0, rows[0][1]), (None, [1.0] * 5), (20, [9.0, -9.0])]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, v string, score int")
    got = sorted(map(tuple, topk.top_k(df, k=4, every=10, blocks=blocks).collect()))
    assert got == brute(rows, 4, 10)
    assert topk.top_k(df.where("vec_id in (10, 11)"), k=4, every=10).collect()[0]["vec_id"] == 11
    assert topk.top_k(df.limit(0)).count() == 0
