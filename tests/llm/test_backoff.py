"""Operator 9 against a plain Python walk of the automaton."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tests.llm.fixtures import awkward_documents, empty_documents
from veinworks.llm import backoff_lm
from veinworks.llm.entries import op9_backoff_automaton

END, START = object(), object()


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


def brute(rows, share):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    train = [tokens(t) for (_, t), h in zip(rows, held, strict=True) if not h]
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    states = {w for w in c if c[w] >= max(2, share * n)} | {START}
    pairs = Counter(p for t in train for p in zip([START, *t], t, strict=False))
    arcs = {p: k for p, k in pairs.items() if p[0] in states and p[1] in states and k >= 2}
    seen = Counter(c)
    seen[START] = len(train)
    mass = defaultdict(float)
    for (a, _), k in arcs.items():
        mass[a] += k - 0.75
    out = []
    for (d, t), h in zip(rows, held, strict=True):
        state, base, score = START, 0.0, 0.0
        own = tokens(t)
        for w in own:
            root = (c[w] + 1) / (n + v + 1)
            base += math.log10(root)
            p = root
            if state in states and seen[state]:
                p = max(arcs.get((state, w), 0) - 0.75, 0) / seen[state] + (1 - mass[state] / seen[state]) * root
            score += math.log10(p)
            state = w
        out.append((d, h, len(own), sum(c[w] > 0 for w in own), n, base, score))
    return out


def check(got, rows, share):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[3], r[6])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(brute(rows, share), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op9_backoff_automaton(spark, sf_dir).collect()
    check(got, rows, backoff_lm.SHARE)
    fold = [r for r in got if r.held_out]
    assert sum(r.score for r in fold) > sum(r.base_score for r in fold)


@pytest.mark.parametrize("share", [1e-5, 0.01])
def test_awkward(spark, share, monkeypatch):
    df = awkward_documents(spark, long_words=2000)
    check(backoff_lm.score(df, share=share).collect(), [(r.doc_id, r.text) for r in df.collect()], share)


def test_empty_and_nothing_to_learn(spark):
    assert backoff_lm.score(empty_documents(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    df = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    r = backoff_lm.score(df).first()
    assert r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0.0


def test_arcs_of_rare_words_in_a_large_corpus(spark):
    """Pairs seen twice have arcs, however many tokens stand beside them."""
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, " ".join(["x"] * 10_000)) for i in train[:30]] + [(train[30], "rare pair of words"), (train[31], "rare pair of words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = backoff_lm.score(df).collect()
    check(got, rows, 0)
    rare = next(r for r in got if r.doc_id == train[30])
    assert rare.train_tokens > 300_000 and rare.score > rare.base_score + 10
