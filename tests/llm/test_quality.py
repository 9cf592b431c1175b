"""Operator 4 against a plain Python version."""

import re
from collections import Counter

from tests.llm.fixtures import awkward_documents, empty_documents
from veinworks.llm import weak_rules
from veinworks.llm.entries import op4_weak_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    repeated = set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    return n, sum(map(len, words)), sum(ch in "#*$%&|<>" for ch in text), dup, len(repeated), failed


def check(got, texts):
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((i, *brute(t)) for i, t in texts)
    assert not any(r.kept and r.base_failed for r in got)
    assert all(0 <= r.posterior <= 1 and (r.base_failed or r.kept == (r.posterior >= 0.5)) for r in got)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op4_weak_rules(spark, sf_dir).collect()
    check(got, rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good = [r.kept for r in got if quality.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in got if quality.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.35


def test_awkward(spark):
    df = awkward_documents(spark, long_words=4000)
    got = weak_rules.judge(df).collect()
    check(got, [(r.doc_id, r.text) for r in df.collect()])
    assert set(df.columns) - {"text"} <= set(weak_rules.judge(df).columns)
    assert weak_rules.judge(empty_documents(spark)).count() == 0


def test_native(spark):
    plan = weak_rules.judge(awkward_documents(spark, long_words=10).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_estimate_finds_the_accuracies():
    import random

    rng = random.Random(3)
    good, bad, cast = [0.98, 0.95, 0.9, 0.97], [0.9, 0.6, 0.7, 0.8], [1.0, 0.8, 0.9, 0.5]
    patterns = Counter()
    for _ in range(40_000):
        y = rng.random() < 0.7
        patterns[tuple((1 if rng.random() < (g if y else 1 - b) else -1) if rng.random() < k else 0 for g, b, k in zip(good, bad, cast, strict=True))] += 1
    found = weak_rules.estimate(patterns, 4)
    assert abs(found.prior - 0.7) < 0.03
    assert all(abs(a - b) < 0.05 for a, b in zip(found.on_good + found.on_bad, good + bad, strict=True))
    empty = weak_rules.estimate({}, 4)
    assert 0 < empty.posterior((1, 1, -1, 0)) < 1
