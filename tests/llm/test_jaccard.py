"""Operator 10 against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import awkward_documents, empty_documents
from veinworks.llm import jaccard_join
from veinworks.llm.entries import op10_part_enum


def shingles(text, n):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute(rows, n, p, q):
    """rows: (doc_id, text) -> Counter of (doc_id, size, component)."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    seen = set()
    for own in index.values():
        for at, i in enumerate(own):
            for j in own[at + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if q * both >= p * (len(sets[i]) + len(sets[j]) - both):
                        parent[find(j)] = find(i)
    by_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            if d in by_id:
                parent[find(i)] = find(by_id[d])
            by_id[d] = i
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), (least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def check(spark, rows, n, p, q):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, sig int")
    got = jaccard_join.join_components(df, n, p, q).collect()
    assert Counter(map(tuple, got)) == brute(rows, n, p, q)


def families(rng, n_families, copies, words, edits):
    rows, i = [], 0
    for _ in range(n_families):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice(words))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice(edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(4000)}"
            if rng.random() < 0.2:
                own += [f"t{rng.randrange(4000)}" for _ in range(rng.randrange(1, 4))]
            rows.append((i * 7 % 10007, " ".join(own)))
            i += 1
    return rows


@pytest.mark.parametrize(("n", "p", "q"), [(3, 90, 100), (5, 80, 100)])
def test_families(spark, n, p, q):
    rng = random.Random(n)
    rows = families(rng, 25, 8, [4, 12, 25, 60, 150, 400], [0, 0, 1, 1, 2, 3, 5, 8])
    check(spark, rows, n, p, q)


def test_chain_of_one_large_family(spark):
    """Near copies that the pivot alone does not reach."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(240)] = f"e{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    check(spark, rows, 3, 90, 100)


def test_crowded_group(spark, monkeypatch):
    """Near copies that share buckets of hundreds of classes, beside texts that only
    hold the same passage; groups cut in many pieces."""
    monkeypatch.setattr(jaccard_join, "MIDDLE_BUCKET", 12)
    monkeypatch.setattr(jaccard_join, "PIECE", 2000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(base)
        if i % 5 == 0:  # strays, linked to none or to few others
            own[40:] = [f"s{i // 10}-{j}" if rng.random() < 0.9 else f"o{rng.randrange(10**6)}" for j in range(80)]
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i * 7 % 1009, " ".join(own)))
    for n, p in ((3, 90), (5, 80)):
        check(spark, rows, n, p, 100)


def test_large_bucket(spark):
    """Buckets past `MIDDLE_BUCKET`, at the default settings."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"e{rng.randrange(10**6)}" for _ in range(rng.choice((2, 3, 9)))])) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard_join.buckets(df, 3, 90, 100, "text", 4).select("sig", "cls").distinct().groupBy("sig").count().agg(F.max("count")).first()[0] > jaccard_join.MIDDLE_BUCKET
    check(spark, rows, 3, 90, 100)


def test_rows_without_an_id_link_others(spark):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words[i : i + 38]) for i in range(3)]
    rows = [(1, texts[0]), (None, texts[1]), (3, texts[2]), (None, "quite alone here")]
    assert len({c for _, _, c in brute(rows, 3, 90, 100)}) == 2
    check(spark, rows, 3, 90, 100)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(map(tuple, op10_part_enum(spark, sf_dir).collect())) == brute(rows, 3, 90, 100)


def test_awkward(spark):
    df = awkward_documents(spark, long_words=3000)
    got = jaccard_join.join_components(df).collect()
    assert Counter(map(tuple, got)) == brute([(r.doc_id, r.text) for r in df.collect()], 3, 90, 100)
    assert jaccard_join.join_components(empty_documents(spark)).count() == 0


def test_signatures_lose_no_pair():
    """Every pair at the threshold shares a signature."""
    rng = np.random.default_rng(2)
    for p, q in ((90, 100), (80, 100)):
        bands = jaccard_join.Bands(p, q)
        for size in (5, 9, 10, 19, 40, 130, 600):
            for _ in range(20):
                a = rng.integers(1, 2**62, size).astype(np.uint64)
                most = (q - p) * 2 * size // (q + p)
                drop = rng.integers(0, most // 2 + 1)
                b = np.concatenate([a[drop:], rng.integers(1, 2**62, most // 2 if drop else 0).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if q * both < p * (len(a) + len(b) - both) or drop == 0:
                    continue
                sig, of = jaccard_join.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), bands)
                assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (p, size, drop)


def test_exact_sets_of_repeated_rows(spark):
    """One row for each class, though equal rows are in different partitions."""
    texts = [(1, "a b c d e")] * 6 + [(2, "c d e f g")] * 6
    df = spark.sparkContext.parallelize(texts, 12).toDF("doc_id long, text string")
    elements, sizes = jaccard_join.shingle_sets(pa.array([texts[0][1], texts[-1][1]]), 3)
    cls = jaccard_join.class_hashes(elements, sizes).tolist()
    wanted = spark.createDataFrame([(cls[0], 1), (cls[1], 2)], "cls long, doc_id long")
    got = jaccard_join.exact_sets(df, F.broadcast(wanted), 3, "doc_id", "text").collect()
    assert sorted(r.cls for r in got) == sorted(cls) and all(len(r.elements) == 3 * 8 for r in got)


def test_packed_entries_are_small(spark, monkeypatch):
    """Over many parts, where a class has few entries in each."""
    rng = random.Random(3)
    df = spark.createDataFrame([(" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)),) for _ in range(200)], "text string").coalesce(1)
    sent = []
    elements, sizes = jaccard_join.shingle_sets(pa.array([r.text for r in df.collect()]), 5)
    entries = len(jaccard_join.signatures(elements, sizes, jaccard_join.Bands(80, 100))[0])
    frame = type(df)
    plan = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: sent.append(self) or plan(self, *a))
    jaccard_join.buckets(df, 5, 80, 100, "text", 100)
    size = sum(sum(len(x) for x in r if isinstance(x, bytes | bytearray)) for r in sent[0].collect())
    assert size < 9.5 * entries, size / entries


def test_hot_passage_of_unlike_texts(spark, monkeypatch):
    """Texts that share one passage alone leave a bucket past `MIDDLE_BUCKET` before
    sets are made; near copies among them stay."""
    monkeypatch.setattr(jaccard_join, "MIDDLE_BUCKET", 12)
    rng = random.Random(8)
    rows = [(i, "this very line is in all of them " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " tail") for i in range(0, 40, 4)] + [(None, rows[7][1] + " other")]
    made = {}
    inner = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name, *a: made.setdefault(name, inner(df, name, *a)) if name == "sets" else inner(df, name, *a))
    check(spark, rows, 3, 80, 100)
    assert made["sets"].count() < 60


def test_near_copies_meet_in_few_rows(spark, monkeypatch):
    """Buckets that near copies share, and pairs of them, travel once and not for
    each signature."""
    rng = random.Random(12)
    rows, i = [], 0
    for copies in (60, *[2] * 40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
        for _ in range(copies):
            own = list(base)
            own[rng.randrange(250)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
            i += 1
    made = {}
    inner = jaccard_join.materialise
    monkeypatch.setattr(jaccard_join, "materialise", lambda df, name, *a: made.setdefault(name, inner(df, name, *a)) if name in ("refined", "thinned") else inner(df, name, *a))
    check(spark, rows, 5, 80, 100)
    assert made["refined"].count() < 15 * 60, made["refined"].count()
    assert made["thinned"].where("n = 2").count() < 10 * 80, made["thinned"].where("n = 2").count()


def test_wanted_texts_alone_travel(spark):
    """The bitmap before the joins of texts keeps all wanted ids and few others."""
    texts = spark.range(-5000, 15000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).union(spark.sql("select null, 'b'"))
    wanted = spark.createDataFrame([(i * 37 - 4000,) for i in range(400)] + [(None,)], "doc_id long")
    got = [r.doc_id for r in jaccard_join.likely(texts, wanted).collect()]
    assert len(set(got)) == len(got) and None not in got
    assert {i * 37 - 4000 for i in range(400)} <= set(got) and len(got) < 400 + 20000 // 8
    assert jaccard_join.likely(texts, wanted.where("doc_id is null")).count() == 0


def test_sketches_bound_from_below():
    """Fine and coarse, of sets on both sides of `LONG_SET`."""
    rng = np.random.default_rng(5)
    for size in (6, 60, 500, 1990, 2040, 2200, 9000):
        a = rng.integers(1, 2**62, size).astype(np.uint64)
        for drop, add in ((0, 1), (size // 10, size // 10), (0, size // 5), (size, size)):
            b = np.concatenate([a[drop:], rng.integers(1, 2**62, add).astype(np.uint64)])
            for each in (jaccard_join.FINE, jaccard_join.COARSE):
                cells = jaccard_join.cells_of(jaccard_join.sketches(np.concatenate([a, b]), np.array([len(a), len(b)]), each))
                assert np.abs(np.subtract(*cells)).sum() <= drop + add
                if drop == size > 50:
                    assert 9 * np.abs(np.subtract(*cells)).sum() > len(a) + len(b), (size, each)
