"""Toxicity: a character n-gram linear classifier with naive Bayes scaling.

Features are the character n-grams that a lower-cased text holds, present or
not. Each is scaled by its log-count ratio between the classes; a logistic
regression on the scaled features, shrunk towards its mean weight, gives the
score. An n-gram is a feature if `LEAST_COUNT` texts of the sample hold it and its
chi-squared is `CHI_SQUARED` or more (the best `LEAST_FEATURES` in any case). Fitting
takes a bounded sample of labelled rows, drawn by hash: of each class `MAX_ROWS` texts
of up to `USUAL_CHARS` and `MAX_LONG` longer ones of up to `MAX_CHARS`. Scoring reads
every whole text.

Scoring is array work over a batch: rolling 64-bit n-gram hashes, one bitmap
look-up each, and an exact look-up of the few that the model knows. The model
has at most `MAX_FEATURES` weights, so what is shipped to tasks is bounded.

Defined cases: null or empty texts have no feature and get the model's score of
an empty text; null labels are not learned from; without both classes in the
sample every score is 1.0 if all labels are 1, else 0.0; repeated rows are
scored each; an empty table gives none; other columns pass by untouched, but one
named like the output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, materialise, slices, whole_texts

ORDERS = (3, 5, 7)
MAX_ROWS = 2500
USUAL_CHARS = 20_000
MAX_LONG = 100
MAX_CHARS = 200_000
MAX_FEATURES = 20_000
LEAST_FEATURES = 200
CHI_SQUARED = 30.0
LEAST_COUNT = 5
BITMAP = 22
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD1B54A32D192ED03)


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit n-gram hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.bitmap = np.zeros(1 << BITMAP, bool)
        self.bitmap[self.features >> np.uint64(64 - BITMAP)] = True

    def scores(self, texts: list[str | None]) -> np.ndarray:
        points, starts = code_points(texts)
        total = np.full(len(texts), self.bias)
        if len(self.features):
            for h in gram_hashes(points):
                at = np.flatnonzero(self.bitmap[h >> np.uint64(64 - BITMAP)])
                h = h[at]
                known = np.searchsorted(self.features, h)
                known[known == len(self.features)] = 0
                ok = self.features[known] == h
                document = np.searchsorted(starts, at[ok], side="right") - 1
                pairs = np.unique(document * len(self.features) + known[ok])
                np.add.at(total, pairs // len(self.features), self.weights[pairs % len(self.features)])
        return 0.5 * (1 + np.tanh(0.5 * total))


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' lower-case code points, each followed by a zero; where each
    text starts."""
    lowered = [(t or "").lower().replace("\0", " ") for t in texts]
    starts = np.zeros(len(lowered), np.int64)
    np.cumsum([len(t) + 1 for t in lowered[:-1]], out=starts[1:])
    return np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4"), starts


def gram_hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, a hash at every position; 0 where the n-gram would leave
    its text (the bitmap position of 0 is never set but by a feature 0)."""
    p = points.astype(np.uint64)
    edge = np.flatnonzero(points == 0)
    h = p.copy()
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * _A + p[n - 1 :] if len(h) > 1 else h[:0]
        if n in ORDERS:
            mixed = h * _B
            mixed ^= mixed >> np.uint64(29)
            mixed *= _A
            for back in range(n):
                cut = edge - back
                mixed[cut[(cut >= 0) & (cut < len(mixed))]] = 0
            yield mixed


def fit(texts: list[str], labels: list[int], rounds: int = 150, shrink: float = 0.25, smooth: float = 1.0) -> Model:
    """Log-count ratios, then logistic regression on the scaled features."""
    y = np.array([1 if v else 0 for v in labels], np.float64)
    nothing = np.zeros(0, np.uint64)
    if not len(y) or y.min() == y.max():
        return Model(nothing, np.zeros(0), 40.0 if len(y) and y[0] else -40.0)
    n, n1 = len(y), y.sum()
    bits = np.uint64(64 - BITMAP)

    def grams(text: str) -> np.ndarray:
        found = np.unique(np.concatenate(list(gram_hashes(code_points([text])[0]))))
        return found[found != 0]

    def worth(df: np.ndarray, positive: np.ndarray) -> np.ndarray:
        """Chi-squared of those found in `LEAST_COUNT` texts: among a million n-grams
        only clear association counts, for labels are noisy."""
        common = df >= LEAST_COUNT
        return n * (positive * n - df * n1) ** 2 / np.maximum(df * (n - df) * n1 * (n - n1), 1e-9) * common

    # First by hash bucket, in fixed memory; then exactly, of promising buckets.
    counts = np.zeros((2, 1 << BITMAP), np.int32)
    for t, label in zip(texts, y, strict=True):
        counts[int(label), np.unique(grams(t) >> bits)] += 1
    chi = worth((counts[0] + counts[1]).astype(np.float64), counts[1].astype(np.float64))
    least = min(CHI_SQUARED, np.partition(chi, -LEAST_FEATURES)[-LEAST_FEATURES])
    hopeful = (chi >= 0.5 * least) & (chi > 0)
    del counts, chi
    per_text = [(g := grams(t))[hopeful[g >> bits]] for t in texts]
    grams_all = np.concatenate(per_text)
    rows = np.repeat(np.arange(len(y)), [len(g) for g in per_text])
    features, column, df = np.unique(grams_all, return_inverse=True, return_counts=True)
    positive = np.bincount(column, weights=y[rows], minlength=len(features))
    p, q = (positive + smooth) / (n1 + 2 * smooth), (df - positive + smooth) / (n - n1 + 2 * smooth)
    ratio = np.log(p / q)
    chi = worth(df.astype(np.float64), positive)
    best = np.argsort(-chi, kind="stable")[:MAX_FEATURES]
    best = best[: max(LEAST_FEATURES, int((chi[best] >= CHI_SQUARED).sum()))]
    best = np.sort(best[chi[best] > 0])
    if not len(best):
        return Model(nothing, np.zeros(0), float(np.log(n1 / (n - n1))))
    place = np.full(len(features), -1)
    place[best] = np.arange(len(best))
    keep = place[column] >= 0
    rows, column, features, ratio = rows[keep], place[column][keep], features[best], ratio[best]
    w, b = np.zeros(len(best)), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    x = ratio[column]
    for t in range(1, rounds + 1):
        z = np.bincount(rows, weights=x * w[column], minlength=len(y)) + b
        g = (0.5 * (1 + np.tanh(0.5 * z)) - y) / n
        gw, gb = np.bincount(column, weights=x * g[rows], minlength=len(w)) + 1e-3 * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    scaled = ((1 - shrink) * w + shrink * np.abs(w).mean()) * ratio
    z = np.bincount(rows, weights=scaled[column], minlength=len(y)) + b
    return Model(features, scaled, b + best_shift(z, y))


def best_shift(z: np.ndarray, y: np.ndarray) -> float:
    """Moves the border to the middle of the widest gap with fewest errors."""
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    missed = np.concatenate([[0], np.cumsum(ys)])
    wrong = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - ys)])
    errors = missed + wrong
    edges = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
    width = np.concatenate([[0], np.diff(zs), [0]])
    best = np.lexsort((-width, errors))[0]
    return -float(edges[best])


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled rows outside the held-out fold. From the labels alone the
    2 * ``max_rows`` ids of smallest hash are drawn for each class; that list is
    broadcast, so no text is shuffled, and of the texts found the first of each
    class and length are taken."""
    known = labels.select(F.col("doc_id").alias("id"), (F.col("toxic") != 0).alias("y")).where("id is not null and y is not null")
    known = known.where(doc_remainder(modulus, "id") != 0).distinct().withColumn("h", F.xxhash64("id"))
    drawn = [known.where(F.col("y") == F.lit(toxic)).orderBy("h", "id").limit(2 * max_rows) for toxic in (True, False)]
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS))
    found = materialise(texts.join(F.broadcast(drawn[0].union(drawn[1])), "id").withColumn("long", F.length("text") > USUAL_CHARS), "sample")
    rows = []
    for toxic in (False, True):
        for long, most in ((False, max_rows), (True, MAX_LONG)):
            # Each task gives no more rows than are asked for.
            rows += found.where((F.col("y") == F.lit(toxic)) & (F.col("long") == F.lit(long))).orderBy("h", "id", "text").limit(most).collect()
    rows.sort(key=lambda r: (r["y"], r["h"], r["id"], r["text"]))
    return fit([r["text"] for r in rows], [int(r["y"]) for r in rows])


def score(df: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """``df`` with a score of 0 to 1 for every row. Narrow: no shuffle."""
    held = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != output]
    rows = whole_texts(df).select(*kept)
    from pyspark.sql.types import DoubleType, StructType

    schema = StructType([*rows.schema.fields]).add(output, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 1 << 20):
            scores = held.value.scores(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*kept, output])

    return rows.mapInArrow(run, schema)
