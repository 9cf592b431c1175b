"""Language ID: a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled by a forward and a backward GRU that read its
window of `WINDOW` bytes; the position's class probabilities are averaged over
the whole text. The network is trained in numpy by backpropagation through time
(`Network.train`) on a bounded sample of every label: `MAX_ROWS` texts of each and
`MAX_SAMPLE` in all, `CUTS` pieces of `CUT_CHARS` characters of each text. Weights
are a few kilobytes; scoring is narrow and reads whole texts, windows batched.

Defined cases: text that is null or has no letter is `und` with score 0; with no
label to learn from, every text is `und`; repeated rows are labelled each; null
labels are not learned from; an empty table gives none; other columns pass by
untouched, but those named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, slices, whole_texts

WINDOW = 128
HIDDEN = 12
MAX_ROWS = 500
#: Training texts in all; with many labels each has fewer.
MAX_SAMPLE = 32_000
CUTS = 6
CUT_CHARS = 64
UNKNOWN = "und"
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def gru(table: np.ndarray, u: np.ndarray, steps: np.ndarray, live: np.ndarray | None, keep: bool = False):
    """States (T, B, H) of a GRU over byte columns ``steps`` (T, B). ``table``
    holds each byte's input to the gates (reset, update: halved, for the logistic
    function is taken through tanh; candidate). ``live`` (T, B, 1) zeroes states
    at padding. keep: also what the backward pass needs."""
    t_max, batch = steps.shape
    h = u.shape[0]
    state = np.zeros((batch, h), np.float32)
    out = np.empty((t_max, batch, h), np.float32)
    saved = []
    for t in range(t_max):
        x = table[steps[t]]
        y = state @ u
        gates = np.tanh(x[:, : 2 * h] + y[:, : 2 * h])
        gates += 1
        gates *= 0.5
        r, z = gates[:, :h], gates[:, h:]
        n = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
        new = n + z * (state - n)
        if live is not None:
            new *= live[t]
        if keep:
            saved.append((state, r, z, n, y[:, 2 * h :]))
        out[t] = state = new
    return out, saved


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        scale = 1 / np.sqrt(hidden)
        self.p = {}
        for d in "fb":
            self.p["x" + d] = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
            self.p["u" + d] = (rng.standard_normal((hidden, 3 * hidden)) * scale).astype(np.float32)
        self.p["v"] = (rng.standard_normal((2 * hidden, len(languages))) * scale).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def states(self, steps: np.ndarray, live: np.ndarray | None, keep: bool = False):
        forward, sf = gru(self.p["xf"], self.p["uf"], steps, live, keep)
        backward, sb = gru(self.p["xb"], self.p["ub"], steps[::-1], live[::-1] if live is not None else None, keep)
        return np.concatenate([forward, backward[::-1]], axis=2), sf, sb

    def position_probabilities(self, steps: np.ndarray, live: np.ndarray | None, keep: bool = False):
        s, sf, sb = self.states(steps, live, keep)
        logits = s @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, s, sf, sb

    def _backward(self, d: str, steps: np.ndarray, saved: list, ds: np.ndarray, grad: dict) -> None:
        """Backpropagation through time of one direction; ``ds`` (T, B, H) is the
        loss's gradient at its states, in its own order of steps."""
        h, u = self.hidden, self.p["u" + d]
        gu, gx = grad["u" + d], grad["x" + d]
        carry = np.zeros_like(ds[0])
        for t in range(len(steps) - 1, -1, -1):
            state, r, z, n, yn = saved[t]
            g = ds[t] + carry
            dn = g * (1 - z) * (1 - n * n)
            dz = g * (state - n) * z * (1 - z) * 2
            dr = dn * yn * r * (1 - r) * 2
            dx = np.concatenate([dr, dz, dn], axis=1)
            dy = np.concatenate([dr, dz, dn * r], axis=1)
            gu += state.T @ dy
            np.add.at(gx, steps[t], dx)
            carry = g * z + dy @ u.T

    def train(self, pieces: np.ndarray, labels: np.ndarray, rounds: int = 160, batch: int = 192, rate: float = 0.02, seed: int = 7) -> None:
        """Cross-entropy of every position's label, Adam."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            pick = rng.integers(0, len(pieces), min(batch, 4 * len(pieces)))
            steps, y = np.ascontiguousarray(pieces[pick].T), labels[pick]
            probs, states, sf, sb = self.position_probabilities(steps, None, keep=True)
            probs[:, np.arange(len(y)), y] -= 1
            probs /= steps.size
            grad = {k: np.zeros_like(v) for k, v in self.p.items()}
            flat = probs.reshape(-1, probs.shape[2])
            grad["v"] += states.reshape(-1, states.shape[2]).T @ flat
            grad["c"] += flat.sum(axis=0)
            ds = probs @ self.p["v"].T
            self._backward("f", steps, sf, ds[:, :, : self.hidden], grad)
            self._backward("b", steps[::-1], sb, ds[::-1, :, self.hidden :], grad)
            slow = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s2[k] = 0.99 * s2[k] + 0.01 * g * g
                self.p[k] -= slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(s2[k] / (1 - 0.99**step)) + 1e-8)

    def pooled(self, texts: list[bytes], batch: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Mean position probabilities of each text (rows of zeros for empty ones)
        and the number of positions labelled as each language."""
        total = np.zeros((len(texts), len(self.languages)))
        votes = np.zeros((len(texts), len(self.languages)), np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        if len(owner):
            flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
            base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            start = base[owner] + place * WINDOW
            length = np.minimum(WINDOW, sizes[owner] - place * WINDOW)
            order = np.argsort(-length, kind="stable")
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                longest = int(length[own].max())
                steps = np.ascontiguousarray(flat[start[own][:, None] + np.arange(longest)].T)
                live = (np.arange(longest)[:, None] < length[own])[:, :, None]
                partial = not live.all()
                live = live.astype(np.float32)
                probs = self.position_probabilities(steps, live if partial else None)[0]
                won = probs.argmax(axis=2)
                if partial:
                    probs *= live
                    won[live[:, :, 0] == 0] = -1
                np.add.at(total, owner[own], probs.sum(axis=0, dtype=np.float64))
                for k in range(len(self.languages)):
                    np.add.at(votes[:, k], owner[own], (won == k).sum(axis=0))
        return total / np.maximum(sizes, 1)[:, None], votes

    def labels(self, text: str) -> list[str]:
        """The label of every byte of a text."""
        data = np.frombuffer(text.encode(), np.uint8)
        out: list[str] = []
        for i in range(0, len(data), WINDOW):
            probs = self.position_probabilities(data[i : i + WINDOW, None], None)[0]
            out += [self.languages[k] for k in probs[:, 0].argmax(axis=1)]
        return out


def train(df: DataFrame, modulus: int = 5, text: str = "text", label: str = "lang", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Network | None:
    """Fit on rows outside the held-out fold: of each label about ``max_rows``
    texts by hash (their share follows from counts of the label column alone),
    cut into CUTS pieces spread over the whole text."""
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("y"), F.col(text).cast("string").alias("t")).where("y is not null and t is not null").where(doc_remainder(modulus, "id") != 0)
    counts = rows.groupBy("y").count().orderBy(F.desc("count"), "y").limit(MAX_SAMPLE).collect()
    if not counts:
        return None
    max_rows = max(1, min(max_rows, MAX_SAMPLE // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["y"], min(1.0, 1.5 * max_rows / r["count"]))])
    h = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 40))
    rows = rows.where(F.rlike("t", F.lit(r"\p{L}"))).withColumn("h", h).where(F.col("h") < F.try_element_at(share, F.col("y")) * (1 << 40))
    size = F.length("t")
    cuts = F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)), lambda i: F.substring(F.col("t"), (F.lit(1) + F.floor((size - CUT_CHARS) * i / (CUTS - 1))).cast("int"), F.lit(CUT_CHARS)))
    cuts = F.when(size > CUT_CHARS, cuts).otherwise(F.array("t"))
    drawn = rows.orderBy("h", "id", "t").limit(2 * max_rows * len(counts)).select("y", cuts.alias("cuts")).collect()
    languages = sorted({r["y"] for r in drawn})
    if not languages:
        return None
    taken = dict.fromkeys(languages, 0)
    pieces, labels = [], []
    for r in drawn:
        taken[r["y"]] += 1
        if taken[r["y"]] <= max_rows:
            for c in r["cuts"]:
                data = c.encode()
                pieces.append((data * (CUT_CHARS // max(1, len(data)) + 1))[:CUT_CHARS] if data else bytes(CUT_CHARS))
                labels.append(languages.index(r["y"]))
    order = np.argsort(labels, kind="stable")
    labels = np.array(labels)[order]
    # Languages weigh alike: rare ones are repeated.
    most = np.bincount(labels).max()
    order = np.concatenate([np.resize(order[labels == k], most) for k in range(len(languages))])
    network = Network(languages)
    network.train(np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, CUT_CHARS)[order], np.repeat(np.arange(len(languages)), most))
    return network


def predict(df: DataFrame, network: Network | None, text: str = "text", outputs: tuple[str, str, str] = ("lang_pred", "score", "agreeing")) -> DataFrame:
    """``df`` with the predicted label, its pooled probability, and the share of
    positions whose own label it is."""
    held = df.sparkSession.sparkContext.broadcast(network)
    kept = [c for c in df.columns if c not in outputs]
    rows = whole_texts(df).select(*kept)
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*rows.schema.fields]).add(outputs[0], StringType()).add(outputs[1], DoubleType()).add(outputs[2], DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in slices(batches, text, 1 << 20):
            texts = batch.column(text).to_pylist()
            labels, scores, agree = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            if net is not None:
                own = [i for i, t in enumerate(texts) if has_letter(t)]
                data = [texts[i].encode() for i in own]
                probs, votes = net.pooled(data)
                for i, p, v, d in zip(own, probs, votes, data, strict=True):
                    k = int(p.argmax())
                    labels[i], scores[i], agree[i] = net.languages[k], min(1.0, p[k]), v[k] / len(d)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels), pa.array(scores), pa.array(agree)], names=[*kept, *outputs])

    return rows.mapInArrow(run, schema)
