"""Best-fit packing with exact-complement hashing.

Documents become pieces of at most ``capacity`` ids. Only the counts of the
piece lengths (at most ``capacity`` of them) reach the driver. There `plan`
fills gaps exactly, longest pieces first: the gap beside a piece is looked up
among single lengths, then sums of two, then sums of three, each combination
used as often as its lengths are available; what is left goes best-fit in
decreasing order. All steps work on counts, so the plan's size depends on the
capacity, never on the number of documents. Pieces then find their place from
their rank within their length, without any shuffle of texts.

Defined cases: null or empty text is the end id alone; repeated rows are packed
each; documents are cut only if longer than the capacity; an empty table packs
to nothing; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .pretokens import encoder

PIECES = "key {kind}, piece int, start long, length int, ids_crc32 long, part int, local long"


class Plan:
    """Groups of equal sequences. Slots: (length, copies, offset)."""

    def __init__(self, capacity: int):
        self.capacity, self.groups = capacity, []

    def add(self, count: int, gap: int, slots: tuple) -> None:
        self.groups.append((count, gap, slots))

    def runs(self) -> np.ndarray:
        """Rows (length, first rank, ranks, first sequence, offset, copies), sorted:
        rank r of a length has sequence first + (r - rank) // copies."""
        rows, used, sequence = [], Counter(), 0
        for count, _, slots in self.groups:
            for length, copies, offset in slots:
                rows.append((length, used[length], count * copies, sequence, offset, copies))
                used[length] += count * copies
            sequence += count
        return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)

    @property
    def sequences(self) -> int:
        return sum(g[0] for g in self.groups)


def exact_complements(left: np.ndarray, plan: Plan) -> None:
    """Consume combinations that fill sequences exactly; ``left`` (pieces of each
    length) is updated."""
    capacity = plan.capacity

    def take(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        times = min(int(left[x]) // n for x, n in need.items())
        if times <= 0:
            return False
        offset, slots = 0, []
        for x in lengths:
            left[x] -= times
            slots.append((x, 1, offset))
            offset += x
        plan.add(times, 0, tuple(slots))
        return True

    def pairs(total: int, most: int) -> np.ndarray:
        """The larger lengths a of available pairs (a, total - a)."""
        a = np.arange(min(most, total - 1), (total + 1) // 2 - 1, -1)
        a = a[(a > 0) & (a < total)]
        return a[(left[a] > 0) & (left[total - a] > 0)]

    def pair_sums() -> np.ndarray:
        there = (left > 0).astype(np.float64)
        size = 1 << (2 * capacity + 2).bit_length()
        f = np.fft.rfft(there, size)
        return np.fft.irfft(f * f, size)[: capacity + 1] > 0.5

    sums = pair_sums()
    for length in range(capacity, 0, -1):
        if not left[length]:
            continue
        gap = capacity - length
        if gap == 0:
            take((length,))
            continue
        take((length, gap))
        for a in pairs(gap, length).tolist():
            if not left[length]:
                break
            take((length, a, gap - a))
        if not left[length]:
            continue
        if length % 64 == 0:
            sums = pair_sums()
        a = np.arange(min(length, gap - 2), 0, -1)
        a = a[(left[a] > 0) & sums[gap - a]] if len(a) else a
        for x in a.tolist():
            if not left[length]:
                break
            for y in pairs(gap - x, x).tolist():
                if not left[length] or not left[x]:
                    break
                take((length, x, y, gap - x - y))


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Best-fit decreasing of what is left, in bulk."""
    capacity = plan.capacity
    open_groups: dict[int, list[tuple[int, tuple]]] = defaultdict(list)
    gaps: list[int] = []

    def reopen(count: int, gap: int, slots: tuple) -> None:
        if not open_groups[gap]:
            bisect.insort(gaps, gap)
        open_groups[gap].append((count, slots))

    def fill(count: int, gap: int, slots: tuple, length: int, pieces: int) -> int:
        """Fill bins of one kind to the brim with copies; returns pieces placed."""
        copies = min(gap // length, pieces)
        full = min(count, pieces // copies)
        placed = full * copies
        rest = min(pieces - placed, copies) if full < count else 0
        offset = capacity - gap
        reopen(full, gap - copies * length, (*slots, (length, copies, offset)))
        if rest:
            reopen(1, gap - rest * length, (*slots, (length, rest, offset)))
        if (unused := count - full - bool(rest)) > 0:
            reopen(unused, gap, slots)
        return placed + rest

    for length in range(capacity, 0, -1):
        while pieces := int(left[length]):
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                count, slots = open_groups[gap].pop()
                if not open_groups[gap]:
                    gaps.pop(at)
                left[length] -= fill(count, gap, slots, length, pieces)
            else:
                per = capacity // length
                left[length] -= fill(-(-pieces // per), capacity, (), length, pieces)
    for gap, groups in open_groups.items():
        for count, slots in groups:
            plan.add(count, gap, slots)


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    plan = Plan(capacity)
    exact_complements(left, plan)
    best_fit(left, plan)
    return plan


def cut_pieces(df: DataFrame, tokenizer_path: str, kind: str, key: str, text: str, end_id: int, capacity: int, outputs: bool) -> DataFrame:
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = PIECES.format(kind=rows.schema["key"].dataType.simpleString()) + ", ids binary" * outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path, kind)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        seen: Counter = Counter()
        for batch in slices(batches, "text", 4 << 20):
            keys, cols = [], defaultdict(list)
            for k, ids in enumerate(memo.ids(batch.column("text").to_pylist())):
                ids = np.concatenate([ids, end])
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    keys.append(k)
                    for name, v in (("piece", piece), ("start", start), ("length", len(own)), ("crc", zlib.crc32(own)), ("local", seen[len(own)])):
                        cols[name].append(v)
                    if outputs:
                        cols["ids"].append(own.tobytes())
                    seen[len(own)] += 1
            arrays = [batch.column("key").take(pa.array(keys, pa.int64())), pa.array(cols["piece"], pa.int32()), pa.array(cols["start"], pa.int64()), pa.array(cols["length"], pa.int32()), pa.array(cols["crc"], pa.int64()), pa.array([part] * len(keys), pa.int32()), pa.array(cols["local"], pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32", "part", "local"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(cols["ids"], pa.binary())] * outputs, names=names + ["ids"] * outputs)

    return rows.mapInArrow(run, schema)


def pack(df: DataFrame, tokenizer_path: str, kind: str = "word", key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = 4096, outputs: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id,
    offset; with ``outputs`` also the piece's ids (little-endian u4). A piece's
    rank within its length is its task's base plus its place in the task, both
    of one written table, so a retried task cannot change them half-way."""
    spark = df.sparkSession
    pieces = materialise(cut_pieces(df, tokenizer_path, kind, key, text, end_id, capacity, outputs), "pieces")
    per_part = pieces.groupBy("length", "part").agg(F.max("local").alias("n")).withColumn("n", F.col("n") + 1)
    # At most `capacity` rows come to the driver, whatever the number of documents.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = make_plan(counts, capacity).runs()
    held = spark.sparkContext.broadcast((runs[:, 0] << 48 | runs[:, 1], runs))
    base = per_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("base") + F.col("local")).drop("base", "local", "part")
    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * outputs
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, table = held.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            run = table[np.searchsorted(starts, length << 48 | rank, side="right") - 1] if len(rank) else table[:0]
            within = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(run[:, 3] + within // run[:, 5]), pa.array(run[:, 4] + within % run[:, 5] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema).withColumnRenamed("key", key)
