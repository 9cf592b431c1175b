"""Token-id output with Elias-Fano document boundaries.

`write_tokens` encodes texts and stores them, in ascending key order, as shards.
A shard is one binary record (layout below) in a Parquet column, so Spark's
commit protocol makes files whole when tasks are retried, on any store that
Spark reaches. `read_tokens` streams the shards back.

Shard layout, little-endian: magic ``VWEF``, id width u8 (2 or 4), null-key
count u32, documents u32, ids u64, key base i64; the Elias-Fano list of keys
minus base (null keys come first and count 0); the Elias-Fano list of document
ends; the ids. A list: low-bit width u8, length u32, bytes of the high part u32,
packed low bits, unary high bits, and the bit position of every 64th entry u32,
from which `select` finds any entry by a short popcount scan. Space is about
2 + log2(ids / documents) bits a document instead of a 64-bit table.

Defined cases: null or empty text has the end id alone; null keys sort first;
repeated keys stay separate documents, in order of their text's hash; an empty
table gives no shards; columns other than key and text are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_partitions, slices
from .pretokens import encoder

MAGIC = b"VWEF"
EVERY = 64
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
SHARD_SCHEMA = "part int, ids_before long, n_ids long, n_docs int, shard binary"
DOC_SCHEMA = "key long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing list of unsigned integers with select(i)."""

    def __init__(self, low: int, n: int, lows: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.low, self.n, self.lows, self.high, self.samples = low, n, lows, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        shifts = np.arange(low, dtype=np.uint64)
        lows = np.concatenate([((v[i : i + 65536, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel() for i in range(0, n, 65536)] or [np.zeros(0, np.uint8)])
        return cls(low, n, np.packbits(lows, bitorder="little"), np.packbits(bits, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<BII", self.low, self.n, len(self.high)) + self.lows.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        low, n, n_high = struct.unpack_from("<BII", data, at)
        at += 9
        sizes = ((n * low + 7) // 8, n_high, 4 * ((n + EVERY - 1) // EVERY))
        parts = []
        for size in sizes:
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(low, n, parts[0], parts[1], parts[2].view(np.uint32) if parts[2].flags.c_contiguous else parts[2].copy().view(np.uint32)), at

    def select(self, i: int) -> int:
        """Entry i, without decoding the list."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        position = int(self.samples[i // EVERY])
        left = i % EVERY
        byte, word = position // 8, int(self.high[position // 8]) & (0xFF << position % 8)
        while (found := int(_POP[word])) <= left:
            left -= found
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        bit = i * self.low
        lows = int.from_bytes(self.lows[bit // 8 : (bit + self.low + 7) // 8].tobytes(), "little") >> bit % 8
        return (one - i) << self.low | lows & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        out = (ones - np.arange(self.n, dtype=np.uint64)) << np.uint64(self.low)
        if self.low and self.n:
            bits = np.unpackbits(self.lows, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
            out |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out


def pack_shard(keys: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
    nulls = sum(k is None for k in keys)
    base = min((k for k in keys if k is not None), default=0)
    offsets = np.array([0 if k is None else k - base for k in keys], dtype=np.uint64)
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    body = np.concatenate(ids).astype(f"<u{width}").tobytes()
    head = MAGIC + struct.pack("<BIIQq", width, nulls, len(keys), int(ends[-1]), base)
    return head + EliasFano.of(offsets).to_bytes() + EliasFano.of(ends).to_bytes() + body


class Shard:
    """A shard's documents: document i is ids[end(i - 1) : end(i)]."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token shard")
        width, self.nulls, self.n_docs, self.n_ids, self.base = struct.unpack_from("<BIIQq", data, 4)
        view = memoryview(data)
        self.keys, at = EliasFano.from_bytes(view, 29)
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.keys.select(i)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_tokens(df: DataFrame, tokenizer_path: str, kind: str = "byte", key: str = "doc_id", text: str = "text", end_id: int = 0, shard_ids: int = 1 << 21) -> DataFrame:
    """Encode ``text`` and store shards in ascending ``key`` order in the shared
    folder; returns the stored shards (SHARD_SCHEMA). One shuffle of the texts,
    ranged by key (a hot key is split by text hash)."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(sized_partitions(rows), "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(tokenizer_path, kind)
        width = 2 if max(memo.library.get_vocab_size(), end_id + 1) <= 65536 else 4
        part = TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4")
        keys: list = []
        ids: list = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, ids, held, before
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_before": [before], "n_ids": [held], "n_docs": pa.array([len(keys)], pa.int32()), "shard": [pack_shard(keys, ids, width)]})
            before, keys, ids, held = before + held, [], [], 0
            return row

        for batch in slices(batches, "text", 4 << 20):
            for k, one in zip(batch.column("key").to_pylist(), memo.ids(batch.column("text").to_pylist()), strict=True):
                keys.append(k)
                ids.append(np.concatenate([one, end]))
                held += len(one) + 1
                if held >= shard_ids:
                    yield flush()
        if keys:
            yield flush()

    return materialise(rows.mapInArrow(encode, SHARD_SCHEMA), "tokens")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Per document, from the stored shards alone: key, start (ids before it in
    the whole output), n_tokens, ids_crc32. The broadcast holds one row for each
    write partition, of which `sized_partitions` allows 200,000 at most."""
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    from pyspark.sql import Window

    starts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    placed = shards.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("ids_before")).alias("at"), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column("at"), batch.column("shard"), strict=True):
                shard = Shard(data.as_py())
                keys = [shard.key(i) for i in range(shard.n_docs)]
                ends = np.array([shard.ends.select(i) for i in range(shard.n_docs)], np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = shard.ids.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + at.as_py()), pa.array(ends - starts), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(decode, DOC_SCHEMA)
