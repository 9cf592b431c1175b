"""Language-model scoring by a weighted backoff automaton.

States are contexts: the root, the start of a text, and every word. Arcs from a
context are all pairs seen `CUTOFF` times or more, with interpolated absolute
discounting; a word without an arc takes the failure arc to the root at the
context's backoff weight, and there its own, additively smoothed weight. One
left-to-right walk carries the state and adds up log10 probabilities.

The corpus is read once. Batches of texts become blocks: token ids of a local
vocabulary of 64-bit word hashes. Blocks send their words, their pairs (as 64-bit
hashes of two words) and their contexts' discounted mass with training counts to
hash-dealt parts, which add up all blocks' counts and answer each block with the
sums of just its own entries. So exact counts of every word and pair are gathered
by shuffles that grow with the corpus, an entry goes once per block however often
it occurs, no task holds the model, nothing of it is broadcast, and a block is
scored with what it asked for. Of the blocks that ask for an arc one is named its
owner, which adds it to its context's mass.

Defined cases: null or empty text is the end token alone; rows with a null id
are learned from; nothing to learn from gives N = 0, V = 0 and base scores of
log10(1) each; repeated rows count and are scored each; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_remainder, materialise, sized_partitions, slices, text_bytes, whole_texts
from .jaccard_join import U, mix, word_hashes

#: A share of the training tokens under which a word has no arcs: none is cut.
SHARE = 0.0
CUTOFF = 2
DISCOUNT = 0.75
#: Mass is added up in quarters, which are whole numbers.
MASS_UNITS = 4
BLOCK_BYTES = 8 << 20
END = U(0x5851F42D4C957F2D)
START = U(0x14057B7EF767814F)
BLOCKS = "block long, n_train long, doc_ids array<long>, sizes array<int>, held array<boolean>, ids binary, occurs binary, vocabulary binary, counts binary"
REQUESTS = "part int, block long, entries binary, counts binary"
ANSWERS = "block long, part int, data binary, amount double"


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_planes(x: np.ndarray) -> bytes:
    """Numbers by planes of equal bytes."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def unsqueeze_planes(data: bytes, kind) -> np.ndarray:
    planes = unsqueeze(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind)[:, 0]


def by_rank(occurs: np.ndarray) -> np.ndarray:
    """A vocabulary's places, frequent words first."""
    return np.argsort(-occurs.astype(np.int64), kind="stable")


def pack(x: np.ndarray) -> bytes:
    """Ascending 64-bit hashes, by their steps."""
    return squeeze_planes(np.diff(x, prepend=U(0)))


def unpack(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze_planes(data, U), dtype=U)


def make_blocks(df: DataFrame, modulus: int, remainder: int, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("held", doc_remainder(modulus, "id") == remainder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        words, sizes, ids, held, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal words, sizes, ids, held, size, number
            every, n, h = np.concatenate(words), np.concatenate(sizes), np.concatenate(held)
            learn = np.repeat(~h, n)
            vocabulary, local = np.unique(every, return_inverse=True)
            counts = np.bincount(local[learn], minlength=len(vocabulary)).astype(np.uint32)
            occurs = np.bincount(local).astype(np.uint32)
            rank = np.empty(len(vocabulary), np.int32)
            rank[by_rank(occurs)] = np.arange(len(vocabulary), dtype=np.int32)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([int(learn.sum())]), pa.array([sum(ids, [])], pa.list_(pa.int64())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())), pa.array([h.tolist()], pa.list_(pa.bool_())), pa.array([squeeze_planes(rank[local])]), pa.array([squeeze_planes(occurs)]), pa.array([pack(vocabulary)]), pa.array([squeeze(counts)])],
                names=["block", "n_train", "doc_ids", "sizes", "held", "ids", "occurs", "vocabulary", "counts"],
            )
            words, sizes, ids, held, size = [], [], [], [], 0
            number += 1
            return out

        for batch in slices(batches, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            h, row = word_hashes(data, offsets)
            n = np.bincount(row, minlength=batch.num_rows)
            words.append(np.insert(h, np.cumsum(n), END))
            sizes.append(n + 1)
            ids.append(batch.column("id").to_pylist())
            held.append(batch.column("held").to_numpy(zero_copy_only=False))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield flush()
        if words:
            yield flush()

    return rows.mapInArrow(run, BLOCKS)


def dealt(entries: np.ndarray, n_parts: int) -> np.ndarray:
    """The part of each hash, ascending with it."""
    return (((entries >> U(32)) * U(n_parts)) >> U(32)).astype(np.int64)


def asked(n_parts: int, block: int, entries: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Requests of a block, a row for each part; ``entries`` ascend."""
    part = dealt(entries, n_parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    to = part[np.concatenate([[0], cuts])]
    return pa.RecordBatch.from_arrays(
        [pa.array(to.astype(np.int32)), pa.array(np.full(len(to), block, np.int64)), pa.array([pack(x) for x in np.split(entries, cuts)], pa.binary()), pa.array([squeeze(x) for x in np.split(counts.astype(np.int64), cuts)], pa.binary())],
        names=["part", "block", "entries", "counts"],
    )


def answered(requests: DataFrame, n_parts: int, summary) -> DataFrame:
    """Each part's sums, answered to every block that asked; ``summary(sums,
    inverse, firsts) -> (answers to all entries, amount)`` adds a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("part", "block", "entries", "counts")), strict=True):
                held.setdefault(row[0], []).append(row[1:])
        for part in list(held):
            rows = held.pop(part)
            entries = [unpack(r[1]) for r in rows]
            cuts = np.cumsum([len(e) for e in entries])[:-1]
            _, firsts, inverse = np.unique(np.concatenate(entries), return_index=True, return_inverse=True)
            del entries
            sums = np.bincount(inverse, weights=np.concatenate([unsqueeze(r[2], np.int64) for r in rows])).astype(np.int64)
            answers, amount = summary(sums, inverse, firsts)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows] + [None], pa.int64()), pa.array([part] * (n + 1), pa.int32()), pa.array([squeeze(a) for a in np.split(answers, cuts)] + [None], pa.binary()), pa.array([None] * n + [float(amount)], pa.float64())],
                names=["block", "part", "data", "amount"],
            )

    return requests.repartition(n_parts, "part").mapInArrow(run, ANSWERS)


def pair_hashes(local: np.ndarray, sizes: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token (len(vocabulary): the start of the text), and the
    hash of the two."""
    before = np.concatenate([[0], local[:-1]])
    before[np.cumsum(sizes) - sizes] = len(vocabulary)
    return before, mix(mix(np.append(vocabulary, START))[before] + vocabulary[local])


def contexts_of(vocabulary: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's contexts (places in its vocabulary, the start after the last), in
    the order of their hashes, and those."""
    names, places = np.append(vocabulary, START), np.flatnonzero(np.append(often, True))
    places = places[np.argsort(names[places])]
    return places, names[places]


def row_arrays(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = batch.column("sizes")[i].values.to_numpy()
    held = batch.column("held")[i].values.to_numpy(zero_copy_only=False)
    local = by_rank(unsqueeze_planes(batch.column("occurs")[i].as_py(), np.uint32))[unsqueeze_planes(batch.column("ids")[i].as_py(), np.int32)]
    return local, sizes.astype(np.int64), held, unpack(batch.column("vocabulary")[i].as_py())


def restore(answers: list) -> np.ndarray:
    """A block's answers, in the order of its entries."""
    return np.concatenate([unsqueeze(a["data"], np.int64) for a in answers])


def score(df: DataFrame, modulus: int = 7, remainder: int = 2, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score. Rows whose crc32 remainder is ``remainder`` are not learned from."""
    spark = whole_texts(df).sparkSession
    n_parts = sized_partitions(df.select(text), 24 << 20)
    blocks = materialise(make_blocks(df, modulus, remainder, key, text), "blocks")
    facts = blocks.agg(F.sum("n_train").alias("n"), F.count("*").alias("blocks"), F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + F.when(h, 0).otherwise(1))).alias("texts")).first()
    total, n_texts = facts["n"] or 0, facts["texts"] or 0
    least = max(CUTOFF, share * total)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary = unpack(batch.column("vocabulary")[i].as_py())
                yield asked(n_parts, batch.column("block")[i].as_py(), vocabulary, unsqueeze(batch.column("counts")[i].as_py(), np.uint32))

    # The amount of a part is its number of distinct words.
    words = materialise(answered(blocks.select("block", "vocabulary", "counts").mapInArrow(ask_words, REQUESTS), n_parts, lambda sums, inverse, _: (sums[inverse], (sums > 0).sum())), "word-counts")
    distinct = int(words.agg(F.sum("amount")).first()[0] or 0)

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                local, sizes, held, vocabulary = row_arrays(batch, i)
                pairs, inverse = np.unique(pair_hashes(local, sizes, vocabulary)[1], return_inverse=True)
                counts = np.bincount(inverse[np.repeat(~held, sizes)], minlength=len(pairs))
                yield asked(n_parts, batch.column("block")[i].as_py(), pairs, counts)

    def arcs(sums: np.ndarray, inverse: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, int]:
        """Twice the count of each arc, and one more for its owner; 0 for no arc."""
        arc = np.where(sums >= CUTOFF, sums, 0)
        answers = 2 * arc[inverse]
        answers[firsts] += arc > 0
        return answers, 0

    pairs = materialise(answered(blocks.select("block", "sizes", "held", "ids", "occurs", "vocabulary").mapInArrow(ask_pairs, REQUESTS), n_parts, arcs), "pair-counts")

    def weighed(batch: pa.RecordBatch, i: int):
        """A block's words' counts and contexts, each token's word before and the
        count of its arc, and its distinct pairs' (word before, count, owned)."""
        local, sizes, _, vocabulary = row_arrays(batch, i)
        counts = restore(batch.column("words")[i].as_py())
        often = counts >= least
        before, keys = pair_hashes(local, sizes, vocabulary)
        _, firsts, inverse = np.unique(keys, return_index=True, return_inverse=True)
        told = restore(batch.column("pairs")[i].as_py())
        told = np.where(np.append(often, True)[before[firsts]] & often[local[firsts]], told, 0)
        return counts, contexts_of(vocabulary, often), before, (told >> 1)[inverse], (before[firsts], told >> 1, told & 1 == 1)

    def ask_mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts, (places, names), _, _, (before, arc, owned) = weighed(batch, i)
                mass = np.bincount(before[owned], weights=arc[owned] - DISCOUNT, minlength=len(counts) + 1)
                yield asked(n_parts, batch.column("block")[i].as_py(), names, np.rint(mass[places] * MASS_UNITS))

    def own_answers(answers: DataFrame, name: str) -> DataFrame:
        return answers.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "data"))).alias(name))

    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), facts["blocks"] // 4)
    asked_words, asked_pairs = own_answers(words, "words"), own_answers(pairs, "pairs")
    ready = blocks.drop("counts", "n_train").repartition(n_tasks, "block").join(asked_words, "block").join(asked_pairs, "block")
    mass = materialise(answered(ready.select("block", "sizes", "held", "ids", "occurs", "vocabulary", "words", "pairs").mapInArrow(ask_mass, REQUESTS), n_parts, lambda sums, inverse, _: (sums[inverse], 0)), "context-mass")
    ready = ready.join(own_answers(mass, "mass"), "block")
    scale = total + 1 * (distinct + 1)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                local, sizes, held, vocabulary = row_arrays(batch, i)
                counts, (places, _), before, seen, _ = weighed(batch, i)
                # At the root a word has its own weight; in a context, its arc's
                # discounted share and what the failure arc lets through.
                context_count = np.maximum(np.append(counts, n_texts), 1)
                lost = np.zeros(len(context_count))
                lost[places] = restore(batch.column("mass")[i].as_py()) / MASS_UNITS
                p = ((counts + 1) / scale)[local]
                p_inside = np.maximum(seen - DISCOUNT, 0) / context_count[before] + (1 - lost / context_count)[before] * p
                base = np.log10(p)
                full = np.log10(p_inside)
                first = np.cumsum(sizes) - sizes
                known = (counts > 0)[local]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids")[i].values, pa.array(held), pa.array(sizes), pa.array(np.add.reduceat(known.astype(np.int64), first)), pa.array(np.full(n, total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(full, first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return ready.mapInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
