"""N-gram Jaccard self-join by PartEnum signatures, up to connected components.

A document is the set of its distinct word n-grams, as 64-bit hashes. Sets of
equal content are one class and are joined once. Sizes fall into bands such that
partners lie in the same or the next band. Two sets of a band with Jaccard
similarity of at least p / q differ in at most k elements, so of the band's
floor(k / 2) + 1 (plus spare) parts of the feature domain at least one holds at
most one difference; each part is cut in three, and leaving out each third in
turn gives three signatures, one of which both sets share. A set signs for its
own band and the next. Spare parts let a set leave out signatures of empty
content (which would match at random), unless it has more of them than spares.

Signatures are packed per batch: entries of a signature that meet in a batch
leave as one, with the batch's other members beside it, so a hot signature sends
one entry a batch. Classes that share a signature are candidates, and links are
checked on the exact sets. Near copies share most of their signatures, so equal
small buckets count once, and middle-sized ones of one least class are put together. Only components are wanted, so pairs within a bucket
of any size are never all formed: up to `SMALL_BUCKET` classes they are, thinned
by sketches that bound the difference from below, and by the same sketches those
of up to `MIDDLE_BUCKET` are split first. From larger ones those go that share too
few elements with all others there; in what stays large a class meets the most central class of its buckets
(its pivot) and is known from then on by what it differs in from the pivot's
group at large. Members near that consensus are linked by their distances from
it; a member that is not can only be linked to one that shares some of its
differences, and prefixes of the rarest differences find those. Every link
between different components is thus found or implied, whatever a group's size.
Nothing of all documents comes to the driver; lineage ends in written tables.

Defined cases: null or empty texts and texts without a word have no set and link
with nothing; fewer words than n make one n-gram; rows of one id are one
document and their texts' classes count as linked; rows with a null id link like
others and take their component's name, null where no row of it has an id; a
component is named by its smallest id; a very long text is one set like any other;
an empty table gives none; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, sized_partitions, slices, text_bytes, whole_texts
from .pretokens import forget

U = np.uint64
_M1, _M2, _BASE = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
PARTS, LEFT_OUT = 3, 1
#: Cells of a set's sketch, one for one or two of its elements within these bounds,
#: and what a cell's half-byte holds; sets over LONG_SET have a byte each for more.
LEAST_CELLS, CELLS, MOST_IN_CELL = 32, 512, 15
LONG_SET, LONG_CELLS = 2048, 2048
#: Elements to a cell, about, at least half as many: of sketches, and of the coarse
#: ones that part sets with little in common before sketches travel.
FINE, COARSE = 2, 8
#: The low bits of a signature name the part where it meets others. The other 40
#: travel; chance hits among the entries of a part only add candidates.
PART_BITS = 24
#: A part's entries carry its classes' hashes, so more parts than these are made
#: only for their size, whatever the session's setting.
USUAL_PARTS = 256
#: Buckets of up to so many classes form all their pairs, which sketches thin out.
SMALL_BUCKET = 8
#: Those of up to so many are split within a task into what sketches let belong
#: together; most crowded buckets only share a few frequent n-grams.
MIDDLE_BUCKET = 512
#: Middle-sized buckets are put together up to so many times MIDDLE_BUCKET classes.
FAMILY = 4
#: Elements of a group that meet in one task, about.
PIECE = 1 << 18
#: Bits of a bitmap that tells which ids are wanted, for each id and in a row of it,
#: and its rows at most (4 MB are broadcast).
BITS_EACH, BITS_ROW, MOST_ROWS = 16, 1 << 15, 1024
SPARE, SPARE_FROM = 2, 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letters = mix(np.arange(1, 257, dtype=U) * _BASE)
    letters[65:91] = letters[97:123]  # A-Z count as a-z
    separator = np.zeros(256, bool)
    separator[[0x20, *range(0x09, 0x0E)]] = True
    inverse = U(pow(int(_BASE), -1, 2**64))
    return letters, separator, np.array([inverse])


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(size - 1, b, U)])) for b in (_BASE, _tables()[2][0])]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word of the concatenated texts."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, np.int64)
    letters, separator, _ = _tables()
    gap = separator[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    word = ~gap
    before = np.concatenate([[True], gap[:-1]]) | first[:-1]
    after = np.concatenate([gap[1:], [True]]) | first[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after)
    up, down = powers(len(data))
    total = np.cumsum(letters[data] * up, dtype=U)
    h = total[ends] - np.where(starts > 0, total[starts - 1], U(0))
    h = mix(h * down[starts] + (ends - starts + 1).astype(U) * _M2)
    return h, np.searchsorted(offsets, starts, side="right") - 1


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' distinct n-gram hashes, sorted within the row, and each row's
    number of them."""
    data, offsets = text_bytes(column)
    h, row = word_hashes(data, offsets)
    rows = len(column)
    words = np.bincount(row, minlength=rows) if len(row) else np.zeros(rows, np.int64)
    begin = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
    out, sizes = [], np.zeros(rows, np.int64)
    if len(h) >= n:
        gram = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            gram = mix(gram * _M1 + h[i : len(h) - n + 1 + i])
    else:
        gram = h[:0]
    for i in range(rows):
        if words[i] >= n:
            own = np.unique(gram[begin[i] : begin[i] + words[i] - n + 1])
        elif words[i]:
            own = h[begin[i] : begin[i] + 1]
            for j in range(begin[i] + 1, begin[i] + words[i]):
                own = mix(own * _M1 + h[j : j + 1])
            own = mix(own ^ words[i : i + 1].astype(U) * _BASE)
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U)), sizes


class Bands:
    """Size bands and their parameters for similarity of at least p / q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.ends = [1]

    def grow(self, size: int) -> np.ndarray:
        """Largest sizes of the bands, two past the one that holds ``size``."""
        while len(self.ends) < 3 or self.ends[-3] < size:
            after = self.ends[-1]
            self.ends.append(max(after + 1, after * self.q // self.p))
        return np.array(self.ends, np.int64)

    def differences(self, ends: np.ndarray) -> np.ndarray:
        """The most elements in which two sets of a band's largest size differ."""
        return (self.q - self.p) * 2 * ends // (self.q + self.p)


def signatures(elements: np.ndarray, sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets and the set (by place in ``sizes``) of each."""
    ends = bands.grow(int(sizes.max(initial=1)))
    own_band = np.searchsorted(ends, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = mix(elements ^ _BASE)
    content = mix(elements + _M1)
    sigs, sets = [], []
    for shift in (0, 1):
        band = own_band + shift
        k = bands.differences(ends[band])
        spare = np.where(k >= SPARE_FROM, SPARE, 0)
        live = (sizes > 0) & (k > 0)
        parts = np.where(live, k // (LEFT_OUT + 1) + 1 + spare, 0)
        base = np.concatenate([[0], np.cumsum(parts)])
        total = int(base[-1])
        if not total:
            continue
        use = live[owner]
        who = owner[use]
        part = base[who] + ((place[use] >> U(33)) % parts[who].astype(U)).astype(np.int64)
        cell = part * PARTS + ((place[use] & U(0xFFFFFFFF)) % U(PARTS)).astype(np.int64)
        sums = np.zeros(total * PARTS, U)
        np.add.at(sums, cell, content[use])
        filled = np.bincount(cell, minlength=total * PARTS).reshape(total, PARTS)
        sums = sums.reshape(total, PARTS)
        of = np.repeat(np.arange(len(sizes)), parts)
        number = np.arange(total) - base[of]
        blank = filled.sum(axis=1, keepdims=True) - filled == 0
        bad = np.bincount(of, weights=blank.any(axis=1), minlength=len(sizes))
        keep = ~blank | (bad > spare)[of][:, None]
        salt = mix((band[of].astype(U) << U(40)) + (number.astype(U) << U(2)))
        sig = mix(sums.sum(axis=1, dtype=U)[:, None] - sums + salt[:, None] + np.arange(PARTS, dtype=U))
        sigs.append(sig[keep])
        sets.append(np.broadcast_to(of[:, None], keep.shape)[keep])
    if not sigs:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(sets)


def class_hashes(elements: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each set's content, as signed 64-bit; 0 for empty sets."""
    content = mix(elements ^ _M2)
    total = np.concatenate([[U(0)], np.cumsum(content, dtype=U)])
    ends = np.cumsum(sizes)
    h = mix(total[ends] - total[ends - sizes] + sizes.astype(U) * _BASE)
    return np.where(sizes > 0, h, U(0)).view(np.int64)


def sketches(elements: np.ndarray, sizes: np.ndarray, each: int = FINE) -> list[bytes]:
    """How many elements of each set fall into each cell, up to what a cell holds.
    The cells' differences sum to no more than what two sets differ in."""
    long_cells = LONG_CELLS * FINE // each
    cell = (mix(elements + _BASE) >> U(33)).astype(np.int64) % LONG_CELLS
    out, end = [], np.cumsum(sizes)
    for a, b in zip((end - sizes).tolist(), end.tolist(), strict=True):
        if b - a > LONG_SET:
            out.append(np.minimum(np.bincount(cell[a:b] % long_cells, minlength=long_cells), 255).astype(np.uint8).tobytes())
        else:
            cells = min(CELLS, max(LEAST_CELLS, 1 << max(0, (b - a - 1) // each).bit_length()))
            half = np.minimum(np.bincount(cell[a:b] % cells, minlength=cells), MOST_IN_CELL).astype(np.uint8)
            out.append((half[0::2] << 4 | half[1::2]).tobytes())
    return out


def cells_of(sketches: list[bytes]) -> np.ndarray:
    """Their cells, folded to the coarsest form among them; the sizes of sets that
    share a bucket are near, and so are their forms."""
    wide = [len(x) > CELLS // 2 for x in sketches]  # a byte for a cell
    least = min((len(x) if w else 2 * len(x) for x, w in zip(sketches, wide, strict=True)), default=CELLS)
    most = 255 if all(wide) else MOST_IN_CELL
    out = np.empty((len(sketches), least), np.int16)
    for i, x in enumerate(sketches):
        cells = np.frombuffer(x, np.uint8)
        if not wide[i]:
            cells = np.stack([cells >> 4, cells & 15], axis=1).ravel()
        if len(cells) > least:
            cells = cells.reshape(-1, least).sum(axis=0, dtype=np.int64)
        out[i] = np.minimum(cells, most)
    return out


def classify(df: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, cls (null without a set), sketch, coarse. Narrow."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in slices(batches, "text"):
            elements, sizes = shingle_sets(batch.column("text"), n)
            cells = [pa.array(sketches(elements, sizes, each), pa.binary()) for each in (FINE, COARSE)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(class_hashes(elements, sizes), mask=sizes == 0), *cells], names=["doc_id", "n_shingles", "cls", "sketch", "coarse"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, cls long, sketch binary, coarse binary")


def buckets(df: DataFrame, n: int, p: int, q: int, text: str, n_parts: int, plain: bool = False) -> DataFrame:
    """(sig, cls, pivot) of every signature that two classes share; ``plain``: of
    every element."""
    rows = df.select(F.col(text).cast("string").alias("text")).where("text is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        bands = Bands(p, q)
        for number, batch in enumerate(slices(batches, "text")):
            elements, sizes = shingle_sets(batch.column("text"), n)
            cls = class_hashes(elements, sizes)
            # Copies within the batch sign once.
            _, once = np.unique(cls, return_index=True)
            first = np.zeros(len(sizes), bool)
            first[once] = True
            keep = first & (sizes > 0)
            own = elements[np.repeat(keep, sizes)]
            sig, of = (own, np.repeat(np.arange(int(keep.sum())), sizes[keep])) if plain else signatures(own, sizes[keep], bands)
            sig = sig >> U(PART_BITS) << U(PART_BITS) | (sig & U((1 << PART_BITS) - 1)) % U(n_parts)
            cls = cls[keep][of]
            order = np.lexsort((cls, sig))
            sig, cls, of = sig[order], cls[order], of[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
            lead = np.flatnonzero(new)
            shared = ~new  # members beside the batch's pivot of the signature
            pivot = cls[lead][np.cumsum(new) - 1] if len(sig) else cls
            if shared.any():
                at = np.flatnonzero(shared)
                for piece in np.array_split(at, len(at) // 500_000 + 1):
                    yield _packed([n_parts + (number * 7919 + int(sig[piece[0]] % U(n_parts))) % n_parts], [sig[piece]], [cls[piece]], [pivot[piece]])
            # By part and class: a class is named once with the number of its entries.
            sig, cls, of = sig[lead], cls[lead], of[lead]
            to = (sig & U((1 << PART_BITS) - 1)).astype(np.int64)
            order = np.argsort(to * len(sizes) + of, kind="stable")
            sig, cls, to, of = sig[order], cls[order], to[order], of[order]
            if len(to):
                named = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (of[1:] != of[:-1])]))
                parts, first = np.unique(to, return_index=True)
                counts = np.split(np.diff(np.append(named, len(to))), np.searchsorted(named, first[1:]))
                classes = np.split(cls[named], np.searchsorted(named, first[1:]))
                yield _packed(parts.tolist(), [_short(x) for x in np.split(sig, first[1:])], classes, None, [x.astype(np.min_scalar_type(x.max())) for x in counts])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for part, s, c, b, n in zip(*(batch.column(x).to_pylist() for x in ("part", "sigs", "classes", "pivots", "counts")), strict=True):
                if b is not None:
                    s, c, b = np.frombuffer(s, U), np.frombuffer(c, np.int64), np.frombuffer(b, np.int64)
                    yield _members(np.concatenate([s, s]), np.concatenate([c, b]), np.concatenate([b, b]))
                else:
                    held.setdefault(part, []).append((s, c, n))
        for part, rows in held.items():
            sig = np.concatenate([_long(s, part) for s, _, _ in rows])
            cls = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(n, f"u{8 * len(n) // len(c)}")) for _, c, n in rows])
            rows.clear()
            order = np.lexsort((cls, sig))
            sig, cls = sig[order], cls[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            bucket = np.cumsum(new) - 1
            fresh = new | np.concatenate([[True], cls[1:] != cls[:-1]])
            several = np.bincount(bucket[fresh]) > 1
            keep = fresh & several[bucket]
            yield _members(sig[keep], cls[keep], cls[np.flatnonzero(new)][bucket[keep]])

    packed = rows.mapInArrow(sign, "part int, sigs binary, classes binary, pivots binary, counts binary")
    return packed.repartition(n_parts, "part").mapInArrow(meet, "sig long, cls long, pivot long")


def _short(sig: np.ndarray) -> np.ndarray:
    """Signatures without their part, five bytes each."""
    rest = sig >> U(PART_BITS)
    return np.concatenate([(rest & U(0xFFFFFFFF)).astype("<u4").view(np.uint8), (rest >> U(32)).astype(np.uint8)])


def _long(data: bytes, part: int) -> np.ndarray:
    n = len(data) // 5
    rest = np.frombuffer(data, np.uint8, n, 4 * n).astype(U) << U(32) | np.frombuffer(data, "<u4", n)
    return rest << U(PART_BITS) | U(part)


def _packed(to: list, sigs: list, classes: list, pivots: list | None, counts: list | None = None) -> pa.RecordBatch:
    blob = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary()) if xs else pa.nulls(len(to), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), blob(sigs), blob(classes), blob(pivots), blob(counts)], names=["part", "sigs", "classes", "pivots", "counts"])


def _members(sig: np.ndarray, cls: np.ndarray, pivot: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls), pa.array(pivot)], names=["sig", "cls", "pivot"])


def likely(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id may be among those of ``wanted``, by a
    bitmap of their hashes: a join after it shuffles few texts beside the wanted
    ones. None of these is lost; rows without an id go."""
    ids = wanted.where("doc_id is not null").select("doc_id")
    n_rows = min(MOST_ROWS, ids.count() * BITS_EACH // BITS_ROW + 1)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n_rows * BITS_ROW))
    place = lambda df: df.withColumn("__row", F.floor(at / BITS_ROW)).withColumn("__bit", at % BITS_ROW)
    bits = place(ids).groupBy("__row").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = place(texts.where("doc_id is not null")).join(F.broadcast(bits), "__row")
    return rows.where(F.floor(byte / F.pow(F.lit(2), F.col("__bit") % 8)) % 2 == 1).select(*texts.columns)


def with_partners(crowd: DataFrame, firsts: DataFrame, df: DataFrame, n: int, p: int, q: int, key: str, text: str, n_parts: int) -> DataFrame:
    """The rows (sig, cls, w) of ``crowd`` whose class can be linked within it: a link
    needs p / q of the class's elements in another class. Most that meet in a hot
    signature have one frequent n-gram in common and hardly more. Counts are high
    where hashes collide or a row repeats, never low."""
    classes = materialise(firsts.join(crowd.select("cls").distinct(), "cls", "left_semi").select("cls", "doc_id", "size"), "hot-classes")
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = likely(texts, classes).join(classes.select("doc_id"), "doc_id", "left_semi").select("text").unionByName(texts.where("doc_id is null").select("text"))
    shared = buckets(texts, n, p, q, "text", n_parts, plain=True).groupBy("cls").agg(F.count("*").alias("n"))
    linked = classes.join(shared, "cls").where(q * F.col("n") >= p * F.col("size")).select("cls")
    return crowd.join(linked, "cls", "left_semi").select("sig", "cls", "w")


def exact_sets(df: DataFrame, wanted: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(cls, elements binary) of the wanted (cls, doc_id), a row for each cls: rows
    of one id can be in several tasks (broadcast joins, split partitions). Classes
    of rows without an id are found by their content."""
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null")
    rows = likely(texts, wanted).join(wanted, "doc_id").select("cls", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            elements, sizes = shingle_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([pa.array(class_hashes(elements, sizes)), batch.column("text")], names=["cls", "text"])

    nameless = texts.where("doc_id is null").select("text").mapInArrow(hashed, "cls long, text string")
    rows = rows.unionByName(nameless.join(wanted.where("doc_id is null").select("cls"), "cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # most repeated rows go before the shuffle
        for batch in slices(batches, "text"):
            elements, sizes = shingle_sets(batch.column("text"), n)
            own = class_hashes(elements, sizes)
            cls = batch.column("cls").to_numpy()
            cuts = np.split(elements, np.cumsum(sizes)[:-1])
            right = []
            for i in np.flatnonzero((sizes > 0) & (own == cls)).tolist():
                if int(cls[i]) not in done:
                    done.add(int(cls[i]))
                    right.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(cls[right]), pa.array([cuts[i].tobytes() for i in right], pa.binary())], names=["cls", "elements"])

    return rows.mapInArrow(run, "cls long, elements binary").dropDuplicates(["cls"])


def differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(c, x, m, size, n_diff, diff): each pair's symmetric difference; where the
    group has only the two, its size alone."""
    rows = pairs.join(sets.toDF("c", "left"), "c").join(sets.toDF("x", "right"), "x").select("c", "x", "m", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            sizes, counts, found = [], [], []
            for m, x, y in zip(batch.column("m").to_pylist(), batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                d = np.setxor1d(x, y, assume_unique=True)
                sizes.append(len(y))
                counts.append(len(d))
                found.append(d.view(np.int64) if m > 2 else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in "cxm"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["c", "x", "m", "size", "n_diff", "diff"])

    return rows.mapInArrow(run, "c long, x long, m long, size long, n_diff long, diff array<long>")


def tested(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) that are linked, by their exact sets."""
    rows = pairs.join(sets.toDF("a", "left"), "a").join(sets.toDF("b", "right"), "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "right"):
            ok = []
            for x, y in zip(batch.column("left"), batch.column("right"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(q * both >= p * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def thinned(every: DataFrame) -> DataFrame:
    """(sig, cls, n, low) of the buckets ``every`` with their sizes and least classes;
    of small buckets of the same classes, told by size, least class and the xor of
    hashes, one."""
    full = every.groupBy("sig").agg(F.count("*").alias("n"), F.min("cls").alias("low"), F.bit_xor(F.xxhash64("cls")).alias("all"))
    one = full.groupBy("n", "low", F.when(F.col("n") <= SMALL_BUCKET, F.col("all")).otherwise(F.col("sig")).alias("all")).agg(F.min("sig").alias("sig"))
    return every.join(one, "sig").select("sig", "cls", "n", "low")


def families(middle: DataFrame) -> DataFrame:
    """(sig, cls, w) of middle-sized buckets, those of one least class put together
    under it; w of them hold the class. Sketches then travel once for all buckets
    that near copies share. Where too many classes would meet, buckets stay apart."""
    met = materialise(middle.groupBy("low", "cls").agg(F.count("*").alias("w")), "families")
    wide = met.groupBy("low").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY * MIDDLE_BUCKET).select("low")
    together = met.join(wide, "low", "left_anti").select(F.col("low").alias("sig"), "cls", "w")
    return together.union(middle.join(wide, "low", "left_semi").select("sig", "cls", F.lit(1).cast("long").alias("w")))


def near_pairs(own: DataFrame, firsts: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of small buckets (sig, cls) that their sketches do not rule out."""
    pairs = own.toDF("sig", "a").join(own.toDF("sig", "b"), "sig").where("a < b").select("a", "b").distinct()
    known = firsts.select("cls", "size", "sketch")
    rows = pairs.join(known.toDF("a", "na", "left"), "a").where("na > 0").join(known.toDF("b", "nb", "right"), "b")
    rows = rows.where(q * F.least("na", "nb") >= p * F.greatest("na", "nb")).select("a", "b", "na", "nb", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            apart = np.array([np.abs(np.subtract(*cells_of([x, y]))).sum() for x, y in zip(left, right, strict=True)], np.int64)
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = pa.array((q + p) * apart <= (q - p) * total)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def refined(members: DataFrame, firsts: DataFrame, p: int, q: int, n_parts: int, sketch: str = "sketch") -> DataFrame:
    """(sig, cls, w) of middle-sized buckets, split into the components of "their
    sketches do not rule a link out"; classes on their own go."""
    rows = members.join(firsts.select("cls", "size", F.col(sketch).alias("sketch")), "cls").select("sig", "cls", "w", "size", "sketch")
    rows = rows.repartition(n_parts, "sig").sortWithinPartitions("sig", "cls")

    def split(sig: int, cls: np.ndarray, w: np.ndarray, size: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cells = cells_of(sketch.tolist())
        apart = np.zeros((len(cls), len(cls)), np.int32)
        step = max(1, (1 << 22) // cells.size)
        for i in range(0, len(cls), step):
            apart[i : i + step] = np.abs(cells[i : i + step, None, :] - cells[None]).sum(axis=2, dtype=np.int32)
        near = (q + p) * apart <= (q - p) * (size[:, None] + size[None])
        label = np.arange(len(cls))
        while True:
            low = np.where(near, label[None], len(cls)).min(axis=1)
            low = low[low]
            if (low == label).all():
                break
            label = low
        many = np.bincount(label, minlength=len(cls))[label] > 1
        return mix(np.full(int(many.sum()), sig, np.int64).view(U) + (label[many].astype(U) + U(1)) * _BASE).view(np.int64), cls[many], w[many]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []  # of the bucket that may go on in the next batch
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [*(batch.column(k).to_numpy() for k in ("sig", "cls", "w", "size")), np.array(batch.column("sketch").to_pylist(), dtype=object)]
            if left:
                own = [np.concatenate([a, b]) for a, b in zip(left, own, strict=True)]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own[0])) + 1, [len(own[0])]])
            out = [split(int(own[0][a]), *(x[a:b] for x in own[1:])) for a, b in zip(cuts[:-2], cuts[1:-1], strict=True)]
            left = [x[cuts[-2] :] for x in own]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in (0, 1, 2)], names=["sig", "cls", "w"])
        if left:
            last = split(int(left[0][0]), *left[1:])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], names=["sig", "cls", "w"])

    return rows.mapInArrow(run, "sig long, cls long, w long")


def group_around_pivots(members: DataFrame) -> DataFrame:
    """(c, x, m): every class x with each pivot c of its buckets, and how many
    classes meet there. A bucket's pivot is its most central class: the one whose
    buckets are fullest, such as the text that the others are copies of."""
    full = members.groupBy("sig").agg(F.count("*").alias("n"))
    central = members.join(full, "sig").groupBy("cls").agg(F.sum(F.col("n") * F.col("w")).alias("w"))
    ranked = members.select("sig", "cls").join(central, "cls")
    pivots = ranked.groupBy("sig").agg(F.max_by("cls", F.struct("w", "cls")).alias("c"))
    pairs = members.join(pivots, "sig").where("cls <> c").select("c", F.col("cls").alias("x")).distinct()
    sizes = pairs.groupBy("c").agg((F.count("*") + 1).alias("m"))
    return pairs.join(sizes, "c")


def in_pieces(rows: DataFrame) -> DataFrame:
    """(c, i, x, label, m, d) of groups c, each cut by element into pieces i of about
    PIECE elements, so that a large group meets in many tasks; pieces are sorted
    together."""
    total = rows.groupBy("c").agg((F.floor(F.sum(F.size("d")) / PIECE) + 1).alias("r"))
    piece = lambda e: F.pmod(e, F.col("r"))
    own = F.when(F.col("r") == 1, F.col("d")).otherwise(F.filter("d", lambda e: piece(e) == F.col("i")))
    cut = rows.where(F.size("d") > 0).join(total, "c").withColumn("i", F.explode(F.array_distinct(F.transform("d", piece))))
    cut = cut.withColumn("d", own).select("c", "i", "x", "label", "m", "d")
    return cut.repartition(sized_partitions(rows), "c", "i").sortWithinPartitions("c", "i")


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(c, m, x, label, element, row of the element) of every piece, as arrays."""
    left: list[pa.RecordBatch] = []  # of the piece that may go on in the next batch
    last = None

    def whole(parts: list[pa.RecordBatch]) -> tuple:
        d = [b.column("d") for b in parts]
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in d])
        elements = np.concatenate([x.flatten().to_numpy() for x in d])
        x, label = (np.concatenate([b.column(k).to_numpy() for b in parts]) for k in ("x", "label"))
        return parts[0].column("c")[0].as_py(), parts[0].column("m")[0].as_py(), x, label, elements, np.repeat(np.arange(len(sizes)), sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        c, i = batch.column("c").to_numpy(), batch.column("i").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(i) != 0)) + 1).tolist(), len(c)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if left and last != (c[a], i[a]):
                yield whole(left)
                left = []
            last = (c[a], i[a])
            left.append(batch.slice(a, b - a))
    if left:
        yield whole(left)


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int64()))


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece the elements that more than half of the group's members have."""
    for c, m, _, _, elements, _ in pieces_of(batches):
        found, n = np.unique(elements, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([found[2 * n > m]], pa.list_(pa.int64()))], names=["c", "e"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece's members the elements that members of several labels have, and
    how many members."""
    for c, _, x, label, elements, row in pieces_of(batches):
        _, inverse, n = np.unique(elements, return_inverse=True, return_counts=True)
        lo, hi = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
        np.minimum.at(lo, inverse, label[row])
        np.maximum.at(hi, inverse, label[row])
        keep = (lo < hi)[inverse]
        if keep.any():
            has, at = np.unique(row[keep], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), c)), pa.array(x[has]), _lists(n[inverse][keep], at, len(has)), _lists(elements[keep], at, len(has))], names=["c", "x", "n", "e"])


def around_consensus(met: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """(c, x, d, slack, n_diff) of all members of all groups, pivots among them. A
    group's reference is its pivot changed by whatever more than half of the
    members differ in; d is a member's difference from it. With slack =
    (q - p) * size - (q + p) * |d|, two members of slacks that sum to 0 or more are
    surely linked, for |d1| + |d2| bounds what they differ in."""
    pivots = met.select("c", "m").distinct().join(sets.select(F.col("cls").alias("c"), (F.length("elements") / 8).cast("long").alias("size")), "c")
    every = met.unionByName(pivots.select("c", F.col("c").alias("x"), "m", "size", F.lit(0).cast("long").alias("n_diff"), F.when(F.col("m") > 2, F.array().cast("array<long>")).alias("diff")))
    # At most twice the mean difference of a group.
    pieces = in_pieces(met.where("m > 2").select("c", "x", F.lit(0).cast("long").alias("label"), "m", F.col("diff").alias("d")))
    usual = pieces.mapInArrow(_common, "c long, e array<long>").groupBy("c").agg(F.flatten(F.collect_list("e")).alias("h"))
    empty = F.array().cast("array<long>")
    with_h = every.join(usual, "c", "left").withColumn("h", F.coalesce("h", empty))
    d = F.when(F.col("m") > 2, F.array_union(F.array_except("diff", "h"), F.array_except("h", "diff")))
    rows = with_h.select("c", "x", "size", d.alias("d"), "n_diff")
    rows = rows.withColumn("n_diff", F.when(F.col("d").isNotNull(), F.size("d").cast("long")).otherwise(F.col("n_diff")))
    return rows.withColumn("slack", (q - p) * F.col("size") - (q + p) * F.col("n_diff"))


def untested(placed: DataFrame, p: int, q: int) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, from (c, x, label, d,
    n_diff, slack, most). A stray is short of slack even with the best member, so
    its links share -(slack1 + slack2) / (2 (q + p)) elements of d at least. Elements
    that one component alone has cannot be shared with another and are left out
    before anything is exploded; of the n others the rarest n - (that) + 1 of both
    sides have one in common, and these prefixes are joined."""
    split = placed.groupBy("c").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("c")
    rows = materialise(placed.where("d is not null").join(split, "c", "left_semi").select("c", "x", "label", "slack", "most", "d"), "split-groups")
    pieces = in_pieces(rows.select("c", "x", "label", F.lit(0).cast("long").alias("m"), "d"))
    shared = pieces.mapInArrow(_shared, "c long, x long, n array<long>, e array<long>").groupBy("c", "x").agg(F.array_sort(F.arrays_zip(F.flatten(F.collect_list("n")).alias("n"), F.flatten(F.collect_list("e")).alias("e"))).alias("es"))
    step = 2 * (q + p)
    n = F.size("es")
    first = F.when(F.col("slack") + F.col("most") < 0, n - F.ceil(-(F.col("slack") + F.col("most")) / step) + 1).otherwise(0)
    second = n - F.ceil((F.col("most") + 1 - F.col("slack")) / step) + 1
    rows = rows.drop("d").join(shared, ["c", "x"]).withColumns({"first": first, "second": second}).where(F.greatest("first", "second") > 0)
    cells = rows.select("c", "x", "label", "slack", n.alias("n"), "first", "second", F.posexplode(F.slice("es", F.lit(1), F.greatest("first", "second").cast("int"))).alias("turn", "cell"))
    cells = materialise(cells.select("c", "x", "label", "slack", (F.col("n") - F.col("turn")).alias("rest"), (F.col("turn") < F.col("first")).alias("first"), (F.col("turn") < F.col("second")).alias("second"), F.col("cell.e").alias("e")), "prefixes")
    left = cells.where("first").select("c", "e", F.col("x").alias("a"), F.col("label").alias("la"), F.col("slack").alias("sa"), F.col("rest").alias("ra"))
    right = cells.where("second").select("c", "e", F.col("x").alias("b"), F.col("label").alias("lb"), F.col("slack").alias("sb"), F.col("rest").alias("rb"))
    # The first element that two have in common leaves enough places in both.
    enough = F.least("ra", "rb") * step >= -(F.col("sa") + F.col("sb"))
    return left.join(right, ["c", "e"]).where((F.col("la") != F.col("lb")) & enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges`` (a, b): the least node of its
    component, by minimum labels with pointer jumping."""
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("b", "l"), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("m"))
        step = labels.join(near, "node", "left").select("node", "label", F.least("label", "m").alias("low"))
        jump = step.select(F.col("node").alias("low"), F.col("low").alias("further"))
        new = materialise(step.join(jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", "further").alias("label")), "labels")
        moved = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def join_components(df: DataFrame, n: int = 3, p: int = 90, q: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    df = whole_texts(df)
    docs = materialise(classify(df, n, key, text), "classes")
    # About one signature entry for each n-gram, some ten bytes of text apart.
    n_parts = sized_partitions(df.select(text), 48 << 20)
    n_meet = sized_partitions(df.select(text), 32 << 20, USUAL_PARTS)
    every = materialise(buckets(df, n, p, q, text, n_meet).select("sig", "cls").distinct(), "buckets")
    named = docs.where("cls is not null and doc_id is not null")
    firsts = materialise(docs.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"), F.max("coarse").alias("coarse")), "firsts")
    thin = materialise(thinned(every), "thinned")
    middle = families(thin.where(f"n > {SMALL_BUCKET} and n <= {MIDDLE_BUCKET}"))
    large = thin.where(f"n > {MIDDLE_BUCKET}").select("sig", "cls", F.lit(1).cast("long").alias("w"))
    if large.limit(1).count():
        large = materialise(with_partners(large, firsts, df, n, p, q, key, text, n_meet), "partners")
        still = large.groupBy("sig").agg(F.count("*").alias("n"))
        middle = middle.union(large.join(still.where(f"n > 1 and n <= {MIDDLE_BUCKET}").select("sig"), "sig", "left_semi"))
        large = large.join(still.where(f"n > {MIDDLE_BUCKET}").select("sig"), "sig", "left_semi")
    middle = materialise(refined(middle, firsts, p, q, n_parts, "coarse"), "parted")
    middle = materialise(refined(middle, firsts, p, q, n_parts), "refined")
    left = middle.groupBy("sig").agg(F.count("*").alias("n"))
    few = middle.join(left.where(f"n <= {SMALL_BUCKET}").select("sig"), "sig", "left_semi").select("sig", "cls")
    pairs = near_pairs(thin.where(f"n <= {SMALL_BUCKET}").select("sig", "cls").union(few), firsts, p, q)
    pairs = materialise(pairs, "near")
    members = materialise(middle.join(left.where(f"n > {SMALL_BUCKET}").select("sig"), "sig", "left_semi").union(large), "crowded")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(members.select("cls")).distinct()
    known = materialise(firsts.select("cls", "doc_id").join(wanted, "cls", "left_semi"), "wanted")
    sets = materialise(exact_sets(df, known, n, key, text), "sets")
    # Each class first meets one partner; other pairs wait for what that joins.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    close = tested(first, sets, p, q)
    repeated = named.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z")
    same_id = named.join(repeated, "doc_id").where("cls > a").select("a", F.col("cls").alias("b"))
    met = materialise(differences(group_around_pivots(members), sets), "differences")
    around = materialise(around_consensus(met, sets, p, q), "consensus")
    best = around.groupBy("c").agg(F.max_by("x", F.struct("slack", "x")).alias("best"), F.max("slack").alias("most"))
    around = around.join(best, "c")
    star = around.where("x <> best and slack + most >= 0").select(F.col("best").alias("a"), F.col("x").alias("b"))
    links = materialise(star.union(close).union(same_id.select("a", "b")).distinct(), "links")
    labels = components(links)
    placed = around.join(labels.toDF("x", "label"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    known_label = lambda c, name: labels.select(F.col("node").alias(c), F.col("label").alias(name))
    waiting = pairs.join(known_label("a", "la"), "a", "left").join(known_label("b", "lb"), "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    waiting = waiting.join(first, ["a", "b"], "left_anti")
    todo = materialise(untested(placed, p, q).union(waiting).distinct(), "pairs")
    more = materialise(tested(todo, sets, p, q), "more-links")
    if more.limit(1).count():
        labels = components(links.union(more))
    lowest = firsts.join(labels.toDF("cls", "label"), "cls", "left").select("cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    names = lowest.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = lowest.join(names, "label").select("cls", "component_id")
    return docs.join(by_class, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
