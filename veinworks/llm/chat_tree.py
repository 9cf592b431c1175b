r"""Chat formatting into a prefix tree.

Conversations that share initial turns share tree nodes. A node is a turn after
a given history; its formatted text is written once, in depth-first order, with
its position ids (a node starts where its ancestors' text ends), the intervals
of the output that it may attend to besides itself (its ancestors, neighbours
merged) and the spans under the loss mask. Tokens are code points.

Template: ``### role: text </turn>`` and a line feed. Inside roles and texts a
backslash is doubled, ``###`` and ``</turn>`` lose their first character to
``\h`` and ``\l``, and a role's colon becomes ``\c``; so no text can spell a
control string, and `unescape` undoes it.

No group is collected. Turns are dealt and sorted by conversation and hashed in
one pass (a turn's hash covers its history); conversations are then ranged by
their lists of hashes, which is depth-first order, and each emits what it does
not share with its predecessor. Ranges are joined by a scan over one summary of
each range on the driver. A first turn that a third of all conversations share
is thus an ordinary run of the order; its copies are split by what follows.

Defined cases: null text or role is empty; null conv_id is a conversation of its
own; turns are in order of turn (null first), role, text; repeated rows are
turns; equal conversations share all nodes; an empty table gives none; other
columns are ignored. A conversation's list of turn hashes must fit in memory,
its texts need not.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_partitions, slices

HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
#: Stands for a null conversation id in joins.
NO_ID = -(2**63)
_ESCAPE = {"\\": r"\\", "#": r"\h", "<": r"\l", ":": r"\c"}
_BACK = {v[1]: k for k, v in _ESCAPE.items()}


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"\\|#(?=##)|<(?=/turn>)" + "|:" * role, lambda m: _ESCAPE[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def format_turn(role: str | None, text: str | None) -> tuple[str, tuple[int, int] | None]:
    """The turn's formatted text and, for an assistant, its span under the mask."""
    head = HEAD + escape(role or "", role=True) + MIDDLE
    segment = head + escape(text or "") + TAIL
    return segment, (len(head), len(segment) - len(TAIL)) if role == "assistant" else None


def parse_turn(segment: str) -> tuple[str, str]:
    role, _, text = segment[len(HEAD) : -len(TAIL)].partition(MIDDLE)
    return unescape(role), unescape(text)


@dataclass
class Tree:
    """nodes: start, length, position, ancestors array<struct<start,stop>>, loss
    array<struct<start,stop>> (within the node), segment; in depth-first order.
    index: conv_id (NO_ID for null), starts: each turn's node."""

    nodes: DataFrame
    index: DataFrame


NODE = "start long, length long, position long, ancestors array<struct<start:long,stop:long>>"


def turn_hashes(df: DataFrame) -> DataFrame:
    """cid, depth, node (hash of history and turn), length, segment, mask."""
    rows = df.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("cid"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition(sized_partitions(rows), "cid").sortWithinPartitions("cid", "turn", "role", "text").select("cid", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, depth, history = None, 0, b""
        for batch in slices(batches, "text"):
            out = {k: [] for k in ("depth", "node", "length", "segment", "low", "high")}
            for cid, role, text in zip(*(batch.column(c).to_pylist() for c in ("cid", "role", "text")), strict=True):
                if cid != at:
                    at, depth, history = cid, 0, b""
                segment, span = format_turn(role, text)
                history = hashlib.blake2b(history + segment.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for k, v in zip(out, (depth, history, len(segment), segment, span and span[0], span and span[1]), strict=True):
                    out[k].append(v)
                depth += 1
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(out["depth"], pa.int32()), pa.array(out["node"], pa.binary()), pa.array(out["length"], pa.int64()), pa.array(out["segment"], pa.string()), pa.array(out["low"], pa.int64()), pa.array(out["high"], pa.int64())], names=["cid", *out])

    return rows.mapInArrow(run, "cid long, depth int, node binary, length long, segment string, low long, high long")


def shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def ordered(paths: DataFrame) -> DataFrame:
    """Conversations in depth-first order: range and place in it, first new depth
    (within the range) and each turn's start if the range stood alone."""
    rows = paths.repartitionByRange(sized_partitions(paths), "path", "cid").sortWithinPartitions("path", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, end = TaskContext.get().partitionId(), 0, 0
        last, starts = [], []
        for batch in batches:
            out = {k: [] for k in ("new", "starts", "place", "end")}
            for path, lengths in zip(batch.column("path").to_pylist(), batch.column("lengths").to_pylist(), strict=True):
                new = shared(path, last)
                starts = starts[:new]
                for n in lengths[new:]:
                    starts.append(end)
                    end += n
                last = path
                for k, v in zip(out, (new, starts[:], place, end), strict=True):
                    out[k].append(v)
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * batch.num_rows, pa.int32()), pa.array(out["place"], pa.int64()), *(batch.column(c) for c in ("cid", "path", "lengths")), pa.array(out["new"], pa.int32()), pa.array(out["starts"], pa.list_(pa.int64())), pa.array(out["end"], pa.int64())], names=["part", "place", "cid", "path", "lengths", "new", "starts", "end"])

    return rows.mapInArrow(run, "part int, place long, cid long, path array<binary>, lengths array<long>, new int, starts array<long>, end long")


def join_ranges(summaries: list) -> dict[int, tuple[int, int, list[int]]]:
    """For each range: the size of what its first conversation shares with the
    range before, its base, and the starts of those shared nodes."""
    out, base, last, last_starts = {}, 0, [], []
    for r in summaries:
        common = shared(r["first"]["path"], last)
        size = sum(r["first"]["lengths"][:common])
        out[r["part"]] = (size, base, last_starts[:common])
        last = r["last"]["path"]
        last_starts = [s + base - size if s >= size else last_starts[d] for d, s in enumerate(r["last"]["starts"])]
        base += r["last"]["end"] - size
    return out


def build(df: DataFrame) -> Tree:
    """Write the tree of all conversations (conv_id, turn, role, text)."""
    turns = materialise(turn_hashes(df), "turns")
    history = F.sort_array(F.collect_list(F.struct("depth", "node", "length")))
    paths = turns.groupBy("cid").agg(history.alias("h")).select("cid", F.col("h.node").alias("path"), F.col("h.length").alias("lengths"))
    order = materialise(ordered(paths), "order")
    # A row for each range (200,000 at most): its first and last conversation.
    facts = F.struct("path", "lengths", "starts", "end")
    ends = order.groupBy("part").agg(F.min_by(facts, "place").alias("first"), F.max_by(facts, "place").alias("last"))
    held = df.sparkSession.sparkContext.broadcast(join_ranges(ends.orderBy("part").collect()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = held.value
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "starts")]
            real = []
            for part, starts in zip(*columns, strict=True):
                size, base, before = ranges[part]
                real.append([s + base - size if s >= size else before[d] for d, s in enumerate(starts)])
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("lengths"), pa.array([[ranges[p][0]] * len(s) for p, s in zip(*columns, strict=True)], pa.list_(pa.int64())), batch.column("new"), batch.column("starts"), pa.array(real, pa.list_(pa.int64()))], names=["cid", "lengths", "given", "new", "own", "starts"])

    index = materialise(order.select("part", "cid", "lengths", "new", "starts").mapInArrow(place, "cid long, lengths array<long>, given array<long>, new int, own array<long>, starts array<long>"), "index")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("cid", "depth", "start", "length", "position", "ancestors")}
            for cid, lengths, given, new, own, starts in zip(*(batch.column(c).to_pylist() for c in ("cid", "lengths", "given", "new", "own", "starts")), strict=True):
                position, spans = 0, []
                for d, (n, s) in enumerate(zip(lengths, starts, strict=True)):
                    if d >= new and own[d] >= given[d]:
                        for k, v in zip(out, (cid, d, s, n, position, [{"start": a, "stop": b} for a, b in spans]), strict=True):
                            out[k].append(v)
                    if spans and spans[-1][1] == s:
                        spans[-1] = (spans[-1][0], s + n)
                    else:
                        spans.append((s, s + n))
                    position += n
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out["cid"], pa.int64()), pa.array(out["depth"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "position")), pa.array(out["ancestors"], span)], names=list(out))

    nodes = index.mapInArrow(emit, f"cid long, depth int, {NODE}")
    texts = turns.select("cid", "depth", F.when(F.col("low").isNull(), F.array().cast("array<struct<start:long,stop:long>>")).otherwise(F.array(F.struct(F.col("low").alias("start"), F.col("high").alias("stop")))).alias("loss"), "segment")
    whole = nodes.join(texts, ["cid", "depth"]).drop("cid", "depth")
    whole = materialise(whole.repartitionByRange(sized_partitions(texts), "start").sortWithinPartitions("start"), "tree")
    return Tree(whole, index.select("cid", "starts"))


DIGEST = "cid long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(tree: Tree) -> DataFrame:
    """Per conversation, read back from the output. Rows stream through in order,
    so no conversation is held whole."""
    wanted = tree.index.select("cid", F.posexplode("starts").alias("depth", "start"))
    rows = wanted.join(tree.nodes.select("start", "segment", "loss"), "start").select("cid", "depth", "segment", "loss")
    rows = rows.repartition(sized_partitions(tree.nodes), "cid").sortWithinPartitions("cid", "depth").select("cid", "segment", "loss")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = DIGEST.replace(" long", "").replace(" string", "").split(", ")
        at, n, turns, chars, loss, size = None, 0, None, 0, None, 0
        done: list = []
        for batch in slices(batches, "segment"):
            for cid, segment, spans in zip(*(batch.column(c).to_pylist() for c in ("cid", "segment", "loss")), strict=True):
                if cid != at:
                    if at is not None:
                        done.append((at, n, turns.hexdigest(), chars, loss.hexdigest(), size))
                    at, n, turns, chars, loss, size = cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                role, text = parse_turn(segment)
                turns.update(f"{role}\n{text}\n".encode())
                for s in spans:
                    masked = unescape(segment[s["start"] : s["stop"]])
                    chars += len(masked)
                    loss.update(masked.encode())
                n, size = n + 1, size + len(segment)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=names)
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (at, n, turns.hexdigest(), chars, loss.hexdigest(), size)], names=names)

    found = rows.mapInArrow(run, DIGEST)
    return found.select(F.when(F.col("cid") != NO_ID, F.col("cid")).alias("conv_id"), *found.columns[1:])
