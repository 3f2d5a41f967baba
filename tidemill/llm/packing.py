"""Documents packed into sequences of a fixed number of tokens: dominance reduction, then best fit.

What a packing needs to know of the corpus is how many pieces there are of each length, at most `capacity`
numbers however many documents there are. Martello and Toth's reduction works on these counts: for a length it
looks for a set of one to three pieces that dominates every other set holding such a piece, which is then a
sequence of some optimal packing, and fixes it as often as the counts allow. What remains is packed by best
fit in falling length, also by counts: equal sequences form runs. Pieces are numbered within their length, and a
run says where the pieces from one number to another go, so each piece finds its place by itself.

The plan is small: a length splits at most one run and opens at most two, and a run that takes pieces is left
with less than half of its room, so there are under 4 x 12 x capacity entries.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.components import stored
from tidemill.llm.text import give_back, slices
from tidemill.llm.tokens import worker_encoder

#: Times that the reduction goes through all lengths; it ends before that when a turn fixes nothing.
TURNS = 8

_PIECE = "doc_id long, piece int, start long, length long, ids array<int>, block int, nth long"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids, block, nth): the ids of every whole text, closed by the end id, in pieces of
    `capacity` ids, the last one shorter; a stored table.

    A null or empty text is the end id alone. Rows of one id are documents each, as are rows without an id.
    `block` names the task that made a piece, `nth` counts its pieces of that length.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in slices(batch):
                if not some.num_rows:
                    continue
                tokens, sizes = worker_encoder(tokenizer_path, end_id, lower).encode(some.column("text"))
                owner, piece, length = cut(sizes, capacity)
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.record_batch(
                    [some.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.astype(np.int32))), pa.array(np.full(len(owner), block, np.int32)), pa.array(_numbered(length, seen))],
                    names=["doc_id", "piece", "start", "length", "ids", "block", "nth"],
                )
        give_back()

    return stored(rows.mapInArrow(run, _PIECE), "pieces")


def cut(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, number, length) of the pieces of documents of these sizes."""
    counts = -(-sizes // capacity)
    owner = np.repeat(np.arange(len(sizes)), counts)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, piece, np.minimum(capacity, sizes[owner] - piece * capacity)


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each piece among those of its length; `seen` holds how many there were before."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    first = np.searchsorted(ranked, ranked)
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ranked)) - first + seen[ranked]
    np.add.at(seen, lengths, 1)
    return out


def dominating(counts: np.ndarray, j: int, capacity: int) -> list[int]:
    """A set of lengths, j first, that dominates every other set with a piece of length j; empty if none is known.

    With {j, x, ..} feasible, a set dominates it if its other pieces can stand in for x, ..: each of them is at
    least as long as what it replaces. `counts[l]` pieces of length l are there, j among them.
    """
    free = counts.copy()
    free[j] -= 1
    room = capacity - j
    lengths = np.flatnonzero(free[: room + 1])
    if not len(lengths):
        return [j]
    largest = int(lengths[-1])
    if largest == room:
        return [j, largest]  # nothing is longer than all the room
    least = np.repeat(lengths[:3], np.minimum(free[lengths[:3]], 3))[:3]
    sums = np.cumsum(least)
    if len(least) < 2 or sums[1] > room:
        return [j, largest]  # one more piece at most
    if len(least) == 3 and sums[2] <= room:
        return []
    # Two more pieces at most. The longest pair: for each piece, the longest that fits beside it.
    upto = np.maximum.accumulate(np.where(free[: room + 1] > 0, np.arange(room + 1), 0))
    beside = upto[room - lengths]
    alone = (beside == lengths) & (free[lengths] == 1)
    beside = np.where(alone, upto[np.maximum(lengths - 1, 0)], beside)
    best = int((lengths + beside)[beside > 0].max(initial=0))
    if largest >= best:
        return [j, largest]
    free[largest] -= 1
    second = np.flatnonzero(free[: room - largest + 1])
    if not len(second):
        return []
    b = int(second[-1])
    between = np.flatnonzero(free[b + 1 : largest]) + b + 1
    pair = np.repeat(between[:2], np.minimum(free[between[:2]], 2))[:2]
    # No two pieces both longer than b fit, so in every pair one is at most b and the other at most `largest`.
    return [j, largest, b] if len(pair) < 2 or pair.sum() > room else []


@dataclass
class Plan:
    """Where pieces go, by their number: pieces are counted by rising length, then inside their length.

    A run takes pieces from `start` on, `per` to a sequence from `sequence` on, the first at `offset`.
    """

    capacity: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # start, sequence, per, offset, length
    sequences: int = 0
    fixed: int = 0

    def arrays(self) -> list[np.ndarray]:
        table = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        return list(table.T)


def plan(counts: np.ndarray, capacity: int) -> Plan:
    """Places for counts[l] pieces of every length l: dominating sets first, then best fit in falling length."""
    counts = np.asarray(counts, dtype=np.int64)
    out, left = Plan(capacity), counts.copy()
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])

    def run(length: int, n: int, sequence: int, per: int, offset: int) -> None:
        out.runs.append((int(begin[length]), sequence, per, offset, length))
        begin[length] += n
        left[length] -= n

    for _ in range(TURNS):
        before = left.sum()
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j] and (fixed := dominating(left, j, capacity)):
                times = min(int(left[x]) // fixed.count(x) for x in set(fixed))
                offset = 0
                for x in dict.fromkeys(fixed):
                    per = fixed.count(x)
                    run(x, times * per, out.sequences, per, offset)
                    offset += per * x
                out.sequences += times
        if left.sum() == before:
            break
    out.fixed = out.sequences
    _best_fit(out, left, run)
    return out


def _best_fit(out: Plan, left: np.ndarray, run) -> None:
    """A piece goes where the least room is left that still holds it. Sequences of equal room stand in ranges."""
    rooms: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    order: list[int] = []

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append((first, n))

    for length in np.flatnonzero(left)[::-1].tolist():
        while n := int(left[length]):
            at = bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first = out.capacity, out.sequences
                many = -(-n // (room // length))
                out.sequences += many
            per = room // length
            full = min(many, n // per)
            if full:
                run(length, full * per, first, per, out.capacity - room)
                put(room - per * length, first, full)
            if rest := min(per - 1, int(left[length])) if full < many else 0:
                run(length, rest, first + full, rest, out.capacity - room)
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), many - full - bool(rest))


def packed(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces, with all their other columns, and their sequence_id and offset. No rows give no rows.

    Needs `length` (1 to capacity), `block` and `nth` as from `token_pieces`. A length that most pieces have is
    numbered block by block like any other, so no task holds it. Columns that the caller does not need are
    best dropped before: the rows go through one join on (block, length).
    """
    counts = stored(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    per_length = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        per_length[r["length"]] = r["n"]
    starts, sequence, per, offset, length = plan(per_length, capacity).arrays()
    first = np.concatenate([[0], np.cumsum(per_length)[:-1]])

    @F.pandas_udf("sequence_id long, offset long")
    def place(of_length: pd.Series, number: pd.Series) -> pd.DataFrame:
        position = first[of_length.to_numpy()] + number.to_numpy()
        at = np.searchsorted(starts, position, side="right") - 1
        inside = position - starts[at]
        return pd.DataFrame({"sequence_id": sequence[at] + inside // per[at], "offset": offset[at] + inside % per[at] * length[at]})

    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    kept = [c for c in pieces.columns if c not in ("block", "nth")]
    # `before` grows with the pieces, so it is never broadcast.
    placed = pieces.join(before.hint("shuffle_hash"), ["block", "length"]).withColumn("_place", place("length", F.col("_before") + F.col("nth")))
    return placed.select(*kept, "_place.sequence_id", "_place.offset")


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the pieces of a sequence put together; at most `capacity` ids each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    rows = packed_pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts"))
    return rows.select("sequence_id", "n_tokens", F.flatten("_parts.ids").alias("ids"))


def with_crc(pieces: DataFrame) -> DataFrame:
    """The pieces with `ids_crc32`, of their ids as little-endian unsigned 32-bit integers, in place of the ids."""
    kept = [c for c in pieces.columns if c != "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False), dtype="<u4")
            ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))
            sums = [zlib.crc32(flat[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"])

    schema = T.StructType([f for f in pieces.schema.fields if f.name != "ids"]).add("ids_crc32", "long")
    return pieces.mapInArrow(run, schema)
