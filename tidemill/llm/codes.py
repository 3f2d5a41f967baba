"""Vector codes from integer codebooks, with distances looked up in value dictionaries.

A vector's components become integers and are cut into equal parts; each part is coded by the nearest entry
of its codebook, and Lloyd rounds move the entries. Blocks of vectors are stored with a dictionary per
dimension: its distinct integers, and a 16-bit code per vector. For a codebook, the squared differences of
every distinct integer to all entries are tabulated once per block and dimension; the distance of a part to
all entries is then a sum of table rows, gathered by the codes. The codebooks are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import stored
from tidemill.operators.buckets import group_sizes, join_per_group

#: Vectors that share dictionaries; their codes fit 16 bits.
BLOCK_ROWS = 4096
#: Vectors whose distances are summed at once.
_STEP = 1024
_BLOCK = "dims int, n int, ids array<long>, labels array<{label}>, sizes binary, dictionary binary, codes binary"


def blocks(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Stored blocks of vectors as integers floor(scale * x); vectors that are null or hold a null or a value
    that is not finite are left out. A block holds vectors of one length; integers too large for a squared
    distance in 64 bits make a block of length -1 without codes.
    """
    kind = vectors.schema[label_col].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    out_schema = _BLOCK.format(label=kind.simpleString())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, list] = {}
        for batch in batches:
            for dims, ids, labels, ints in _integers(batch, scale):
                held = open_.setdefault(dims, [])
                for k in range(0, len(ids), BLOCK_ROWS):
                    held.append((ids.slice(k, BLOCK_ROWS), labels.slice(k, BLOCK_ROWS), ints[k : k + BLOCK_ROWS]))
                while sum(len(h[0]) for h in held) >= BLOCK_ROWS:
                    yield _block(dims, held)
        for dims, held in open_.items():
            while held:
                yield _block(dims, held)

    return stored(rows.mapInArrow(run, out_schema), "vector-blocks")


def _integers(batch: pa.RecordBatch, scale: int) -> Iterator[tuple[int, pa.Array, pa.Array, np.ndarray]]:
    """(length, ids, labels, integers) of the batch's usable vectors, one for each length."""
    batch = batch.filter(pc.is_valid(batch.column("v")))
    lists = batch.column("v")
    flat = pc.fill_null(lists.flatten(), math.nan).to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    finite = np.bincount(owner[~np.isfinite(flat)], minlength=len(sizes)) == 0
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)
    widest = np.zeros(len(sizes))
    np.maximum.at(widest, owner, np.where(np.isfinite(flat), np.abs(flat), np.inf))
    groups = np.where((2 * widest) ** 2 * np.maximum(sizes, 1) < 2.0**62, sizes, -1)
    for dims in np.unique(groups[finite]).tolist():
        at = np.flatnonzero(finite & (groups == dims))
        taken = pa.array(at)
        ints = flat[begin[at][:, None] + np.arange(dims)].astype(np.int64) if dims > 0 else np.empty((len(at), 0), np.int64)
        yield dims, batch.column("id").take(taken), batch.column("label").take(taken), ints


def _block(dims: int, held: list) -> pa.RecordBatch:
    """One block from the front of `held`."""
    taken, n = [], 0
    while held and n < BLOCK_ROWS:
        ids, labels, ints = held.pop(0)
        room = BLOCK_ROWS - n
        if len(ids) > room:
            held.insert(0, (ids.slice(room), labels.slice(room), ints[room:]))
            ids, labels, ints = ids.slice(0, room), labels.slice(0, room), ints[:room]
        taken.append((ids, labels, ints))
        n += len(ids)
    ints = np.concatenate([t[2] for t in taken])
    found = [np.unique(ints[:, d], return_inverse=True) for d in range(max(dims, 0))]
    sizes = np.array([len(v) for v, _ in found], dtype=np.int32)
    values = np.concatenate([np.empty(0, np.int64), *[v for v, _ in found]])
    codes = np.array([c for _, c in found], dtype=np.uint16).reshape(max(dims, 0), n)
    columns = {
        "dims": pa.array([dims], pa.int32()),
        "n": pa.array([n], pa.int32()),
        "ids": _as_list([t[0] for t in taken]),
        "labels": _as_list([t[1] for t in taken]),
        "sizes": pa.array([sizes.tobytes()], pa.binary()),
        "dictionary": pa.array([values.tobytes()], pa.binary()),
        "codes": pa.array([codes.tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


def _as_list(pieces: list[pa.Array]) -> pa.Array:
    whole = pa.concat_arrays(pieces)
    return pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)


class Block:
    """A stored block: per dimension its distinct integers, and each vector's place among them."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        self.ids, self.labels = batch.column("ids")[row].values, batch.column("labels")[row].values
        self.n = len(self.ids)
        sizes = np.frombuffer(batch.column("sizes")[row].as_py(), np.int32)
        values = np.frombuffer(batch.column("dictionary")[row].as_py(), np.int64)
        self.dictionary = np.split(values, np.cumsum(sizes)[:-1])
        self.codes = np.frombuffer(batch.column("codes")[row].as_py(), np.uint16).reshape(len(sizes), self.n)

    def integers(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([v[c[rows]] for v, c in zip(self.dictionary, self.codes)], axis=1)

    def nearest(self, entries: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every vector's part; ties to the lower index."""
        width = entries.shape[1]
        dims = range(part * width, (part + 1) * width)
        widest = max([int(np.abs(entries).max()), *[int(np.abs(self.dictionary[d]).max()) for d in dims]])
        kind = np.int32 if 4 * widest**2 * width < 2**31 else np.int64
        tables = []
        for d in dims:
            gap = self.dictionary[d][:, None] - entries[:, d - part * width]
            tables.append((gap * gap).astype(kind))
        index, distance = np.empty(self.n, np.int64), np.empty(self.n, np.int64)
        for k in range(0, self.n, _STEP):
            some = slice(k, min(k + _STEP, self.n))
            total = tables[0][self.codes[dims[0]][some]]
            for d, table in zip(dims[1:], tables[1:]):
                total += table[self.codes[d][some]]
            index[some] = total.argmin(axis=1)
            distance[some] = total[np.arange(total.shape[0]), index[some]]
        return index, distance


@dataclass
class Codebooks:
    """`entries[part]`: integers of every entry."""

    entries: list[np.ndarray]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integers that codes (rows of one index per part) stand for."""
        return np.concatenate([e[codes[:, p]] for p, e in enumerate(self.entries)], axis=1)


def common_length(stored_blocks: DataFrame) -> int:
    """The length that most vectors have, the longer of equals; 0 if no vector can be coded."""
    counts = stored_blocks.where("dims > 0").groupBy("dims").agg(F.sum("n").alias("rows"))
    top = counts.orderBy(F.desc("rows"), F.desc("dims")).first()
    return top["dims"] if top else 0


def _first_vectors(of_length: DataFrame, entries: int) -> np.ndarray:
    """Integers of the vectors with the smallest ids, ascending; null ids last, equal ids by their integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                known = block.ids.is_valid().to_numpy(zero_copy_only=False)
                order = np.where(known, block.ids.fill_null(0).to_numpy(zero_copy_only=False), np.iinfo(np.int64).max)
                last = np.partition(order, min(entries, block.n) - 1)[min(entries, block.n) - 1]
                at = np.flatnonzero(order <= last)
                yield pa.record_batch([block.ids.take(pa.array(at)), pa.array(block.integers(at).tolist(), pa.list_(pa.int64()))], names=["id", "v"])

    rows = of_length.mapInArrow(run, "id long, v array<long>").orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    return np.array([r["v"] for r in rows.collect()], dtype=np.int64)


def fit(stored_blocks: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks after `rounds` rounds over all vectors of the most common length.

    Part p starts from that part of the `entries` vectors with the smallest ids (all, if there are fewer). A
    round assigns every part to its nearest entry and moves each entry to the floored mean of its parts;
    unused entries stay. A task adds up its own vectors, and Spark the tasks' sums.
    """
    dims = common_length(stored_blocks)
    if not dims:
        return Codebooks([])
    if dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    of_length = stored_blocks.where(F.col("dims") == dims)
    books = Codebooks(np.split(_first_vectors(of_length, entries), parts, axis=1))
    for _ in range(rounds):
        _moved(of_length, books)
    return books


def _moved(of_length: DataFrame, books: Codebooks) -> None:
    current = [e.copy() for e in books.entries]
    width = current[0].shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(e), np.int64) for e in current]
        sums = [np.zeros(e.shape, np.int64) for e in current]
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                for p, e in enumerate(current):
                    index, _ = block.nearest(e, p)
                    counts[p] += np.bincount(index, minlength=len(e))
                    for k in range(width):
                        # One pair of (entry, code) at a time: whole numbers, exact in any size.
                        values = block.dictionary[p * width + k]
                        pairs = np.bincount(index * len(values) + block.codes[p * width + k], minlength=len(e) * len(values))
                        sums[p][:, k] += pairs.reshape(len(e), len(values)) @ values
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            if len(used):
                yield pa.record_batch([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(np.column_stack([n, sums[p]])[used].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "sums"])

    partial = of_length.mapInArrow(run, "part int, entry int, sums array<long>")
    totals = partial.select("part", "entry", F.posexplode("sums")).groupBy("part", "entry", "pos").agg(F.sum("col").alias("total"))
    totals = totals.groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("pos", "total"))).alias("all"))
    for r in totals.collect():
        n, *total = [x["total"] for x in r["all"]]
        books.entries[r["part"]][r["entry"]] = [x // n for x in total]


def coded(stored_blocks: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of every vector in the blocks: the index of each part's nearest entry as two hex
    digits, and the squared distances summed. Vectors of another length than the codebooks' have a null
    code and error.
    """
    entries = books.entries
    dims = sum(e.shape[1] for e in entries)
    label = stored_blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                code, error = pa.nulls(block.n, pa.string()), pa.nulls(block.n, pa.int64())
                if dims and len(block.codes) == dims:
                    found = [block.nearest(e, p) for p, e in enumerate(entries)]
                    digits = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                    code = pa.array([bytes(d).hex() for d in digits], pa.string())
                    error = pa.array(sum(f[1] for f in found), pa.int64())
                yield pa.record_batch([block.ids, block.labels, code, error], names=["id", "label", "code", "error"])

    return stored_blocks.mapInArrow(run, f"id long, label {label}, code string, error long")


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every vector with finite components only.

    label_error: errors summed over equal labels, null being one label. Repeated rows count as often as they
    stand; equal distances go to the lower index. Vectors of another length than the most common one, empty
    ones, and integers too large for 64-bit distances come back with a null code and error and move no
    codebook. An empty table gives no rows. At most 256 entries, so that an index is two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index of two hex digits names 256 entries")
    held = blocks(vectors, scale, id_col, vector_col, label_col)
    books = fit(held, parts, entries, rounds)
    rows = stored(coded(held, books), "vector-codes")
    groups, _ = group_sizes(rows, ["label"])
    per_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = join_per_group(rows, per_label, ["label"], groups)
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
