"""Benchmark passages in training texts: n-gram seeds, then Smith-Waterman alignment of words.

Words are lower-cased (A-Z) and lose closing punctuation. One pass looks the items' n-grams up in every
text and aligns the passages around them, inside the task that holds the text: no text is shuffled. Every
n-gram is a seed, however many texts hold it: copies keep different parts of an item, so a frequent n-gram
may be all that one of them has left. What a frequent n-gram costs is cut by a bound on the score of its
passage, which no leak fails, and by aligning equal passages once per batch. The benchmark travels in
blocks of bounded size, each with its own pass.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import LOWER, give_back, raw, shingle_hashes, slices, span_hashes, spans, without_closing

#: Words in a seed.
SEED_WORDS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score as a share of a perfect alignment of the item.
MIN_SHARE = 0.5
#: Words of an unbroken copy that count as a leak in an item of any length.
LONG_COPY = 20
#: Bytes of benchmark texts in a block.
BLOCK_BYTES = 16 << 20


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text, offsets = raw(column)
    if not len(text):
        return np.empty(0, np.uint64), np.zeros(len(offsets), dtype=np.int64)
    starts, ends, first = spans(text, offsets)
    return span_hashes(LOWER[text], starts, without_closing(text, starts, ends)), first


@dataclass
class Items:
    """A block of the benchmark: words of each item, and its n-grams as (sorted hashes, owner rows)."""

    ids: list[int]
    words: list[np.ndarray]
    grams: np.ndarray
    places: list[list[tuple[int, int]]]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], n: int) -> Items:
        words, first = _words(pa.array(texts, pa.string()))
        grams, begin = shingle_hashes(words, first, n)
        places: dict[int, list] = defaultdict(list)
        for i in range(len(ids)):
            for k, g in enumerate(grams[begin[i] : begin[i + 1]].tolist()):
                places[g].append((i, k))
        keys = np.array(sorted(places), dtype=np.uint64)
        return cls(list(ids), [words[first[i] : first[i + 1]] for i in range(len(ids))], keys, [places[int(k)] for k in keys])


def _hits(column: pa.Array, items: Items, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, gram) of the items' n-grams in the texts, and the texts' words."""
    words, first = _words(column)
    grams, begin = shingle_hashes(words, first, n)
    if not len(grams) or not len(items.grams):
        none = np.empty(0, np.int64)
        return none, none, none, words, first
    at = np.minimum(np.searchsorted(items.grams, grams), len(items.grams) - 1)
    hit = np.flatnonzero(items.grams[at] == grams)
    text = np.searchsorted(begin, hit, side="right") - 1
    return text, hit - begin[text], at[hit], words, first


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """(best Smith-Waterman score, end of it in the passage)."""
    ramp = -GAP * np.arange(1, len(item) + 1)
    row = np.zeros(len(item) + 1, dtype=np.int64)
    best, end = 0, 0
    for k, word in enumerate(passage):
        step = np.maximum(row[:-1] + np.where(item == word, MATCH, MISMATCH), np.maximum(row[1:] + GAP, 0))
        row[1:] = np.maximum(np.maximum.accumulate(step + ramp) - ramp, 0)
        top = int(row.max())
        if top > best:
            best, end = top, k + 1
    return best, end


def most(item_words: np.ndarray, passage: np.ndarray) -> int:
    """No alignment scores more: a word of the passage gains at most a match if the item has it, and else costs one.

    item_words: the item's distinct words, sorted.
    """
    at = np.minimum(np.searchsorted(item_words, passage), len(item_words) - 1)
    sums = np.concatenate([[0], np.cumsum(np.where(item_words[at] == passage, MATCH, max(MISMATCH, GAP)))])
    return int((sums - np.minimum.accumulate(sums)).max())


def found_leaks(column: pa.Array, items: Items, n: int = SEED_WORDS) -> Iterator[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, last word + 1) of every leak, the best place of each text and item."""
    text, place, gram, words, first = _hits(column, items, n)
    starts: dict[tuple[int, int], list[int]] = defaultdict(list)
    for t, p, g in zip(text.tolist(), place.tolist(), gram.tolist()):
        for i, k in items.places[g]:
            starts[t, i].append(p - k)
    known: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    distinct: dict[int, np.ndarray] = {}
    for (t, i), begins in starts.items():
        item, own = items.words[i], words[first[t] : first[t + 1]]
        size = len(item)
        if i not in distinct:
            distinct[i] = np.unique(item)
        begins = sorted(begins)
        needed = min(MIN_SHARE * MATCH * size, MATCH * LONG_COPY)
        best = (0, 0, 0)
        apart, head = max(4, size // 2), 0
        for k in range(1, len(begins) + 1):
            if k < len(begins) and begins[k] - begins[k - 1] <= apart:
                continue
            low = max(0, begins[head] - size // 4 - 2)
            passage = own[low : begins[k - 1] + size + size // 4 + 2]
            head = k
            if most(distinct[i], passage) < max(needed, best[0]):
                continue
            key = (item.tobytes(), passage.tobytes())
            if key not in known:
                known[key] = align(item, passage)
            score, end = known[key]
            best = max(best, (score, -low, low + end))
        if best[0] >= needed:
            yield t, i, best[0] / (MATCH * size), -best[1], best[2]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """The items, in blocks of bounded size. Items without an id or a word are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and trim(text) <> ''")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(count):
        block = rows.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == k).distinct().collect()
        block.sort()
        if block:
            yield [r["id"] for r in block], [r["text"] for r in block]


def _prepared(benchmark: DataFrame, item_col: str, item_text_col: str, n: int) -> list[Items]:
    return [Items.of(ids, texts, n) for ids, texts in _blocks(benchmark, item_col, item_text_col)]


_LEAK = "doc_id long, item_id long, score double, first_word long, last_word long"


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word) of each text that holds an item, exact or edited.

    score: alignment score over that of a whole exact copy. Null or empty texts hold nothing; an item of
    fewer than n words is found only as a whole text of its own; repeated rows are reported each. An empty
    benchmark or table gives no rows. Other columns are not read.
    """
    out = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for items in _prepared(benchmark, item_col, item_text_col, n):

        def run(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    found = list(found_leaks(piece.column("text"), items, n))
                    ids = piece.column("doc_id")
                    yield pa.record_batch(
                        [pa.array([ids[t].as_py() for t, *_ in found], pa.int64()), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                        names=["doc_id", "item_id", "score", "first_word", "last_word"],
                    )

        block = rows.mapInArrow(run, _LEAK)
        out = block if out is None else out.unionByName(block)
    return out if out is not None else docs.sparkSession.createDataFrame([], _LEAK)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = SEED_WORDS) -> DataFrame:
    """The rows, with all their columns, that hold no item. Only the text goes to Python.

    Null and empty texts stay, repeated rows are judged alike; an empty benchmark keeps all rows, an empty
    table stays empty.
    """
    blocks = _prepared(benchmark, item_col, item_text_col, n)

    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        kept = [np.empty(0, dtype=bool)]
        for piece in slices(pa.record_batch([texts], names=["text"])):
            own = np.ones(piece.num_rows, dtype=bool)
            for items in blocks:
                own[[t for t, *_ in found_leaks(piece.column("text"), items, n)]] = False
            kept.append(own)
        give_back()
        return pa.array(np.concatenate(kept))

    return docs.where(clean(F.col(text_col).cast("string")))
