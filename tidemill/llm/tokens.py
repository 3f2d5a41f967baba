"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks without copies.

A data set is a folder of pairs of Arrow IPC files (the stream format with a footer, hence random
access) and a manifest table that names the files that count:

* `part-*.ids.arrow`: `tokens` fixed_size_list<uint16 or uint32>[L], `mask` fixed_size_list<bool>[L],
  in record batches of `ROWS` sequences. The documents of a file follow each other without gaps, each
  closed by the end id; the last sequence of a file is filled up, and its mask is false there.
* `part-*.docs.arrow`: doc_id, start (in the file), n_tokens of each document.

Files hold consecutive ranges of ids, so a token's place is the file's offset plus its place inside.
A task writes under a name of its own, and only names in the manifest, which Spark commits, count:
lost, repeated and speculative tasks leave no trace in the result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.text import LOWER, give_back, raw, slices, span_hashes, spans, without_closing
from tidemill.session import scratch_path

#: Sequences in a record batch.
ROWS = 128
#: Pieces of text that a worker keeps with their ids, about 40 bytes each.
CACHE_WORDS = 4_000_000
_MANIFEST = "part int, ids_file string, docs_file string, n_docs long, n_tokens long"
_ASCII_ALNUM = np.array([chr(i).isalnum() and i < 128 for i in range(256)])


class PieceEncoder:
    """Ids of whole texts from a tokenizer whose pieces never cross ASCII white space.

    Each distinct piece of text between white space goes through the tokenizer once and is kept, under
    a 64-bit hash. Two spellings share an entry where the tokenizer treats them alike for certain: ASCII
    words that differ in case (for a lower-casing tokenizer), and a word before closing punctuation, which
    is a piece of its own after an ASCII letter or digit.
    """

    def __init__(self, path: str, end_id: int, lower: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.lower, self.end_id = lower, end_id
        self._forget()
        mark = self._ids(["0"])[0]
        self.mark = int(mark[0]) if len(mark) == 1 else None

    def _forget(self) -> None:
        """Slot 0 is the end id; slots of the others are in order of their first use."""
        self.keys, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.offsets = np.array([self.end_id], dtype=self.dtype), np.array([0, 1])

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _tokenize(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces. Those without the digit 0 go in runs, parted by that digit, which is always one id."""
        out: list = [None] * len(pieces)
        plain = [i for i, w in enumerate(pieces) if b"0" not in w and b"<" not in w] if self.mark is not None else []
        for k in range(0, len(plain), 64):
            run = plain[k : k + 64]
            text = b" 0 ".join([pieces[i] for i in run]).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
            cuts = [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(cuts) == len(run) + 1:
                for j, i in enumerate(run):
                    out[i] = ids[cuts[j] + 1 : cuts[j + 1]]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._ids([pieces[i].decode("utf-8", "replace") for i in rest])):
            out[i] = ids
        return out

    def _spans(self, text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of all pieces, and the first piece of each text."""
        starts, ends, _ = spans(text, offsets)
        bodies = without_closing(text, starts, ends)
        cut = np.flatnonzero((bodies < ends) & _ASCII_ALNUM[text[bodies - 1]])
        begin = np.insert(starts, cut + 1, bodies[cut])
        return begin, np.insert(ends, cut, bodies[cut]), np.searchsorted(begin, offsets)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each closed by the end id; ids in each text)."""
        text, offsets = raw(column)
        starts, ends, first = self._spans(text, offsets)
        view = text
        if self.lower and len(starts):
            # Only pure ASCII words: a letter before a combining mark may compose in one case only.
            special = np.concatenate([[0], np.cumsum((text >= 128) | (text == 60))])
            upper = np.flatnonzero(LOWER[text] != text)
            word = np.searchsorted(starts, upper, side="right") - 1
            upper = upper[special[ends[word]] == special[starts[word]]]
            view = text.copy()
            view[upper] += 32
        keys, at, which = np.unique(span_hashes(view, starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self._forget()
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), dtype=bool)
        if new.any():
            plain = view.tobytes()
            ids = self._tokenize([plain[starts[i] : ends[i]] for i in at[new]])
            slots = len(self.offsets) - 1 + np.arange(len(ids))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in ids])])
            self.flat = np.concatenate([self.flat, *ids])
            where = np.searchsorted(self.keys, keys[new])
            self.keys, self.slots = np.insert(self.keys, where, keys[new]), np.insert(self.slots, where, slots)
        slots = self.slots[np.searchsorted(self.keys, keys)][which] if len(keys) else np.empty(0, np.int64)
        slots = np.insert(slots, first[1:], 0)
        sizes = self.offsets[slots + 1] - self.offsets[slots]
        begin = np.cumsum(sizes) - sizes
        tokens = self.flat[np.repeat(self.offsets[slots] - begin, sizes) + np.arange(sizes.sum())]
        ends_of_texts = (begin + sizes)[first[1:] + np.arange(len(first) - 1)]
        return tokens, np.diff(ends_of_texts, prepend=0)


class _Writer:
    """The two files of one task."""

    def __init__(self, folder: str, part: int, dtype: np.dtype, length: int, end_id: int):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.names = f"{name}.ids.arrow", f"{name}.docs.arrow"
        self.length, self.dtype = length, dtype
        self.fs.create_dir(base, recursive=True)
        value = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        about = {"end_id": str(end_id), "length": str(length)}
        self.schema = pa.schema([("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))], metadata=about)
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{base}/{n}") for n in self.names]
        self.ids = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.doc_schema)
        self.waiting, self.n_waiting, self.n_tokens, self.n_docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.n_tokens + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.docs.write_batch(pa.record_batch([doc_ids.cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=self.doc_schema))
        self.n_docs += len(sizes)
        self.n_tokens += len(tokens)
        self.waiting.append(tokens)
        self.n_waiting += len(tokens)
        if self.n_waiting >= ROWS * self.length:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        tokens = np.concatenate([np.empty(0, self.dtype), *self.waiting])
        size = ROWS * self.length
        whole = len(tokens) // size * size
        for k in range(0, whole, size):
            self._batch(tokens[k : k + size], size)
        rest = tokens[whole:]
        self.waiting, self.n_waiting = [rest], len(rest)
        if last and len(rest):
            filled = np.zeros(-(-len(rest) // self.length) * self.length, dtype=self.dtype)
            filled[: len(rest)] = rest
            self._batch(filled, len(rest))

    def _batch(self, tokens: np.ndarray, used: int) -> None:
        lists = pa.FixedSizeListArray.from_arrays(pa.array(tokens), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(tokens)) < used), self.length)
        self.ids.write_batch(pa.record_batch([lists, mask], schema=self.schema))

    def close(self) -> None:
        self._write(last=True)
        for x in (self.ids, self.docs, *self.sinks):
            x.close()


class TokenFile:
    """Random access to one pair of files; local files are mapped, so arrays are views of the file."""

    def __init__(self, folder: str, ids_file: str, docs_file: str):
        fs, base = pafs.FileSystem.from_uri(folder)
        local = isinstance(fs, pafs.LocalFileSystem)
        opened = [pa.memory_map(f"{base}/{n}") if local else fs.open_input_file(f"{base}/{n}") for n in (ids_file, docs_file)]
        self.ids, self.docs = (pa.ipc.open_file(x) for x in opened)
        self.length = self.ids.schema.field("tokens").type.list_size
        self._at, self._batch = -1, None

    def _load(self, batch: int) -> pa.RecordBatch:
        if batch != self._at:
            self._at, self._batch = batch, self.ids.get_batch(batch)
        return self._batch

    def sequence(self, row: int) -> tuple[np.ndarray, pa.Array]:
        """(tokens, mask) of one sequence: a view, and its bits."""
        batch, at = self._load(row // ROWS), row % ROWS
        begin = at * self.length
        return batch.column(0).values.to_numpy(zero_copy_only=True)[begin : begin + self.length], batch.column(1).values.slice(begin, self.length)

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Tokens start .. start+n in views, one for each record batch that they touch."""
        size = ROWS * self.length
        while n > 0:
            values = self._load(start // size).column(0).values.to_numpy(zero_copy_only=True)
            piece = values[start % size : start % size + n]
            yield piece
            start, n = start + len(piece), n - len(piece)

    def documents(self) -> Iterator[tuple[list, list, list]]:
        for k in range(self.docs.num_record_batches):
            yield tuple(c.to_pylist() for c in self.docs.get_batch(k).columns)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, length: int = 2048, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """Encode every whole text and write the files; the manifest, one row per file, in order of ids.

    A null or empty text is the end id alone. Rows are ordered by id, equal ids by text; a null id comes
    first. An empty table gives an empty manifest. Other columns are not read. `lower`: the tokenizer
    lower-cases.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, writer = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for piece in slices(batch):
                if not piece.num_rows:
                    continue
                if encoder is None:
                    encoder = worker_encoder(tokenizer_path, end_id, lower)
                    writer = _Writer(folder, part, encoder.dtype, length, end_id)
                writer.add(piece.column("id"), *encoder.encode(piece.column("text")))
        if writer is not None:
            writer.close()
            give_back()
            yield pa.RecordBatch.from_pylist([{"part": part, "ids_file": writer.names[0], "docs_file": writer.names[1], "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}], schema=pa.schema([("part", pa.int32()), ("ids_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    path = scratch_path(spark, "token-manifest")
    ordered.mapInArrow(write, _MANIFEST).write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


_ENCODERS: dict[tuple, PieceEncoder] = {}


def worker_encoder(*key) -> PieceEncoder:
    """The worker's encoder; Spark keeps workers between tasks, and so the pieces that they know."""
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(*key)
    return _ENCODERS[key]


def read_documents(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files, one task or more per file.

    `start` counts all ids before the document, over all files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    count = max(1, manifest.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(folder, row["ids_file"], row["docs_file"])
                for ids, starts, sizes in file.documents():
                    sums = []
                    for start, n in zip(starts, sizes):
                        crc = 0
                        for piece in file.span(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([row["offset"] + s for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("ids_file", "docs_file", "offset").repartition(count).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
