"""All links of a Jaccard self-join on word shingles, as connected components, by set-relation skipping.

A node is a distinct set of shingles, so exact copies are one node however many there are.

1. `shared_shingles`: shingles go by hash to buckets that count in how many sets each occurs. One that
   occurs once cannot link anything; only the others return to their sets, with their counts.
2. A set's shingles are ordered by that count. Linked sets share one of their first
   `size - ceil(t size) + 1` shingles; those make the inverted lists, whose entries know the set's size and
   the shingle's position in it. Size and position bound the overlap of any two entries, so whole blocks
   of a list are skipped without a look at their sets.
3. Every list compares its sets with its most central one only: a star, not all pairs. Sets that
   link are merged, and a list within one component is never looked at again.
4. In lists that still mix components, a set's answers follow from those of the list's centre: with
   overlaps oa, ob to centre L, |a n b| lies between oa + ob - |L| and min(oa, ob) + min(|a|-oa, |b|-ob).
   Pairs that these bounds decide are not verified; all others between different components are.

Every link between different components is found in step 4, so components are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.components import components, stored
from tidemill.llm.text import give_back, mix, shingle_hashes, slices, word_hashes

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles in a bucket of step 1, in expectation.
BUCKET = 1_500_000
#: Bytes of shingles that a task of step 1 counts.
TASK_BYTES = 64 << 20
#: Entries of a list that one task compares with the list's other components; longer lists are dealt out.
LIST_ROWS = 20_000
#: Bounded rounds of step 4 that merge by best candidates before the exhaustive one.
MERGE_ROUNDS = 2


def _distinct(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    hashes, begin = shingle_hashes(*word_hashes(column), k)
    for i in range(len(column)):
        yield i, np.unique(hashes[begin[i] : begin[i + 1]])


def _name(hashes: np.ndarray) -> int:
    """A set's 64-bit name, the same in any order of its shingles."""
    if not len(hashes):
        return 0
    total = int(mix(hashes + np.uint64(0x51ED270B)).sum(dtype=np.uint64)) + len(hashes) * 0x9E3779B97F4A7C15
    return int(mix(np.array([total & (2**64 - 1)], dtype=np.uint64)).view(np.int64)[0])


def named_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, node) of every row. Texts without words have size 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                sizes, names = [], []
                for _, s in _distinct(piece.column("text"), k):
                    sizes.append(len(s))
                    names.append(_name(s))
                yield pa.record_batch([piece.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], names=["doc_id", "n_shingles", "node"])
        give_back()

    return _inputs(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_shingles long, node long")


def _inputs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


_ENTRY = "node long, size int, hash long, sets int"


def shared_shingles(docs: DataFrame, total: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """(node, size, hash, sets) of shingles that occur in at least two sets, `sets` being that number.

    A row of the exchange holds all shingles of a slice of texts that fall into one bucket.
    """
    buckets = max(64, math.ceil(total / BUCKET))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in this task
        for batch in batches:
            for piece in slices(batch, limit=4 << 20):
                sets, nodes = [], []
                for small in slices(piece):
                    for _, s in _distinct(small.column("text"), k):
                        name = _name(s)
                        if len(s) and name not in seen:
                            seen.add(name)
                            sets.append(s)
                            nodes.append(name)
                if not sets:
                    continue
                sizes = np.array([len(s) for s in sets], dtype=np.int32)
                hashes = np.concatenate(sets)
                owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
                bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                bucket, hashes, owner = bucket[order], hashes[order], owner[order]
                names = np.array(nodes, dtype=np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for begin, end in zip(cuts, [*cuts[1:], len(bucket)]):
                    own, counts = np.unique(owner[begin:end], return_counts=True)
                    yield pa.RecordBatch.from_pydict(
                        {"bucket": [int(bucket[begin])], "nodes": [names[own].tobytes()], "sizes": [sizes[own].tobytes()], "counts": [counts.astype(np.int32).tobytes()], "hashes": [hashes[begin:end].tobytes()]},
                        schema=pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())]),
                    )
                sets = hashes = owner = bucket = order = None
        give_back()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _buckets(batches):
            counts = np.concatenate([r[2] for r in rows])
            nodes = np.repeat(np.concatenate([r[0] for r in rows]), counts)
            sizes = np.repeat(np.concatenate([r[1] for r in rows]), counts)
            hashes = np.concatenate([r[3] for r in rows])
            order = np.argsort(hashes, kind="stable")
            edge = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] + np.uint64(1)))
            times = np.diff([*edge, len(order)])
            order = order[np.repeat(times > 1, times)]
            order = order[np.lexsort((nodes[order], hashes[order]))]
            nodes, sizes, hashes = nodes[order], sizes[order], hashes[order]
            first = np.ones(len(order), dtype=bool)  # a set that several tasks sent
            first[1:] = (hashes[1:] != hashes[:-1]) | (nodes[1:] != nodes[:-1])
            nodes, sizes, hashes = nodes[first], sizes[first], hashes[first]
            _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
            times = times[at] if len(at) else np.empty(0, np.int64)
            keep = times > 1
            yield pa.record_batch([pa.array(nodes[keep]), pa.array(sizes[keep]), pa.array(hashes[keep].view(np.int64)), pa.array(times[keep].astype(np.int32))], names=["node", "size", "hash", "sets"])
        give_back()

    dealt = _inputs(docs, id_col, text_col).mapInArrow(deal, "bucket long, nodes binary, sizes binary, counts binary, hashes binary")
    # A shingle takes about 14 bytes of a row; tasks grow with the table.
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 14 / TASK_BYTES))
    return dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(count, _ENTRY)


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list[np.ndarray]]]:
    """(nodes, sizes, counts, hashes) of a bucket's rows, which follow each other, as views of their batches."""
    kinds = {"nodes": np.int64, "sizes": np.int32, "counts": np.int32, "hashes": np.uint64}
    open_, held = None, []
    for batch in batches:
        for i, bucket in enumerate(batch.column("bucket").to_numpy()):
            if held and bucket != open_:
                yield held
                held = []
            open_ = bucket
            held.append([np.frombuffer(batch.column(n)[i].as_buffer(), kind) for n, kind in kinds.items()])
    if held:
        yield held


def _runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[dict[str, list]]:
    """Rows of equal keys, which follow each other, as column lists."""
    open_key, held = None, None
    for batch in batches:
        columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for i, key in enumerate(zip(*(columns[k] for k in keys))):
            if key != open_key:
                if held:
                    yield held
                open_key, held = key, {n: [] for n in columns}
            for n, c in columns.items():
                held[n].append(c[i])
    if held:
        yield held


def _whole_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole runs of `key`; many short runs come together."""
    held: list[pa.RecordBatch] = []
    open_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        others = np.flatnonzero(values != values[-1])
        cut = int(others[-1]) + 1 if len(others) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and open_key != values[-1]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
        open_key = values[-1]
    if held:
        yield pa.Table.from_batches(held)


_SETS = "node long, size int, unique int, shared binary, head int"


def ordered_sets(shared: DataFrame, percent: int) -> DataFrame:
    """(node, size, unique, shared, head): a set's shared shingles, rarest first, and how many of them are in its prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "node"):
            node = table.column("node").to_numpy()
            size = table.column("size").to_numpy()
            hashes = table.column("hash").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            ends = np.append(begin[1:], len(node))
            sizes = size[begin].astype(np.int64)
            unique = sizes - (ends - begin)
            prefix = sizes - -(-percent * sizes // 100) + 1
            yield pa.record_batch(
                [pa.array(node[begin]), pa.array(size[begin]), pa.array(unique.astype(np.int32)), pa.array([hashes[a:b].tobytes() for a, b in zip(begin, ends)], pa.binary()), pa.array(np.clip(prefix - unique, 0, ends - begin).astype(np.int32))],
                names=["node", "size", "unique", "shared", "head"],
            )

    return shared.repartition("node").sortWithinPartitions("node", "sets", "hash").mapInArrow(run, _SETS)


def inverted_lists(sets: DataFrame) -> DataFrame:
    """(hash, node, size, pos, unique): one entry per shared shingle in a set's prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.column("head").to_numpy()
            total = int(head.sum())
            if not total:
                continue
            own = np.repeat(np.arange(len(head)), head)
            rank = np.arange(total) - np.repeat(np.cumsum(head) - head, head)
            hashes = np.concatenate([np.frombuffer(x.as_py(), np.int64, count=n) for x, n in zip(batch.column("shared"), head) if n])
            unique = batch.column("unique").to_numpy()[own]
            yield pa.record_batch([pa.array(hashes), pa.array(batch.column("node").to_numpy()[own]), pa.array(batch.column("size").to_numpy()[own]), pa.array((unique + rank).astype(np.int32)), pa.array(unique)], names=["hash", "node", "size", "pos", "unique"])

    return sets.filter("head > 0").mapInArrow(run, "hash long, node long, size int, pos int, unique int")


def _need(a, b, percent: int):
    """The least overlap that links sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, size_a, size_b, overlap) of pairs (a, b): exact overlaps of the sets."""
    left = sets.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("shared").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("shared").alias("of_b"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64), assume_unique=True)) for x, y in zip(batch.column("of_a"), batch.column("of_b"))]
            yield pa.record_batch([*(batch.column(n) for n in ("a", "b", "size_a", "size_b")), pa.array(overlap, pa.int32())], names=["a", "b", "size_a", "size_b", "overlap"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "of_a", "of_b")
    return joined.mapInArrow(run, "a long, b long, size_a int, size_b int, overlap int")


def _is_link(percent: int):
    return F.expr(f"{100 + percent}L * overlap >= {percent}L * (size_a + size_b)")


def mixed_pairs(entries: DataFrame, percent: int, best_only: bool) -> DataFrame:
    """(a, b, derived) of sets in different components that a common list may link.

    Entries (hash, salt, dealt, node, size, pos, component, centre_overlap, centre_size) come list by list.
    Of a dealt list, a set outside the list's main component is in every salt, and pairs without a set
    of the main component are taken in salt 0 only. `best_only`: each set's most promising pair, not all.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "hash", "salt"):
            c = {n: np.array(rows[n], dtype=np.int64) for n in ("node", "size", "pos", "component", "main", "centre_overlap", "centre_size")}
            salt = rows["salt"][0]
            order = np.lexsort((c["pos"], c["size"]))
            c = {n: x[order] for n, x in c.items()}
            out_a, out_b, out_d = [], [], []
            outside = np.flatnonzero(c["component"] != c["main"])
            inside = c["component"] == c["main"]
            for i in outside:
                lo, hi = np.searchsorted(c["size"], [-(-percent * c["size"][i] // 100), 100 * c["size"][i] // percent + 1])
                j = np.arange(lo, hi)
                other = (c["component"][j] != c["component"][i]) & (inside[j] | ((j < i) & (salt == 0)))
                need = _need(c["size"][i], c["size"][j], percent)
                room = np.minimum(c["size"][i] - c["pos"][i], c["size"][j] - c["pos"][j])
                oa, ob = c["centre_overlap"][i], c["centre_overlap"][j]
                known = (oa >= 0) & (ob >= 0)
                upper = np.minimum(oa, ob) + np.minimum(c["size"][i] - oa, c["size"][j] - ob)
                room = np.where(known, np.minimum(room, upper), room)
                j, room, need, known, ob = (x[other & (room >= need)] for x in (j, room, need, known, ob))
                if not len(j):
                    continue
                derived = known & (oa + ob - c["centre_size"][j] >= need)
                if best_only:
                    pick = np.argmax(room - need + np.where(derived, 1 << 30, 0))
                    j, derived = j[pick : pick + 1], derived[pick : pick + 1]
                out_a.append(np.full(len(j), c["node"][i]))
                out_b.append(c["node"][j])
                out_d.append(derived)
            if out_a:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (out_a, out_b, out_d)], names=["a", "b", "derived"])

    ordered = entries.repartition("hash", "salt").sortWithinPartitions("hash", "salt")
    pairs = ordered.mapInArrow(run, "a long, b long, derived boolean")
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("derived").alias("derived"))


def _list_entries(lists: DataFrame, comp: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Entries of the lists that mix components, dealt out by salt where a list is long."""
    named = lists.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    about = named.groupBy("hash").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows"),
        F.min_by("component", F.struct("rank", "node")).alias("main"), F.min_by("node", F.struct("rank", "node")).alias("centre"), F.min_by("size", F.struct("rank", "node")).alias("centre_size"),
    ).filter("low <> high")
    mixed = named.join(about, "hash")
    salts = F.ceil(F.col("rows") / LIST_ROWS).cast("int")
    mixed = mixed.withColumn("salt", F.explode(F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("node"), salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))))
    to_centre = overlaps.select(F.col("a").alias("node"), F.col("b").alias("centre"), F.col("overlap").alias("centre_overlap"))
    mixed = mixed.join(to_centre, ["node", "centre"], "left")
    own = F.when(F.col("node") == F.col("centre"), F.col("size")).otherwise(F.coalesce("centre_overlap", F.lit(-1)))
    return mixed.select("hash", "salt", "node", "size", "pos", "component", "main", own.alias("centre_overlap"), "centre_size")


def linked_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    component_id is the least id that links reach, the row's own included. A null, empty or wordless text
    has size 0 and links with nothing; its component is its own id. Repeated rows and rows of equal texts
    are one node. A null id takes part as text, but is no one's component id, its own row's included
    unless another row of its component has one. Other columns are not read; an empty table gives no rows.
    """
    named = stored(named_sets(docs, id_col, text_col, k), "named")
    nodes = stored(named.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n")), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    comp = _link_nodes(docs, int(total), id_col, text_col, k, percent)
    lowest = nodes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = lowest.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_node = stored(lowest.join(ids, "component").select("node", "component_id"), "component-ids")
    # A node has rows in proportion to its copies: each row meets one row of `by_node`.
    out = named.join(by_node, "node", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def _link_nodes(docs: DataFrame, total: int, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    sets = stored(ordered_sets(shared_shingles(docs, total, id_col, text_col, k), percent), "sets")
    rank = F.col("unique") / F.col("size")  # few shingles of its own: central
    lists = stored(inverted_lists(sets).withColumn("rank", rank), "lists")

    # Step 3: each entry against its list's centre, where size and position leave room for a link.
    centre = lists.groupBy("hash").agg(F.min_by(F.struct("node", "size", "pos"), F.struct("rank", "node")).alias("c"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    room = F.expr("least(size - pos, c.size - c.pos)")
    stars = lists.join(centre, "hash").filter("node <> c.node").filter(room * (100 + percent) >= percent * (F.col("size") + F.col("c.size")))
    pairs = stars.select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
    overlaps = stored(verified(pairs, sets), "overlaps")
    comp = components(overlaps.filter(_is_link(percent)).select("a", "b"))

    # Step 4.
    known = overlaps
    for turn in range(MERGE_ROUNDS + 1):
        last = turn == MERGE_ROUNDS
        found = stored(mixed_pairs(_list_entries(lists, comp, overlaps), percent, best_only=not last), "mixed")
        if found.isEmpty():  # a set with any candidate has a best one
            break
        done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        fresh = found.filter("not derived").join(done, ["a", "b"], "left_anti").select("a", "b")
        checked = stored(verified(fresh, sets), "checked")
        known = known.unionByName(checked)
        comp = _merged(comp, checked.filter(_is_link(percent)).select("a", "b").unionByName(found.filter("derived").select("a", "b")))
    return comp


def _merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after more links, from links between components only."""
    for end in ("a", "b"):
        of = comp.select(F.col("node").alias(end), F.col("component").alias("of"))
        links = links.join(of, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    up = components(links).withColumnRenamed("component", "up")
    moved = comp.join(up.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
    alone = up.join(comp, "node", "left_anti").select("node", F.col("up").alias("component"))
    return stored(moved.unionByName(alone), "components")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is their component's; of rows that repeat an id, one.

    Rows without an id stay: no other row can be named in their place.
    """
    rows = stored(linked_components(docs, id_col, text_col).select("doc_id", "component_id"), "groups")
    dropped = rows.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(dropped, id_col, "left_anti")
    twice = rows.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_col))
    if twice.isEmpty():
        return kept
    return kept.join(twice, id_col, "left_anti").unionByName(kept.join(twice, id_col, "left_semi").dropDuplicates([id_col]))
