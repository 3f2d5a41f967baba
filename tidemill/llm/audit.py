"""What each filter of a corpus costs in every order of the filters, from wide packed counters.

A row's failures are a mask of one bit per filter. For every mask there is one big integer with a field of
`FIELD_BITS` for each step of each order (5 filters: 120 x 5 = 600 fields), 1 where the step has that
outcome. Rows of one mask are counted by Spark; a part's integers are multiplied by those counts and summed,
and all fields are read from the sum at once. A count stays below 2^63, so no field runs into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELD_BITS = 64
_SPACE = " \t\n\x0b\f\r"


def word_conditions(text: Column) -> tuple[Column, Column]:
    """(under 50 words, under 65 % of the words distinct); words are parted by space and \\t..\\r."""
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.when(bare == "", 0).otherwise(F.size(words))
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words)))
    return n < 50, 100 * distinct.cast("long") < 65 * n.cast("long")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: A too few words, B too few distinct words, C too many capitals, D a control character."""
    few, same = word_conditions(text)
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long")
    marks = text.rlike(r"[#$%&*|]")
    return sum((c.cast("int") * (1 << k) for k, c in enumerate((few, same, capitals, marks))), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id") -> DataFrame:
    """(part, mask, good, toxic, n): rows by their failures of filters A to D (`text_mask`) and E, a copy of
    the text of a smaller id anywhere in the table, with the labels quality = 1 and toxic = 1.

    A null text is empty, a null part is the part ''. A row without an id has no smaller id and no label;
    rows that repeat one id are rows each and not smaller than each other. Several labels of one id count
    as one that is good (toxic) if any is. Whole texts are read once, and only their digests move; copies
    collapse in the map tasks, so a text that a third of all rows share is a few rows in the exchange.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    known = labels.where(F.col(label_id).isNotNull()).groupBy(F.col(label_id).cast("long").alias("id"))
    known = known.agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    labelled = rows.join(known, "id", "left").na.fill(0, ["good", "toxic"])

    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = labelled.groupBy(*kind, "id").agg(F.count(F.lit(1)).alias("n"))
    kinds = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n"))).alias("n_without"),
    )
    first = F.min("first").over(Window.partitionBy("digest"))
    original = F.coalesce(F.when(F.col("first") == F.col("first_of_text"), F.col("n_first")), F.lit(0)) + F.coalesce("n_without", F.lit(0))
    split = kinds.withColumn("first_of_text", first).withColumn("original", original)
    pair = F.array(F.struct(F.col("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("original")).alias("n")))
    out = split.select("part", "good", "toxic", F.explode(pair).alias("of"))
    return out.groupBy("part", F.col("of.mask").alias("mask"), "good", "toxic").agg(F.sum("of.n").alias("n"))


class Counters:
    """Big integers of one field per step of every order of the filters, `names[k]` being bit k of a mask.

    `kept`, `removed`, `redundant` and `unique` give the integer of a mask.
    """

    def __init__(self, names: str):
        self.names = names
        self.orders = ["".join(p) for p in permutations(names)]
        self.steps = [(o, k) for o in self.orders for k in range(len(names))]
        self.letter = np.array([names.index(o[k]) for o, k in self.steps])
        bit = {f: 1 << k for k, f in enumerate(names)}
        self.own = [bit[o[k]] for o, k in self.steps]
        self.earlier = [sum(bit[f] for f in o[:k]) for o, k in self.steps]
        masks = range(1 << len(names))
        self.kept = [self._packed(not m & (a | b) for a, b in zip(self.own, self.earlier)) for m in masks]
        self.removed = [self._packed(m & a and not m & b for a, b in zip(self.own, self.earlier)) for m in masks]
        self.redundant = [self._packed(m & a and m & b for a, b in zip(self.own, self.earlier)) for m in masks]
        self.unique = [self._packed(m == a for a in self.own) for m in masks]

    @staticmethod
    def _packed(outcomes) -> int:
        return sum(1 << (FIELD_BITS * k) for k, x in enumerate(outcomes) if x)

    def unpacked(self, total: int) -> np.ndarray:
        """The fields of a sum, in the order of `steps`."""
        return np.frombuffer(total.to_bytes(len(self.steps) * FIELD_BITS // 8, "little"), dtype="<i8")

    def outcomes(self, rows: list[tuple[int, int, int, int]]) -> dict[str, np.ndarray]:
        """Counts per step from (mask, good, toxic, n) of one part."""
        sums = dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"), 0)
        for mask, good, toxic, n in rows:
            sums["kept"] += n * self.kept[mask]
            sums["removed"] += n * self.removed[mask]
            sums["redundant"] += n * self.redundant[mask]
            sums["unique_fails"] += n * self.unique[mask]
            sums["good_lost"] += n * good * self.removed[mask]
            sums["toxic_lost"] += n * toxic * self.removed[mask]
        out = {name: self.unpacked(total) for name, total in sums.items()}
        per_filter = np.zeros(len(self.names), dtype=np.int64)
        np.add.at(per_filter, self.letter, out["removed"])
        return out | {"shapley": per_filter[self.letter]}


@lru_cache(maxsize=4)
def counters(names: str) -> Counters:
    return Counters(names)


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counts: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, from (part, mask, good, toxic, n); zeros included.

    kept: rows that pass this step and all before; removed: rows that fail here first; redundant: rows that
    fail here and were removed before; unique_fails: rows that fail this filter alone; good_lost and
    toxic_lost: labelled rows removed here; shapley: rows this filter removes, summed over all orders.
    A part has one row per mask and label, so a group is small whatever the table. No rows give no parts.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        of = counters(names)
        rows = list(zip(*(table.column(c).to_pylist() for c in ("mask", "good", "toxic", "n"))))
        found = of.outcomes(rows)
        about = {
            "part": pa.array([key[0].as_py()] * len(of.steps), pa.string()),
            "filter_order": pa.array([o for o, _ in of.steps], pa.string()),
            "step": pa.array([k + 1 for _, k in of.steps], pa.int32()),
        }
        return pa.table(about | {name: pa.array(found[name], pa.int64()) for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")})

    return counts.select("part", "mask", "good", "toxic", "n").groupBy("part").applyInArrow(run, _AUDIT)
