"""Shards on a consistent-hash ring with virtual nodes and bounded loads.

A text's hash is its place on the ring, so equal texts share a place. An arc belongs to the shard whose
virtual node ends it; what a full shard cannot take goes on clockwise to the next virtual node of a shard
with room. Loads are bytes, and no shard holds more than (1 + SLACK) of the mean (and one row).

The ring is settled on sums per arc, of which there are shards x virtual nodes: rows only ask which cut of
their arc they lie in. A row's place in its arc comes from sums of cells, so even an arc that holds a third
of all rows is never in one task.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import stored

#: Virtual nodes of a shard.
VIRTUAL = 64
SLACK = 0.0005
#: Cells of an arc: by place of the text, then by id within equal places.
PLACE_CELLS = 64
ID_CELLS = 64
RING = 1 << 32


def ring(shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, in order."""
    return sorted((int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:4], "big"), s) for s in range(shards) for v in range(virtual))


def settle(nodes: list[tuple[int, int]], load: dict[int, int], shards: int, slack: float = SLACK) -> dict[int, list[tuple[int, int]]]:
    """{arc: [(end, shard)]}: the shard of each stretch of an arc's load, in clockwise order of arcs.

    Every arc first fills its own shard; then what is left over goes on clockwise, arc by arc.
    """
    total = sum(load.values())
    room = [int((1 + slack) * total / shards) + 1] * shards
    cuts: dict[int, list[tuple[int, int]]] = {}
    left = {}
    for arc, (_, shard) in enumerate(nodes):
        own = min(load.get(arc, 0), room[shard])
        room[shard] -= own
        cuts[arc] = [(own, shard)]
        if load.get(arc, 0) > own:
            left[arc] = load[arc] - own
    for arc, rest in left.items():
        at, end = arc, cuts[arc][-1][0]
        while rest:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            part = min(rest, room[shard])
            if part:
                room[shard] -= part
                rest -= part
                end += part
                cuts[arc].append((end, shard))
    return cuts


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", virtual: int = VIRTUAL) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    size: UTF-8 bytes of the text plus 1; a null text is an empty one. The law is `bytes`: sizes of shards
    are near equal; grown_shard is null. Equal texts stay together except where an arc is cut. slot
    numbers a shard's rows without gaps. Order inside an arc is by place, id, so reruns agree; rows with
    equal id and text are interchangeable. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    nodes = ring(shards, virtual)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    by_id = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(ID_CELLS)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"), by_id.alias("by_id"))
    # The arc of a place ends at the first virtual node at or after it; places after the last wrap round.
    ends = [p for p, _ in nodes]
    blocks = 1 << 12  # of 20 bits each
    first = [bisect.bisect_left(ends, b * (RING // blocks)) for b in range(blocks)]
    most = max(bisect.bisect_left(ends, (b + 1) * (RING // blocks)) - first[b] for b in range(blocks))
    ends_lit, first_lit = (F.expr(f"array({', '.join(f'{x}L' for x in xs)})") for xs in ([*ends, *[RING] * (most + 1)], first))
    begin = F.get(first_lit, F.shiftright("place", 20)).cast("int")
    passed = F.size(F.filter(F.slice(ends_lit, begin + 1, most + 1), lambda e: e < F.col("place")))
    arc = F.pmod(begin + passed, F.lit(len(nodes)))
    rows = rows.withColumn("arc", arc).withColumn("by_place", F.pmod(F.col("place"), F.lit(PLACE_CELLS)).cast("int"))
    rows = stored(rows, "ring-rows")

    cell = ["arc", "by_place", "by_id"]
    cells = stored(rows.groupBy(*cell).agg(F.sum("size").alias("bytes")), "ring-cells")
    load = {r["arc"]: r["bytes"] for r in cells.groupBy("arc").agg(F.sum("bytes").alias("bytes")).collect()}
    cuts = settle(nodes, load, shards)
    table = spark.createDataFrame([(arc, [{"end": e, "shard": s} for e, s in parts]) for arc, parts in cuts.items()], "arc int, cuts array<struct<end: long, shard: int>>")
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("arc").orderBy("by_place", "by_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumn("before_cell", before).drop("bytes").join(table, "arc")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy(*cell).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.col("before_cell") + F.col("inside")
    shard = F.coalesce(F.get(F.filter("cuts", lambda c: start < c["end"]), F.lit(0))["shard"], F.element_at("cuts", -1)["shard"])
    dealt = rows.withColumn("inside", inside).join(placed, cell).withColumn("shard", shard).drop("cuts", "before_cell")
    dealt = stored(dealt, "ring-dealt")

    counts = dealt.groupBy("shard", *cell).agg(F.count(F.lit(1)).alias("n"))
    # Few rows: one for each shard and cell.
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("offset", offset).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", *cell).orderBy("inside", "doc_id")) - 1
    out = dealt.withColumn("number", number).join(offsets, ["shard", *cell])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
