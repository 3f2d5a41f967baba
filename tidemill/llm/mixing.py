"""Mixing sources to target weights by minimum-cost flow, for documents that may belong to several sources.

Documents are aggregated by membership pattern. A flow routes each pattern's words to the quotas of its
sources; using a pattern again costs more with each pass, so repetition happens only where quotas need it.
The network has one node per pattern and source, whatever the number of documents. Inside a pattern,
documents stand in a seeded order, and the flow says how far along that order they are taken, pass by pass.
"""

from __future__ import annotations

import math
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.components import stored

#: Membership patterns, which the driver plans for, and those that may meet in one network. Sources whose documents
#: belong to no other source need no network.
MAX_PATTERNS, MAX_NETWORK = 1_000_000, 20_000
#: Hexadecimal digits of the seeded order that name a cell; sums inside and before a cell are taken apart.
CELL_DIGITS = 3

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights: dict, share: float, cap: float) -> dict:
    """Targets by weight that sum to `share` of all sizes, none above `cap` times its size.

    The excess of capped sources goes to the others by weight until none is above: sources reach their cap
    in order of cap over weight, so one pass along that order finds the level of the rest.
    """
    order = sorted(sizes, key=lambda s: (cap * sizes[s] / weights[s], s is None, s or ""))
    left, weight, out = share * sum(sizes.values()), sum(weights.values()), {}
    for i, s in enumerate(order):
        if left / weight * weights[s] <= cap * sizes[s]:
            out.update((r, weights[r] * (left / weight)) for r in order[i:])
            break
        out[s] = cap * sizes[s]
        left, weight = left - out[s], weight - weights[s]
    return out


def min_cost_flow(supply: dict[tuple, int], quotas: dict, passes: int) -> dict[tuple, dict]:
    """Words that each pattern gives each of its sources: {pattern: {source: words}}.

    A pattern gives its supply once per pass; pass p costs p per word (convex). The flow is the largest
    possible and the cheapest of those, found by shortest augmenting paths over the residual network.
    """
    nodes: dict = {"in": 0, "out": 1}
    edges: list[list[int]] = []  # to, capacity, cost
    at: list[list[int]] = [[], []]

    def node(key) -> int:
        if key not in nodes:
            nodes[key] = len(nodes)
            at.append([])
        return nodes[key]

    def link(a: int, b: int, capacity: int, cost: int) -> int:
        at[a].append(len(edges))
        edges.append([b, capacity, cost])
        at[b].append(len(edges))
        edges.append([a, 0, -cost])
        return len(edges) - 2

    routes = {}
    for pattern, words in supply.items():
        p = node(("pattern", pattern))
        for turn in range(passes):
            link(0, p, words, turn)
        for source in pattern:
            routes[pattern, source] = link(p, node(("source", source)), passes * words, 0)
    for source, quota in quotas.items():
        link(node(("source", source)), 1, quota, 0)

    while True:
        cost, via, waiting = {0: 0}, {}, deque([0])
        queued = {0}
        while waiting:
            a = waiting.popleft()
            queued.discard(a)
            for e in at[a]:
                b, capacity, c = edges[e]
                if capacity > 0 and cost[a] + c < cost.get(b, math.inf):
                    cost[b], via[b] = cost[a] + c, e
                    if b not in queued:
                        queued.add(b)
                        waiting.append(b)
        if 1 not in cost:
            break
        path, b = [], 1
        while b:
            path.append(via[b])
            b = edges[via[b] ^ 1][0]
        push = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
    out: dict[tuple, dict] = {p: {} for p in supply}
    for (pattern, source), e in routes.items():
        out[pattern][source] = edges[e ^ 1][1]
    return out


def shares(supply: dict[tuple, int], quotas: dict, passes: int) -> dict[tuple, dict]:
    """`min_cost_flow` of all patterns. A source that no pattern shares with another takes what it wants of its own
    documents, as far as they go; only the others make a network.
    """
    shared = {s for pattern in supply if len(pattern) > 1 for s in pattern}
    network = {p: n for p, n in supply.items() if shared.intersection(p)}
    if len(network) > MAX_NETWORK:
        raise ValueError(f"over {MAX_NETWORK} membership patterns that share sources")
    flow = min_cost_flow(network, {s: q for s, q in quotas.items() if s in shared}, passes) if network else {}
    return {p: flow[p] if p in flow else {s: min(quotas.get(s, 0), passes * n) for s in p} for p, n in supply.items()}


def mix(docs: DataFrame, members: Column, targets, passes: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict]:
    """(doc_id, members, size, copies, taken_for) of every row, and each source's target.

    `members`: array of a row's sources (a null element is a source too; null or empty: in none, never
    taken). `targets(sizes)` gives words wanted per source from all sources' words. copies: how often the
    row is taken, 0 to `passes`; taken_for: the source of each copy. Size is in words, 0 for null and empty
    texts. Order is by a seeded hash of the id, then id and size, so reruns agree and equal rows are
    interchangeable. An empty table gives no rows.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    unique = F.sort_array(F.array_distinct(F.coalesce(members.cast("array<string>"), F.array().cast("array<string>"))))
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), unique.alias("members"), words_in(F.col(text_col)).alias("size"), order.alias("order")).withColumn("cell", F.substring("order", 1, CELL_DIGITS)), "sized")

    cells = stored(rows.groupBy("members", "cell").agg(F.sum("size").alias("words")), "cells")
    patterns = cells.groupBy("members").agg(F.sum("words").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns")
    supply = {tuple(r["members"]): r["words"] for r in sorted(patterns, key=lambda r: [(m is None, m or "") for m in r["members"]])}
    sizes: dict = {}
    for pattern, words in supply.items():
        for source in pattern:
            sizes[source] = sizes.get(source, 0) + words
    wanted = targets(sizes)
    flow = shares(supply, {s: math.floor(t) for s, t in wanted.items()}, passes)

    plan, begin = [], {}
    for pattern, given in flow.items():
        at = 0
        for source in pattern:
            plan.append((list(pattern), source, at, at + given.get(source, 0)))
            at += given.get(source, 0)
        begin[pattern] = at
    spark = docs.sparkSession
    totals = spark.createDataFrame([(list(p), w, begin[p]) for p, w in supply.items()], "members array<string>, words_all long, used long")
    share = spark.createDataFrame(plan, "members array<string>, source string, low long, high long")
    share = share.groupBy("members").agg(F.sort_array(F.collect_list(F.struct("low", "high", "source"))).alias("shares"))

    before_cell = F.coalesce(F.sum("words").over(Window.partitionBy("members").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed_cells = cells.withColumn("before_cell", before_cell).select("members", "cell", "before_cell")
    placed_cells = placed_cells.join(totals, "members").join(share, "members", "left")
    in_cell = Window.partitionBy("members", "cell").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("in_cell", F.coalesce(F.sum("size").over(in_cell), F.lit(0))).join(placed_cells, ["members", "cell"])
    # A row is taken in a pass if its middle lies before the end of what the pattern gives.
    middle = F.expr("2 * (before_cell + in_cell) + size")
    turns = F.filter(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda t: middle + 2 * t * F.col("words_all")), lambda m: (m <= 2 * F.col("used")) & (F.col("size") > 0))
    of = F.transform(turns, lambda m: F.element_at(F.filter("shares", lambda s: m <= 2 * s["high"]), 1)["source"])
    out = placed.withColumn("taken_for", of).select("doc_id", "members", "size", F.size("taken_for").cast("int").alias("copies"), "taken_for")
    return out, wanted


def by_one_source(docs: DataFrame, source_col: str = "source", pattern: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, **kw) -> tuple[DataFrame, dict, dict]:
    """`mix` for rows of one source each. Sources by code point, null last, weigh `pattern` in turn.

    Also gives the words of each source.
    """
    known: dict = {}

    def targets(sizes: dict) -> dict:
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        known.update(sizes)
        return capped_targets(sizes, {s: pattern[i % len(pattern)] for i, s in enumerate(order)}, share, cap)

    out, wanted = mix(docs, F.array(F.col(source_col).cast("string")), targets, passes=math.ceil(cap), **kw)
    return out, wanted, known


def mixed_rows(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows that the mix takes, with all their columns, once per copy.

    What the mix takes is known per source, id and size; among rows alike in these, the first by a hash of the
    text take the most copies. So rows without an id and rows that repeat one come as often as they are taken.
    """
    taken, _, _ = by_one_source(docs, source_col, id_col=id_col, text_col=text_col, **kw)

    def fresh(name: str) -> str:
        return fresh(f"_{name}") if name in docs.columns else name

    key, nth, least = fresh("_alike"), fresh("_nth"), fresh("_least")
    passes = taken.agg(F.max("copies")).first()[0] or 0
    alike = F.struct(F.element_at("members", 1).alias("source"), F.col("doc_id").alias("id"), F.col("size").alias("size"))
    counts = F.array(*[F.count_if(F.col("copies") > p) for p in range(max(1, passes))])
    copies = taken.filter("copies > 0").groupBy(alike.alias(key)).agg(counts.alias(least))
    # Of the same type as `alike` (where a size may be NULL), so that window and join share one exchange of the rows.
    own = F.struct(F.col(source_col).cast("string"), F.col(id_col).cast("long"), words_in(F.col(text_col).cast("string"))).cast("struct<source: string, id: bigint, size: bigint>")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text_col), text_col))
    rows = docs.withColumn(key, own).filter(F.col(f"{key}.size") > 0).withColumn(nth, place)
    joined = rows.join(copies, key)
    times = F.filter(F.col(least), lambda n: F.col(nth) <= n)
    return joined.withColumn(nth, F.explode(times)).select(*docs.columns)
