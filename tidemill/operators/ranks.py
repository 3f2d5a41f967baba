"""Find the row at a given position of a time-ordered table without sorting it.

The table is read twice, whatever its size. The first pass counts rows per calendar day. The second reads only
the days that hold a wanted position, with the days' bounds as literals that reach the scan; a day of more
rows than one task should number is narrowed down in what that pass stored.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from tidemill.functions.timecols import DAY, epoch_micros
from tidemill.session import cut_lineage
from tidemill.sources.tables import kept

_CELLS = 4_096
_MICROS = DAY * 1_000_000


class Positions:
    """Positions of a table's rows in (time, *tie) order, NULLs first. Counts the rows when made (one pass)."""

    def __init__(self, df: DataFrame, time: str, tie: Sequence[str]):
        self.rows, self.time, self.tie = df.select(time, *tie), time, list(tie)
        day = F.floor(epoch_micros(time) / _MICROS).cast("long").alias("day")
        self.days = kept(df.select(day).groupBy("day").agg(F.count(F.lit(1)).alias("n")), "day-counts")
        self.n = self.days.agg(F.sum("n")).first()[0] or 0

    def _between(self, day: int | None, days: int = 1) -> Column:
        if day is None:
            return F.col(self.time).isNull()
        first = dt.date(1970, 1, 1) + dt.timedelta(days=day)
        kind = self.rows.schema[self.time].dataType
        low = F.lit(first.isoformat()).cast(kind)
        if first > dt.date.max - dt.timedelta(days=days):
            return F.col(self.time) >= low
        return (F.col(self.time) >= low) & (F.col(self.time) < F.lit((first + dt.timedelta(days=days)).isoformat()).cast(kind))

    def rows_at(self, ranks: Iterable[int], max_rows: int = 100_000) -> dict[int, Row]:
        """`rank -> (time, *tie)` of the row with that 0-based rank. One task numbers at most `max_rows` rows."""
        ranks = sorted(set(ranks))
        if not ranks:
            return {}
        earlier = Window.orderBy(F.col("day").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)  # one row per day
        counted = self.days.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        hit = F.exists(F.array(*[F.lit(r).cast("long") for r in ranks]), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
        cells = counted.where(hit).collect()
        wanted = {c["day"]: [(r, r - c["before"]) for r in ranks if c["before"] <= r < c["before"] + c["n"]] for c in cells}
        small = [c["day"] for c in cells if c["n"] <= max_rows]
        found = self._numbered(small, wanted)
        large = {c["day"]: c["n"] for c in cells if c["n"] > max_rows}
        if large:
            part = cut_lineage(self._of_days(large).withColumn("_us", epoch_micros(self.time)))
            for day, n in large.items():
                found.update(_narrowed(part, self.time, self.tie, day, n, wanted[day], max_rows))
        return found

    def _of_days(self, days: Iterable[int | None]) -> DataFrame:
        return self.rows.where(reduce(lambda a, b: a | b, [self._between(d) for d in days]))

    def _numbered(self, days: list[int | None], wanted: dict) -> dict[int, Row]:
        if not days:
            return {}
        day = F.floor(epoch_micros(self.time) / _MICROS).cast("long")
        inside = Window.partitionBy("_day").orderBy(self.time, *self.tie)
        numbered = self._of_days(days).withColumn("_day", day).withColumn("_at", F.row_number().over(inside) - 1)
        picks = reduce(lambda a, b: a | b, [F.col("_day").eqNullSafe(F.lit(d)) & F.col("_at").isin([at for _, at in wanted[d]]) for d in days])
        by_place = {(row["_day"], row["_at"]): row for row in numbered.where(picks).collect()}
        return {rank: by_place[d, at] for d in days for rank, at in wanted[d]}


def rows_at(df: DataFrame, time: str, tie: Sequence[str], ranks: Iterable[int], max_rows: int = 100_000) -> dict[int, Row]:
    """`rank -> (time, *tie)` of the row with that 0-based rank in (time, *tie) order, NULLs first."""
    return Positions(df, time, tie).rows_at(ranks, max_rows)


def _narrowed(rows: DataFrame, time: str, tie: Sequence[str], day: int | None, n: int, wanted: list[tuple[int, int]], max_rows: int) -> dict[int, Row]:
    """Ranks inside one day of very many rows: counts per cell narrow each down to a cell of at most `max_rows` rows, and
    only those cells are sorted. The driver sees at most 4,096 counts per step.
    """
    open_cells, done = {}, {}
    if day is None:
        done[(None, None, n)] = wanted
    else:
        open_cells[(day * _MICROS, (day + 1) * _MICROS, n)] = wanted
    while open_cells:
        (start, stop, count), inside = open_cells.popitem()
        if count <= max_rows or stop - start == 1:
            done[(start, stop, count)] = inside
            continue
        width = -(-(stop - start) // _CELLS)
        cell = F.floor((F.col("_us") - start) / width).cast("long").alias("cell")
        counts = _within(rows, start, stop).groupBy(cell).count().collect()
        before = 0
        for c in sorted(counts, key=lambda r: r["cell"]):
            here = [(rank, at - before) for rank, at in inside if before <= at < before + c["count"]]
            if here:
                left = start + c["cell"] * width
                open_cells[(left, min(left + width, stop), c["count"])] = here
            before += c["count"]
    found = {}
    for (start, stop, count), inside in done.items():
        cell_rows = _within(rows, start, stop)
        if count > max_rows:
            found.update(_in_one_instant(cell_rows, tie, inside, count, max_rows))
            continue
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(time, *tie)) - 1
        picks = cell_rows.withColumn("_at", number).where(F.col("_at").isin([at for _, at in inside]))
        by_place = {row["_at"]: row for row in picks.collect()}
        found.update({rank: by_place[at] for rank, at in inside})
    return found


def _in_one_instant(rows: DataFrame, tie: Sequence[str], wanted: list[tuple[int, int]], count: int, max_rows: int) -> dict[int, Row]:
    """Ranks among very many rows of one instant. Without a tie they are all alike; else the rows are dealt
    into ranges of the tie, kept by a checkpoint (ranges come from a sample), and only ranges that hold a
    wanted rank are numbered. Rows of equal ties share a range, and any of them will do.
    """
    if not tie:
        row = rows.first()
        return {rank: row for rank, _ in wanted}
    dealt = rows.repartitionByRange(min(_CELLS, 2 * -(-count // max_rows)), *tie).withColumn("_range", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    found, before = {}, 0
    for c in sorted(dealt.groupBy("_range").count().collect(), key=lambda r: r["_range"]):
        inside = {at - before: rank for rank, at in wanted if before <= at < before + c["count"]}
        if inside:
            # Rows of equal ties count once, with their number: a range of one tie value is one row.
            part = dealt.where(F.col("_range") == c["_range"]).groupBy(*[x for x in rows.columns]).agg(F.count(F.lit(1)).alias("_n"))
            end = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy(*tie).rowsBetween(Window.unboundedPreceding, 0))
            ended = part.withColumn("_end", end)
            hit = F.array(*[F.lit(a) for a in sorted(inside)])
            picked = ended.withColumn("_at", F.explode(F.filter(hit, lambda a: (a < F.col("_end")) & (a >= F.col("_end") - F.col("_n")))))
            found.update({inside[row["_at"]]: row for row in picked.collect()})
        before += c["count"]
    return found


def _within(rows: DataFrame, start: int | None, stop: int | None) -> DataFrame:
    if start is None:
        return rows.where(F.col("_us").isNull())
    return rows.where((F.col("_us") >= start) & (F.col("_us") < stop))


def at_or_after(row: Row, time: str, tie: Sequence[str]) -> Column:
    """Whether a row stands at or behind `row` in (time, *tie) order, NULLs first. Never NULL."""
    later = F.lit(True)
    for c in reversed(list(tie)):
        behind = F.col(c).isNotNull() if row[c] is None else F.coalesce(F.col(c) > F.lit(row[c]), F.lit(False))
        later = behind | (F.col(c).eqNullSafe(F.lit(row[c])) & later)
    if row[time] is None:
        return F.col(time).isNotNull() | later
    bound = F.lit(row[time]).cast("timestamp_ntz")
    return F.coalesce((F.col(time) >= bound) & ((F.col(time) > bound) | later), F.lit(False))
