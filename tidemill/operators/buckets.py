"""Windows over long series, cut into bounded pieces.

`Window.partitionBy(series)` puts a whole series on one task, which fails when one series holds
most of the data. Here a series is cut into pieces, each piece also receives the few neighbouring
rows its windows can reach (the halo), windows run inside the piece, and halo rows are dropped.
State that can reach arbitrarily far (the last seen value) travels through a per-piece summary.

Two ways to cut:
* by time, for rows on a regular step: at most width/step rows per piece, one shuffle;
* by ordinal, for irregular rows: rows are numbered first, so pieces have equal row counts.

A NULL series key is a series of its own: joins between pieces and their summaries run on the keys as one
struct, as plain equi-joins that share the shuffle of the windows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from tidemill.functions.timecols import epoch_micros, epoch_seconds
from tidemill.session import cut_lineage

PIECE = "_piece"
OWNED = "_owned"
ROWS_PER_PIECE = 8_192
_SECOND = 1_000_000
_NO_TIME = -(2**62)
# Candidate widths in microseconds for cutting irregular rows, widest first.
_WIDTHS = [d * 86_400 * _SECOND for d in (365, 30, 1)] + [3_600 * _SECOND, 60 * _SECOND, _SECOND, 1_000]
#: Rows that one task may number.
ROWS_PER_CUT = 1_000_000

WindowColumn = Callable[[WindowSpec], Column]


def with_piece(df: DataFrame, time: str, width: int) -> DataFrame:
    """Number of the piece of `width` microseconds that holds the row.

    Never NULL (rows without a time get a piece of their own), so a join on it keeps all rows and
    adds no filter that would keep two uses of one shuffle apart.
    """
    return df.withColumn(PIECE, F.coalesce(F.floor(epoch_micros(time) / width), F.lit(_NO_TIME)))


#: The key columns as one struct. It is never NULL, and structs compare NULL fields as equal, so a join on
#: it keeps rows whose keys are NULL and still runs on a shuffle of the same column.
SERIES = "_series"


def with_series(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn(SERIES, F.struct(*keys)) if keys else df


def series_of(keys: Sequence[str]) -> list[str]:
    return [SERIES] if keys else []


def piece_width(df: DataFrame, keys: Sequence[str], time: str, max_rows: int = ROWS_PER_CUT) -> int | None:
    """Widest cut for which no (series, piece) holds more than `max_rows` rows; None if there is none.

    Every candidate costs one map-side-combined count; the first ones nearly always fit.
    """
    for width in _WIDTHS:
        counts = with_piece(df.select(*keys, time), time, width).groupBy(*keys, PIECE).count()
        if (counts.agg(F.max("count")).first()[0] or 0) <= max_rows:
            return width
    return None


def cut_by_ranges(df: DataFrame, order: Sequence[str], rows: int = ROWS_PER_CUT) -> DataFrame:
    """Rows with a piece number that grows along `order`, of about `rows` rows each.

    Pieces part rows of one instant too, even rows that are equal in all of `order`: a running number, taken
    from a checkpoint so that it stays the same, comes last in the order. Ranges come from a sample, so the
    result is kept by a checkpoint as well.
    """
    kept = cut_lineage(df)
    parts = max(1, -(-kept.count() // rows))
    numbered = kept.withColumn("_running", F.monotonically_increasing_id())
    ranges = numbered.repartitionByRange(parts, *order, "_running").drop("_running")
    return cut_lineage(ranges.withColumn(PIECE, F.spark_partition_id().cast("long")))


def join_same(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps one copy of the keys."""
    names = {c: f"_r_{c}" for c in on}
    renamed = right.withColumnsRenamed(names)
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[names[c]]) for c in on])
    return left.join(renamed, cond, how).drop(*names.values())


# A per-group table of up to this many rows may be broadcast.
SMALL_GROUPS = 10_000


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(number of groups, rows of the largest), from one map-side-combined count."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    row = counts.agg(F.count(F.lit(1)), F.coalesce(F.max("_n"), F.lit(0))).first()
    return row[0], row[1]


def join_per_group(df: DataFrame, per_group: DataFrame, keys: Sequence[str], n_groups: int) -> DataFrame:
    """Attach one row per group to all rows. Few groups (as counted before) are broadcast, so the
    rows stay where they are; many are joined by shuffle.
    """
    if not keys:
        return df.withColumns({c: per_group.select(c).scalar() for c in per_group.columns})
    return join_same(df, F.broadcast(per_group) if n_groups <= SMALL_GROUPS else per_group, keys)


def with_ordinal(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str] = (),
    width: int | None = None,
    name: str = "ordinal",
    most_rows: int = ROWS_PER_CUT,
) -> DataFrame:
    """0-based row number per series, without a window over the whole series.

    Rows are counted per piece, the counts are summed up over pieces, and rows are numbered only
    inside their piece. Where no width gives pieces of at most `most_rows` rows (a burst at one instant),
    pieces are ranges of (series, time, tie) instead.
    """
    width = width or piece_width(df, keys, time, most_rows)
    series = series_of(keys)
    rows = with_series(df, keys)
    cut = with_piece(rows, time, width) if width else cut_by_ranges(rows, [*series, time, *tie], most_rows)
    counts = cut.groupBy(*series, PIECE).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*series).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*series, PIECE, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*series, PIECE).orderBy(time, *tie)
    return (
        cut.join(offsets.hint("shuffle_hash"), [*series, PIECE])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop(PIECE, "_before", *series)
    )


def with_halo(df: DataFrame, position: Column, width: int, back: int, ahead: int) -> DataFrame:
    """Send each row to its own piece and to the pieces whose windows reach it.

    Rows without a position stay, in pieces of their own.
    """
    first, last = F.floor((position - ahead) / width), F.floor((position + back) / width)
    nowhere = F.lit(_NO_TIME) + F.spark_partition_id()
    out = df.withColumn("_home", F.coalesce(F.floor(position / width), nowhere))
    out = out.withColumn(PIECE, F.explode(F.coalesce(F.sequence(first, last), F.array(F.col("_home")))))
    return out.withColumn(OWNED, F.col(PIECE) == F.col("_home")).drop("_home")


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    columns: Mapping[str, WindowColumn],
    back: int,
    ahead: int = 0,
    step: int | None = None,
    tie: Sequence[str] = (),
    rows_per_piece: int = ROWS_PER_PIECE,
) -> DataFrame:
    """Add window columns that look at most `back` rows behind and `ahead` rows ahead.

    `step`: seconds between rows when the series lies on a regular grid; rows without a time have no place on
    it, and NULL in the added columns. Without `step` the rows are numbered first, those without a time
    being the first.
    """
    rows = max(rows_per_piece, 4 * (back + ahead))
    if step:
        halo = with_halo(df, epoch_seconds(time), rows * step, back * step, ahead * step)
        helper = []
    else:
        numbered = with_ordinal(df, keys, time, tie, name="_ordinal")
        halo = with_halo(numbered, F.col("_ordinal"), rows, back, ahead)
        helper = ["_ordinal"]
    spec = Window.partitionBy(*keys, PIECE).orderBy(time, *tie)
    added = [(F.when(F.col(time).isNotNull(), build(spec)) if step else build(spec)).alias(name) for name, build in columns.items()]
    return halo.select("*", *added).where(OWNED).drop(PIECE, OWNED, *helper)


def carry_neighbours(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], width: int
) -> DataFrame:
    """Add the nearest non-null value at or before, and at or after, each row.

    For column c: structs `_before_c` and `_after_c` with fields t (time) and v (value). Per piece
    (`width` seconds) the first and last observation are kept; a window over those summaries
    carries them on.
    """
    # The rows carry their keys in the struct only, so that both uses read the same columns.
    cut = with_piece(with_series(df, keys).drop(*keys), time, width * _SECOND)
    shared = set(df.columns) <= {*keys, time, *cols}
    restored = [f"`{SERIES}`.`{c}` AS `{c}`" if c in keys else f"`{c}`" for c in df.columns]
    keys = series_of(keys)
    if shared:
        # Summary and rows read the same columns, so both can run on one shuffle of the input.
        cut = cut.repartition(*keys, PIECE)
    series = ", ".join(f"`{k}`" for k in keys)

    def seen(c: str, then: str) -> str:
        return f"CASE WHEN `{c}` IS NOT NULL THEN {then} END"

    ends = []
    for c in cols:
        at = seen(c, f"`{time}`")
        for side, pick in (("first", "min"), ("last", "max")):
            ends.append(F.expr(f"{pick}({at})").alias(f"_{side}_t_{c}"))
            ends.append(F.expr(f"{pick}_by(`{c}`, {at})").alias(f"_{side}_v_{c}"))
    summary = cut.groupBy(*keys, PIECE).agg(*ends)

    def carried(c: str, side: str, order: str) -> str:
        # A descending order makes "next" a growing frame; an ascending one would rescan the
        # rest of the partition for every row.
        end = f"CASE WHEN `_{side}_t_{c}` IS NOT NULL THEN named_struct('t', `_{side}_t_{c}`, 'v', `_{side}_v_{c}`) END"
        by = f"PARTITION BY {series} " if keys else ""
        return f"last({end}, true) OVER ({by}ORDER BY {PIECE} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    beyond = []
    for c in cols:
        beyond.append(f"{carried(c, 'last', 'ASC')} AS `_earlier_{c}`")
        beyond.append(f"{carried(c, 'first', 'DESC')} AS `_later_{c}`")
    names = [f"`{k}`" for k in keys]
    summary = summary.selectExpr(*names, PIECE, *beyond)
    # One summary row per piece: hashed per partition, next to rows that stay where the windows
    # need them. Without the hint Spark may broadcast the rows instead.
    joined = cut.join(summary.hint("shuffle_hash"), [*keys, PIECE])

    def nearest(c: str, spare: str, order: str) -> str:
        by = ", ".join([*names, PIECE])
        own = seen(c, f"named_struct('t', `{time}`, 'v', `{c}`)")
        frame = f"PARTITION BY {by} ORDER BY `{time}` {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"coalesce(last({own}, true) OVER ({frame}), `{spare}`)"

    near = []
    for c in cols:
        near.append(f"{nearest(c, f'_earlier_{c}', 'ASC')} AS `_before_{c}`")
        near.append(f"{nearest(c, f'_later_{c}', 'DESC')} AS `_after_{c}`")
    return joined.selectExpr(*restored, *near)
