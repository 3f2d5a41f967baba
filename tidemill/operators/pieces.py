"""Grids laid inside the pieces of a series, with the values that reach into them from other pieces.

A table is stored once, cut into pieces. One row per piece says where its rows and values begin and end.
These ends are carried on in two levels, between the pieces of a group and between groups, so that no
window holds the pieces of a whole series. Each row then emits the steps that are missing up to the next row,
and knows the value before and behind them: a grid needs no join with the rows, and a fill of the grid no
second pass. Gaps longer than a piece are dealt out over tasks by their number of steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F, types as T

from tidemill.functions.timecols import epoch_seconds, seconds_interval
from tidemill.operators.buckets import PIECE, SERIES, series_of, with_piece, with_series
from tidemill.sources.tables import kept

#: Steps that one piece spans.
PIECE_STEPS = 131_072
#: Pieces in a group of the first level.
GROUP_PIECES = 1_024
#: Missing steps that one row of a long gap emits, and that one task emits.
_BLOCK_STEPS, _TASK_STEPS = 4_096, 1 << 20
_GROUP = "_group"


def gridded_neighbours(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int) -> DataFrame:
    """The rows of `df`, one per series and time and all a whole number of steps apart, with a row for every
    missing step in between, and per column c of `cols` the structs `_before_c` and `_after_c` (fields t and v):
    the nearest value at or before, and behind, the row.

    Rows without a time are left out; a NULL key is a series. Runs jobs when called: the rows and the ends of
    their pieces are stored in the shared folder. A table that spans less than a piece is one piece per series, and
    has no ends to carry.
    """
    series = series_of(keys)
    cut = with_piece(with_series(df.where(F.col(time).isNotNull()), keys).drop(*keys), time, step * PIECE_STEPS * 1_000_000)
    span = Observation()
    seconds = epoch_seconds(time)
    rows = kept(cut.observe(span, F.min(seconds).alias("low"), F.max(seconds).alias("high")), "grid-rows")
    low, high = span.get["low"], span.get["high"]
    ends = None
    if low is not None and (high - low) // step >= PIECE_STEPS:
        ends = kept(_carried(rows.groupBy(*series, PIECE).agg(*_ends(time, cols)), series, cols), "grid-ends")
    else:
        # Pieces that begin with the table: all rows are in the first.
        rows = rows.withColumn(PIECE, F.floor((seconds - F.lit(low or 0)) / (step * PIECE_STEPS)))
    return _laid(rows, ends, df.columns, keys, time, cols, step)


def _laid(rows: DataFrame, ends: DataFrame | None, names: Sequence[str], keys: Sequence[str], time: str, cols: Sequence[str], step: int) -> DataFrame:
    series = series_of(keys)
    if ends is None:
        nothing = {f"_{side}_{c}": F.lit(None).cast(_end_type(rows, time, c)) for c in cols for side in ("earlier", "later")}
        joined = rows.withColumns({"_next": F.lit(None).cast(rows.schema[time].dataType), **nothing})
    else:
        # One row of ends per piece: hashed next to the rows, which the windows need there anyway.
        joined = rows.join(ends.drop("_last_t", *[f"_last_{c}" for c in cols]).hint("shuffle_hash"), [*series, PIECE])
    parts = ", ".join(f"`{c}`" for c in (*series, PIECE))
    ahead = f"OVER (PARTITION BY {parts} ORDER BY `{time}` ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    behind = f"OVER (PARTITION BY {parts} ORDER BY `{time}` DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    near = [f"coalesce(lag(`{time}`) OVER (PARTITION BY {parts} ORDER BY `{time}` DESC), _next) AS _next"]
    for c in cols:
        own = f"CASE WHEN `{c}` IS NOT NULL THEN named_struct('t', `{time}`, 'v', `{c}`) END"
        near.append(f"coalesce(last({own}, true) {ahead}, `_earlier_{c}`) AS `_before_{c}`")
        near.append(f"coalesce(last({own}, true) {behind}, `_later_{c}`) AS `_after_{c}`")
    rest = [c for c in names if c not in (*keys, time)]
    known = joined.selectExpr(*[f"`{c}`" for c in (*series, time, *rest)], *near)
    missing = F.greatest((epoch_seconds("_next") - epoch_seconds(time)) / step - 1, F.lit(0)).cast("long")
    short = F.when(missing < PIECE_STEPS, missing).otherwise(0)
    emitted = known.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(short, F.lit(0)))))
    at = F.when(F.col("_i") == 0, F.col(time)).otherwise(F.col(time) + seconds_interval(F.col("_i") * step))
    values = [F.when(F.col("_i") == 0, F.col(c)).alias(c) for c in rest]
    found = [f"_{side}_{c}" for c in cols for side in ("before", "after")]
    own_keys = [F.col(f"{SERIES}.{k}").alias(k) for k in keys]
    out = emitted.select(*own_keys, at.alias(time), *values, *found)
    between = None if ends is None else _long_gaps(ends, keys, time, cols, step)
    out = out if between is None else out.unionByName(between, allowMissingColumns=True)
    return out.select(*names, *found)


def _end_type(rows: DataFrame, time: str, c: str) -> T.StructType:
    return T.StructType([T.StructField("t", rows.schema[time].dataType), T.StructField("v", rows.schema[c].dataType)])


def _ends(time: str, cols: Sequence[str]) -> list:
    out = [F.min(time).alias("_first_t"), F.max(time).alias("_last_t")]
    for c in cols:
        at = f"CASE WHEN `{c}` IS NOT NULL THEN `{time}` END"
        for side, pick in (("first", "min"), ("last", "max")):
            out += [F.expr(f"{pick}({at})").alias(f"_{side}_t_{c}"), F.expr(f"{pick}_by(`{c}`, {at})").alias(f"_{side}_v_{c}")]
    return out


def _carried(ends: DataFrame, series: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(series, piece, _last_t, _next, and per column _last_c, _earlier_c, _later_c): each piece's last row and values,
    the next row's time, and the nearest values of other pieces.
    """
    pieces = ends.withColumn(_GROUP, F.floor(F.col(PIECE) / GROUP_PIECES))
    merged = [F.min("_first_t").alias("_first_t")]
    for c in cols:
        for side, pick in (("first", "min"), ("last", "max")):
            merged += [F.expr(f"{pick}(`_{side}_t_{c}`)").alias(f"_{side}_t_{c}"), F.expr(f"{pick}_by(`_{side}_v_{c}`, `_{side}_t_{c}`)").alias(f"_{side}_v_{c}")]
    groups = pieces.groupBy(*series, _GROUP).agg(*merged)
    across = groups.selectExpr(*_quoted(series), _GROUP, *_beyond(series, _GROUP, cols, "_g"))
    last = [f"{_end('last', c)} AS `_last_{c}`" for c in cols]
    inside = pieces.selectExpr(*_quoted(series), PIECE, _GROUP, "_last_t", *last, *_beyond([*series, _GROUP], PIECE, cols, ""))
    joined = inside.join(across.hint("shuffle_hash"), [*series, _GROUP])
    names = ["_next", *[f"_{side}_{c}" for c in cols for side in ("earlier", "later")]]
    return joined.selectExpr(*_quoted(series), PIECE, "_last_t", *[f"`_last_{c}`" for c in cols], *[f"coalesce(`{n}`, `_g{n}`) AS `{n}`" for n in names])


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def _end(side: str, c: str) -> str:
    return f"CASE WHEN `_{side}_t_{c}` IS NOT NULL THEN named_struct('t', `_{side}_t_{c}`, 'v', `_{side}_v_{c}`) END"


def _beyond(by: Sequence[str], order: str, cols: Sequence[str], prefix: str) -> list[str]:
    """What stands before and behind each row of ends. A descending order makes "next" a growing frame."""
    part = f"PARTITION BY {', '.join(_quoted(by))} " if by else ""

    def over(way: str) -> str:
        return f"OVER ({part}ORDER BY {order} {way} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    out = [f"last(_first_t) {over('DESC')} AS `{prefix}_next`"]
    for c in cols:
        out.append(f"last({_end('last', c)}, true) {over('ASC')} AS `{prefix}_earlier_{c}`")
        out.append(f"last({_end('first', c)}, true) {over('DESC')} AS `{prefix}_later_{c}`")
    return out


def _long_gaps(ends: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int) -> DataFrame | None:
    """The steps of gaps of a piece or more, in as many tasks as there are steps; None where no gap is so long."""
    missing = ((epoch_seconds("_next") - epoch_seconds("_last_t")) / step - 1).cast("long")
    gaps = ends.withColumn("_missing", missing).where(F.col("_missing") >= PIECE_STEPS)
    steps = gaps.agg(F.sum("_missing")).first()[0]
    if not steps:
        return None
    blocks = gaps.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_missing") - 1) / _BLOCK_STEPS))))
    dealt = blocks.repartition(max(2, -(-steps // _TASK_STEPS)), *series_of(keys), "_block")
    low = F.col("_block") * _BLOCK_STEPS + 1
    points = dealt.withColumn("_i", F.explode(F.sequence(low, F.least(low + (_BLOCK_STEPS - 1), F.col("_missing")))))
    near = []
    for c in cols:
        near += [F.coalesce(f"_last_{c}", f"_earlier_{c}").alias(f"_before_{c}"), F.col(f"_later_{c}").alias(f"_after_{c}")]
    names = [F.col(f"{SERIES}.{k}").alias(k) for k in keys]
    return points.select(*names, (F.col("_last_t") + seconds_interval(F.col("_i") * step)).alias(time), *near)
