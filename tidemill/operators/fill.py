"""Gap filling on gridded series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemill.functions.timecols import micros
from tidemill.operators.buckets import carry_neighbours, over_rows
from tidemill.operators.pieces import gridded_neighbours

# Fills need no halo, so their pieces are long and the summary (one row per piece) stays small:
# one series of 10^11 rows has under a million pieces.
ROWS_PER_FILL = 131_072


def interpolate_time(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    step: int,
    both_edges: bool = False,
    flag: str | None = None,
    grid: bool = False,
) -> DataFrame:
    """Straight line in time between the surrounding values.

    After the last value the last value holds. Before the first value rows stay null, or take
    the first value with `both_edges`. `flag` names a 0/1 column: any cell was null before filling.
    `grid`: rows, one per time and whole steps apart, are put on the regular grid in the same pass.
    """
    near = _neighbours(df, keys, time, cols, step, grid)

    def line(c: str) -> str:
        b, a = f"`_before_{c}`", f"`_after_{c}`"
        span = f"({micros(a + '.t')} - {micros(b + '.t')})"
        straight = f"({a}.v - {b}.v) / {span} * ({micros(f'`{time}`')} - {micros(b + '.t')}) + {b}.v"
        edge = f" WHEN {a} IS NOT NULL THEN {a}.v" if both_edges else ""
        return (
            f"CAST(CASE WHEN `{c}` IS NOT NULL THEN `{c}` WHEN {b} IS NOT NULL AND {a} IS NOT NULL THEN {straight} "
            f"WHEN {b} IS NOT NULL THEN {b}.v{edge} END AS DOUBLE) AS `{c}`"
        )

    out = [line(c) if c in cols else f"`{c}`" for c in df.columns]
    if flag:
        nulls = [f"`{c}` IS NULL" for c in df.columns if c not in (*keys, time)]
        out.append(f"CAST({' OR '.join(nulls)} AS INT) AS `{flag}`")
    return near.selectExpr(*out)


def _neighbours(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int, grid: bool) -> DataFrame:
    return gridded_neighbours(df, keys, time, cols, step) if grid else carry_neighbours(df, keys, time, cols, step * ROWS_PER_FILL)


def fill_midpoint(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int, grid: bool = False
) -> DataFrame:
    """A gap takes the mean of the values around it; gaps at an edge stay null. `grid` as in `interpolate_time`."""
    near = _neighbours(df, keys, time, cols, step, grid)
    middle = {c: f"coalesce(`{c}`, (`_before_{c}`.v + `_after_{c}`.v) / 2) AS `{c}`" for c in cols}
    return near.selectExpr(*[middle.get(c, f"`{c}`") for c in df.columns])


def fill_neighbour_mean(
    df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], step: int | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """A null takes the mean of the rows just before and after it; wider gaps stay null."""
    windows = {f"_mean_{c}": lambda w, c=c: (F.lag(c).over(w) + F.lead(c).over(w)) / 2 for c in cols}
    added = over_rows(df, keys, time, windows, back=1, ahead=1, step=step, tie=tie)
    filled = added.withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in cols})
    return filled.select(*df.columns)
