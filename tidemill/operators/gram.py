"""Pairwise correlations of wide tables from blocked products of their columns.

A task turns its rows into a matrix of values (0 where NULL) and one of flags, and adds up four products of
them; with the flags, a pair counts the rows where both columns have a value. What tasks add up are rows of
these products, so they meet per column and no task holds more than a few of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that shift each column towards 0, so that large means do not swallow small spreads.
_SHIFT_ROWS = 1_000
#: Rows of a matrix product.
_STEP = 4_096
#: Sums per pair: rows, values of the column and of the other, their squares, products, rows with a NaN.
_SUMS = 7


def wide_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr) for every ordered pair over the rows where both have a value, in one pass.

    NULL where a pair has no spread or no row, NaN where it has a NaN, as in `corr`.
    """
    cols, n = list(cols), len(cols)
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.limit(_SHIFT_ROWS).agg(*[F.avg(F.nanvl(f"c{i}", F.lit(None).cast("double"))) for i in range(n)]).first()
    shift = np.array([m if m is not None and np.isfinite(m) else 0.0 for m in means])

    def add_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((_SUMS, n, n))
        for batch in batches:
            for k in range(0, batch.num_rows, _STEP):
                part = batch.slice(k, _STEP)
                has = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                x = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in part.columns])
                bad = np.isnan(x)
                x = np.where(bad | (has == 0), 0.0, x - shift)
                sums[0] += has.T @ has
                of = x.T @ has
                squares = (x * x).T @ has
                nan = bad.astype(float).T @ has
                sums[1] += of
                sums[2] += of.T
                sums[3] += squares
                sums[4] += squares.T
                sums[5] += x.T @ x
                sums[6] += nan + nan.T
        yield pa.record_batch([pa.array(np.arange(n, dtype=np.int32)), pa.array([sums[:, i].tobytes() for i in range(n)], pa.binary())], names=["i", "sums"])

    def merged(table: pa.Table) -> np.ndarray:
        out = np.zeros(_SUMS * n)
        for s in table.column("sums"):
            out += np.frombuffer(s.as_py())
        return out

    def some(key: tuple, table: pa.Table) -> pa.Table:
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([merged(table).tobytes()], pa.binary())})

    def finish(key: tuple, table: pa.Table) -> pa.Table:
        i = key[0].as_py()
        rows, a, b, aa, bb, ab, nan = merged(table).reshape(_SUMS, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            spread = (aa - a * a / rows) * (bb - b * b / rows)
            corr = (ab - a * b / rows) / np.sqrt(spread)
        known = (rows > 0) & (spread > 0)
        corr = np.where(nan > 0, np.nan, np.clip(corr, -1.0, 1.0))
        names = {"col_a": pa.array([cols[i]] * n, pa.string()), "col_b": pa.array(cols, pa.string())}
        return pa.table(names | {"corr": pa.array(corr, pa.float64(), mask=~known & ~(nan > 0))})

    parts = values.mapInArrow(add_up, "i int, sums binary").withColumn("part", F.spark_partition_id() % 64)
    fewer = parts.groupBy("i", "part").applyInArrow(some, "i int, sums binary")
    return fewer.groupBy("i").applyInArrow(finish, "col_a string, col_b string, corr double")
