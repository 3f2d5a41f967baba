"""Keep-first dedup, union by name, and step checks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemill.functions.timecols import DAY, HOUR, epoch_micros, from_seconds
from tidemill.operators.buckets import PIECE, cut_by_ranges, piece_width, with_piece


def dedup_keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per `subset` value: the first in `order` (source order, which must be total; NULLs come first).

    Done as an aggregate, so that copies collapse before the shuffle; a rank would send every copy
    of a hot key to one task. Where all other columns and the order have a fixed width, the order is packed into
    whole numbers and the aggregate hashes; a job reads the order's ranges when this is called. Else Spark sorts.
    """
    rest = [c for c in df.columns if c not in subset]
    fixed = [f.dataType for f in df.schema.fields if f.name in rest]
    named = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)])
    kinds = [f.dataType for f in named.schema.fields[len(df.columns) :]]
    if rest and all(isinstance(t, _FIXED) for t in fixed) and all(isinstance(t, _FIXED) for t in kinds):
        names = [c if isinstance(c, str) and c in rest else None for c in order]
        return _by_words(named, subset, rest, _words(named, kinds, names)).select(*df.columns)
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    picked = df.groupBy(*subset).agg(first)
    fields = [F.col("_first").getField(c).alias(c) for c in rest]
    return picked.select(*subset, *fields).select(*df.columns)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
_FIXED = (*_WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
#: Sizes of sort keys: a long, and a decimal of 38 digits.
_LONG, _DECIMAL = 2**63, 10**38 - 1
_HUNDREDTHS = 10**13
#: Steps, largest first, that all values of a column may be multiples of: microseconds of times, hundredths of fractions.
_TIME_STEPS, _FRACTION_STEPS = (DAY * 1_000_000, HOUR * 1_000_000, 1_000_000, 1_000, 1), (100, 1)
#: Microseconds up to which a time is read back from its number.
_TIMES = 10**18


@dataclass
class _Part:
    """A column's place in a sort key: 0 for NULL, else its whole number in steps from `low` on."""

    value: Column
    size: int
    low: int = 0
    step: int = 1
    kind: T.DataType | None = None
    name: str | None = None  # of a column that can be read back from the key

    def read(self, limb: Column, weight: int) -> Column:
        """The value, from the whole number `limb` in which it has this weight."""
        place = _div(limb % _long(weight * self.size), weight)
        number = (place - 1 + _long(self.low)) * _long(self.step)
        return F.when(place > 0, _from_whole(number, self.kind)).alias(self.name)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _div(c: Column, by: int) -> Column:
    """Whole part of a quotient, as a long."""
    return c.cast("long") if by == 1 else F.call_function("div", c, _long(by) if by < _LONG else F.lit(Decimal(by)))


def _whole(c: str, kind: T.DataType) -> Column:
    """The value as a whole number of the same order."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return epoch_micros(c) if isinstance(kind, T.TimestampNTZType) else F.unix_micros(c)
    if isinstance(kind, T.DoubleType):
        return F.round(F.col(c) * 100).cast("long")
    return F.col(c).cast("int").cast("long") if isinstance(kind, T.BooleanType) else F.col(c).cast("long")


def _from_whole(number: Column, kind: T.DataType) -> Column:
    """The value that has this whole number."""
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(number.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(number)
    if isinstance(kind, T.TimestampNTZType):
        return from_seconds(number.cast("decimal(18,0)") / F.lit(Decimal(1_000_000)))
    return (number / 100 if isinstance(kind, T.DoubleType) else number).cast(kind)


def _steps_of(kind: T.DataType) -> tuple[int, ...]:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return _TIME_STEPS
    return _FRACTION_STEPS if isinstance(kind, T.DoubleType) else (1,)


def _words(df: DataFrame, kinds: Sequence[T.DataType], names: Sequence[str | None]) -> list[list[_Part] | Column]:
    """Columns `_o0`, `_o1`, .. as few sort keys without NULLs. Whole numbers share a key as far as their ranges allow, and
    so do fractions that are all hundredths; other numbers are keys of their own, with a flag in the key before. Times and
    fractions count in the largest step (days to microseconds, ones or hundredths) that all their values are multiples of.
    """
    counted = [i for i, t in enumerate(kinds) if isinstance(t, (*_WHOLE, T.DoubleType))]
    asked = []
    for i in counted:
        c, known = F.col(f"_o{i}"), _whole(f"_o{i}", kinds[i])
        fits = exact = F.lit(True)
        if isinstance(kinds[i], T.DoubleType):
            fits = F.coalesce(F.bool_and((F.abs(c) < _HUNDREDTHS) & (F.round(c * 100) / 100 == c)), F.lit(True))
            exact = F.coalesce(F.bool_and((c != 0) | (c.cast("string") != "-0.0")), F.lit(True))  # no -0.0
            known = F.when(F.abs(c) < _HUNDREDTHS, known)
        even = [F.coalesce(F.bool_and(known % _long(s) == 0), F.lit(True)) for s in _steps_of(kinds[i])]
        asked.append(F.struct(F.min(known).alias("low"), F.max(known).alias("high"), fits.alias("fits"), exact.alias("exact"), F.array(*even).alias("even")))
    ends = df.agg(*[a.alias(f"_o{i}") for i, a in zip(counted, asked)]).first() if asked else []
    words: list[list[_Part] | Column] = []
    open_: list[_Part] = []

    def put(part: _Part) -> None:
        nonlocal open_
        if part.size * math.prod(p.size for p in open_) > _DECIMAL:
            words.append(open_)
            open_ = []
        open_.append(part)

    for i, kind in enumerate(kinds):
        c = F.col(f"_o{i}")
        if i in counted:
            end = ends[f"_o{i}"]
            low, high = end["low"] or 0, end["high"] or 0
            timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
            readable = names[i] if end["exact"] and not (timed and max(abs(low), abs(high)) >= _TIMES) else None
            step = next(s for s, even in zip(_steps_of(kind), end["even"]) if even)
            low, high = low // step, high // step
            if end["fits"] and high - low + 2 < _LONG:
                number = _whole(f"_o{i}", kind)
                value = F.coalesce((_div(number, step) if step > 1 else number) - _long(low) + 1, _long(0))
                put(_Part(value, high - low + 2, low, step, kind, readable))
                continue
        put(_Part(c.isNotNull().cast("long"), 2))
        whole = isinstance(kind, _WHOLE)
        words += [open_, F.coalesce(_whole(f"_o{i}", kind) if whole else c, F.lit(0).cast("long" if whole else kind))]
        open_ = []
    return [*words, open_] if open_ or not words else words


def _limbs(parts: Sequence[_Part]) -> list[list[_Part]]:
    """Neighbouring parts that fit into a long together."""
    limbs: list[list[_Part]] = [[]]
    for p in parts:
        if math.prod(x.size for x in limbs[-1]) * p.size >= _LONG:
            limbs.append([])
        limbs[-1].append(p)
    return limbs


def _packed(parts: Sequence[_Part]) -> Column:
    limbs = _limbs(parts)
    whole = [reduce(lambda out, p: out * _long(p.size) + p.value, limb, _long(0)) for limb in limbs]
    if len(limbs) == 1:
        return whole[0]
    out = whole[0].cast("decimal(38,0)")
    for limb, number in zip(limbs[1:], whole[1:]):
        out = (out * F.lit(Decimal(math.prod(p.size for p in limb))) + number.cast("decimal(20,0)")).cast("decimal(38,0)")
    return out


def _read(word: str, parts: Sequence[_Part]) -> dict[str, Column]:
    """The columns that can be read back from a packed word."""
    limbs, out = _limbs(parts), {}
    for k, limb in enumerate(limbs):
        below = math.prod(p.size for after in limbs[k + 1 :] for p in after)
        upper = F.col(word) % F.lit(Decimal(below * math.prod(p.size for p in limb))) if k else F.col(word)
        number = _div(upper, below)
        for j, part in enumerate(limb):
            if part.name:
                out[part.name] = part.read(number, math.prod(p.size for p in limb[j + 1 :]))
    return out


def _by_words(df: DataFrame, subset: Sequence[str], rest: Sequence[str], words: Sequence[list[_Part] | Column]) -> DataFrame:
    """The first row per subset. Several words are taken from the last to the first, each among rows of equal words
    before it, which also spreads the rows of a hot key. Columns that a word holds are read back from it.
    """
    names = [f"_w{i}" for i in range(len(words))]
    rows = df.select(*subset, *rest, *[(_packed(w) if isinstance(w, list) else w).alias(n) for w, n in zip(words, names)])
    back: dict[str, Column] = {}
    held = []
    for n, w in zip(names, words):
        if isinstance(w, list) and (found := _read(n, w)):
            back |= found
            held.append(n)
    for i in reversed(range(len(words))):
        picked = [F.min_by(c, names[i]).alias(c) for c in [*[c for c in rest if c not in back], *[n for n in names[i + 1 :] if n in held]]]
        least = [F.min(names[i]).alias(names[i])] if names[i] in held else []
        rows = rows.groupBy(*subset, *names[:i]).agg(*picked, *least)
    return rows.select(*subset, *[back.get(c, F.col(c)) for c in rest])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column missing from one of them is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def time_steps(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    order: Sequence[str] | None = None,
    piece: Column | None = None,
) -> DataFrame:
    """(keys, [order,] time, previous, step_seconds, n_rows): the step from each row to the last.

    In time order (the default) rows of one time are counted first, however many they are: one
    line for the step to that time and, for repeats, one line with step 0; `n_rows` says how many
    rows have the step. With `order`, steps follow other columns (rows as they were read); the series is cut
    into ranges of that order, or by `piece`, a column that grows with it. A series' first row has a null
    step.

    Only the first row of each piece needs its predecessor from another piece, and that comes
    from a summary of one row per piece.
    """
    if order is None:
        times = df.groupBy(*keys, time).agg(F.count(F.lit(1)).alias("n_rows"))
        width = piece_width(times, keys, time)
        cut = with_piece(times, time, width) if width else cut_by_ranges(times, [*keys, time])
        steps = _steps(cut, keys, time, [*keys, time, "n_rows"], [time])
        repeats = steps.where(F.col("n_rows") > 1)
        repeats = repeats.withColumns({"previous": F.col(time), "n_rows": F.col("n_rows") - 1})
        steps = steps.withColumn("n_rows", F.lit(1).cast("long")).unionByName(repeats)
    else:
        cols = list(dict.fromkeys([*keys, *order, time]))
        cut = cut_by_ranges(df.select(*cols), [*keys, *order]) if piece is None else df.select(*cols, piece.alias(PIECE))
        steps = _steps(cut, keys, time, cols, order).withColumn("n_rows", F.lit(1).cast("long"))
    step = (epoch_micros(time) - epoch_micros("previous")) / F.lit(1_000_000)
    return steps.withColumn("step_seconds", step)


def _steps(cut: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    inside = Window.partitionBy(*keys, PIECE).orderBy(*order)
    ranked = cut.withColumns({"previous": F.lag(time).over(inside), "_row": F.row_number().over(inside)})
    later_rows = ranked.where(F.col("_row") > 1).select(*cols, "previous")
    position = F.struct(*order)
    ends = cut.groupBy(*keys, PIECE).agg(
        F.min_by(F.struct(*cols), position).alias("_head"),
        F.max_by(F.col(time), position).alias("_tail"),
    )
    across = Window.partitionBy(*keys).orderBy(PIECE)
    heads = ends.withColumn("previous", F.lag("_tail").over(across)).select("_head.*", "previous")
    return later_rows.unionByName(heads)


def step_histogram(df: DataFrame, keys: Sequence[str], time: str, order=None, piece=None) -> DataFrame:
    """Number of rows per step to the previous row (first rows have no step)."""
    steps = time_steps(df, keys, time, order, piece).where(F.col("step_seconds").isNotNull())
    return steps.groupBy(*keys, "step_seconds").agg(F.sum("n_rows").alias("n_rows"))


def discontinuities(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    expected: float | None = None,
    among: Sequence[float] | None = None,
    order=None,
    piece=None,
) -> DataFrame:
    """Steps that are not `expected` (first rows count), or that are one of `among`."""
    steps = time_steps(df, keys, time, order, piece)
    if among is not None:
        return steps.where(F.col("step_seconds").isin(*among))
    return steps.where(~F.col("step_seconds").eqNullSafe(F.lit(float(expected))))
