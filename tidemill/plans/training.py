"""From a feature table to split, scaled rows, and the usual ways to train on them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidemill.models.forecaster import Forecaster
from tidemill.models.search import SearchResult, search
from tidemill.operators.features import sequence_columns
from tidemill.operators.scale import Scaler, fit_scaler
from tidemill.operators.split import SPLIT, split_ratio, split_three_way, split_years


@dataclass
class Prepared:
    """Scaled rows with a `split` column, and the scaler for rows that come later."""

    rows: DataFrame
    scaler: Scaler
    features: list[str]
    target: str

    def part(self, *names: str) -> DataFrame:
        return self.rows.where(F.col(SPLIT).isin(*names))

    @property
    def train(self) -> DataFrame:
        return self.part("train")

    @property
    def val(self) -> DataFrame:
        return self.part("val")

    @property
    def test(self) -> DataFrame:
        return self.part("test")

    @property
    def trainval(self) -> DataFrame:
        return self.part("train", "val")

    def sequences(self) -> tuple[list[str], list[str]]:
        """(lag columns, newest first; static columns) for sequence models."""
        return sequence_columns(self.features, self.target)


def prepare(
    df: DataFrame,
    time: str,
    features: Sequence[str],
    target: str,
    no_scale: Sequence[str] = (),
    holdout_years: int | None = 1,
    holdout_ratio: float = 0.1,
    val_years: int | None = None,
    scaler_type: str | None = "standard",
    fit_on: str = "train",
    tie: Sequence[str] = (),
) -> Prepared:
    """Hold out the last years (or the last share of rows), optionally carve out validation years,
    and scale with parameters learnt on `fit_on`: train, or trainval (validation rows included).
    """
    if holdout_years is None:
        split = split_ratio(df, time, tie, holdout_ratio)
    elif val_years is None:
        split = split_years(df, time, holdout_years)
    else:
        split = split_three_way(df, time, holdout_years, val_years)
    known = ["train"] if fit_on == "train" else ["train", "val"]
    scaler = fit_scaler(split.where(F.col(SPLIT).isin(*known)), features, scaler_type, skip=no_scale)
    return Prepared(scaler.transform(split), scaler, list(features), target)


def tune_and_refit(
    older: Prepared, final: Prepared, time: str, tie: Sequence[str], make: Callable[[dict], Forecaster], candidates: Sequence[dict], **options
) -> tuple[Forecaster, SearchResult]:
    """Search on `older` (a smaller, earlier slice where fits are slow), refit the best on `final`."""
    found = search(older.trainval, time, tie, make, candidates, **options)
    return make(found.best_params).fit(final.trainval), found
