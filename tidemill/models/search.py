"""Parameter search over expanding folds."""

from __future__ import annotations

import itertools
import json
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.models.boosting import SquaredBoosting, as_forecaster, boosting_rows
from tidemill.models.forecaster import PREDICTION, Forecaster
from tidemill.operators.metrics import point_metrics
from tidemill.operators.split import expanding_folds, fold_test, fold_train
from tidemill.sources.tables import read_json, write_json


def expand_grid(grid: Mapping[str, Sequence] | Sequence[Mapping[str, Sequence]]) -> list[dict]:
    """All combinations. A list of grids is conditional: each part is expanded on its own."""
    parts = [grid] if isinstance(grid, Mapping) else list(grid)
    return [
        dict(zip(part, values)) for part in parts for values in itertools.product(*part.values())
    ]


def draw(space: Mapping[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """`n` random settings. Ranges: ("int", a, b), ("real", a, b), ("log", a, b)."""
    rng = random.Random(seed)

    def one(kind: str, low: float, high: float):
        if kind == "int":
            return rng.randint(int(low), int(high))
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        return rng.uniform(low, high)

    return [{name: one(*spec) for name, spec in space.items()} for _ in range(n)]


class ParzenDraws:
    """Settings drawn one after another, conditioned on the scores of those before (lower is better).

    After `startup` plain draws, finished settings are parted into the best few, about `share` of twice the root of their number, and the rest. Each range
    gets a density of both parts, a sum of bell curves on the settings plus a flat one, in the range's own scale
    (logarithmic for "log"). Candidates come from the density of the good ones, and the one for
    which good is likeliest against the rest is the next draw. Ranges as in `draw`.
    """

    def __init__(self, space: Mapping[str, tuple], seed: int = 42, startup: int = 10, share: float = 0.25, candidates: int = 24):
        self.space, self.startup, self.share, self.candidates = dict(space), startup, share, candidates
        self.rng = random.Random(seed)
        self.finished: list[tuple[dict, float]] = []

    def _unit(self, name: str, value: float) -> float:
        """A setting as a place in [0, 1]."""
        kind, low, high = self.space[name]
        if kind == "log":
            return (math.log(value) - math.log(low)) / (math.log(high) - math.log(low)) if high > low else 0.5
        if kind == "int":
            return (value - int(low) + 0.5) / (int(high) - int(low) + 1)
        return (value - low) / (high - low) if high > low else 0.5

    def _value(self, name: str, at: float):
        kind, low, high = self.space[name]
        if kind == "log":
            return math.exp(math.log(low) + at * (math.log(high) - math.log(low)))
        if kind == "int":
            return min(int(high), int(low) + int(at * (int(high) - int(low) + 1)))
        return low + at * (high - low)

    @staticmethod
    def _width(n: int) -> float:
        return max(0.03, 0.5 * n**-0.8) if n else 1.0

    def _density(self, at: float, known: Sequence[float]) -> float:
        width = self._width(len(known))
        bells = sum(math.exp(-0.5 * ((at - x) / width) ** 2) / (width * math.sqrt(2 * math.pi)) for x in known)
        return (1.0 + bells) / (1 + len(known))

    def _near(self, known: Sequence[float]) -> float:
        pick = self.rng.randrange(len(known) + 1)
        if pick == len(known):
            return self.rng.random()
        at = -1.0
        while not 0 <= at < 1:
            at = self.rng.gauss(known[pick], self._width(len(known)))
        return at

    def next(self) -> dict:
        """The next setting to try."""
        if len(self.finished) < self.startup:
            return {name: self._value(name, self.rng.random()) for name in self.space}
        ranked = sorted(self.finished, key=lambda f: f[1])
        n_good = max(2, math.ceil(self.share * math.sqrt(len(ranked)) * 2))
        good, rest = ranked[:n_good], ranked[n_good:]
        out = {}
        for name in self.space:
            of_good, of_rest = ([self._unit(name, p[name]) for p, _ in part] for part in (good, rest))
            places = [self._near(of_good) for _ in range(self.candidates)]
            out[name] = self._value(name, max(places, key=lambda x: self._density(x, of_good) / self._density(x, of_rest)))
        return out

    def tell(self, setting: Mapping, score: float | None) -> None:
        """The score of a finished setting; None or NaN counts as the worst."""
        self.finished.append((dict(setting), math.inf if score is None or math.isnan(score) else float(score)))


@dataclass
class SearchResult:
    table: DataFrame
    best_params: dict
    best_score: float


class SharedStages:
    """Vectors of a search's folds, made once per setting of the stages before the regressor.

    Candidates of one setting follow each other, and its vectors are dropped after the last fit that reads
    them, so a search holds few at a time. Models whose stages learn from the rows assemble for themselves.
    """

    def __init__(self, folds: DataFrame, models: Sequence, n_splits: int):
        self.folds, self.models, self.made = folds, models, 0
        known = [isinstance(m, Forecaster) and not m.stages_learn for m in models]
        self.keys = [m.stage_settings() if k else None for m, k in zip(models, known)]
        firsts = {key: c for c, key in reversed(list(enumerate(self.keys)))}
        self.order = sorted(range(len(models)), key=lambda c: (firsts[self.keys[c]], c))
        self._left = Counter(key for key in self.keys for _ in range(n_splits))
        self._tables: dict[tuple, DataFrame] = {}
        self._lock = Lock()

    @contextmanager
    def rows(self, c: int) -> Iterator[tuple[DataFrame, bool]]:
        """(the folds, whether they are assembled) for one fit of candidate c."""
        key = self.keys[c]
        if key is None:
            yield self.folds, False
            return
        with self._lock:
            if key not in self._tables:
                self._tables[key] = self.models[c].assembled(self.folds).persist()
                self.made += 1
        try:
            yield self._tables[key], True
        finally:
            with self._lock:
                self._left[key] -= 1
                if not self._left[key]:
                    self._tables.pop(key).unpersist()

    def close(self) -> None:
        while self._tables:
            self._tables.popitem()[1].unpersist()


def search(
    df: DataFrame,
    time: str,
    tie: Sequence[str],
    make: Callable[[dict], Forecaster],
    candidates: Sequence[dict],
    n_splits: int = 5,
    scores: Sequence[str] = ("rmse", "mae", "mape", "sd"),
    refit: str = "rmse",
    score: Callable[[DataFrame], float] | None = None,
    threads: int = 4,
) -> SearchResult:
    """Mean score per candidate over folds that train on the past and test on what follows.

    Fits are independent Spark jobs, submitted from a few threads. `score` replaces the point
    scores by one of its own (lower is better). The folds are cached, not collected, and so are the vectors of
    each setting of the stages before the regressor: candidates that share it, and their folds, read them.
    A score that is NULL (such as mape where all actuals are zero) stays NULL, and its candidate is chosen last.
    """
    models = [make(c) for c in candidates]
    folds = expanding_folds(df, time, tie, n_splits).persist()
    shared = SharedStages(folds, models, n_splits)

    def run(job: tuple[int, int]) -> dict:
        c, i = job
        with shared.rows(c) as (rows, assembled):
            how = {"assembled": True} if assembled else {}
            model = make(candidates[c]).fit(rows.where(fold_train(i)), **how)
            predicted = model.predict(rows.where(fold_test(i)), **how)
            return scored(model, predicted, c, i)

    def scored(model, predicted: DataFrame, c: int, i: int) -> dict:
        if score is not None:
            return {"candidate": c, "fold": i, refit: float(score(predicted))}
        row = point_metrics(predicted, model.target, PREDICTION, scores=scores).first()
        return {"candidate": c, "fold": i, **{s: None if row[s] is None else float(row[s]) for s in scores}}

    jobs = [(c, i) for c in shared.order for i in range(1, n_splits + 1)]
    try:
        with ThreadPool(threads) as pool:
            results = pool.map(run, jobs, chunksize=1)
    finally:
        shared.close()
        folds.unpersist()
    results.sort(key=lambda r: (r["candidate"], r["fold"]))
    spark = df.sparkSession
    names = [refit] if score is not None else list(scores)
    schema = "candidate int, fold int, " + ", ".join(f"{s} double" for s in names)
    per_fold = spark.createDataFrame([[r["candidate"], r["fold"], *(r[s] for s in names)] for r in results], schema)
    labels = spark.createDataFrame([(c, str(p)) for c, p in enumerate(candidates)], "candidate int, params string")
    table = per_fold.groupBy("candidate").agg(*[F.avg(s).alias(f"cv_{s}") for s in names]).join(labels, "candidate")
    means = [sum(math.inf if r[refit] is None else r[refit] for r in results if r["candidate"] == c) / n_splits for c in range(len(candidates))]
    best = min(range(len(candidates)), key=means.__getitem__)
    return SearchResult(table, dict(candidates[best]), means[best])


def search_in_turn(
    df: DataFrame,
    time: str,
    tie: Sequence[str],
    make: Callable[[dict], Forecaster],
    space: Mapping[str, tuple],
    n_iter: int = 50,
    at_once: int = 4,
    seed: int = 42,
    refit: str = "rmse",
    **options,
) -> SearchResult:
    """`search` over `n_iter` settings of which each few (`at_once`) are drawn with the scores of those before.

    Candidates are numbered in the order of their draws. `options` go to `search`.
    """
    draws, tables, tried = ParzenDraws(space, seed), [], []
    while len(tried) < n_iter:
        batch = [draws.next() for _ in range(min(at_once, n_iter - len(tried)))]
        found = search(df, time, tie, make, batch, refit=refit, **options)
        rows = sorted(found.table.collect(), key=lambda r: r["candidate"])
        for r in rows:
            draws.tell(batch[r["candidate"]], r[f"cv_{refit}"])
        tables += [(r["candidate"] + len(tried), *r[1:]) for r in rows]
        schema = found.table.schema
        tried += [(p, s) for p, s in draws.finished[len(tried) :]]
    best = min(range(n_iter), key=lambda c: tried[c][1])
    return SearchResult(df.sparkSession.createDataFrame(sorted(tables), schema), dict(tried[best][0]), tried[best][1])


@dataclass
class EarlyStop:
    model: Forecaster
    best_iteration: int
    losses: DataFrame


def boost_with_early_stop(
    make: Callable[[int], Forecaster], train: DataFrame, val: DataFrame, max_iter: int, patience: int
) -> EarlyStop:
    """Boost until `patience` rounds bring no better validation loss (or `max_iter` rounds), and keep the
    model of the best round. `make(n)` builds a model of n rounds; it is asked for one round, whose settings
    and feature stages hold for all. Rounds are appended to a running margin, so each is trained once.
    """
    prototype = make(1).fit(train)
    boosting = SquaredBoosting(prototype.estimator, boosting_rows(prototype, train), boosting_rows(prototype, val))
    best = 0
    try:
        while len(boosting.trees) < max_iter:
            boosting.add()
            val_loss = [v for _, _, v in boosting.history]
            if val_loss[-1] is not None and (val_loss[best] is None or val_loss[-1] < val_loss[best]):
                best = len(val_loss) - 1
            elif len(val_loss) - 1 - best >= patience:
                break
        losses = train.sparkSession.createDataFrame(boosting.history, "iteration int, train_loss double, val_loss double")
        return EarlyStop(as_forecaster(prototype, boosting, best + 1), best + 1, losses)
    finally:
        boosting.margins.close()


def store_params(spark: SparkSession, params: Mapping[str, Mapping], path: str) -> None:
    """Settings by model name, as JSON lines."""
    write_json(spark.createDataFrame([(name, json.dumps(dict(p))) for name, p in params.items()], "model string, params string"), path)


def stored_params(spark: SparkSession, path: str) -> dict[str, dict]:
    """What `store_params` wrote; numbers keep every bit."""
    rows = read_json(spark, path, "model string, params string").collect()
    return {r["model"]: json.loads(r["params"]) for r in rows}
