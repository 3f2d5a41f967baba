"""Language by hierarchical discrimination: the family first, then pairwise linear SVMs inside it.

Features are relative frequencies of character 1- to 3-grams, hashed to `DIMS` cells for each length, so
every score is a sum of table lookups over the whole text. Families are found, not given: languages whose
mean feature vectors are alike are merged (average link), and the tree is cut at its widest gap. A linear
SVM per family (one against the rest) picks the family; one-versus-one SVMs of the languages in it vote.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import give_back, mix, slices

#: Bytes of text whose n-grams a worker scores at once; they take some 150 times as much memory.
SLICE_BYTES = 256 << 10
#: Cells for each n-gram length.
DIMS = 2048
ORDERS = 3
UNKNOWN = "und"
#: Labelled rows of one language that a fit takes, in expectation; which ones, a hash of the id decides.
SAMPLE_ROWS = 600
#: Languages a fit accepts.
MAX_LANGUAGES = 200

_SPACE = 32
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters of all texts, other characters as one space; first position of each text; texts with a letter).

    Each text gets a space before and after, so words at its ends have n-grams of their ends too.
    """
    parts = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    low = np.minimum(codes, 0xFFFF)
    letter = _LETTER[low]
    for i in np.flatnonzero(codes > 0xFFFF):
        letter[i] = chr(codes[i]).isalpha()
    counts = np.add.reduceat(letter, first[:-1], dtype=np.int64) if len(parts) else np.empty(0, np.int64)
    return np.where(letter, codes, _SPACE).astype(np.uint64), first, counts > 0


def _cells(codes: np.ndarray) -> list[np.ndarray]:
    """The cell of the n-gram that begins at each position, for n = 1, 2, 3; runs of spaces count once."""
    out, key = [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(ORDERS):
        moved = np.full(len(codes), _SPACE, dtype=np.uint64)
        moved[: len(codes) - n] = codes[n:]
        key = key * np.uint64(0x110001) + moved + np.uint64(1)
        out.append((mix(key) & np.uint64(DIMS - 1)).astype(np.int64) + n * DIMS)
    return out


def _kept(codes: np.ndarray) -> np.ndarray:
    """Positions that count: not a space after a space."""
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
    return keep


def _squeeze(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes, first, has_letter = _code_points(texts)
    keep = _kept(codes)
    keep[first[:-1]] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], before[first], has_letter


def features(texts: list[str]) -> np.ndarray:
    """Dense feature rows; for the bounded sample of a fit."""
    codes, first, _ = _squeeze(texts)
    cells = _cells(codes)
    out = np.zeros((len(texts), ORDERS * DIMS), dtype=np.float32)
    for i in range(len(texts)):
        for c in cells:
            out[i] += np.bincount(c[first[i] : first[i + 1]], minlength=ORDERS * DIMS)
    return out / np.maximum(np.diff(first), 1)[:, None].astype(np.float32)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient steps. y is +1 or -1."""
    step = 8.0 / (2 * float(weight @ np.einsum("ij,ij->i", x, x)) + ridge + 2 * float(weight.sum()))
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    vw, vb, t = w.copy(), b, 1.0
    best, last = (np.inf, w, b), np.inf
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb))
        loss = float((weight * slack**2).sum() + ridge * (vw @ vw) / 2)
        if loss < best[0]:
            best = (loss, vw.copy(), vb)
        if loss > last:
            step, t, vw, vb = step / 2, 1.0, best[1].copy(), best[2]
            w, b, last = vw.copy(), vb, np.inf
            continue
        last = loss
        g = (-2 * weight * slack * y).astype(np.float32)
        new_w, new_b = vw - np.float32(step) * (g @ x + np.float32(ridge) * vw), vb - step * g.sum()
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = new_w + np.float32((t - 1) / new_t) * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return best[1], best[2]


def families_of(labels: list[str], means: np.ndarray) -> list[list[str]]:
    """Languages in families: average-link merging of their mean vectors, cut at the widest gap."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    groups, history = [[i] for i in range(len(labels))], []
    while len(groups) > 1:
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: np.mean(near[np.ix_(groups[p[0]], groups[p[1]])]))
        history.append((float(np.mean(near[np.ix_(groups[a], groups[b])])), [list(g) for g in groups]))
        groups = [g for i, g in enumerate(groups) if i not in (a, b)] + [groups[a] + groups[b]]
    if len(history) < 2:
        cut = history[0][1] if history else groups
    else:
        gaps = [history[i][0] - history[i + 1][0] for i in range(len(history) - 1)]
        cut = history[int(np.argmax(gaps)) + 1][1]
    return sorted(sorted(labels[i] for i in g) for g in cut)


@dataclass
class LanguageModel:
    """`table` holds one column of weights per SVM: the families first, then the pairs."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    table: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score); a null text, or one without a letter, is `und` with score 0."""
        if not texts:
            return [], np.empty(0)
        codes, first, has_letter = _squeeze([t or "" for t in texts])
        if not self.families:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins = np.zeros((len(texts), self.table.shape[1]))
        for cells in _cells(codes):
            margins += np.add.reduceat(self.table[cells], first[:-1], axis=0)
        margins = margins / np.maximum(np.diff(first), 1)[:, None] + self.bias
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        pair_at = {p: len(self.families) + i for i, p in enumerate(self.pairs)}
        family = margins[:, : len(self.families)].argmax(axis=1)
        for i in np.flatnonzero(has_letter):
            row, group = margins[i], self.families[family[i]]
            sure = row[family[i]] if len(self.families) > 1 else 1.0
            votes = dict.fromkeys(group, 0.0)
            for a, b in combinations(group, 2):
                m = row[pair_at[a, b]]
                votes[a if m > 0 else b] += 1 + np.tanh(abs(m)) / 1000  # margins only settle equal votes
            names[i] = max(group, key=lambda g: (votes[g], g))
            own = [row[pair_at[p]] * (1 if p[0] == names[i] else -1) for p in self.pairs if names[i] in p]
            scores[i] = 1 / (1 + np.exp(-2 * np.clip(min([sure, *own]), -20, 20)))
        return names, scores


def held_out(id_col: Column) -> Column:
    """A third of the rows, by the CRC of the id's text; a row without an id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on a bounded sample of the rows where `learn` holds and text and label are not null.

    Each language gives about `rows` rows (all, if it has fewer). Without any such row the model knows no
    language and answers `und`.
    """
    usable = docs.filter(learn & F.col(text_col).isNotNull() & F.col(label_col).isNotNull()).select(
        F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col)).alias("pick")
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().orderBy("label").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"{label_col} has over {MAX_LANGUAGES} values")
    if not counts:
        return LanguageModel([], [], np.empty((ORDERS * DIMS, 0), np.float32), np.empty(0))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, rows / n))).otherwise(share)
    taken = usable.filter(F.pmod(F.col("pick"), F.lit(1_000_003)) < share * 1_000_003)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SLICE_BYTES):
                texts = piece.column("text").to_pylist()
                packed = [(np.flatnonzero(v), v) for v in features(texts)]
                yield pa.record_batch(
                    [piece.column("label"), piece.column("pick"), pa.array([i.astype("<u2").tobytes() for i, _ in packed], pa.binary()), pa.array([v[i].tobytes() for i, v in packed], pa.binary())],
                    names=["label", "pick", "cells", "shares"],
                )

    sample = taken.mapInArrow(vectors, "label string, pick long, cells binary, shares binary").collect()
    sample.sort(key=lambda r: (r["label"], r["pick"], r["cells"]))
    x = np.zeros((len(sample), ORDERS * DIMS), dtype=np.float32)
    for row, r in zip(x, sample):
        row[np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["shares"], np.float32)
    return _fit_sample(x, np.array([r["label"] for r in sample], dtype=object))


def _fit_sample(x: np.ndarray, labels: np.ndarray) -> LanguageModel:
    names = sorted(set(labels.tolist()))
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-4)  # rarer cells count more
    x = x * scale
    families = families_of(names, np.array([x[labels == n].mean(axis=0) for n in names]))
    pairs = [p for group in families for p in combinations(group, 2)]
    columns = []
    for members in families:
        y = np.where(np.isin(labels, members), 1.0, -1.0)
        columns.append((x, y))
    for a, b in pairs:
        rows = (labels == a) | (labels == b)
        columns.append((x[rows], np.where(labels[rows] == a, 1.0, -1.0)))
    weights, bias = [], []
    for rows, y in columns:
        weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
        w, b = _svm(rows, y, weight)
        weights.append(w * scale)
        bias.append(b)
    return LanguageModel(families, pairs, np.array(weights, dtype=np.float32).T.copy(), np.array(bias))


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only id and text are read."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SLICE_BYTES):
                names, scores = model.predict(piece.column("text").to_pylist())
                yield pa.record_batch([piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows, with all their columns, whose language is known with at least `min_score`.

    Only the text goes to Python. Null texts and texts without a letter go; repeated rows are judged alike;
    an empty table stays empty, and a model that knows no language keeps nothing.
    """

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        kept = []
        for piece in slices(pa.record_batch([texts], names=["text"]), limit=SLICE_BYTES):
            names, scores = model.predict(piece.column("text").to_pylist())
            kept.extend(n != UNKNOWN and s >= min_score for n, s in zip(names, scores))
        give_back()
        return pa.array(kept, pa.bool_())

    return docs.where(known(F.col(text_col).cast("string")))
