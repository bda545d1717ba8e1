"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting gives each feature in turn a shallow tree on the gradient of the log loss; the trees add up to one lookup
table a feature. The pairs of features with the largest gain on what is left get two-way tables in the same manner. A score
is a vectorised sum of table entries at a text's bins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import BLANKS, id_remainder, materialise, table

#: Most labelled rows that the driver fits on; of more, those with the smallest hash of their id.
SAMPLE_ROWS = 60_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, PAIR_BINS, RATE, LEAST_HESSIAN = 32, 120, 6, 60, 8, 0.2, 5.0
FEATURES = (
    "words", "word_length", "symbols", "exclamations", "capitals", "digits", "stops", "distinct_words", "repeated_neighbours",
    "repeated_lines", "line_words", "ended_lines", "commonest_word", "long_words", "non_ascii", "distinct_pairs",
)
_SYMBOLS, _CAPITALS, _LETTERS, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)]), b"0123456789"


def features(text: str | None) -> list[float]:
    """FEATURES of one whole text; all 0 without words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    count = lambda of: len(raw) - len(raw.translate(None, of))
    letters = max(1, count(_LETTERS))
    counts = Counter(words)
    lines = [line for line in (x.strip(BLANKS) for x in text.split("\n")) if line]
    return [
        float(np.log1p(n)), chars / n, count(_SYMBOLS) / chars, raw.count(b"!") / chars, count(_CAPITALS) / letters, count(_DIGITS) / chars, (raw.count(b".") + raw.count(b",")) / chars, len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), sum(line[-1] in ".!?…" for line in lines) / len(lines), max(counts.values()) / n,
        sum(len(w) > 12 for w in words) / n, 1 - len(text) / len(raw), len(set(zip(words, words[1:]))) / n,
    ]


@dataclass(frozen=True)
class Model:
    """cuts: bin edges by feature; tables: log odds by feature and bin; pairs: (feature, feature, log odds by both bins)."""

    intercept: float
    cuts: tuple[np.ndarray, ...]
    tables: tuple[np.ndarray, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, a row of features each."""
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, entries in enumerate(self.tables):
            total += entries[b[:, j]]
        for i, j, entries in self.pairs:
            total += entries[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins left of the cut) of the best split of a row of bins; no gain without one."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= LEAST_HESSIAN) & (hr >= LEAST_HESSIAN), gl**2 / (hl + 1) + gr**2 / (hr + 1) - g.sum() ** 2 / (h.sum() + 1), -np.inf)
    at = int(gain.argmax()) if len(gain) else 0
    return (float(gain[at]), at + 1) if len(gain) and gain[at] > 0 else (0.0, 0)


def tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A tree of that depth on one feature's bins, as its Newton step by bin. g, h: sums of gradients and hessians by bin."""
    gain, at = _best_cut(g, h) if depth else (0.0, 0)
    if not gain:
        return np.full(len(g), -g.sum() / (h.sum() + 1))
    return np.concatenate([tree(g[:at], h[:at], depth - 1), tree(g[at:], h[at:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, Newton step by bins) of the best cut of both features into four quarters. g, h: sums by both features' bins."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, value = 0.0, np.zeros_like(g)
    if min(g.shape) < 2:
        return best, value
    gq = [gc[:-1, :-1], gc[:-1, -1:] - gc[:-1, :-1], gc[-1:, :-1] - gc[:-1, :-1], gc[-1, -1] - gc[:-1, -1:] - gc[-1:, :-1] + gc[:-1, :-1]]
    hq = [hc[:-1, :-1], hc[:-1, -1:] - hc[:-1, :-1], hc[-1:, :-1] - hc[:-1, :-1], hc[-1, -1] - hc[:-1, -1:] - hc[-1:, :-1] + hc[:-1, :-1]]
    gain = sum(a**2 / (b + LEAST_HESSIAN) for a, b in zip(gq, hq)) - gc[-1, -1] ** 2 / (hc[-1, -1] + LEAST_HESSIAN)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    if gain[i, j] > 0:
        best = float(gain[i, j])
        step = [-a[i, j] / (b[i, j] + LEAST_HESSIAN) for a, b in zip(gq, hq)]
        value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = step
    return best, value


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of labels y (0, 1) by features x. Without rows it scores 0.5; with one label only, near that label's share."""
    share = (y.sum() + 1) / (len(y) + 2)
    intercept = float(np.log(share / (1 - share)))
    quantiles = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.empty(0) for j in range(len(FEATURES))]
    blank = Model(intercept, tuple(quantiles), tuple(np.zeros(len(c) + 1) for c in quantiles), ())
    if not len(x):
        return blank
    b, total = blank.bins(x), np.full(len(x), intercept)
    tables = [t.copy() for t in blank.tables]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j, entries in enumerate(tables):
            g, h = slopes()
            step = RATE * tree(np.bincount(b[:, j], g, len(entries)), np.bincount(b[:, j], h, len(entries)))
            entries += step
            total += step[b[:, j]]
    coarse = [np.minimum(b[:, j] * PAIR_BINS // len(t), PAIR_BINS - 1) for j, t in enumerate(tables)]

    def both(i: int, j: int, values: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * PAIR_BINS + coarse[j], values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    ranked = sorted(((pair_tree(both(i, j, g), both(i, j, h))[0], i, j) for i, j in combinations(range(len(tables)), 2)), key=lambda r: (-r[0], r[1:]))
    chosen = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, i, j in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, entries in chosen:
            g, h = slopes()
            step = RATE * pair_tree(both(i, j, g), both(i, j, h))[1]
            entries += step
            total += step[coarse[i], coarse[j]]
    widen = lambda j: np.minimum(np.arange(len(tables[j])) * PAIR_BINS // len(tables[j]), PAIR_BINS - 1)
    return Model(intercept, tuple(quantiles), tuple(tables), tuple((i, j, entries[np.ix_(widen(i), widen(j))]) for i, j, entries in chosen))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with an array column "features"."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn("features", F.pandas_udf(of, "array<double>")(F.col(text_col)))


def score_features(rows: DataFrame, model: Model) -> DataFrame:
    """rows with a column "score"."""

    def of(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else [], dtype=float)

    of.__annotations__ = {"x": pd.Series, "return": pd.Series}
    return rows.withColumn("score", F.pandas_udf(of, "double")("features"))


def train(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows (id, features) that have a label of 0 or 1; of several labels of an id the larger counts."""
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("label"))
    joined = rows.select(id_col, "features").join(known, id_col).withColumn("order", F.xxhash64(id_col))
    found = joined.orderBy("order", id_col, "features").limit(sample_rows).select("features", "label").toPandas()
    return fit(np.stack(found["features"].to_numpy()) if len(found) else np.empty((0, len(FEATURES))), found["label"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held_out_fold: int = 1, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """id, held_out, score and predicted, a row for each row of docs.

    Features of every whole text are written once; a bounded, hash-picked sample of the labelled rows outside the held-out
    fold fits the model on the driver. Null and empty texts have the features of no words and a score like any other. Null
    ids have no label. Labels other than 0 and 1 are left out; without labels every score is 0.5. Repeated rows are scored
    each; only the named columns are read. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    rows = with_features(rows, "__text").select(id_col, "features", (id_remainder(F.col(id_col), folds) == held_out_fold).alias("held_out"))
    rows = materialise(rows, "features")
    model = train(rows.where("not held_out"), labels, id_col, label_col, sample_rows)
    return score_features(rows, model).select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
