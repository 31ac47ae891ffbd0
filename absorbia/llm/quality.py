"""Quality classifier: naive Bayes support vectors.

N-gram indicators are scaled by the log ratio of their smoothed frequencies in the two classes;
a linear model with hinge loss is fitted to the scaled rows by dual coordinate descent, and its
margins are turned into probabilities on rows that its fit left out. Fitting uses a bounded
sample of labelled rows, scoring all rows.

Null and empty texts have no n-gram and get the score of the bias alone. Rows with several labels
count with the larger one. Without labels of both classes every score is the class share (1 if
there are no labels at all). Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_ids, map_text, one_row_an_id
from .features import features, indicators

#: Bounds of what is fitted: labelled rows, hashed features, least rows a feature is in.
MAX_ROWS = 4_000
BITS = 18
LEAST_ROWS = 3
KINDS = ("w", "s", "ss", "r")
THRESHOLD = 0.3


@dataclass
class Rows:
    """Sparse 0/1 rows."""

    start: np.ndarray
    feature: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        return cls(np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64), np.concatenate(lists) if lists else np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.start) - 1

    def take(self, at: np.ndarray) -> Rows:
        return Rows.of([self.feature[self.start[i] : self.start[i + 1]] for i in at])

    def counts(self, mask: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature[np.repeat(mask, np.diff(self.start))], minlength=size)


@dataclass
class Model:
    weight: np.ndarray  # per feature, the class log ratio multiplied in
    square: np.ndarray  # squared log ratio, for the row norm
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(row, self.square[feature], n))
        return np.bincount(row, self.weight[feature], n) / np.maximum(norm, 1e-9) + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -35, 35)))


def fit_margin(rows: Rows, y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 6, least: int = LEAST_ROWS, seed: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, squared ratios, bias). y is +1 or -1."""
    p, q = rows.counts(y > 0, size), rows.counts(y < 0, size)
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    ratio = np.where(p + q >= least, np.log((p + 1.0) / (n1 + 2.0)) - np.log((q + 1.0) / (n0 + 2.0)), 0.0)
    square = ratio**2
    w, bias = np.zeros(size), 0.0
    parts = [rows.feature[rows.start[i] : rows.start[i + 1]] for i in range(len(rows))]
    norm = [max(np.sqrt(square[f].sum()), 1e-9) for f in parts]
    values = [ratio[f] / n for f, n in zip(parts, norm)]
    alpha = np.zeros(len(rows))
    top = np.where(y > 0, cost * len(y) / (2 * n1), cost * len(y) / (2 * n0))  # both classes weigh alike
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, x = parts[i], values[i]
            gradient = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / ((x @ x) + 1.0), 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w * ratio, square, bias


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve from margins to probabilities (Newton's method)."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - t))
        a -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(rows: Rows, labels: np.ndarray, bits: int = BITS) -> Model:
    size, y = 1 << bits, np.where(labels > 0, 1, -1)
    if not len(y) or abs(y.sum()) == len(y):
        share = 1.0 if not len(y) or y[0] > 0 else 0.0
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, 35.0 if share else -35.0)
    fold = np.arange(len(y)) % 4 == 0
    w, square, bias = fit_margin(rows.take(np.flatnonzero(~fold)), y[~fold], size)
    left = rows.take(np.flatnonzero(fold))
    outside = Model(w, square, bias, 1.0, 0.0).margins(np.repeat(np.arange(len(left)), np.diff(left.start)), left.feature, len(left))
    slope, shift = calibrate(outside, y[fold])
    return Model(*fit_margin(rows, y, size), slope, shift)


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int, bits: int, kinds: tuple[str, ...]) -> tuple[Rows, np.ndarray]:
    """Indicator rows and labels of at most `most` labelled rows, in the order of their ids.

    labels: (id, label), ids distinct. The ids drawn are few enough to broadcast.
    """
    drawn = bounded_ids(labels.select(id_col, "label"), id_col, most)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn.withColumnRenamed(id_col, "id")), "id").withColumn("h", F.xxhash64("text"))

    def start():
        def apply(texts):
            row, feature, _ = indicators(*features(texts, bits, kinds), bits)
            return [np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))]

        return apply

    rows = one_row_an_id(map_text(found, "text", [("feature", "array<int>")], start, ["id", "h", "label"]), "id")
    got = rows.select(F.xxhash64(F.lit(0), "id").alias("order"), "feature", "label").toArrow()
    if not got.num_rows:
        return Rows.of([]), np.zeros(0, np.int32)
    lists = got["feature"].combine_chunks()
    rows = Rows(lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py(), lists.flatten().to_numpy())
    order = np.lexsort((got["label"].to_numpy(), got["order"].to_numpy()))
    return rows.take(order), got["label"].to_numpy()[order]


def score(docs: DataFrame, model: Model, text_col: str = "text", bits: int = BITS, kinds: tuple[str, ...] = KINDS, threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score (0 to 1) and predicted (1 at or above the threshold), under `names`."""
    shared = docs.sparkSession.sparkContext.broadcast((model, threshold))

    def start():
        model, threshold = shared.value

        def apply(texts):
            row, feature = features(texts, bits, kinds)
            used = model.square[feature] > 0
            row, feature, _ = indicators(row[used], feature[used], bits)
            p = model.probability(model.margins(row, feature, len(texts)))
            return [p, (p >= threshold).astype(np.int32)]

        return apply

    return map_text(docs, text_col, [(names[0], "double"), (names[1], "int")], start, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Fit on the labelled rows given and score all of docs."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    model = fit(*sample_rows(docs, known, id_col, text_col, max_rows, BITS, KINDS))
    return score(docs, model, text_col, threshold=threshold, keep=keep, names=names)
