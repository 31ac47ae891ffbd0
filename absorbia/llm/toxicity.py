"""Toxicity by non-negative positive-unlabelled learning.

A linear model over word and word-prefix indicators is trained in numpy from confirmed toxic
texts and unlabelled ones. Its risk is the class prior's share of the positive loss plus the
unlabelled negative loss corrected for the positives among the unlabelled; that part, which
cannot be negative in truth, counts as zero where its estimate falls below, which keeps the model
from fitting the unlabelled rows away. Features are those whose share differs between the two
samples by LEAST_Z standard errors, however many.

The unlabelled texts are a bounded sample of the labelled rows with their labels hidden, so that
the class prior, the share of toxic rows among the labelled ones in the table, is that of the
population they come from. Scoring covers all rows.

Null and empty texts have no feature and get the score of the bias. Without confirmed positives
every score is 0. Rows with several labels count as toxic if one says so. Repeated rows each give
a row; an empty table gives none. Texts of any length are read whole, in batches of bounded bytes.
An id that stands at several texts is learned from the one of least hash. Columns of the table
that have the names of the new ones are replaced by them; `names` gives the new ones other names.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import bounded_ids, claim, discard, map_text, materialize, one_row_an_id

#: Bounds of what is fitted: labelled rows drawn as confirmed texts and, labels hidden, as unlabelled ones.
MAX_POSITIVE = 2_000
MAX_UNLABELLED = 4_000
PREFIXES = (4, 5, 6)
#: Features are in at least so many rows drawn, and differ by so many standard errors.
LEAST_ROWS = 4
LEAST_Z = 4.0
THRESHOLD = 0.5
MEMO = 500_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”’…¡¿"


def piece_features(piece: str) -> tuple[int, ...]:
    """Hashed features of a piece: its word and its word's prefixes."""
    word = piece.strip(_EDGE).lower()
    if not word:
        return ()
    names = [f"w{word}", *(f"p{word[:n]}" for n in PREFIXES if len(word) >= n)]
    return tuple(crc32(n.encode("utf-8", "surrogatepass")) - (1 << 31) for n in names)


@dataclass
class Model:
    weight: dict[int, float]
    bias: float
    memo: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        claim("toxicity", self.memo.clear)
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, weight = self.memo, self.weight
        found = [set((t or "").split()) for t in texts]
        for p in set().union(*found) - memo.keys():
            memo[p] = tuple(f for f in piece_features(p) if f in weight)
        margin = [self.bias + sum(weight[f] for f in set().union(*filter(None, map(memo.__getitem__, pieces)))) for pieces in found]
        return 1 / (1 + np.exp(-np.clip(np.array(margin, float), -35, 35)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 600, ridge: float = 1e-5) -> Model:
    """Non-negative PU training with logistic loss on 0/1 rows (lists of distinct features)."""
    if not positive or not unlabelled:
        return Model({}, -35.0)
    features, p = np.unique(np.concatenate(positive), return_counts=True)
    others, more = np.unique(np.concatenate(unlabelled), return_counts=True)
    features, places = np.unique(np.concatenate([features, others]), return_inverse=True)
    p, u = np.bincount(places[: len(p)], p, len(features)), np.bincount(places[len(p) :], more, len(features))
    share = (p + u + 1.0) / (len(positive) + len(unlabelled) + 2.0)
    z = (p / len(positive) - u / len(unlabelled)) / np.sqrt(share * (1 - np.minimum(share, 0.999)) * (1 / len(positive) + 1 / len(unlabelled)))
    z[p + u < LEAST_ROWS] = 0
    chosen = np.flatnonzero(np.abs(z) >= LEAST_Z)
    features = features[chosen]

    def rows(lists):
        if not len(features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), len(lists)
        at = [np.searchsorted(features, x) for x in lists]
        kept = [i[features[i] == x] for i, x in ((np.minimum(i, len(features) - 1), x) for i, x in zip(at, lists))]
        return np.repeat(np.arange(len(kept)), [len(k) for k in kept]), np.concatenate(kept).astype(np.int64), len(kept)

    (pr, pf, n_p), (ur, uf, n_u) = rows(positive), rows(unlabelled)
    theta, m, v = (np.zeros(len(chosen) + 1) for _ in range(3))
    theta[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        fp = np.bincount(pr, theta[pf], n_p) + theta[-1]
        fu = np.bincount(ur, theta[uf], n_u) + theta[-1]
        sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gp, gu = -prior * (1 - sp) / n_p, np.zeros(n_u)  # the positive part
        if negative > 0:  # the corrected negative part counts only above zero
            gp, gu = gp - prior * sp / n_p, su / n_u
        g = np.r_[np.bincount(pf, gp[pr], len(chosen)) + np.bincount(uf, gu[ur], len(chosen)), gp.sum() + gu.sum()]
        g[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({int(f): float(w) for f, w in zip(features, theta)}, float(theta[-1]))


def _sample(docs: DataFrame, drawn: DataFrame, id_col: str, text_col: str) -> list[np.ndarray]:
    """The distinct features of the drawn ids' texts, in the order of their hashed ids."""

    def start():
        def apply(texts):
            return [[sorted({f for p in set((t or "").split()) for f in piece_features(p)}) for t in texts]]

        return apply

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id", "left_semi").withColumn("h", F.xxhash64("text"))
    got = one_row_an_id(map_text(found, "text", [("feature", "array<int>")], start, ["id", "h"]), "id").select(F.xxhash64(F.lit(0), "id").alias("order"), "feature").toArrow()
    if not got.num_rows:
        return []
    lists = got["feature"].combine_chunks()
    parts = np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1] - lists.offsets[0].as_py())
    return [parts[i] for i in np.argsort(got["order"].to_numpy(), kind="stable")]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """labels: those to learn from. Rows of docs without a label are not used."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    present = materialize(known.join(docs.select(F.col(id_col).alias("id")), "id", "left_semi"), "labelled")
    prior = present.agg(F.avg("label")).first()[0]
    if prior:
        positive = _sample(docs, bounded_ids(present.where("label > 0").select("id"), "id", max_positive), id_col, text_col)
        rest = _sample(docs, bounded_ids(present.select("id"), "id", max_unlabelled, seed=1), id_col, text_col)
    discard(present)
    return train(positive, rest, min(max(prior, 0.001), 0.9)) if prior else Model({}, -35.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score (0 to 1) and predicted (1 at or above the threshold), under `names`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a worker keeps it, and its memory, from task to task

    def start():
        mine = shared.value

        def apply(texts):
            s = mine.scores(texts)
            return [s, (s >= threshold).astype(np.int32)]

        return apply

    return map_text(docs, text_col, [(names[0], "double"), (names[1], "int")], start, keep)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Fit on the labelled rows given and score all of docs."""
    return score(docs, fit(docs, labels, id_col, text_col), text_col, threshold, keep, names)
