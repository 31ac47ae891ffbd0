"""Language identification by words first, shorter and shorter character n-grams after.

A known word scores its log frequency in each language. An unseen word scores the mean log
frequency of its longest character n-grams that are known. All words of the documents learned
from, and all n-grams of these words, are known.

Null texts and texts without a letter are `und` with score 0; so is every text where nothing was
learned. Of equally likely languages the alphabetically first is taken. Repeated rows each give a
row; an empty table gives none. Texts of any length are read whole, in batches of bounded bytes.
Rows to learn from that share id and language count once, the one of least text hash; rows
without an id by their texts. Columns of the table that have the names of the new ones are
replaced by them.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import claim, map_text, one_row_an_id, pieces

#: Bounds of what is fitted: labelled documents in all, and besides of each language; longest n-gram.
MAX_DOCS = 4_000
LANG_DOCS = 1_000
#: Parts of a language whose least rows are found apart.
PARTS = 256
LONGEST = 5
UNKNOWN = "und"
MEMO = 500_000
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Model:
    langs: list[str]
    words: list[str]
    grams: list[str]
    values: np.ndarray  # log frequencies by language, of the words and then of the n-grams
    memo: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None  # a row for each remembered piece

    def __post_init__(self) -> None:
        self.word_at = {w: i for i, w in enumerate(self.words)}
        self.gram_at = {g: i + len(self.words) for i, g in enumerate(self.grams)}
        self.table = np.zeros((1024, len(self.langs) + 1), np.float32)

    def __reduce__(self):  # the tables are built again where the model arrives
        return Model, (self.langs, self.words, self.grams, self.values)

    def forget(self) -> None:
        self.memo.clear()

    def word(self, word: str) -> tuple[list[int], float]:
        """(rows of `values` that score a lower-cased word, the share of each)."""
        i = self.word_at.get(word)
        if i is not None:
            return [i], 1.0
        padded, gram_at = f" {word} ", self.gram_at
        for n in range(min(LONGEST, len(padded)), 0, -1):
            got = [i for k in range(len(padded) - n + 1) if (i := gram_at.get(padded[k : k + n])) is not None]
            if got:
                return got, 1.0 / len(got)
        return [], 0.0

    def _learn(self, new: list[str]) -> None:
        """Append a row for each new piece: its words' log frequencies and their number."""
        rows, at, share, counts = [], [], [], []
        for r, piece in enumerate(new):
            words = LETTERS.findall(piece.lower())
            counts.append(len(words))
            for w in words:
                got, each = self.word(w)
                rows += [r] * len(got)
                at += got
                share += [each] * len(got)
        first = len(self.memo)
        while first + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rows, share = np.array(rows, np.int64), np.array(share)
        values = self.values[np.array(at, np.int64)]
        for j in range(len(self.langs)):
            self.table[first : first + len(new), j] = np.bincount(rows, values[:, j] * share, len(new))
        self.table[first : first + len(new), -1] = counts
        self.memo.update(zip(new, range(first, first + len(new))))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        claim("langid", self.forget)
        if len(self.memo) > MEMO:
            self.forget()
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        split = [(t or "").split() for t in texts]
        self._learn(list(set().union(*split) - self.memo.keys()))
        memo, table = self.memo, self.table
        langs, scores = [], []
        for p in split:
            total = table[np.fromiter(map(memo.__getitem__, p), np.int64, len(p))].sum(axis=0, dtype=np.float64)
            if total[-1] == 0:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(np.argmax(total[:-1]))
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp(np.clip(total[:-1] - total[best], -700, 0)).sum()))
        return langs, scores


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS, lang_docs: int = LANG_DOCS) -> Model:
    """Learn from the `max_docs` rows with a language and a letter of least hashed id, and from the
    `lang_docs` of each language, so that every language with a word is learned.

    Words are counted in Spark; their n-grams are counted on the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(1), lang_col, text_col)).otherwise(F.xxhash64(F.lit(0), lang_col, id_col))
    known = known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), key.alias("key"))
    # the least keys of a part of each language first: no task gets the rows of a frequent language
    keys = known.select("lang", "key", F.pmod("key", F.lit(PARTS)).alias("part")).repartition("lang", "part").distinct()
    least = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("rank") <= lang_docs)
    own = least(least(keys, "lang", "part"), "lang")
    drawn = keys.orderBy("key").limit(max_docs).select("key").unionByName(own.select("key")).distinct()
    found = known.join(F.broadcast(drawn), "key", "left_semi")
    sample = one_row_an_id(found.select("key", F.xxhash64("text").alias("h"), "lang", "text"), "key").select("lang", "text")

    def count(batches):
        total: Counter = Counter()
        for part in pieces(batches, "text"):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                total.update((lang, w) for w in LETTERS.findall(text.lower()))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    return learn(*(counted[c].to_pylist() for c in ("lang", "word", "n")))


def learn(lang: Sequence[str], word: Sequence[str], n: Sequence[int]) -> Model:
    """A model from the number of times that words occur in languages."""
    langs, words = sorted(set(lang)), sorted(set(word))
    lang_at, word_at = ({x: i for i, x in enumerate(xs)} for xs in (langs, words))
    counts = np.zeros((len(words), len(langs)))
    np.add.at(counts, ([word_at[w] for w in word], [lang_at[x] for x in lang]), n)
    weights = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0)
    gram_at: dict[str, int] = {}
    gram, of = array("i"), array("i")
    for k, w in enumerate(words):
        padded = f" {w} "
        made = [gram_at.setdefault(padded[i : i + m], len(gram_at)) for m in range(1, LONGEST + 1) for i in range(m == 1, len(padded) - m + 1 - (m == 1))]
        gram.extend(made)
        of.extend([k] * len(made))
    gram, of = np.frombuffer(gram, np.int32) if gram else np.zeros(0, np.int32), np.frombuffer(of, np.int32) if of else np.zeros(0, np.int32)
    heavy = np.stack([np.bincount(gram, weights[of, j], len(gram_at)) for j in range(len(langs))], axis=1) if langs else np.zeros((0, 0))
    return Model(langs, words, list(gram_at), np.concatenate([_logs(counts), _logs(heavy)]).astype(np.float32))


def _logs(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(counts))) if len(counts) else counts


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score (the posterior of the language under even priors)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a worker keeps it, and its memory, from task to task

    def start():
        return shared.value.predict

    return map_text(docs, text_col, [("lang_pred", "string"), ("score", "double")], start, keep)
