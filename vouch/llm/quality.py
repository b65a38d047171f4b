"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins at quantiles of the training rows. Boosting goes round the features in turn: for
each a shallow tree of a few leaves is grown on the bins' gradients, and a small step of it is added to that
feature's lookup table, so that no feature takes what another explains as well. The pairs of features whose
joint bins explain most of what is left get tables of their own in the same way. A score is the sum of one
table entry for each feature and pair, looked up for whole batches at once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import held_out, labelled_sample, materialize, slices, text_of

#: Rows that the model is fitted on at most.
TRAINING_ROWS = 20_000
FOLDS, FOLD = 3, 1
FEATURES = [
    "log_words", "log_bytes", "word_length", "upper_share", "digit_share", "symbol_share", "other_share", "space_share",
    "line_words", "distinct_words", "distinct_lines", "top_word", "repeated_next", "end_marks", "symbol_words", "upper_words", "compressed",
]
KINDS = np.zeros(256, dtype=np.int64)  # 0 other ASCII signs, 1 lower, 2 upper, 3 digit, 4 white space, 5 ordinary marks, 6 non-ASCII
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = 1, 2, 3, 6
KINDS[[9, 10, 11, 12, 13, 32]] = 4
KINDS[[ord(c) for c in ".,;:'\"-?()"]] = 5
SENTENCE_END = re.compile(rb"[.!?][\s\"')]|[.!?]\Z")
SYMBOL_WORD = re.compile(rb"[^\w\s\x80-\xff.,;:'\"?()-]+(?=\s|\Z)")
UPPER_WORD = re.compile(rb"\b[A-Z]{2,}\b")


def features(text: str) -> list[float]:
    """The numbers that a text is judged by, all of the whole text; an empty text has zeros."""
    data = text.encode("utf-8")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    kinds = np.bincount(KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=7)
    words = data.split()
    m = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    letters = max(1, int(kinds[1] + kinds[2]))
    again = sum(map(bytes.__eq__, words, words[1:]))
    squeezed = len(zlib.compress(data, 1))
    return [
        np.log1p(len(words)), np.log1p(n), (n - int(kinds[4])) / m, int(kinds[2]) / letters, int(kinds[3]) / n, int(kinds[0]) / n, int(kinds[6]) / n, int(kinds[4]) / n,
        np.log1p(len(words) / max(1, len(lines))), len(counts) / m, len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / m, again / m,
        len(SENTENCE_END.findall(data)) / m, len(SYMBOL_WORD.findall(data)) / m, len(UPPER_WORD.findall(data)) / m, squeezed / n,
    ]


@dataclass
class Additive:
    """Bin edges and lookup tables; a score is the logistic function of the sum of table entries."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    coarse: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[at[:, k]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[self.coarse[a][at[:, a]], self.coarse[b][at[:, b]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float = 1.0) -> np.ndarray:
    """Newton steps of a tree on ordered bins: the split that gains most is made until there are enough leaves."""
    cuts = [0, len(gradient)]
    g, h = np.r_[0, np.cumsum(gradient)], np.r_[0, np.cumsum(weight)]
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    while len(cuts) <= leaves:
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gains = gain(a, mid) + gain(mid, b) - gain(a, b)
                if gains.max() > best:
                    best, at = gains.max(), int(mid[gains.argmax()])
        if at is None:
            break
        cuts = sorted({*cuts, at})
    step = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, pairs: int = 6, pair_bins: int = 8, pair_rounds: int = 40) -> Additive:
    """Fits the tables. Without rows, or with rows of one class, all scores are the share of label 1 (0.5 without rows)."""
    k = x.shape[1]
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(k)]
    coarse = [np.arange(len(e) + 1) * pair_bins // (len(e) + 1) for e in edges]
    model = Additive(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [], [], coarse)
    if len(np.unique(y)) < 2:
        return model
    at, total = model.bins(x), np.full(len(x), model.base)

    def slopes(total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes(total)
            size = len(edges[j]) + 1
            step = rate * _tree(np.bincount(at[:, j], g, size), np.bincount(at[:, j], h, size), leaves=3)
            model.tables[j] += step
            total += step[at[:, j]]
    g, h = slopes(total)
    cell = {(a, b): coarse[a][at[:, a]] * pair_bins + coarse[b][at[:, b]] for a, b in combinations(range(k), 2)}
    gain = {ab: float((np.bincount(c, g, pair_bins**2) ** 2 / (np.bincount(c, h, pair_bins**2) + 1)).sum()) for ab, c in cell.items()}
    model.pairs = sorted(gain, key=lambda ab: (-gain[ab], ab))[:pairs]
    model.pair_tables = [np.zeros((pair_bins, pair_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for ab, table in zip(model.pairs, model.pair_tables):
            g, h = slopes(total)
            gs, hs = (np.bincount(cell[ab], v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (g, h))
            # A tree of two levels: the rows are cut in two, then each part's columns by a tree of its own.
            cut = _tree(gs.sum(axis=1), hs.sum(axis=1), leaves=2)
            step = np.zeros_like(gs)
            for value in np.unique(cut):
                part = cut == value
                step[part] = rate * _tree(gs[part].sum(axis=0), hs[part].sum(axis=0), leaves=2)
            table += step
            total += step.ravel()[cell[ab]]
    return model


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and x (the features) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = [features(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def train(table: DataFrame, known: DataFrame) -> Additive:
    """The model, from features (doc_id, x) and a bounded sample of labelled documents (doc_id, label)."""
    # Ids are at most the sample's rows, so they may be broadcast, and their features fetched.
    rows = table.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).orderBy("doc_id").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(dtype=float))


def quality_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only text makes a score; labels of the held-out fold are never read, and at most `bound` labelled documents are
    learnt from. Null text counts as empty; a null doc_id counts as the empty text, whose crc32 is not in the
    held-out fold, but has no label; null labels are left out, of repeated labels the largest counts, repeated documents
    repeat their result, and an empty table gives an empty one. Without usable labels all scores are 0.5. Other
    columns are ignored.
    """
    table = materialize(feature_table(docs), "quality-features")
    known = labelled_sample(table, labels, "quality", FOLDS, FOLD, bound)
    model = docs.sparkSession.sparkContext.broadcast(train(table, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """docs without the rows that the classifier rejects (score below 0.5); columns stay as they are.

    The model is trained as in quality_scores; then each text is scored where it is, so that texts are not shuffled.
    Null text counts as empty, rows of a null doc_id are judged like others, repeated rows go or stay together,
    without usable labels all stay, and an empty table gives an empty one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = materialize(labelled_sample(base, labels, "quality", FOLDS, FOLD, bound), "quality-labelled")
    model = docs.sparkSession.sparkContext.broadcast(train(feature_table(base.join(F.broadcast(known), "doc_id", "left_semi")), known))

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        x = np.array([features(t) for t in text], dtype=float).reshape(len(text), len(FEATURES))
        return pd.Series(model.value.score(x.astype(np.float32).astype(float)))

    return docs.filter(score(text_of()) >= 0.5)
