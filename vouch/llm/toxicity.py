"""Toxicity by weak supervision.

Many weak voters look at a text: one for each term of a lexicon, which joins a fixed list with words and word
beginnings that occur more often in the labelled toxic documents, some for patterns such as disguised spelling,
and one that speaks for a clean text where no term occurs. A voter that does not fire abstains. A generative
label model over a sample of all documents, labelled or not, estimates by EM how often each voter fires on toxic
and on other texts from how the voters agree, and from their joint residuals how far they only repeat one
another; their weights are lowered accordingly. The given labels are none of its inputs: those of the allowed
fold choose the lexicon and set the prior. A linear classifier over a wider set of terms is then trained on the
posterior labels, drawn towards the label model's own evidence where there is little to learn from, and scores
all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTES, held_out, labelled_sample, materialize, sampled, slices, text_of

#: Labelled documents that choose the lexicon, and documents of all that label model and classifier are fitted on, at most each.
TRAINING_ROWS, SAMPLE_ROWS = 20_000, 20_000
FOLDS, FOLD = 5, 0
#: Terms of the classifier, and those of them that vote.
TERMS, VOTERS = 256, 64
#: Insults that vote without any labels: fixed values.
LEXICON = "asshole bastard bitch clown crap cunt dickhead disgusting dumbass fool garbage idiot imbecile jerk loser lunatic moron pathetic pig retard scum shit slut stupid trash vermin whore worthless".split()
#: Lengths of word beginnings that are terms, in bytes.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Digits and signs that stand for letters in disguised words: fixed values.
DISGUISE = bytes.maketrans(b"013457@$", b"oieastas")
DISGUISED = bytes(range(256)).translate(DISGUISE).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
#: Words with a character that may stand for a letter, and words with a letter three times in a row.
MIXED, TRIPLED = re.compile(rb"\S*[013457@$]\S*"), re.compile(rb"\b[A-Za-z]*([A-Za-z])\1\1[A-Za-z]*\b")
PATTERNS = ["disguised", "stretched", "shouted", "repeated"]
#: Patterns that vote; the other one counts terms, which vote themselves.
VOTING = 3
#: Voters for a clean text.
CALM = 1
#: Share of toxic documents where no labels tell it, counted as so many labelled documents beside those given.
SHARE, SHARE_ROWS = 0.1, 20
#: Rates at which a voter for toxic texts fires on toxic and on other texts, and a voter for clean ones, before any
#: document is seen; they count as so many documents of each kind.
FIRES, CALMS, SEEN = (0.1, 0.002), (0.2, 0.9), 100.0
#: Least rate at which any voter for toxic texts is taken to fire on other texts, by chance.
CHANCE = 0.005
#: Correlation of two voters' residuals from which they count as repeating one another.
REPEATS = 0.6
#: Least lift of a term, and its least lower bound of about 95 %; share of toxic texts among those that hold a term from which it votes.
LIFT, SURE, TRUSTED = 1.6, 1.5, 0.8


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + b"*" for n in BEGINNINGS if len(word) > n)]


def squeezed(word: bytes) -> bytes:
    """The word without letters that repeat the one before."""
    return bytes(c for i, c in enumerate(word) if not i or word[i - 1] != c)


class Reader:
    """Turns a text into the terms and patterns that it shows; remembers words it has seen."""

    def __init__(self, terms: list[tuple[bytes, float]]):
        self.index = {t: i for i, (t, _) in enumerate(terms)}
        self.lift = [lift for _, lift in terms]
        self.words = {t.encode() for t in LEXICON} | {t for t in self.index if not t.endswith(b"*")}
        self.squeezed = {squeezed(w) for w in self.words if len(w) > 4}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def ids(self, word: bytes) -> tuple[int, ...]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= 500_000:
                self.known.clear()
            found = self.known[word] = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        return found

    def design(self, text: str) -> np.ndarray:
        """Inputs of the classifier: for each term whether and how often it occurs, patterns, and the lift of all hits."""
        data = text.encode("utf-8")
        words = data.translate(WORD_BYTES).split()
        n, row = len(self.index), np.zeros(2 * len(self.index) + len(PATTERNS) + 3)
        known, lift, total = self.known.get, self.lift, 0.0
        kinds = set()
        for word in words:
            found = known(word)
            if found is None:
                found = self.ids(word)
            if found:
                kinds.add(word)
                total += max(lift[i] for i in found)
                for i in found:
                    row[i] += 1
        row[n : 2 * n] = np.log1p(np.maximum(row[:n] - 1, 0))
        row[:n] = row[:n] > 0
        disguised = stretched = 0
        for raw in MIXED.findall(data):
            bare = raw.strip(b".,;:!?\"'()*")
            disguised += 4 <= len(bare) <= 40 and not bare.isdigit() and bare.translate(DISGUISED) in self.words
        for raw in (m[0] for m in TRIPLED.finditer(data)):
            stretched += squeezed(raw.lower()) in self.squeezed
        row[2 * n : -3] = disguised > 0, stretched > 0, bool(kinds) and text.isupper(), len(kinds) >= 3
        row[-3:] = np.log1p(total), min(2.0, 20 * total / max(1, len(words))), np.log1p(len(kinds))
        return row


def mine_terms(texts: DataFrame, terms: int = TERMS) -> tuple[list[tuple[bytes, float]], int, int]:
    """The most telling terms of labelled texts (text, label), with the log of how much oftener toxic texts have them,
    and the numbers of toxic and other texts.

    Each task counts its own documents first; what is fetched is a fixed multiple of `terms` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        seen = [0, 0]
        for part in slices(batches):
            for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = set(text.encode("utf-8").translate(WORD_BYTES).split())
                counts[label].update({t for w in words for t in terms_of(w)})
                seen[label] += 1
        # Terms of other documents alone cannot be telling; leaving them out here changes no total of those kept.
        rows = [(t, counts[1][t], counts[0][t]) for t in counts[1].keys() | counts[0].keys()] + [(b"", seen[1], seen[0])]
        for at in range(0, len(rows), 10_000):
            part = list(zip(*rows[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.binary()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.int64())], ["term", "n1", "n0"])

    counted = texts.select("text", "label").mapInArrow(run, "term binary, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counted = materialize(counted.filter("n1 > 0 or term = X''"), "toxic-terms")
    totals = counted.filter("term = X''").collect()
    if not totals:
        return [], 0, 0
    n1, n0 = totals[0].n1, totals[0].n0
    lift = F.log(((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1)))
    sure = F.col("lift") - 2 * F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    telling = counted.filter("term <> X''").withColumn("lift", lift).filter((F.col("lift") > LIFT) & (sure > SURE)).withColumn("weight", F.col("lift") * F.col("n1"))
    found = [(bytes(r.term), r.n1, r.n0, r.lift) for r in telling.orderBy(F.desc("weight"), "term").limit(6 * terms).collect()]
    # Beginnings of one word that occur in as many documents say the same: the longest stands for them.
    longest: dict[tuple, tuple] = {}
    for f in sorted(found, key=lambda f: (f[0].endswith(b"*"), len(f[0]), f[0])):
        longest[(f[0][:4], f[1], f[2])] = f
    ordered = [f for f in found if longest[(f[0][:4], f[1], f[2])] is f]
    return [(t, lift) for t, _, _, lift in ordered[:terms]], n1, n0


@dataclass
class LabelModel:
    """Rates at which voters fire on toxic and on other texts, their weights, and the prior."""

    prior: float
    on_toxic: np.ndarray
    on_other: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    @property
    def evidence(self) -> np.ndarray:
        """Log odds that each voter adds where it fires; one that does not fire abstains."""
        return self.weight * np.log(self.on_toxic / self.on_other)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + votes @ self.evidence, -30, 30)))


def fit_label_model(votes: np.ndarray, prior: float, calm: int = 0, rounds: int = 4, steps: int = 15) -> LabelModel:
    """EM over votes (documents by voters, 0 or 1), the last `calm` of which speak for clean texts.

    No label is read. Voters are taken to be better than chance: none counts against what it speaks for. After
    each round of steps the voters' correlations given the class are estimated from the residuals, and a voter's
    weight becomes one over one plus the correlations that it has with others which speak for the same.
    """
    n, m = votes.shape
    speaks = np.r_[np.ones(m - calm), -np.ones(calm)]
    toxic0, other0 = (np.where(speaks > 0, FIRES[k], CALMS[k]) for k in (0, 1))

    def repeats(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = residual / (np.sqrt((residual**2).mean(axis=0)) + 1e-9) if n else residual
        correlation = scaled.T @ scaled / max(1, n)
        alike = np.where((correlation > REPEATS) & (np.outer(speaks, speaks) > 0), correlation, 0.0)
        np.fill_diagonal(alike, 1.0)
        return 1 / alike.sum(axis=1), correlation

    # Before there are classes, voters that fire together count as one, so that no crowd of them makes a class of its own.
    model = LabelModel(prior, toxic0, other0, *repeats(votes - (votes.mean(axis=0) if n else 0.0)))
    for _ in range(rounds):
        for _ in range(steps):
            q = model.posterior(votes)
            on_toxic = (q @ votes + SEEN * toxic0) / (q.sum() + SEEN)
            on_other = ((1 - q) @ votes + SEEN * other0) / ((1 - q).sum() + SEEN)
            on_other = np.where(speaks > 0, np.maximum(on_other, CHANCE), on_other)
            even = speaks * (on_toxic - on_other) < 0
            on_other[even] = on_toxic[even]
            model = LabelModel(prior, on_toxic, on_other, model.weight, model.correlation)
        q = model.posterior(votes)
        model.weight, model.correlation = repeats(votes - (np.outer(q, model.on_toxic) + np.outer(1 - q, model.on_other)))
    return model


def fit_linear(x: np.ndarray, q: np.ndarray, start: np.ndarray, ridge: float = 1.0, steps: int = 25, block: int = 2048) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, summed over blocks of rows; the last coefficient is the constant.

    Coefficients are drawn towards `start`, and stay there without rows.
    """
    k = x.shape[1]
    w = start.astype(float)
    pull = ridge * np.ones(k + 1)
    for _ in range(steps):
        h, g = np.diag(pull), -pull * (w - start)
        for at in range(0, len(x), block):
            x1 = np.c_[x[at : at + block].astype(float), np.ones(len(x[at : at + block]))]
            p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
            h += (x1 * (p * (1 - p) + 1e-6)[:, None]).T @ x1
            g += x1.T @ (q[at : at + block] - p)
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def votes_of(x: np.ndarray, voters: list[int], n: int) -> np.ndarray:
    """Votes of the terms `voters`, of the patterns, and of the lack of all `n` terms, from classifier inputs x."""
    return np.c_[x[:, voters], x[:, 2 * n : 2 * n + VOTING], x[:, :n].sum(axis=1) == 0].astype(np.float32)


def choose_voters(mined: list[tuple[bytes, float]], n1: int, n0: int, most: int = VOTERS) -> list[int]:
    """The first terms that mostly toxic texts hold, without those that begin another one chosen before or begin like it."""
    least = np.log(TRUSTED / (1 - TRUSTED) * (n0 + 1) / (n1 + 1))
    chosen: list[int] = []
    stems: list[bytes] = []
    for i, (term, lift) in enumerate(mined):
        stem = term.rstrip(b"*")
        if lift >= least and len(chosen) < most and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            chosen.append(i)
            stems.append(stem)
    return chosen


def train_on(sample: DataFrame, mined: list[tuple[bytes, float]], n1: int, n0: int) -> tuple[list[tuple[bytes, float]], np.ndarray]:
    """Terms and coefficients from a sample of all texts (text), few enough for their inputs to be fetched.

    `mined` are terms with their lift, n1 and n0 the numbers of toxic and other texts for the prior: all that labels tell.
    """
    known = {t.rstrip(b"*") for t, _ in mined}
    terms = [*mined, *((w.encode(), 3.0) for w in LEXICON if w.encode() not in known)]
    n = len(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms)
        for part in slices(batches):
            x = [reader.design(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), part.column(1)], ["x", "key"])

    rows = sample.select("text", F.xxhash64("text").alias("key")).mapInArrow(run, "x array<float>, key long").toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(rows), 2 * n + len(PATTERNS) + 3)
    x = x[np.argsort(rows["key"].to_numpy(), kind="stable")]  # rows come in any order; sums of floats then still agree
    voters = [*choose_voters(mined, n1, n0), *range(len(mined), n)]
    votes = votes_of(x, voters, n)
    model = fit_label_model(votes, (n1 + SHARE * SHARE_ROWS) / (n1 + n0 + SHARE_ROWS), calm=CALM)
    # Where the classifier starts, it says what the label model says of terms and patterns.
    start = np.zeros(x.shape[1] + 1)
    start[voters], start[2 * n : 2 * n + VOTING] = model.evidence[: len(voters)], model.evidence[len(voters) : -CALM]
    start[-1] = np.log(model.prior / (1 - model.prior))
    return terms, fit_linear(x, model.posterior(votes), start)


def scores_of(texts: list[str], reader: Reader, coefficients: np.ndarray) -> np.ndarray:
    x = np.stack([reader.design(t) for t in texts])
    return 1 / (1 + np.exp(-np.clip(x @ coefficients[:-1] + coefficients[-1], -30, 30)))


def toxicity_scores(docs: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS, sample: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Only text makes a score; labels of the held-out fold are never read. The lexicon is chosen on at most `bound`
    labelled documents, label model and classifier are fitted on at most `sample` of all documents, those of the
    least hashes of doc_id. Null text counts as empty; a null doc_id counts as the empty text, whose crc32 is in
    the held-out fold, and is in no sample; null labels are left out, of repeated labels the largest counts,
    repeated documents repeat their result, and an empty table gives an empty one. Without labels the fixed lexicon
    and the patterns vote alone. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    known = labelled_sample(base, labels, "toxic", FOLDS, FOLD, bound)
    some = sampled(base.select("doc_id").filter("doc_id is not null"), "doc_id", sample)
    # Ids are at most `bound` and `sample` rows, so they may be broadcast.
    ids = known.unionByName(some.select("doc_id", F.lit(None).cast("int").alias("label"))).groupBy("doc_id").agg(F.max("label").alias("label"), F.max(F.col("label").isNull()).alias("drawn"))
    chosen = materialize(base.join(F.broadcast(ids), "doc_id").select("text", "label", "drawn"), "toxic-training")
    terms, w = train_on(chosen.filter("drawn"), *mine_terms(chosen.filter("label is not null")))
    model = docs.sparkSession.sparkContext.broadcast((terms, w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, coefficients = model.value
        reader = Reader(names)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores_of(part.column(1).to_pylist(), reader, coefficients))], ["doc_id", "score"])

    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
