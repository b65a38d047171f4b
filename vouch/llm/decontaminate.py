"""Benchmark decontamination by latent semantic retrieval.

Documents are read as overlapping passages, for items of each length class in passages of their size. Passages
and benchmark items become TF-IDF vectors over the items' words, with document frequencies counted over all
documents. A one-pass randomised SVD (a Nystroem sketch A'(A Omega), summed over tasks) gives a latent space, in which each item's candidates are the passages that lie
in its direction and carry enough of its weight. Candidates are then checked word by word: the longest common
subsequence with the item must cover most of it, or somewhat less where the item's answer, its last words,
stands in the passage as it is. A subsequence is no longer than the words in common are many, so candidates with too
few of these, counted for all of a block of passages at once, are out before. Items of fewer words than an answer are looked up as exact runs of words.

A benchmark is handled in blocks of items, so what is sent to the tasks is bounded whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import WORD_BYTES, slices, text_of

#: Items, and words of items, that one pass over the documents looks for, about; more are searched for in further passes.
BLOCK, BLOCK_WORDS = 20_000, 1_000_000
#: Words of passages that are projected together, about.
PROJECTED = 49_152
#: Words of a text whose passages are searched together; at least four passages are.
SEARCHED = 2_048
#: Dimensions of the latent space.
DIMENSIONS = 64
#: Rows of the sketch in an Arrow batch.
SENT = 4_096
#: Least cosine, and least share of an item's weight, of a candidate.
COSINE, WEIGHT = 0.3, 0.3
#: Share of an item's words in the common subsequence that is a leak, and that is one if the answer stands there too.
COPIED, PARAPHRASED = 0.8, 0.6
#: Last words of an item that are its answer.
ANSWER = 5
FOUND = "doc_id long, item_id long, start_word int, n_words int, common_words int, item_words int, answer boolean, kind string"


def words_of(text: str) -> list[bytes]:
    """Lower-case words of letters and digits."""
    return text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()


def ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after the other."""
    sizes = hi - lo
    return np.arange(int(sizes.sum())) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits of one integer for each row of the usual table."""
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


@dataclass
class Sized:
    """Items of one length class (from a power of two of words to below the next), and the words of the passages that may hold them."""

    items: np.ndarray
    passage: int
    stride: int
    credit: np.ndarray
    points: np.ndarray | None = None
    length: np.ndarray | None = None

    def passages(self, n: int, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages with enough weight for some item: first word, and the range of known words in each."""
        starts = np.arange(0, max(1, n - self.passage + self.stride), self.stride)
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, starts + self.passage)
        sums = np.r_[0.0, np.cumsum(self.credit[ids])]
        heavy = sums[hi] - sums[lo] >= WEIGHT
        return starts[heavy], lo[heavy], hi[heavy]


@dataclass
class Items:
    """A block of benchmark items with their vocabulary; after fit() also weights and latent vectors."""

    ids: list[int]
    words: list[list[bytes]]

    def __post_init__(self):
        self.terms = {w: i for i, w in enumerate(sorted({w for ws in self.words for w in ws}))}

    def known(self, text: str) -> tuple[int, np.ndarray, np.ndarray, list[bytes]]:
        """Number of words, positions and ids of those that items have, and all words."""
        words = words_of(text)
        ids = np.fromiter(map(self.terms.get, words, [-1] * len(words)), np.int64, len(words)) if words else np.zeros(0, np.int64)
        at = np.flatnonzero(ids >= 0)
        return len(words), at, ids[at], words

    def weigh(self, frequency: np.ndarray, documents: int) -> None:
        self.idf = np.log((1 + documents) / (1 + frequency))
        lists = [np.array([self.terms[w] for w in ws], dtype=np.int64) for ws in self.words]
        # An item of words that every document has would have no weight to be found by.
        for ids in lists:
            if len(ids) and not self.idf[ids].any():
                self.idf[ids] = 0.1
        self.lists = lists
        self._count_words(lists)
        self.mass = np.array([(self.idf[ids] ** 2).sum() for ids in lists])
        self.sizes = sizes = np.array([len(ids) for ids in lists], dtype=np.int64)
        # Short items by their first word.
        self.short: dict[int, list[int]] = {}
        for i in np.flatnonzero((sizes > 0) & (sizes < ANSWER)).tolist():
            self.short.setdefault(int(lists[i][0]), []).append(i)
        self.opens = np.zeros(len(self.terms), dtype=bool)
        self.opens[list(self.short)] = True
        # An item is at most as long as its class's passage and at least half as long; some passage holds three quarters of it, or all.
        power = np.array([int(x).bit_length() - 1 for x in sizes], dtype=np.int64)
        self.classes = []
        for k in np.unique(power[sizes >= ANSWER]).tolist():
            these = np.flatnonzero((power == k) & (sizes >= ANSWER))
            # The greatest share of any item's weight that a word can give: a passage below WEIGHT in sum holds no item.
            credit = np.zeros(len(self.terms))
            for i in these:
                if self.mass[i] > 0:
                    np.maximum.at(credit, lists[i], self.idf[lists[i]] ** 2 / self.mass[i])
            self.classes.append(Sized(these, 2 << k, 1 << k, credit))

    def _count_words(self, lists: list[np.ndarray]) -> None:
        """Different words of each item with their numbers, by item and by word."""
        every = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(lists)), [len(ids) for ids in lists])
        cells, self.own_count = np.unique(owner * max(1, len(self.terms)) + every, return_counts=True)
        owner, self.own_term = np.divmod(cells, max(1, len(self.terms)))
        self.own_at = np.searchsorted(owner, np.arange(len(lists) + 1))
        order = np.argsort(self.own_term, kind="stable")
        self.has_item, self.has_count = owner[order], self.own_count[order]
        self.has_at = np.searchsorted(self.own_term[order], np.arange(len(self.terms) + 1))
        self.needed = PARAPHRASED * np.array([len(ids) for ids in lists])

    def in_common(self, ids: np.ndarray) -> np.ndarray:
        """For each item the number of its words that ids have, repeats as often as both have them."""
        terms, counts = np.unique(ids, return_counts=True)
        lo, hi = self.has_at[terms], self.has_at[terms + 1]
        at = ranges(lo, hi)
        return np.bincount(self.has_item[at], np.minimum(self.has_count[at], np.repeat(counts, hi - lo)), len(self.ids))

    def enough(self, places: np.ndarray, n: int, items: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a to b, whose places are known as sorted term * n + position, have enough of each item's words in common."""
        lo, hi = self.own_at[items], self.own_at[items + 1]
        at, sizes = ranges(lo, hi), hi - lo
        base = self.own_term[at] * n
        there = np.searchsorted(places, base + np.repeat(b, sizes)) - np.searchsorted(places, base + np.repeat(a, sizes))
        return np.add.reduceat(np.minimum(there, self.own_count[at]), np.cumsum(sizes) - sizes) >= self.needed[items]

    def project(self, weighted: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Sums of the rows of weighted (terms by dimensions, times idf) over each range of ids; only these rows are read."""
        sizes = hi - lo
        out = np.zeros((len(lo), weighted.shape[1]))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            out[full] = np.add.reduceat(weighted[ids[ranges(lo, hi)]], starts, axis=0)
        return out

    def sketch(self, weighted: np.ndarray, out: np.ndarray, ids: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
        """Adds a'(a omega) of each passage a, scaled to unit length, to out; weighted is omega times idf."""
        sizes = hi - lo
        rows = np.repeat(np.arange(len(lo)), sizes)
        cells, counts = np.unique(rows * len(self.terms) + ids[ranges(lo, hi)], return_counts=True)
        rows, terms = cells // len(self.terms), cells % len(self.terms)
        value = counts * self.idf[terms]
        norm = np.bincount(rows, value**2, len(lo))
        value = np.where(norm[rows] > 0, value / np.maximum(norm[rows], 1e-300), 0.0)
        order = np.argsort(terms, kind="stable")
        if len(order):
            first = np.flatnonzero(np.r_[True, np.diff(terms[order]) > 0])
            z = self.project(weighted, ids, lo, hi)
            out[terms[order][first]] += np.add.reduceat(z[rows[order]] * value[order, None], first, axis=0)

    def latent(self, basis: np.ndarray) -> None:
        self.weighted = basis * self.idf[:, None]
        for sized in self.classes:
            sized.points = np.stack([self.weighted[self.lists[i]].sum(axis=0) for i in sized.items])
            sized.length = np.sqrt((sized.points**2).sum(axis=1)) + 1e-12

    def leaks(self, text: str) -> list[tuple]:
        """(item, first word, words, common words, item words, answer, kind) of each item in the text, best passage."""
        n, at, ids, words = self.known(text)
        if not len(ids):
            return []
        best: dict[int, tuple] = {}
        for p in np.flatnonzero(self.opens[ids]).tolist():
            start = int(at[p])
            for item in self.short[int(ids[p])]:
                size = len(self.words[item])
                if item not in best and words[start : start + size] == self.words[item]:
                    best[item] = (self.ids[item], start, size, size, size, True, "copy")
        places, common, counted = np.sort(ids * (n + 1) + at), np.zeros(0), None
        for sized in self.classes:
            starts, lo, hi = sized.passages(n, at, ids)
            step = max(4, SEARCHED // sized.stride)
            for block in range(0, len(starts), step):
                part = slice(block, block + step)
                first, last = starts[part][[0, -1]]
                span = tuple(np.searchsorted(at, [first - sized.passage, last + 2 * sized.passage]).tolist())
                if span != counted:
                    common, counted = self.in_common(ids[slice(*span)]), span
                z = self.project(self.weighted, ids, lo[part], hi[part])
                dots = z @ sized.points.T
                near = (dots >= COSINE * sized.length * (np.sqrt((z**2).sum(axis=1)) + 1e-12)[:, None]) & (dots >= WEIGHT * sized.length**2)
                rows, columns = np.nonzero(near & (common >= self.needed)[sized.items])
                if not len(rows):
                    continue
                items, begins = sized.items[columns], starts[part][rows]
                sizes = self.sizes[items]
                some = self.enough(places, n + 1, items, np.maximum(begins - sizes, 0), np.minimum(begins + sized.passage + sizes, n))
                for item, start in zip(items[some].tolist(), begins[some].tolist()):
                    found = self.check(item, words, start, sized.passage)
                    if found and (item not in best or found[3] > best[item][3]):
                        best[item] = found
        return [best[i] for i in sorted(best)]

    def check(self, item: int, words: list[bytes], start: int, passage: int) -> tuple | None:
        asked = self.words[item]
        size = len(asked)
        a, b = max(0, start - size), min(len(words), start + passage + size)
        region = words[a:b]
        common = common_subsequence(asked, region)
        if common < PARAPHRASED * size:
            return None
        answer = asked[-ANSWER:]
        stands = any(region[i : i + len(answer)] == answer for i in range(len(region) - len(answer) + 1))
        if common < COPIED * size and not stands:
            return None
        return self.ids[item], a, b - a, common, size, stands, "copy" if common >= COPIED * size else "paraphrase"


def _counted(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Document frequency of each term over all documents, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.terms) + 1, dtype=np.int64)
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                counts[np.unique(shared.value.known(text)[2])] += 1
                counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.terms) + 1)
    counts[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=float)
    return counts[:-1], int(counts[-1])


def _fitted(docs: DataFrame, items: Items, seed: int = 11) -> np.ndarray:
    """Terms by dimensions: right singular vectors of the passages' matrix, from one pass over all documents."""
    terms, width = len(items.terms), min(DIMENSIONS, max(1, len(items.terms)))
    drawn = lambda: np.random.default_rng(seed).standard_normal((terms, width))
    omega = drawn()
    shared = docs.sparkSession.sparkContext.broadcast(items)
    some = docs.select(text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The same random directions are drawn in each task and not sent.
        them, weighted = shared.value, drawn()
        weighted *= them.idf[:, None]
        out = np.zeros_like(weighted)
        for part in slices(batches):
            held, words = [[] for _ in them.classes], 0
            known = [them.known(text)[:3] for text in part.column(0).to_pylist()]
            for n, at, ids in known:
                for k, sized in enumerate(them.classes):
                    _, lo, hi = sized.passages(n, at, ids)
                    held[k].append((lo + words, hi + words))
                words += len(ids)
            ids = np.concatenate([x[2] for x in known])
            for sized, spans in zip(them.classes, held):
                lo, hi = (np.concatenate(x) for x in zip(*spans))
                step = max(1, PROJECTED // sized.passage)
                for block in range(0, len(lo), step):
                    them.sketch(weighted, out, ids, lo[block : block + step], hi[block : block + step])
        at = np.flatnonzero(out.any(axis=1))
        for terms_of in np.split(at, range(SENT, len(at), SENT)):
            yield pa.RecordBatch.from_arrays([pa.array(terms_of), *(pa.array(out[terms_of, k]) for k in range(out.shape[1]))], ["term", *names])

    # A column for each dimension: a term of a task is one row, and sums need no arrays.
    names = [f"v{k}" for k in range(width)]
    parts = some.mapInArrow(run, ", ".join(["term long", *(f"{x} double" for x in names)]))
    summed = parts.groupBy("term").agg(*(F.sum(x).alias(x) for x in names)).toArrow()
    y = np.zeros((terms, width))
    for k, x in enumerate(names):
        y[summed["term"].to_numpy(), k] = summed[x].to_numpy()
    # The items count as passages too, with as much weight together as the corpus has, so that the space tells them apart.
    own = np.zeros_like(y)
    weighted, stops = omega * items.idf[:, None], np.cumsum([len(ids) for ids in items.lists])
    starts, every = np.r_[0, stops[:-1]], np.concatenate(items.lists)
    for block in range(0, len(stops), 256):
        items.sketch(weighted, own, every, starts[block : block + 256], stops[block : block + 256])
    scale = np.linalg.norm(own)
    y = y + own * (max(1.0, np.linalg.norm(y)) / scale if scale else 0.0)
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > 1e-9 * max(1e-30, values.max(initial=0.0))
    left, _, _ = np.linalg.svd(y @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False) if keep.any() else (np.zeros((terms, 1)), None, None)
    return left


def _blocks(benchmark: DataFrame, block: int) -> Iterator[Items]:
    """The items, in blocks of about `block` with as many words as BLOCK_WORDS; items without words cannot leak and are left out."""
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).filter("item_id is not null")
    size = usable.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+"))), F.lit(0)).alias("words")).first()
    count = max(-(-size.items // block), -(-size.words // BLOCK_WORDS)) if size.items else 0
    for k in range(count):
        rows = usable.filter(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).collect() if count > 1 else usable.collect()
        listed = sorted((r.item_id, words_of(r.text)) for r in rows)
        listed = [(i, w) for i, w in listed if w]
        if listed:
            yield Items([i for i, _ in listed], [w for _, w in listed])


def prepare(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> Iterator[Items]:
    """Blocks of items, weighed by all documents, with the latent space fitted."""
    for items in _blocks(benchmark, block):
        frequency, documents = _counted(docs, items)
        items.weigh(frequency, documents)
        items.latent(_fitted(docs, items))
        yield items


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, where, and how much of it.

    start_word and n_words give the region that was compared, common_words the longest common subsequence with
    the item's item_words, answer whether its last words stand there, kind `copy` or `paraphrase`. Null and
    empty texts hold nothing; items of fewer words than an answer must stand there as they are, and are the region; null item_ids
    and items without words are left out; repeated rows repeat theirs; empty tables give an empty result.
    Columns other than doc_id, item_id and text are ignored. Short items that meet a text only in words that most documents
    have share less than WEIGHT of the item's weight and are no candidates.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = spark.createDataFrame([], FOUND)
    for items in prepare(docs, benchmark, block):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = [(d, *x) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in shared.value.leaks(t)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
                    names = [x.split()[0] for x in FOUND.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        found = found.unionByName(base.mapInArrow(run, FOUND))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without the rows that hold an item; columns stay as they are, and texts are judged where they are.

    Null and empty texts hold nothing and stay, repeated rows go or stay together, rows of a null doc_id are judged
    like others, a text of any length is read whole, and an empty benchmark or an empty table leaves docs as it is.
    """
    kept = docs
    for items in prepare(docs, benchmark, block):
        kept = kept.filter(~_holds(docs.sparkSession.sparkContext.broadcast(items))(text_of()))
    return kept


def _holds(items: Broadcast):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        return pd.Series([bool(items.value.leaks(t)) for t in text], dtype=bool)

    return holds
