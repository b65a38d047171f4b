"""Substring deduplication by MinHash banding of paragraphs.

Repeated passages begin and end anywhere, so a paragraph here is a stretch of words between two cuts that the
words themselves choose: a cut lies where the hash of two neighbouring words is the least within a few words on
either side. Copies of a passage are then cut alike, but for their first and last few words. Paragraphs get
MinHash bands over shingles of five words; paragraphs that share a band meet, pairs are verified by exact
Jaccard similarity of their shingle sets, and classes of like paragraphs are connected components. Adjacent
paragraphs that other documents have too are joined into passages, whose ends are then moved word by word to where
the first or the last document with a like paragraph ceases to go along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ASCII_LOWER, materialize, slices, small, text_of, with_range
from .components import components

#: Words on either side among which a cut is least; at most so many words in a paragraph; words of a shingle.
REACH, LONGEST, SHINGLE = 5, 64, 5
#: Bands and MinHash values of each: a pair of similarity 0.8 meets with probability 0.95, one of 0.9 with 0.99.
BANDS, EACH = 3, 2
#: Similarity of like paragraphs.
SIMILAR = 0.8
#: Words from which a passage counts, its ends included.
LEAST = 40
#: Most words between two runs of an edited passage that are counted together.
GAP = 16
#: Paragraphs of one band that are paired directly; more are compared as groups.
FEW = 8
#: Paragraphs of one band that are compared all with all, and kinds of them in a block of a larger one.
GROUP, KINDS = 128, 2048
#: Different contents of which each task keeps a count, so that a line of a third of all documents is one row of each task.
HELD = 8192
TOP = np.uint64(2**64 - 1)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[0]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _permuted(shingles: np.ndarray, k: int) -> np.ndarray:
    """Values of the k-th MinHash function."""
    return _mix(shingles ^ np.uint64(k * 0x51ED270B + 1))


class Words:
    """Word hashes x of some texts in one row, with room between the texts: where each begins, and its number of words."""

    def __init__(self, texts: list[str]):
        lists = [t.encode("utf-8", "replace").translate(ASCII_LOWER).split() for t in texts]
        self.sizes = np.array([len(w) for w in lists], dtype=np.int64)
        pad = REACH + SHINGLE
        self.first = np.cumsum(np.r_[pad, self.sizes[:-1] + pad]) if len(lists) else np.zeros(0, np.int64)
        self.x = np.zeros(int(self.sizes.sum()) + pad * (len(lists) + 1), dtype=np.uint64)
        self.inside = np.zeros(len(self.x), dtype=bool)
        for a, words in zip(self.first, lists):
            self.x[a : a + len(words)] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            self.inside[a : a + len(words)] = True
        self.sums = np.r_[np.uint64(0), np.cumsum(self.x * _powers(len(self.x), BASE), dtype=np.uint64)]
        self.shifts = _powers(len(self.x) + 1, INVERSE)

    def hashes(self, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words of each stretch, wherever it lies."""
        return _mix((self.sums[stop] - self.sums[at]) * self.shifts[at] + (stop - at).astype(np.uint64) * ODD[4])


class Paragraphs:
    """The paragraphs of some texts: text number, first word, words, content hash, and shingle hashes to ask for."""

    def __init__(self, texts: list[str]):
        words = Words(texts)
        x, inside, first, sizes = words.x, words.inside, words.first, words.sizes
        pair = _mix(x * ODD[2] + np.r_[x[1:], np.uint64(0)] * ODD[3])
        pair[~(inside & np.r_[inside[1:], False])] = TOP
        cut = inside & (pair < TOP)
        for d in range(1, REACH + 1):
            cut[d:] &= pair[d:] < pair[:-d]
            cut[:-d] &= pair[:-d] <= pair[d:]
        cut[first[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        text = np.searchsorted(first, starts, side="right") - 1
        stops = np.minimum(np.r_[starts[1:], len(x)], first[text] + sizes[text]) if len(starts) else starts
        # Stretches without a cut are cut by length.
        pieces = np.maximum(1, -(-(stops - starts) // LONGEST))
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, text, whole = np.repeat(starts, pieces) + nth * LONGEST, np.repeat(text, pieces), np.repeat(stops, pieces)
        stops = np.minimum(starts + LONGEST, whole)
        enough = stops - starts >= SHINGLE
        self.at, self.stop, self.text = starts[enough], stops[enough], text[enough]
        self.start, self.n = self.at - first[self.text], self.stop - self.at
        # Words from here to the far end of the paragraph before, and of the one after.
        inside_text = np.r_[False, self.text[1:] == self.text[:-1]] if len(self.text) else np.zeros(0, bool)
        self.before = self.start - np.where(inside_text, np.r_[0, self.start[:-1]], 0) if len(self.text) else self.start
        goes_on = np.r_[inside_text[1:], False] if len(self.text) else inside_text
        self.after = np.where(goes_on, np.r_[(self.start + self.n)[1:], 0], sizes[self.text]) - self.start - self.n if len(self.text) else self.start
        self.hash = words.hashes(self.at, self.stop)
        shingle = np.zeros(len(x), dtype=np.uint64)
        for k in range(SHINGLE):
            shingle[: len(x) - k] += x[k:] * np.uint64(pow(BASE, 2 * k + 1, 2**64))
        self.shingle = _mix(shingle)

    def bands(self) -> Iterator[np.ndarray]:
        """For each band its key of every paragraph."""
        bounds = np.stack([self.at, self.stop - SHINGLE + 1], axis=1).ravel()
        least = lambda k: np.minimum.reduceat(_permuted(self.shingle, k), bounds)[::2] if len(bounds) else np.zeros(0, np.uint64)
        for b in range(BANDS):
            key = np.full(len(self.at), np.uint64(b + 1), dtype=np.uint64)
            for k in range(b * EACH, (b + 1) * EACH):
                key = _mix(key * ODD[5] + least(k))
            yield key

    def lists(self) -> pa.Array:
        """The shingles of each paragraph in order, repeats included."""
        n = self.stop - self.at - SHINGLE + 1
        stops = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(self.at - (stops - n), n)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), _longs(self.shingle[at]))

    def sets(self) -> list[np.ndarray]:
        return [np.unique(self.shingle[a : b - SHINGLE + 1]).view(np.int64) for a, b in zip(self.at, self.stop)]


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, h, low, high): each band of each paragraph, the first with the least and greatest doc_id.

    Copies within a slice are joined; contents that are frequent in a slice are held back, up to HELD of them, and
    given once at the end of the task.
    """
    held = [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(BANDS))]

    def rows(h: np.ndarray, low: np.ndarray, high: np.ndarray, keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, key in enumerate(keys):
            # The documents are told with the first band alone; zeros take next to no room in the shuffle.
            told = (low, high) if b == 0 else (np.zeros_like(low), np.zeros_like(high))
            yield pa.RecordBatch.from_arrays([_longs(key), _longs(h), *map(pa.array, told)], ["key", "h", "low", "high"])

    for part in slices(batches, 1024):
        ids = part.column(0).to_numpy(zero_copy_only=False)
        them = Paragraphs(part.column(1).to_pylist())
        h, one, inverse, count = np.unique(them.hash, return_index=True, return_inverse=True, return_counts=True)
        low, high = np.full(len(h), 2**63 - 1, dtype=np.int64), np.full(len(h), -(2**63), dtype=np.int64)
        np.minimum.at(low, inverse, ids[them.text])
        np.maximum.at(high, inverse, ids[them.text])
        keys = [key[one] for key in them.bands()]
        at = np.minimum(np.searchsorted(held[0], h), max(0, len(held[0]) - 1))
        known = held[0][at] == h if len(held[0]) else np.zeros(len(h), dtype=bool)
        np.minimum.at(held[1], at[known], low[known])
        np.maximum.at(held[2], at[known], high[known])
        often = np.flatnonzero(~known & (count >= 4))[: HELD - len(held[0])]
        if len(often):
            held = [np.r_[a, b[often]] for a, b in zip(held, (h, low, high, *keys))]
            order = np.argsort(held[0])
            held = [a[order] for a in held]
            known[often] = True
        yield from rows(h[~known], low[~known], high[~known], [key[~known] for key in keys])
    yield from rows(held[0], held[1], held[2], held[3:])


MET = "u long, v long, cell long"


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, h, low, high) sorted by key and h: paragraphs of several documents (u = v), pairs that meet,
    and the members of bands where many meet (cell).

    Of a band that goes over several batches no more is held than FEW paragraphs and a batch: once it has more, its
    members are told as they come.
    """
    held: list[np.ndarray] | None = None
    many: int | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.r_[a, b] for a, b in zip(held, columns)]
        if not len(columns[0]):
            continue
        columns = _joined(columns)
        key = columns[0]
        last = int(np.searchsorted(key, key[-1]))
        if len(key) - last > FEW:
            # The last band is one of many; its last paragraph may go on in the next batch.
            told, held = [c[:-1] for c in columns], [c[-1:] for c in columns]
        else:
            told, held = [c[:last] for c in columns], [c[last:] for c in columns]
        if len(told[0]):
            yield from _met(told, many, int(key[-1]) if len(key) - last > FEW else None)
        many = int(key[-1]) if len(key) - last > FEW or (many is not None and key[-1] == many) else None
    if held is not None and len(held[0]):
        yield from _met(held, many, None)


def _joined(columns: list[np.ndarray]) -> list[np.ndarray]:
    key, h, low, high = columns
    new = np.r_[True, (key[1:] != key[:-1]) | (h[1:] != h[:-1])]
    at = np.flatnonzero(new)
    return [key[at], h[at], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)]


def _met(columns: list[np.ndarray], first: int | None, last: int | None) -> Iterator[pa.RecordBatch]:
    """What meets in these bands; `first` and `last` are bands that are known to be of many."""
    key, h, low, high = columns

    def rows(a: np.ndarray, b: np.ndarray, cell: pa.Array | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(h[b]), cell if cell is not None else pa.nulls(len(a), pa.int64())], ["u", "v", "cell"])

    same = np.flatnonzero(low != high)
    yield rows(same, same)
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.repeat(np.diff(edge), np.diff(edge))
    for band in (first, last):
        if band is not None:
            size[key == band] = FEW + 1
    for d in range(1, FEW):
        pairs = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= FEW)) if len(key) > d else np.zeros(0, np.int64)
        if not len(pairs):
            break
        yield rows(pairs, pairs + d)
    many = np.flatnonzero(size > FEW)
    if len(many):
        yield rows(many, many, pa.array(key[many]))


def _paragraph_rows(docs: DataFrame, with_sets: bool) -> DataFrame:
    """doc_id, start, n, before, after, h of every paragraph, or h and its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            them = Paragraphs(part.column(1).to_pylist())
            if with_sets:
                yield pa.RecordBatch.from_arrays([_longs(them.hash), them.lists()], ["h", "shingles"])
            else:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(them.text)), pa.array(them.start.astype(np.int32)), pa.array(them.n.astype(np.int32)), pa.array(them.before.astype(np.int32)), pa.array(them.after.astype(np.int32)), _longs(them.hash)], ["doc_id", "start", "n", "before", "after", "h"])

    return docs.mapInArrow(run, "h long, shingles array<long>" if with_sets else "doc_id long, start int, n int, before int, after int, h long")


def _alike(h: list[int], sets: list[set], similar: float) -> Iterator[tuple]:
    """Links of one group by exact similarity; what is linked is not compared again."""
    left = list(range(len(h)))
    while left:
        frontier = [left.pop()]
        while frontier and left:
            x = frontier.pop()
            rest = []
            for y in left:
                if len(sets[x] & sets[y]) >= similar * len(sets[x] | sets[y]):
                    frontier.append(y)
                    yield h[x], h[y]
                else:
                    rest.append(y)
            left = rest


def _grouped(batches: Iterator[pa.RecordBatch], similar: float) -> Iterator[pa.RecordBatch]:
    """For each run of equal cells in rows (cell, h, shingles) sorted by cell its links, all compared with all."""
    rest: pa.RecordBatch | None = None

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells, h = (batch.column(k).to_numpy() for k in (0, 1))
        flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy())
        edges = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1], True])
        rows = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:  # one row alone is like no other
                sets = [set(flat[ends[i - 1] if i else 0 : ends[i]].tolist()) for i in range(a, b)]
                rows += _alike(h[a:b].tolist(), sets, similar)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        whole = batch if rest is None else pa.concat_batches([rest, batch])
        cells = whole.column(0).to_numpy()
        last = int(np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])[-1])
        rest = whole.slice(last)
        if last:
            yield told(whole.slice(0, last))
    if rest is not None:
        yield told(rest)


def _compared_cores(left: pa.Table, right: pa.Table, similar: float) -> pa.Table:
    """Links between the kinds (cell, h, size, core) of two blocks, or within one: like by what they have in common of the core alone.

    A kind that is like itself is told as a link to itself.
    """
    cores = [t.column("core").combine_chunks() for t in (left, right)]
    rows = [np.repeat(np.arange(len(c)), c.value_lengths().to_numpy()) for c in cores]
    flat = [c.flatten().to_numpy() for c in cores]
    shared = np.intersect1d(*flat)
    both = np.zeros((len(cores[0]), len(cores[1])), dtype=np.float32)
    for a in range(0, len(shared), KINDS):
        names, grids = shared[a : a + KINDS], []
        for r, f, c in zip(rows, flat, cores):
            at = np.minimum(np.searchsorted(names, f), len(names) - 1)
            known = names[at] == f
            grid = np.zeros((len(c), len(names)), dtype=np.float32)
            grid[r[known], at[known]] = 1
            grids.append(grid)
        both += grids[0] @ grids[1].T
    sizes = [t.column("size").to_numpy() for t in (left, right)]
    # Counts are whole numbers, exact in float32.
    u, v = np.nonzero(both >= similar * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-4)
    h = [t.column("h").to_numpy() for t in (left, right)]
    cell = left.column("cell").to_numpy()
    return pa.table({"cell": cell[u], "u": h[0][u], "v": h[1][v]})


def _links_of_cells(full: DataFrame, sets: DataFrame, similar: float) -> DataFrame | None:
    """Links among paragraphs (u) of full bands (cell), that connect what pairs of similar ones of a cell connect; None without one.

    Cells of up to GROUP rows are compared all with all. In a larger cell a shingle is rare if up to GROUP of its
    paragraphs have it, else of the core. Pairs with a rare shingle in common are compared in that shingle's own
    cell. What other pairs have in common is of the core alone, so it is told by the kinds of paragraphs: those with
    the same part of the core and of one size. Kinds are compared block by block, and where two are like, so are all
    their members. Nothing is left out, and many copies with small changes are few kinds.
    """
    if full.isEmpty():
        return None
    cells = materialize(full.join(sets, full.u == sets.h).select("cell", "h", "shingles"), "passages-cells")
    large = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("cell"), "passages-large")
    compare = lambda rows: rows.repartition("cell").sortWithinPartitions("cell", "h").mapInArrow(lambda b: _grouped(b, similar), "u long, v long")
    if large.isEmpty():
        return compare(cells)
    found = compare(cells.join(small(large), "cell", "left_anti").select("cell", "h", "shingles"))
    # The cell's name is hashed with the shingle, so that a frequent one is no single task's.
    told = cells.join(small(large), "cell", "left_semi").select("cell", "h", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = told.groupBy("cell", "shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    often = materialize(often, "passages-often")
    rare, core = often.filter(F.col("n") <= GROUP).drop("n"), often.filter(F.col("n") > GROUP).drop("n")
    few = told.join(rare, ["cell", "shingle"]).select(F.xxhash64("cell", "shingle").alias("cell"), "h").join(sets, "h")
    found = found.unionByName(compare(few.select("cell", "h", "shingles")))
    parts = told.join(small(core), ["cell", "shingle"]).groupBy("cell", "h", "size").agg(F.sort_array(F.collect_list("shingle")).alias("core"))
    parts = materialize(parts.withColumn("kind", F.sha2(F.concat_ws(",", F.col("core").cast("array<string>"), F.array(F.col("size").cast("string"))), 256)), "passages-parts")
    kinds = parts.groupBy("cell", "kind", "size").agg(F.min("h").alias("h"), F.first("core").alias("core"))
    sized = kinds.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / KINDS).cast("int").alias("blocks"))
    dealt = materialize(kinds.join(small(materialize(sized, "passages-sized")), "cell").withColumn("block", F.pmod(F.xxhash64("kind"), F.col("blocks")).cast("int")), "passages-kinds")
    grid = lambda mine, other: dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn(mine, F.col("block"))
    columns = ["cell", "a", "b", "h", "size", "core"]
    one, two = grid("a", "b").filter("a <= b").select(columns), grid("b", "a").filter("a <= b").select(columns)
    like = one.groupBy("cell", "a", "b").cogroup(two.groupBy("cell", "a", "b")).applyInArrow(lambda x, y: _compared_cores(x, y, similar), "cell long, u long, v long")
    like = materialize(like, "passages-like")
    joined = like.select("cell", F.col("u").alias("h")).unionByName(like.select("cell", F.col("v").alias("h"))).distinct()
    # A kind that is like any, itself or another, has all its members in one class with its first.
    heads = dealt.join(joined, ["cell", "h"], "left_semi").select("cell", "kind", F.col("h").alias("v"))
    members = parts.join(heads, ["cell", "kind"]).select(F.col("h").alias("u"), "v")
    return found.unionByName(like.select("u", "v")).unionByName(members)


def paragraph_classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """h, root and mixed of every paragraph that several documents have, or that is like another one; mixed tells whether its class has others."""
    banded = docs.mapInArrow(_banded, "key long, h long, low long, high long")
    met = materialize(banded.repartition("key").sortWithinPartitions("key", "h").mapInArrow(_meeting, MET), "passages-met")
    same = met.filter("u = v and cell is null").select("u", "v").distinct()
    pairs, full = met.filter("u <> v").select("u", "v").distinct(), met.filter("cell is not null").select("cell", "u").distinct()
    linked = same.limit(0)
    if not (pairs.isEmpty() and full.isEmpty()):
        # h stands for one content; sets are made again for the paragraphs that met others.
        ends = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).unionByName(full.select("u")).distinct()
        sets = _paragraph_rows(docs, True).join(ends, F.col("h") == F.col("u"), "left_semi").groupBy("h").agg(F.array_sort(F.array_distinct(F.first("shingles"))).alias("shingles"))
        sets = materialize(sets, "passages-sets")
        of = lambda name: sets.select(F.col("h").alias(name), F.col("shingles").alias(f"s{name}"))
        both = pairs.join(of("u"), "u").join(of("v"), "v")
        close = both.filter(F.size(F.array_intersect("su", "sv")) >= similar * F.size(F.array_union("su", "sv"))).select("u", "v")
        grouped = _links_of_cells(full, sets, similar)
        linked = materialize(close if grouped is None else close.unionByName(grouped).filter("u <> v").distinct(), "passages-linked")
    roots = components(linked)
    alone = same.select(F.col("u").alias("node")).join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.withColumn("mixed", F.lit(True)).unionByName(alone.withColumn("mixed", F.lit(False))).withColumnRenamed("node", "h")


#: What an end is asked for: where it truly lies, or how far others may move along it.
MOVES, LEADS = 1, 2


#: From where an end is followed: the other end of its paragraph, the shingle of least hash, or the end itself.
INSIDE, LEAST_SHINGLE, EDGE = 0, 1, 2


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, ends) to (doc_id, side, start, anchor, root, role, origin, words).

    An end is that of a paragraph. Where all of the class have the same words, it is followed outwards from there on; in a
    mixed class from inside, from the paragraph's other end and from the far side of its shingle of least hash, which
    like paragraphs mostly have in common. words are hashes of the first, the first two, ... words from the origin, up
    to the far end of the paragraph beyond and REACH + 1 words: had documents more in common, that paragraph would be too.
    """
    for part in slices(batches):
        words, ends = Words(part.column(1).to_pylist()), part.column(2)
        text = np.repeat(np.arange(part.num_rows), ends.value_lengths().to_numpy())
        side, start, n, beyond, root, role, mixed = (ends.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(7))
        if not len(text):
            continue
        left, first = side == 0, words.first[text] + start
        some = np.flatnonzero(mixed)
        places = [(np.flatnonzero(~mixed), EDGE, np.where(left, first, first + n)), (some, INSIDE, np.where(left, first + n, first))]
        if len(some):
            # The shingle of least hash of each paragraph.
            many = (n[some] - SHINGLE + 1).astype(np.int64)
            stops = np.cumsum(many)
            at = np.arange(int(stops[-1])) - np.repeat(stops - many, many) + np.repeat(first[some], many)
            h = words.hashes(at, at + SHINGLE)
            hit = np.flatnonzero(h == np.repeat(np.minimum.reduceat(h, stops - many), many))
            least = np.zeros(len(text), dtype=np.int64)
            least[some] = at[hit[np.unique(np.searchsorted(stops, hit, side="right"), return_index=True)[1]]]
            places.append((some, LEAST_SHINGLE, np.where(left, least + SHINGLE, least)))
        for these, anchor, place in places:
            if not len(these):
                continue
            own, back, place = text[these], left[these], place[these]
            origin = place - words.first[own]
            edge = np.where(back, start[these], start[these] + n[these])
            far = beyond[these] + REACH + 1
            room = np.where(back, np.minimum(origin, origin - edge + far), np.minimum(words.sizes[own] - origin, edge - origin + far)).astype(np.int64)
            upto = np.cumsum(room)
            end = np.repeat(np.arange(len(these)), room)
            k = np.arange(len(end)) - (upto - room)[end] + 1
            c = words.hashes(place[end] - np.where(back[end], k, 0), place[end] + np.where(back[end], 0, k))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, upto].astype(np.int32)), pa.array((c >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            columns = [part.column(0).take(pa.array(own)), pa.array(side[these]), pa.array(start[these]), pa.array(np.full(len(these), anchor, dtype=np.int32)), pa.array(root[these]), pa.array(role[these]), pa.array(origin.astype(np.int32)), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "side", "start", "anchor", "root", "role", "origin", "words"])


def _true_ends(base: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, side (0 left, 1 right), start and reach: where the end of a run truly lies, by the paragraph that is its first or last.

    An end is followed as far as the first or the last document of the paragraph's class goes along, word for word,
    wherever that lies in them; in a class of different paragraphs it may move inwards too. Each class has two documents to be compared with, however many it has. An end that goes along with neither is not in the result.
    """
    edges = with_range(runs, "root", "doc_id", "leftmost", "rightmost")
    leads = F.when((F.col("doc_id") == F.col("first_doc")) | (F.col("doc_id") == F.col("last_doc")), LEADS).otherwise(0)

    def end(side: int, flag: str) -> Column:
        role = F.when(F.col(flag) == 1, MOVES).otherwise(0) + F.when(F.col(f"high_{flag}") == 1, leads).otherwise(0)
        beyond = F.col("after" if side else "before").alias("beyond")
        return F.when(role > 0, F.struct(F.lit(side).alias("side"), "start", "n", beyond, "root", role.alias("role"), "mixed"))

    ends = edges.select("doc_id", F.explode(F.array_compact(F.array(end(0, "leftmost"), end(1, "rightmost")))).alias("end"))
    ends = ends.groupBy("doc_id").agg(F.collect_set("end").alias("ends"))
    contexts = base.join(ends, "doc_id").select("doc_id", "text", "ends").mapInArrow(_contexts, "doc_id long, side int, start int, anchor int, root long, role int, origin int, words array<int>")
    contexts = materialize(contexts, "passages-contexts")
    first = contexts.filter(F.col("role") >= LEADS).groupBy("root", "side", "anchor", F.col("doc_id").alias("lead")).agg(F.min_by("words", "start").alias("along"))
    met = contexts.filter(F.col("role") % 2 == MOVES).join(first, ["root", "side", "anchor"]).filter("doc_id <> lead")
    by = F.size(F.filter(F.zip_with("words", "along", lambda x, y: x == y), lambda same: same))
    far = met.withColumn("by", by).filter((F.col("anchor") == EDGE) | (F.col("by") >= SHINGLE))
    reach = F.when(F.col("side") == 0, -F.min(F.col("origin") - F.col("by"))).otherwise(F.max(F.col("origin") + F.col("by")))
    return far.groupBy("doc_id", "side", "start").agg(reach.alias("reach")).withColumn("reach", F.when(F.col("side") == 0, -F.col("reach")).otherwise(F.col("reach")))


def repeated_passages(docs: DataFrame, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """One row for each passage of a document that other documents have too: doc_id, start_word, n_words, passage_id, first_doc, kept.

    Words are split at ASCII white space and compared with A-Z lower-cased. Neighbouring paragraphs are one run,
    whose ends lie where the first or the last document of the paragraph there ceases to go along word by word; runs that at most
    GAP words part, as an edit does, count together, and those of fewer than `least` words in all are left out.
    In a run, paragraphs of which the smallest doc_id that has them, first_doc, is the same are one passage.
    passage_id is the class of the passage's first paragraph; kept is true in first_doc, and every other passage may
    be removed, which leaves each paragraph's copy in its first_doc. Repeats within a single document, null or
    empty texts and rows without a doc_id are left out; rows that repeat a doc_id count as one document; a text of
    any length is read whole. An empty table gives an empty result; other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id is not null")
    classes = materialize(paragraph_classes(base, similar), "passages-classes")
    found = _paragraph_rows(base, False).join(classes, "h").select("doc_id", "start", "n", "before", "after", "root", "mixed").distinct()
    # Classes of several documents; repeats within a single one are left out here.
    shared = with_range(materialize(found, "passages-found"), "root", "doc_id", "doc_id").filter("low_doc_id < high_doc_id").withColumnRenamed("low_doc_id", "first_doc").withColumnRenamed("high_doc_id", "last_doc")
    ordered = Window.partitionBy("doc_id").orderBy("start", "n")
    stop = F.col("start") + F.col("n")
    ended = F.max(stop).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    broken = (F.coalesce(ended, F.lit(-1)) < F.col("start")).cast("int")
    runs = shared.withColumn("leftmost", broken).withColumn("rightmost", F.coalesce(F.lead("leftmost").over(ordered), F.lit(1)))
    # The paragraphs of a run that first_doc tells alike are one passage.
    turned = ((F.col("leftmost") == 1) | (F.lag("first_doc").over(ordered) != F.col("first_doc"))).cast("int")
    runs = runs.withColumn("run", F.sum("leftmost").over(ordered)).withColumn("turned", F.coalesce(turned, F.lit(0))).withColumn("part", F.sum("turned").over(ordered))
    runs = materialize(runs.select("doc_id", "start", "n", "before", "after", "root", "mixed", "first_doc", "last_doc", "leftmost", "rightmost", "run", "part"), "passages-runs")

    true = materialize(_true_ends(base, runs), "passages-ends")
    ends = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max(stop).alias("stop"), F.min(F.struct("start", stop.alias("stop"))).alias("head"), F.max(F.struct("start", stop.alias("stop"))).alias("tail"))
    reach = lambda side, name, at: true.filter(F.col("side") == side).select("doc_id", F.col("start").alias(at), F.col("reach").alias(name))
    ends = ends.withColumn("at", F.col("tail.start")).join(reach(0, "left", "start"), ["doc_id", "start"], "left").join(reach(1, "right", "at"), ["doc_id", "at"], "left")
    # A paragraph at an end that goes along with no other document is left out.
    ends = ends.select("doc_id", "run", "start", "stop", F.coalesce("left", "head.stop").alias("left"), F.coalesce("right", "tail.start").alias("right")).filter("left < right")
    by_run = Window.partitionBy("doc_id").orderBy("run")
    before = F.max("right").over(by_run.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("before", before).withColumn("left", F.when(F.col("before").isNull(), F.col("left")).otherwise(F.greatest("left", F.least("before", "start"))))
    ends = ends.withColumn("stretch", F.sum(F.when(F.col("left") - F.col("before") <= GAP, 0).otherwise(1)).over(by_run))
    long = ends.withColumn("words", F.sum(F.col("right") - F.col("left")).over(Window.partitionBy("doc_id", "stretch"))).filter(F.col("words") >= least)

    passages = runs.groupBy("doc_id", "run", "part").agg(F.min("start").alias("first"), F.max(stop).alias("last"), F.min("first_doc").alias("first_doc"), F.min(F.struct("start", "root")).alias("head"))
    told = passages.join(long.select("doc_id", "run", "start", "stop", "left", "right"), ["doc_id", "run"])
    # An end may lie within the passage next to the run's first or last one.
    begin = F.when(F.col("first") == F.col("start"), F.col("left")).otherwise(F.greatest("first", "left"))
    end = F.when(F.col("last") == F.col("stop"), F.col("right")).otherwise(F.least("last", "right"))
    return told.filter(begin < end).select("doc_id", begin.alias("start_word"), (end - begin).alias("n_words"), F.col("head.root").alias("passage_id"), "first_doc", (F.col("doc_id") == F.col("first_doc")).alias("kept"))
