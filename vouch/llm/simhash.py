"""SimHash near-duplicates by anchor points of a covering code.

Two 64-bit fingerprints that differ in at most five bits differ in at most two bits of one of their halves.
The anchors of a half are the words of a perfect code: 31 bits of the Hamming code [31,26] and one free bit,
so that each 32-bit value is within one bit of an anchor. A value halfway between two halves that differ by
two bits is within one bit of both, so both halves are within 1 + 1 = covering radius + half the threshold of
the halfway value's anchor. Each distinct fingerprint is copied to its anchors within that distance, 17 for a
half as a rule, and fingerprints are compared only where they meet.

An anchor with more fingerprints than one task should hold is split by anchors of the other half, again within
covering radius plus half the threshold; such a cell lies in a ball of fixed size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_LOWER, SALTS, materialize, slices, small, text_of, with_range
from .components import components

#: Bits that linked fingerprints may differ in by default, and at most, as the anchors' distance is made for it.
THRESHOLD, WIDEST = 4, 5
#: Words of a shingle, and bits, where near copies of documents are dropped.
STAGE_WORDS, STAGE_THRESHOLD = 5, 5
#: Fingerprints of one anchor that are compared as they are; beyond it the anchor is split.
CELL = 20_000
#: Runs up to this length are compared by shifting the whole batch, longer ones one by one.
SHORT = 8
LOW31 = np.uint64(0x7FFFFFFF)


def fingerprint(text: str, words_each: int = 4) -> int:
    """64-bit SimHash of the shingles of words; zero where there is no word."""
    words = text.encode("utf-8").translate(ASCII_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - words_each + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    stops = ends[words_each - 1 :].tolist() or [len(line)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, [line[a:b] for a, b in zip(starts, stops)], repeat(42)), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = 4) -> DataFrame:
    """doc_id and fp (long) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, words_each) for t in part.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def _flips(size: int) -> list[np.ndarray]:
    """For each syndrome, the sets of `size` bits among 31 whose flipping leads to a code word, as masks."""
    found: list[list[int]] = [[] for _ in range(32)]
    for bits in combinations(range(1, 32), size):
        syndrome = 0
        for b in bits:
            syndrome ^= b
        found[syndrome].append(sum(1 << (b - 1) for b in bits))
    return [np.array(x, dtype=np.uint64) for x in found]


FLIPS = {n: _flips(n) for n in range(5)}
CHECKS = [np.uint64(sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)) for k in range(5)]


def anchors(half: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within `distance` (up to 4) of each 32-bit value: (index of the value, anchor)."""
    word, free = half & LOW31, half & ~LOW31
    syndrome = np.zeros(len(half), dtype=np.int64)
    for k, check in enumerate(CHECKS):
        syndrome |= (np.bitwise_count(word & check).astype(np.int64) & 1) << k
    rows, found = [], []
    for s in range(32):
        at = np.flatnonzero(syndrome == s)
        if not len(at):
            continue
        for flipped in range(distance + 1):
            for other_free in (0, 1):
                masks = FLIPS[flipped][s]
                if flipped + other_free > distance or not len(masks):
                    continue
                rows.append(np.repeat(at, len(masks)))
                found.append(((word[at, None] ^ masks) | (free[at, None] ^ np.uint64(other_free << 31))).ravel())
    return (np.concatenate(rows), np.concatenate(found)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def halves(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)


def forest(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among these fingerprints: (first of the part, member).

    A fingerprint that is reached is not compared again, so a dense part costs little and no pairs are listed.
    """
    left, firsts, members = np.arange(len(fps)), [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        frontier = [seed]
        while frontier and len(left):
            near = np.bitwise_count(fps[left] ^ fps[frontier.pop()]) <= threshold
            hits, left = left[near], left[~near]
            frontier += hits.tolist()
            firsts += [seed] * len(hits)
            members += hits.tolist()
    return fps[np.array(firsts, dtype=np.int64)], fps[np.array(members, dtype=np.int64)]


def _compare(keys: np.ndarray, fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole runs of equal keys."""
    edges = np.flatnonzero(np.diff(keys)) + 1
    starts, stops = np.r_[0, edges], np.r_[edges, len(keys)]
    us, vs = [], []
    short = np.repeat(stops - starts <= SHORT, stops - starts)
    for shift in range(1, SHORT):
        met = np.flatnonzero((keys[shift:] == keys[:-shift]) & short[shift:])
        if not len(met):
            break
        met = met[np.bitwise_count(fps[met] ^ fps[met + shift]) <= threshold]
        us.append(fps[met])
        vs.append(fps[met + shift])
    for a, b in zip(starts, stops):
        if b - a > SHORT:
            u, v = forest(fps[a:b], threshold)
            us.append(u)
            vs.append(v)
    return (np.concatenate(us), np.concatenate(vs)) if us else (fps[:0], fps[:0])


def _batch(u: np.ndarray, v: np.ndarray, cell: np.ndarray | None = None) -> pa.RecordBatch:
    """Links, or with `cell` fingerprints whose anchor is too full."""
    cells = pa.nulls(len(u), pa.int64()) if cell is None else pa.array(cell.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), cells], ["u", "v", "cell"])


def sweep(batches: Iterator[pa.RecordBatch], threshold: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, fp) sorted by key. Of a key with over `most` rows the rows are passed on instead."""
    keys, fps, full = np.zeros(0, np.uint64), np.zeros(0, np.uint64), None
    for batch in batches:
        keys = np.r_[keys, batch.column(0).to_numpy().view(np.uint64)]
        fps = np.r_[fps, batch.column(1).to_numpy().view(np.uint64)]
        if full is not None:
            n = int(np.argmax(keys != full)) if (keys != full).any() else len(keys)
            yield _batch(fps[:n], fps[:n], keys[:n])
            keys, fps, full = keys[n:], fps[n:], full if n == len(keys) else None
        if not len(keys):
            continue
        last = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if (keys != keys[-1]).any() else 0
        yield from _runs(keys[:last], fps[:last], threshold, most)
        keys, fps = keys[last:], fps[last:]
        if len(keys) > most:
            full = keys[0]
            yield _batch(fps, fps, keys)
            keys, fps = keys[:0], fps[:0]
    yield from _runs(keys, fps, threshold, most)


def _runs(keys: np.ndarray, fps: np.ndarray, threshold: int, most: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    many = counts[inverse] > most
    if many.any():
        yield _batch(fps[many], fps[many], keys[many])
    u, v = _compare(keys[~many], fps[~many], threshold) if not many.all() else (fps[:0], fps[:0])
    if len(u):
        yield _batch(u, v)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) to (key, fp) for each anchor near one of its halves. Anchor keys use 33 bits."""
    for batch in slices(batches, 4096):
        fps = batch.column(0).to_numpy().view(np.uint64)
        for side, half in enumerate(halves(fps)):
            rows, found = anchors(half, 2)
            yield pa.RecordBatch.from_arrays([pa.array((found | np.uint64(side << 32)).view(np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "fp"])


def _respread(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """(cell, fp) of full anchors to (cell, key, fp) for each anchor near the other half."""
    for batch in slices(batches, 1024):
        cells, fps = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
        low, high = halves(fps)
        rows, found = anchors(np.where(cells >> np.uint64(32) == 0, high, low), distance)
        yield pa.RecordBatch.from_arrays([pa.array(cells[rows].view(np.int64)), pa.array(found.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["cell", "key", "fp"])


def links(fps: DataFrame, threshold: int = THRESHOLD, most: int = CELL) -> DataFrame:
    """Links u, v that connect distinct fingerprints (column fp) wherever two differ in `threshold` bits or fewer."""
    if not 0 <= threshold <= WIDEST:
        raise ValueError(f"the anchors cover thresholds up to {WIDEST}")
    met = fps.select("fp").mapInArrow(_spread, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    found = materialize(met.mapInArrow(lambda b: sweep(b, threshold, most), "u long, v long, cell long").distinct(), "simhash-links")
    joined = found.filter("cell is null").select("u", "v")
    full = found.filter("cell is not null").select("cell", F.col("u").alias("fp"))
    if full.isEmpty():
        return joined
    # The other half may differ in all the bits: the value halfway is within half of them, its anchor one bit further.
    split = full.mapInArrow(lambda b: _respread(b, 1 + (threshold + 1) // 2), "cell long, key long, fp long").select(F.xxhash64("cell", "key").alias("key"), "fp")
    more = split.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lambda b: sweep(b, threshold, 2**62), "u long, v long, cell long")
    return joined.unionByName(more.select("u", "v").distinct())


def near_components(docs: DataFrame, threshold: int = THRESHOLD, words_each: int = 4, salts: int = SALTS, most: int = CELL) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `threshold` differing bits lead to, the document
    itself included. Texts without words have fingerprint zero and are linked like any other; null text counts
    as empty. Equal fingerprints are one node, so a group of copies of any size is one row in all comparisons.
    Null doc_ids never become a component_id unless the component has no other. Repeated rows repeat their
    result, an empty table gives an empty one, and columns other than doc_id and text are ignored.
    """
    own = materialize(fingerprints(docs, words_each), "fingerprints")
    own = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    salted = own.groupBy("fp", "salt").agg(F.min("doc_id").alias("least"))
    nodes = materialize(salted.groupBy("fp").agg(F.min("least").alias("least"), F.collect_set("salt").alias("salts")), "simhash-nodes")
    roots = components(links(nodes, threshold, most))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "salts", F.coalesce("root", "fp").alias("root"))
    named = with_range(rooted, "root", "fp", "least").select("fp", F.explode("salts").alias("salt"), F.col("low_least").alias("component_id"))
    return own.join(named, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, threshold: int = STAGE_THRESHOLD, words_each: int = STAGE_WORDS) -> DataFrame:
    """docs with one row of each component, the one of the smallest doc_id; columns stay as they are.

    Shingles have five words, and five bits of difference link: texts that share 0.95 or more of their shingles
    are mostly linked, texts of similarity 0.8 seldom are (the README has the rates). Null and empty texts are one
    component, so one of them stays. Rows are told apart by doc_id: where ids repeat, an id stays if any of its rows
    is its component's first, and rows of a null id are one id. An empty table gives an empty result. Texts are not
    shuffled while what goes is few enough ids to be sent to all tasks.
    """
    head = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = near_components(docs, threshold, words_each).groupBy("doc_id").agg(F.max(head).alias("stays")).filter("not stays").select(F.col("doc_id").alias("gone_id"))
    whole = docs.select(F.struct("*").alias("whole"), F.col("doc_id").cast("long").alias("row_id"))
    gone = small(materialize(gone, "simhash-gone"))
    return whole.join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")), "left_anti").select("whole.*")
