"""Grouping of spelling variants by dynamic programming over sorted lists.

Two words within one edit share a beginning or an end of half the shorter one's length, so words meet in cells by
their half; a cell of many words is dealt by half of what is left, as often as it takes. What its words do not
share is a sorted list, and each word of it is looked for in the list row by row of the edit matrix, of which only the three diagonals within one edit are kept. Neighbours that begin alike are one range of
the list and share the rows of that beginning, so a row is worked out once for each range; ranges whose row is
beyond one edit are skipped as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ASCII_LOWER, discard, materialize, slices, small

#: Runs of letters in UTF-8 after A-Z have been lower-cased: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Code points and occurrences of a word at least; one in so many runs loses a letter; ratio of a form to its variants.
LETTERS, OFTEN, SLIPS, RATIO = 5, 3, 97, 2
#: Words of a cell that are compared in one list.
MOST = 4096
#: Words counted together in a task; bytes of a text that are searched at a time; pairs of query and range at a time.
HELD, STRETCH, PAIRS = 1 << 18, 1 << 20, 1 << 19
#: Beyond one edit.
FAR = 2


def runs_of(text: bytes) -> Counter:
    """The runs of letters in a text, with their numbers; a long text is searched stretch by stretch."""
    text = text.translate(ASCII_LOWER)
    if len(text) <= STRETCH:
        return Counter(RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        stop = min(len(text), at + STRETCH)
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        more = RUN.match(text, stop)
        stop = more.end() if more else stop
        found.update(RUN.findall(text, at, stop))
        at = stop
    return found


def slipped(doc: bytes, run: bytes, slips: int = SLIPS) -> str:
    """The run as a word; where `slips` divides the crc32 of `<doc>:<run>`, without the code point that it chooses."""
    h, word = zlib.crc32(doc + b":" + run), run.decode()
    if h % slips:
        return word
    k = h % len(word)
    return word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, letters: int = LETTERS, often: int = OFTEN, slips: int = SLIPS) -> DataFrame:
    """word and n of the words of docs (doc_id, text) with at least so many code points and occurrences.

    Words are runs of letters, A-Z lower-cased, after slips; null texts have none and a null doc_id is written as
    nothing. Each task counts on its own first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for part in slices(batches, 64):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                start = zlib.crc32((doc + ":").encode())
                for r, n in runs_of(text).items():
                    if len(r) < letters:
                        continue
                    # A run without a slip is its own word; crc32 goes on from the document's part.
                    word = r.decode() if zlib.crc32(r, start) % slips else slipped(doc.encode(), r, slips)
                    if len(word) >= letters:
                        held[word] += n
            if len(held) > HELD:
                yield told()
                held = Counter()
        yield told()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= often)


class Lists:
    """Sorted lists of cells, one after another: words (rest) of each cell in order, with the beginnings shared by neighbours."""

    def __init__(self, cells: np.ndarray, rests: list[str]):
        self.sizes = np.fromiter(map(len, rests), np.int64, len(rests))
        self.at = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer("".join(rests).encode("utf-32-le"), dtype=np.uint32)
        n = len(rests)
        # Code points that each word's beginning has in common with the word before; -1 at the beginning of a cell.
        self.shared = np.full(n, -1, dtype=np.int64)
        alive = np.flatnonzero(cells[1:] == cells[:-1]) + 1
        self.shared[alive] = 0
        depth = 0
        while len(alive):
            alive = alive[(self.sizes[alive] > depth) & (self.sizes[alive - 1] > depth)]
            alive = alive[self.flat[self.at[alive] + depth] == self.flat[self.at[alive - 1] + depth]]
            depth += 1
            self.shared[alive] = depth
        self.deep: list[np.ndarray] = [np.arange(n)]
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def ranges(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of the ranges that begin alike for `depth` code points, and where each ends; only words that long are looked at."""
        while len(self.found) <= depth:
            d = len(self.found)
            words = self.deep[-1][self.sizes[self.deep[-1]] >= d]
            first = np.flatnonzero(self.shared[words] < d)
            self.deep[-1] = words
            self.found.append((words[first], words[np.r_[first[1:], len(words)] - 1] + 1 if len(first) else first))
        return self.found[depth]

    def near(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) of one cell that are exactly one edit apart; queries are numbers of words.

        Goes down the ranges depth by depth, for all queries together: a row is the edits between the range's
        beginning and one, none, and one code point less or more of the query's.
        """
        q = queries
        cells, _ = self.ranges(0)
        s = cells[np.searchsorted(cells, q, side="right") - 1]
        row = np.tile(np.array([FAR, 0, 1], dtype=np.int8), (len(q), 1))
        row[self.sizes[q] == 0, 2] = FAR
        depth = 0
        while len(q):
            # Words that end here.
            over = self.sizes[s] == depth
            gap = self.sizes[q] - depth
            for d in (-1, 0, 1):
                hit = over & (gap == d) & (row[:, d + 1] == 1)
                if hit.any():
                    yield q[hit], s[hit]
            here, ends = self.ranges(depth)
            stop = ends[np.searchsorted(here, s)]
            below, _ = self.ranges(depth + 1)
            a, b = np.searchsorted(below, s), np.searchsorted(below, stop)
            many = b - a
            kid = np.repeat(np.arange(len(q)), many)
            s = below[np.arange(len(kid)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)]
            q, row = q[kid], row[kid]
            letter = self.flat[self.at[s] + depth]
            new = np.full_like(row, FAR)
            for d in (-1, 0, 1):
                j = depth + 1 + d  # code points of the query up to here
                inside = (j >= 0) & (j <= self.sizes[q])
                best = np.full(len(q), FAR, dtype=np.int8)
                if j >= 1:
                    of = self.flat[np.minimum(self.at[q] + j - 1, max(0, len(self.flat) - 1))]
                    best = np.minimum(best, row[:, d + 1] + (of != letter))
                if d < 1:
                    best = np.minimum(best, row[:, d + 2] + 1)
                if d > -1:
                    best = np.minimum(best, new[:, d] + 1)
                new[:, d + 1] = np.where(inside, np.minimum(best, FAR), FAR)
            alive = new.min(axis=1) < FAR
            q, s, row = q[alive], s[alive], new[alive]
            depth += 1


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, other, rest, front, size, word, n) sorted by cell and rest to near pairs (word, n, near, near_n), both ways round.

    A word of `size` code points asks, one of size + 1 is only found; `front` is explained at _cells.
    """
    held: list[pa.RecordBatch] = []

    def changes(table: pa.Table) -> np.ndarray:
        """Whether the cell of a row is another than that of the row before, from the second row on."""
        cell, other = (table.column(c).to_numpy() for c in ("cell", "other"))
        return (cell[1:] != cell[:-1]) | (other[1:] != other[:-1])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        front, size = (table.column(c).to_numpy() for c in ("front", "size"))
        rests = table.column("rest").to_pylist()
        edge = np.r_[0, np.flatnonzero(changes(table)) + 1, table.num_rows]
        lists = Lists(np.repeat(np.arange(len(edge) - 1), np.diff(edge)), rests)
        # A cell of one word has no pair.
        several = np.repeat(np.diff(edge) > 1, np.diff(edge))
        asks = np.flatnonzero((lists.sizes == size) & several)
        words, counts = table.column("word"), table.column("n")
        # A cell's words are asked for a few at a time, so that queries times ranges stay bounded.
        room = np.repeat(np.diff(edge), np.diff(edge))[asks]
        turn = np.cumsum(np.minimum(room, 128)) // PAIRS if len(asks) else asks
        for part in np.split(asks, np.flatnonzero(np.diff(turn)) + 1) if len(asks) else []:
            for q, s in lists.near(part):
                same = lists.sizes[q] == lists.sizes[s]
                # Words of one length find each other, so one direction of them counts.
                keep = ~same | (q < s)
                # A letter more at the end: such words meet in the other half too.
                longer = np.flatnonzero(keep & ~same & ~front[q])
                if len(longer):
                    whole = np.array([rests[b].startswith(rests[a]) for a, b in zip(q[longer], s[longer])])
                    keep[longer[whole]] = False
                q, s = q[keep], s[keep]
                if len(q):
                    u, v = np.r_[q, s], np.r_[s, q]
                    yield pa.RecordBatch.from_arrays([words.take(pa.array(u)).combine_chunks(), counts.take(pa.array(u)).combine_chunks(), words.take(pa.array(v)).combine_chunks(), counts.take(pa.array(v)).combine_chunks()], ["word", "n", "near", "near_n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < 1 << 16:
            continue
        table = pa.Table.from_batches(held)
        last = int(np.flatnonzero(np.r_[True, changes(table)])[-1])
        if last:
            yield from pairs(table.slice(0, last))
            held = table.slice(last).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


CELL = "cell long, other long, rest string, front boolean, size int, word string, n long"


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, other, rest, front, size, word, n) to those of the two halves: what is shared goes into the cell's name.

    size is the shorter words' length of rest in a cell; a front half leaves the end of rest, a back half its
    beginning. front stays true as long as all that is shared stood in front: words that differ by a letter at the
    end of rest meet in both halves, and count in such cells alone. Cells are named by two hashes of what is shared, 128 bits together.
    """
    import xxhash

    for part in slices(batches, 8192):
        cells, others, rests, fronts, sizes = (part.column(k).to_pylist() for k in range(5))
        out: list[list] = [[] for _ in range(5)]
        for c, o, rest, all_front, size in zip(cells, others, rests, fronts, sizes):
            half = size // 2
            back = size - half
            for front, shared, left, n in ((True, rest[:half], rest[half:], back), (False, rest[len(rest) - back :], rest[: len(rest) - back], half)):
                name = f"{c}:{o}:{size}:{front:d}:{shared}".encode("utf-8", "surrogatepass")
                h = xxhash.xxh3_128_intdigest(name)
                for column, x in zip(out, ((h >> 64) - (1 << 63), (h & (2**64 - 1)) - (1 << 63), left, front and all_front, n)):
                    column.append(x)
        twice = pa.array(np.repeat(np.arange(part.num_rows), 2))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32())
        yield pa.RecordBatch.from_arrays([*[pa.array(x, t) for x, t in zip(out, kinds)], part.column(5).take(twice), part.column(6).take(twice)], ["cell", "other", "rest", "front", "size", "word", "n"])


def near_pairs(words: DataFrame, letters: int = LETTERS, most: int = MOST) -> DataFrame:
    """word, n, near, near_n of all pairs of distinct words (word, n) that one inserted, deleted or replaced code point tells apart, both ways round.

    Words have `letters` code points or more. A cell of over `most` words is dealt by the halves of what its words
    still differ in, down to the letter, where the alphabet bounds it.
    """
    size = F.char_length("word").cast("int")
    zero = F.lit(0).cast("long")
    # A word meets those of its length, and as the longer one those that are one shorter.
    start = words.withColumn("size", F.explode(F.array(size, size - 1))).filter(F.col("size") >= letters)
    left = start.select(zero.alias("cell"), zero.alias("other"), F.col("word").alias("rest"), F.lit(True).alias("front"), "size", "word", "n")
    found = None
    while True:
        cells = materialize(left.mapInArrow(_cells, CELL), "spelling-cells")
        sizes = cells.filter("size > 1").groupBy("cell", "other").agg(F.count(F.lit(1)).alias("met"))
        full = materialize(sizes.filter(F.col("met") > most).drop("met"), "spelling-full")
        none = full.isEmpty()
        fit = cells if none else cells.join(small(full), ["cell", "other"], "left_anti").select(*cells.columns)
        met = fit.repartition("cell", "other").sortWithinPartitions("cell", "other", "rest")
        pairs = met.mapInArrow(_compared, "word string, n long, near string, near_n long")
        found = pairs if found is None else found.unionByName(pairs)
        if none:
            return found
        left = cells.join(small(full), ["cell", "other"], "left_semi").select(*cells.columns)


def variant_forms(docs: DataFrame, letters: int = LETTERS, often: int = OFTEN, slips: int = SLIPS, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs; see word_counts.

    form is the near word of largest n, then smallest in code-point order, if its n is `ratio` times the word's or
    more, else null, as form_n is then; root is what forms lead to in the end. Documents' other columns are ignored,
    repeated rows count again, and an empty table gives an empty result.
    """
    words = materialize(word_counts(docs, letters, often, slips), "spelling-words")
    pairs = near_pairs(words, letters, most)
    # The order of UTF-8 bytes, in which Spark compares, is that of code points.
    best = F.min_by(F.struct("near", "near_n"), F.struct((-F.col("near_n")).alias("a"), F.col("near").alias("b")))
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    forms = words.join(near, "word", "left")
    fits = F.col("best.near_n") >= ratio * F.col("n")
    forms = forms.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, F.col("best.near_n")).alias("form_n"))
    forms = materialize(forms, "spelling-forms")
    # Each step at least doubles n, so the ways to the roots are short; they are doubled until none goes on.
    ways = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = ways.join(further, "root", "left")
        if longer.filter("next is not null").isEmpty():
            break
        longer = materialize(longer.select("word", F.coalesce("next", "root").alias("root")), "spelling-ways")
        discard(ways)
        ways = longer
    return forms.join(ways, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
