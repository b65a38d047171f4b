"""The ratio of matching blocks between strings, worked out only where cheaper bounds do not decide.

A common subsequence is never shorter than the matching blocks together, so its length bounds the ratio. It is found for
many strings at once, bit by bit: a number of 64 bits stands for the target, and each step takes one code point of
every string. Before that, code points in common, counted, bound the subsequence.
"""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Iterable

import numpy as np

#: Code points of a target that one number of bits holds; windows, and code points of texts, that are looked at together.
BITS, WINDOWS, STRETCH = 63, 1 << 16, 1 << 20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Target:
    """A string that others are compared with."""

    def __init__(self, text: str):
        self.text, codes = text, _codes(text)
        self.letters, place = np.unique(codes, return_inverse=True)
        self.counts = np.bincount(place, minlength=len(self.letters))
        # For each letter the places where it stands, as bits; the last row is for all other letters.
        self.masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
        if len(codes) <= BITS:
            np.bitwise_or.at(self.masks, place, np.uint64(1) << np.arange(len(codes), dtype=np.uint64))

    def places(self, codes: np.ndarray) -> np.ndarray:
        """The number of each code point among the target's letters, or their number where it is none."""
        if not len(self.letters):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters))

    def common(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences with strings, given as rows of places, of which the first `sizes` count."""
        if len(self.text) > BITS:
            return np.minimum(sizes, len(self.text))
        open_ = np.full(len(rows), np.uint64(2**64 - 1))
        for k in range(int(sizes.max(initial=0))):
            on = sizes > k
            met = open_ & self.masks[rows[:, k]]
            open_ = np.where(on, (open_ + met) | (open_ - met), open_)
        low = np.uint64((1 << len(self.text)) - 1)
        return np.bitwise_count(~open_ & low).astype(np.int64)


class Words:
    """Distinct words and how like each may be to a target at most; its ratio is worked out when asked for, once."""

    def __init__(self, target: str, words: Iterable[str]):
        self.matcher = difflib.SequenceMatcher()
        self.matcher.set_seq2(target)
        self.words = sorted(set(words))
        self.number = {w: i for i, w in enumerate(self.words)}
        self.known: dict[int, float] = {}
        goal, sizes = Target(target), np.fromiter(map(len, self.words), np.int64, len(self.words))
        self.bounds = np.zeros(len(self.words))
        order = np.argsort(sizes, kind="stable")  # words of about one length together
        for a in range(0, len(order), WINDOWS):
            these = order[a : a + WINDOWS]
            own = sizes[these]
            rows = np.full((len(these), max(1, int(own.max(initial=0)))), len(goal.letters))
            places = goal.places(_codes("".join(self.words[i] for i in these)))
            rows[np.repeat(np.arange(len(these)), own), np.arange(len(places)) - np.repeat(np.cumsum(own) - own, own)] = places
            self.bounds[these] = np.where(own + len(target) > 0, 2.0 * goal.common(rows, own) / np.maximum(own + len(target), 1), 1.0)

    def ratio(self, i: int) -> float:
        if i not in self.known:
            self.matcher.set_seq1(self.words[i])
            self.known[i] = self.matcher.ratio()
        return self.known[i]

    def closest(self, words: Iterable[str], least: float) -> str | None:
        """The word of greatest ratio, then the last in order, if that is `least` or more."""
        own = np.array(sorted({self.number[w] for w in words}), dtype=np.int64)
        best = (least, "")
        found = None
        for i in own[np.argsort(-self.bounds[own], kind="stable")].tolist():
            if self.bounds[i] < best[0]:
                break
            if (told := (self.ratio(i), self.words[i])) >= best:
                best, found = told, self.words[i]
        return found


def best_window(text: str, label: str) -> float:
    """The greatest ratio of the shorter string with a stretch of its length in the longer one."""
    short, long = sorted((text, label), key=len)
    n = len(short)
    if not n:
        return 0.0
    goal, places = Target(short), None
    places = goal.places(_codes(long))
    starts = len(long) - n + 1
    shared = np.zeros(starts, dtype=np.int64)
    for letter, count in enumerate(goal.counts):
        seen = np.r_[0, np.cumsum(places == letter)]
        shared += np.minimum(seen[n:] - seen[:-n], count)
    matcher = difflib.SequenceMatcher(None, "", short, autojunk=False)
    found, known = 0.0, set()
    # The most promising stretches first, so that few are worked out.
    order = np.argsort(-shared, kind="stable")
    for a in range(0, starts, WINDOWS):
        these = order[a : a + WINDOWS]
        these = these[2.0 * shared[these] / (2 * n) > found]
        if not len(these):
            break
        rows = places[these[:, None] + np.arange(n)]
        bounds = 2.0 * np.minimum(goal.common(rows, np.full(len(these), n)), shared[these]) / (2 * n)
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] <= found:
                break
            window = long[these[k] : these[k] + n]
            if window not in known:
                known.add(window)
                matcher.set_seq1(window)
                found = max(found, matcher.ratio())
    return found


def have_window(texts: list[str], label: str, least: float) -> dict[str, bool]:
    """For each text, whether its best_window with a label is `least` percent or more.

    Distinct texts are bounded together, and a stretch that may be like the label is compared once for all of them.
    """
    matcher, known = difflib.SequenceMatcher(autojunk=False), {}

    def alike(window: str, short: str) -> bool:
        if (window, short) not in known:
            if matcher.b != short:
                matcher.set_seq2(short)
            matcher.set_seq1(window)
            known[window, short] = matcher.ratio() * 100 >= least
        return known[window, short]

    told = {t: not (t and label) and least <= 0 for t in texts}
    given = sorted((t for t in told if t and label), key=len)
    for n, same in itertools.groupby((t for t in given if len(t) <= len(label)), key=len):
        # The texts are the shorter ones: each stretch of the label is compared with all texts of its length.
        same = list(same)
        codes = _codes("".join(same)).reshape(-1, n)
        for k in range(len(label) - n + 1):
            window = label[k : k + n]
            goal = Target(window)
            for a in range(0, len(same), WINDOWS):
                rows = goal.places(codes[a : a + WINDOWS].ravel()).reshape(-1, n)
                for i in np.flatnonzero(_may_be(goal, rows, least)).tolist():
                    told[same[a + i]] = told[same[a + i]] or alike(window, same[a + i])
    longer = [t for t in given if len(t) > len(label)]
    ends = np.cumsum(np.fromiter(map(len, longer), np.int64, len(longer)))
    at, n, goal = 0, len(label), Target(label)
    while at < len(longer):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STRETCH, side="right")))
        whole, begins = "".join(longer[at:upto]), np.r_[0, ends[at : upto - 1] - (ends[at - 1] if at else 0)]
        places = goal.places(_codes(whole))
        shared = np.zeros(len(places) - n + 1, dtype=np.int64)
        for letter, count in enumerate(goal.counts):
            seen = np.r_[0, np.cumsum(places == letter)]
            shared += np.minimum(seen[n:] - seen[:-n], count)
        starts = np.flatnonzero(2.0 * shared / (2 * n) * 100 >= least)
        owner = np.searchsorted(begins, starts, side="right") - 1
        own = starts + n <= np.r_[begins[1:], len(whole)][owner]  # not over the end of a text
        starts, owner = starts[own], owner[own]
        for a in range(0, len(starts), WINDOWS):
            these = starts[a : a + WINDOWS]
            for i in np.flatnonzero(_may_be(goal, places[these[:, None] + np.arange(n)], least)).tolist():
                text, k = longer[at + owner[a + i]], int(these[i])
                told[text] = told[text] or alike(whole[k : k + n], label)
        at = upto
    return told


def _may_be(goal: Target, rows: np.ndarray, least: float) -> np.ndarray:
    """Which strings of a target's length, given as rows of places, may be `least` percent or more like it."""
    n = rows.shape[1]
    most = np.zeros(len(rows), dtype=np.int64)
    for letter, count in enumerate(goal.counts):
        most += np.minimum(np.count_nonzero(rows == letter, axis=1), count)
    may = 2.0 * most / (2 * n) * 100 >= least
    may[may] = 2.0 * goal.common(rows[may], np.full(may.sum(), n)) / (2 * n) * 100 >= least
    return may
