"""Many terms looked for at once in many texts: an automaton as flat arrays, walked by many stretches of text in step."""

from __future__ import annotations

import numpy as np

#: A byte that no UTF-8 text has, between texts.
BETWEEN = b"\xff"
#: Stretches of text that are walked in step, at most.
LANES = 8192


class Automaton:
    """Goto, fail and output of a set of terms (bytes, not empty) as arrays.

    States are the beginnings of terms. Bytes that stand in no term are one class, 0. follow has the next state for
    every state and class, with the failures worked in, so a step is one look-up; best has for each state the greatest
    number among the terms that end there, -1 for none. A term's number is its place in the list given.
    """

    def __init__(self, terms: list[bytes]):
        used = np.unique(np.frombuffer(b"".join(terms), dtype=np.uint8))
        self.classes = np.zeros(256, dtype=np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.longest = len(used) + 1, max(map(len, terms), default=1)
        sizes = np.fromiter(map(len, terms), np.int64, len(terms))
        flat, at = self.classes[np.frombuffer(b"".join(terms), dtype=np.uint8)], np.cumsum(sizes) - sizes
        # Depth by depth: the states of terms that go on are told apart by their state so far and the next class.
        state, count, levels = np.zeros(len(terms), dtype=np.int64), 1, []
        for depth in range(self.longest):
            on = np.flatnonzero(sizes > depth)
            names, inverse = np.unique(state[on] * self.width + flat[at[on] + depth], return_inverse=True)
            levels.append((names // self.width, names % self.width, count + np.arange(len(names))))
            state[on] = count + inverse
            count += len(names)
        self.best = np.full(count, -1, dtype=np.int64)
        np.maximum.at(self.best, state, np.arange(len(terms)))
        follow, fail = np.zeros((count, self.width), dtype=np.int32), np.zeros(count, dtype=np.int64)
        for depth, (parent, letter, child) in enumerate(levels):
            # What the parent's failure leads to by this letter; the parents' own steps are set after.
            fail[child] = follow[fail[parent], letter] if depth else 0
            follow[parent, letter] = child
            self.best[child] = np.maximum(self.best[child], self.best[fail[child]])
            follow[child] = follow[fail[child]]
        self.follow = follow.ravel()

    @staticmethod
    def room(terms: list[bytes]) -> int:
        """Bytes that the arrays take at most."""
        return (sum(map(len, terms)) + 1) * (len(set(b"".join(terms))) + 1) * 4

    def greatest(self, texts: list[bytes]) -> np.ndarray:
        """The greatest number of a term that stands in each text, -1 where none does.

        All texts are one row of bytes, cut into stretches that are walked in step; a stretch begins as many bytes
        early as a term is long, less one.
        """
        out = np.full(len(texts), -1, dtype=np.int64)
        data = self.classes[np.frombuffer(BETWEEN.join(texts), dtype=np.uint8)]
        if not len(data):
            return out
        early = self.longest - 1
        lanes = int(min(LANES, max(1, len(data) // (4 * self.longest))))
        step = -(-len(data) // lanes)
        padded = np.zeros(early + lanes * step, dtype=np.int32)
        padded[early : early + len(data)] = data
        view = np.lib.stride_tricks.as_strided(padded, (lanes, early + step), (padded.strides[0] * step, padded.strides[0]))
        state, spots, found = np.zeros(lanes, dtype=np.int64), [], []
        first = np.arange(lanes) * step - early
        for k, letters in enumerate(np.ascontiguousarray(view.T)):
            state = self.follow[state * self.width + letters]
            best = self.best[state]
            hit = np.flatnonzero(best >= 0)
            if len(hit):
                spots.append(first[hit] + k)
                found.append(best[hit])
        if found:
            starts = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            np.maximum.at(out, np.searchsorted(starts, np.concatenate(spots), side="right") - 1, np.concatenate(found))
        return out
