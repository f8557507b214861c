"""A run-length index over a repetitive collection of byte strings.

Of the Burrows-Wheeler transform the borders of its runs are kept, with the
text positions of the run ends; the suffix order that they come from is not.
At those samples the longest match with the neighbouring suffix is worked out;
between samples it falls by one from each position to the next, so the matching
statistics of the whole collection stream off the samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_WORD = 8


class RunIndex:
    """Matching statistics of every position against all other positions.

    Matches never cross from one string to the next: each string ends in a
    separator of its own, smaller than any byte.
    """

    def __init__(self, strings: list[bytes]) -> None:
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        raw = b"\0".join(strings) + b"\0" * (_WORD + 1)
        self.n = n = int((lengths + 1).sum())
        self.text = np.frombuffer(raw, np.uint8)
        #: bytes left in the own string, 0 at its separator
        self.left = np.repeat(self.starts + lengths, lengths + 1) - np.arange(n)
        words = np.ndarray((n,), ">u8", raw, 0, (1,)).astype(np.uint64)
        short = np.minimum(self.left, _WORD)
        mask = np.array([0] + [(1 << 64) - (1 << 64 - 8 * k) for k in range(1, _WORD + 1)], np.uint64)
        self.words = words & mask[short]
        self._runs(self._sorted_suffixes())

    def _sorted_suffixes(self) -> np.ndarray:
        """Suffix order by ranks of prefixes that grow by a factor; only suffixes that are still tied are sorted again.

        A sorted word holds a position and as many ranks as fit beside it.  A
        suffix that ends before its next prefix has a rank of its own, so what
        is read past its end never counts.
        """
        n = self.n
        slot = np.arange(n, dtype=np.uint64)
        bits = n.bit_length()
        wide, low = np.uint64(bits), np.uint64((1 << bits) - 1)
        step = (61 - bits) // 8
        short = np.minimum(self.left, step).astype(np.uint64)  # ends sort before any byte
        words = ((self.words >> np.uint64(64 - 8 * step) << np.uint64(3) | short) << wide) | slot
        words.sort()
        sa = (words & low).astype(np.int64)
        words >>= wide
        begins = np.ones(n, bool)
        begins[1:] = (words[1:] != words[:-1]) | (short[sa[1:]] < step)
        rank = np.empty(n, np.uint64)
        rank[sa] = np.maximum.accumulate(np.where(begins, slot, 0))
        beside = 64 // bits - 1
        factor = beside if beside > 1 else 63 // bits
        while True:
            tied = ~begins
            tied[:-1] |= ~begins[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                return sa
            at = sa[slots]
            key = rank[at]
            for k in range(1, factor):
                key = key << wide | rank[np.minimum(at + k * step, n - 1)]
            if beside > 1:
                key = key << wide | at.astype(np.uint64)
                key.sort()
                at = (key & low).astype(np.int64)
                key >>= wide
            else:
                order = np.argsort(key)
                at, key = at[order], key[order]
            sa[slots] = at
            new = np.ones(len(slots), bool)
            new[1:] = key[1:] != key[:-1]
            begins[slots] = new
            rank[at] = np.maximum.accumulate(np.where(new, slots, 0)).astype(np.uint64)
            step *= factor

    def _runs(self, sa: np.ndarray) -> None:
        """Run heads of the transform, and the match length across each border of two runs."""
        before = self.text[sa - 1]
        alone = (sa == 0) | (self.left[sa - 1] == 0)  # preceded by a separator: a run of its own
        border = np.ones(self.n, bool)
        border[1:] = (before[1:] != before[:-1]) | alone[1:] | alone[:-1]
        self.heads = np.flatnonzero(border)
        #: sampled ends: text positions of each run's first and last row
        self.first = sa[self.heads]
        self.last = sa[np.append(self.heads[1:], self.n) - 1]
        across = np.zeros(len(self.heads), np.int64)
        across[1:] = self._common(self.last[:-1], self.first[1:])
        self.across = across

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of each two suffixes."""
        most = np.minimum(self.left[a], self.left[b])
        length = np.zeros(len(a), np.int64)
        todo = np.flatnonzero(most > 0)
        while len(todo):
            at = length[todo]
            todo = todo[self.words[a[todo] + at] == self.words[b[todo] + at]]
            length[todo] += _WORD
            todo = todo[length[todo] < most[todo]]
        todo = np.flatnonzero(length < most)
        off = self.words[a[todo] + length[todo]] ^ self.words[b[todo] + length[todo]]
        for k in range(_WORD - 1):  # leading equal bytes of the first words that differ
            equal = (off >> np.uint64(56 - 8 * k)) == 0
            todo, off = todo[equal], off[equal]
            length[todo] += 1
        return np.minimum(length, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of its longest match that starts anywhere else."""
        n = self.n
        out = np.zeros(n, np.int64)
        for samples, length in ((self.first, self.across), (self.last, np.append(self.across[1:], 0))):
            known = np.zeros(n, bool)
            known[samples] = True
            value = np.zeros(n, np.int64)
            value[samples] = length
            place = np.arange(n)
            since = np.maximum.accumulate(np.where(known, place, 0))
            out = np.maximum(out, value[since] - (place - since))
        return np.minimum(out, self.left)


def long_repeats(strings: list[bytes], need: Callable[[RunIndex], np.ndarray]) -> list[tuple[int, int, int]]:
    """(string, start, end) intervals covered by matches that also start elsewhere.

    ``need`` gives the length from which a match at each position counts; its
    windows end in the order in which they start.
    """
    if not strings:
        return []
    index = RunIndex(strings)
    length = need(index)
    hits = np.flatnonzero(index.matching_statistics() >= length)
    if not len(hits):
        return []
    owner = np.searchsorted(index.starts, hits, "right") - 1
    ends = hits + length[hits]
    apart = np.flatnonzero((hits[1:] > ends[:-1]) | (np.diff(owner) != 0)) + 1
    lo, hi = np.concatenate([[0], apart]), np.concatenate([apart, [len(hits)]]) - 1
    base = index.starts[owner[lo]]
    return list(zip(owner[lo].tolist(), (hits[lo] - base).tolist(), (ends[hi] - base).tolist()))
