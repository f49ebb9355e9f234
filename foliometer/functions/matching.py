"""Matching characters of two texts, as ``difflib`` counts them, for texts of any length.

``SequenceMatcher`` takes the longest block of equal characters, then does the same on both
sides of it. Finding a block costs it the product of the lengths. Here a block is found by
bisecting its length over hashes of all runs of that length, in n log n; every block is
compared character by character before it counts, so the figures are the same.
"""

from __future__ import annotations

import difflib
import heapq

import numpy as np

# Shorter texts are left to difflib, which is as fast there (measured on prose).
LONG_TEXT = 2000
# From this length on, difflib passes over characters that make up more than 1 % of the
# second text when it looks for a block (fixed value).
POPULAR_FROM = 200
# Product of lengths and number of equal characters up to which all runs of these are listed; beyond
# that, blocks are looked for one by one. A few megabytes.
RUN_CELLS, RUN_POINTS = LONG_TEXT**2, 100_000
# Runs of a range that are looked at together.
MANY_RUNS = 100
BASE = np.uint64(0x9E3779B97F4A7C15)


class HashClash(Exception):
    """Two different runs of characters have the same hash."""


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _characters_in_common(left: str, right: str) -> int:
    """How many characters match at most, wherever they are."""
    a, count_a = np.unique(_codes(left), return_counts=True)
    b, count_b = np.unique(_codes(right), return_counts=True)
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(count_a[at_a], count_b[at_b]).sum())


def _equal_from_start(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the common beginning."""
    size, at, step = min(len(left), len(right)), 0, 64
    while at < size:
        different = left[at : min(at + step, size)] != right[at : min(at + step, size)]
        if different.any():
            return at + int(different.argmax())
        at, step = at + step, step * 4
    return size


class _Runs:
    """Hashes of the runs of a text that consist of characters a block may begin with."""

    def __init__(self, codes: np.ndarray, usable: np.ndarray, powers: np.ndarray):
        self.usable, self.powers = usable, powers
        self.count = np.concatenate([[0], np.cumsum(usable)])
        # Sums of code * BASE^place; a run is brought to the same power as any other.
        sums = (codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sums, dtype=np.uint64)])

    def longest(self, low: int, high: int) -> int:
        """Length of the longest run in a range."""
        breaks = np.flatnonzero(~self.usable[low:high])
        edges = np.concatenate([[-1], breaks, [high - low]])
        return int(np.diff(edges).max()) - 1

    def of(self, low: int, high: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in a range at which a run of ``size`` starts, and its hash."""
        starts = np.arange(low, high - size + 1)
        starts = starts[self.count[starts + size] - self.count[starts] == size]
        hashes = (self.sums[starts + size] - self.sums[starts]) * self.powers[len(self.usable) - starts]
        return starts, hashes


class Matcher:
    """Blocks of two texts in the order of ``difflib.SequenceMatcher(None, left, right)``."""

    def __init__(self, left: str, right: str):
        self.left, self.right = _codes(left), _codes(right)
        known, counts = np.unique(self.right, return_counts=True)
        if len(self.right) >= POPULAR_FROM:
            known = known[counts <= len(self.right) // 100 + 1]
        # Both texts take powers up to the same length, so that hashes agree between them.
        self.length = max(len(self.left), len(self.right))
        powers = np.full(self.length + 1, BASE, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers, dtype=np.uint64)
        self.runs = [self._runs(codes, known, powers) for codes in (self.left, self.right)]

    def _runs(self, codes, known, powers):
        padded = np.zeros(self.length, np.uint32)
        padded[: len(codes)] = codes
        usable = np.zeros(self.length, bool)
        usable[: len(codes)] = np.isin(codes, known)
        return _Runs(padded, usable, powers)

    def _common(self, span, size: int) -> tuple[int, int] | None:
        """The first equal runs of ``size``: by place on the left, then on the right."""
        a_low, a_high, b_low, b_high = span
        a, hash_a = self.runs[0].of(a_low, a_high, size)
        b, hash_b = self.runs[1].of(b_low, b_high, size)
        shared = np.isin(hash_a, hash_b)
        if not shared.any():
            return None
        at = int(shared.argmax())
        return int(a[at]), int(b[(hash_b == hash_a[at]).argmax()])

    def block(self, span) -> tuple[int, int, int]:
        """(place on the left, on the right, length) of the block difflib takes in a range."""
        a_low, a_high, b_low, b_high = span
        at, size = (a_low, b_low), 0
        low = 0
        high = min(self.runs[0].longest(a_low, a_high), self.runs[1].longest(b_low, b_high))
        while low < high:
            middle = (low + high + 1) // 2
            found = self._common(span, middle)
            if found is None:
                high = middle - 1
            else:
                at, size, low = found, middle, middle
        i, j = at
        if not np.array_equal(self.left[i : i + size], self.right[j : j + size]):
            raise HashClash
        # Any equal characters around it belong to the block; without one, those at the start.
        before = _equal_from_start(self.left[a_low:i][::-1], self.right[b_low:j][::-1]) if size else 0
        after = _equal_from_start(self.left[i + size : a_high], self.right[j + size : b_high])
        return i - before, j - before, before + size + after

    def bounds(self):
        """Lower and upper bounds of the number of matching characters, ever closer.

        Blocks found so far give the lower one; in a range that is still open no more
        characters can match than the shorter side has. The last two are equal.
        """
        whole = (0, len(self.left), 0, len(self.right))
        matched, room = 0, min(len(self.left), len(self.right))
        open_ranges = [(-room, whole)] if room else []
        yield matched, matched + room
        while open_ranges:
            negative, span = heapq.heappop(open_ranges)
            room += negative
            a_low, a_high, b_low, b_high = span
            i, j, size = self.block(span)
            if size:
                matched += size
                for part in ((a_low, i, b_low, j), (i + size, a_high, j + size, b_high)):
                    least = min(part[1] - part[0], part[3] - part[2])
                    if least:
                        room += least
                        heapq.heappush(open_ranges, (-least, part))
            yield matched, matched + room


def _diagonal_runs(left: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """(place on the left, on the right, length) of all longest runs of equal characters that
    ``difflib`` looks at; nothing where these are too many."""
    order = np.argsort(right, kind="stable")
    ranked = right[order]
    first = np.searchsorted(ranked, left, "left")
    counts = np.searchsorted(ranked, left, "right") - first
    if len(right) >= POPULAR_FROM:
        counts[counts > len(right) // 100 + 1] = 0
    if counts.sum() > RUN_POINTS:
        return None
    i = np.repeat(np.arange(len(left)), counts)
    j = order[np.arange(len(i)) + np.repeat(first - np.cumsum(counts) + counts, counts)]
    # Neighbours on a diagonal follow each other in this order.
    along = np.argsort((i - j + len(right)) * (len(left) + 1) + i)
    i, j = i[along], j[along]
    starts = np.ones(len(i), bool)
    starts[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(starts)
    return np.stack([i[at], j[at], np.diff(np.append(at, len(i)))])


def _clipped(runs: np.ndarray, span) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Parts of runs within a range, and the longest of them, by place where several are."""
    a_low, a_high, b_low, b_high = span
    a, b, length = runs
    skip = np.maximum(np.maximum(a_low - a, b_low - b), 0)
    size = np.minimum(np.minimum(a_high - a, b_high - b), length) - skip
    inside = np.stack([a + skip, b + skip, size])[:, size > 0]
    if not inside.size:
        return inside, (a_low, b_low, 0)
    a, b, length = inside
    longest = np.flatnonzero(length == length.max())
    best = longest[(a[longest] * (b_high + 1) + b[longest]).argmin()]
    return inside, (int(a[best]), int(b[best]), int(length[best]))


def _matched_by_runs(left: str, right: str, runs: np.ndarray) -> int:
    """Matching characters of two texts whose runs of equal characters are known.

    A block is the longest run within a range, and only those that reach into one of the two
    ranges beside it are looked at again.
    """
    matched, ranges = 0, [(0, len(left), 0, len(right), runs)]
    while ranges:
        a_low, a_high, b_low, b_high, runs = ranges.pop()
        many = isinstance(runs, np.ndarray)
        if many and runs.shape[1] <= MANY_RUNS:
            runs, many = list(zip(*runs.tolist(), strict=True)), False
        if many:
            inside, (i, j, size) = _clipped(runs, (a_low, a_high, b_low, b_high))
        else:
            i, j, size, inside = a_low, b_low, 0, []
            for a, b, length in runs:
                skip = max(a_low - a, b_low - b, 0)
                length = min(a_high - a, b_high - b, length) - skip
                if length > 0:
                    a, b = a + skip, b + skip
                    inside.append((a, b, length))
                    if length > size or (length == size and (a, b) < (i, j)):
                        i, j, size = a, b, length
        # Any equal characters around it belong to the block; without one, those at the start.
        if size:
            while i > a_low and j > b_low and left[i - 1] == right[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
        while i + size < a_high and j + size < b_high and left[i + size] == right[j + size]:
            size += 1
        if size:
            matched += size
            a, b = i + size, j + size
            if many:
                before = inside[:, (inside[0] < i) & (inside[1] < j)]
                after = inside[:, (inside[0] + inside[2] > a) & (inside[1] + inside[2] > b)]
            else:
                before = [run for run in inside if run[0] < i and run[1] < j]
                after = [run for run in inside if run[0] + run[2] > a and run[1] + run[2] > b]
            if a_low < i and b_low < j:
                ranges.append((a_low, i, b_low, j, before))
            if a < a_high and b < b_high:
                ranges.append((a, a_high, b, b_high, after))
    return matched


def ratio(left: str, right: str) -> float:
    """``SequenceMatcher(None, left, right).ratio()``."""
    if not left or not right:
        return 0.0 if left or right else 1.0
    if min(len(left), len(right)) < LONG_TEXT and len(left) * len(right) <= RUN_CELLS:
        runs = _diagonal_runs(_codes(left), _codes(right))
        if runs is not None:
            return 2.0 * _matched_by_runs(left, right, runs) / (len(left) + len(right))
    if min(len(left), len(right)) >= LONG_TEXT:
        try:
            *_, (matched, _) = Matcher(left, right).bounds()
            return 2.0 * matched / (len(left) + len(right))
        except HashClash:
            pass
    return difflib.SequenceMatcher(None, left, right).ratio()


def below(left: str, right: str, limit: float) -> bool:
    """Whether the ratio is below ``limit``; stops as soon as a bound decides."""
    total = len(left) + len(right)
    if total and 2.0 * min(len(left), len(right)) / total < limit:
        return True
    if min(len(left), len(right)) >= LONG_TEXT:
        if 2.0 * _characters_in_common(left, right) / total < limit:
            return True
        try:
            for least, most in Matcher(left, right).bounds():
                if 2.0 * least / total >= limit:
                    return False
                if 2.0 * most / total < limit:
                    return True
        except HashClash:
            pass
    matcher = difflib.SequenceMatcher(None, left, right)
    return matcher.quick_ratio() < limit or matcher.ratio() < limit
