"""Deep-shallow sorting of byte strings.

Strings are ordered by multikey quicksort, a word of eight bytes at a time, down to a shallow
depth. Strings that still share their beginning there are few but long alike; each group of
them goes through a blind trie, which compares every string with one other only.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 96


def common_prefix(one: int, two: int, width: int) -> int:
    """Leading bytes in which two numbers of ``width`` bytes agree."""
    return width - ((one ^ two).bit_length() + 7) // 8


class BlindTrie:
    """A trie that holds only the places where strings part.

    A node is [depth, {byte: child}, leaf]: ``leaf`` is any string below it. A leaf is the
    list of equal strings.
    """

    def __init__(self, strings: list[bytes]):
        self.width = len(strings[0])
        self.strings = strings
        self.numbers = [int.from_bytes(string) for string in strings]
        self.root: list = [self.width, [0], 0]
        for number in range(1, len(strings)):
            self._insert(number)

    def _insert(self, number: int) -> None:
        string, node = self.strings[number], self.root
        # Down by branching bytes alone, without comparing; any child does where none fits.
        while node[0] < self.width:
            node = node[1].get(string[node[0]]) or next(iter(node[1].values()))
        depth = common_prefix(self.numbers[number], self.numbers[node[2]], self.width)
        above, node = None, self.root
        while node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        if node[0] == self.width:
            if depth == self.width:
                node[1].append(number)
                return
        elif node[0] == depth:
            node[1][string[depth]] = [self.width, [number], number]
            return
        fork = [depth, {self.strings[node[2]][depth]: node, string[depth]: [self.width, [number], number]}, number]
        if above is None:
            self.root = fork
        else:
            above[1][string[above[0]]] = fork

    def in_order(self) -> tuple[list[int], list[int]]:
        """Strings in order, and what each shares with the one before it (0 for the first)."""
        order, shared, stack = [], [], [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if node[0] == self.width:
                order += node[1]
                shared += [before] + [self.width] * (len(node[1]) - 1)
                continue
            children = [node[1][byte] for byte in sorted(node[1])]
            for child in reversed(children[1:]):
                stack.append((child, node[0]))
            stack.append((children[0], before))
        return order, shared


def deep_shallow_sort(rows: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``rows`` (strings x bytes) inside ascending ``groups``, and shared beginnings.

    The second array holds how many bytes each string shares with the one before it; -1 where
    a group begins.
    """
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order = np.argsort(groups, kind="stable")
    shared = np.full(n, width, np.int64)
    starts = np.ones(n, bool)
    starts[1:] = np.diff(groups[order]) != 0
    shared[starts] = -1
    # Runs of strings alike so far; each pass parts them by their next word.
    for at in range(min(-(-shallow // 8), words.shape[1])):
        run = np.cumsum(starts)
        alone = starts & np.append(starts[1:], True)
        open_places = np.flatnonzero(~alone)
        if not len(open_places):
            return order, shared
        here = order[open_places]
        word = words[here, at]
        by_word = np.lexsort((word, run[open_places]))
        order[open_places] = here[by_word]
        word = word[by_word]
        parted = ~starts[open_places][1:] & (word[1:] != word[:-1])
        places = open_places[1:][parted]
        differing = word[1:][parted] ^ word[:-1][parted]
        shared[places] = 8 * at + leading_zero_bytes(differing)
        starts[places] = True
    shared[~starts] = width
    bounds = np.append(np.flatnonzero(starts), n)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        if last - first > 1:
            members = order[first:last]
            by_trie, alike = BlindTrie([rows[i].tobytes() for i in members]).in_order()
            order[first:last] = members[by_trie]
            shared[first + 1 : last] = alike[1:]
    return order, shared


def leading_zero_bytes(values: np.ndarray) -> np.ndarray:
    """Zero bytes at the high end of 64-bit numbers that are not 0."""
    count = np.zeros(len(values), np.int64)
    for size in range(1, 8):
        count += values < np.uint64(1) << np.uint64(64 - 8 * size)
    return count
