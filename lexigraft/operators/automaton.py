"""A trie over vocabulary pieces in flat arrays, searched for all places of many words at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

# Bits of a code point.
CODE_BITS = 21
# States 0 and 1 are roots: for pieces that start a word or stand anywhere, and for those behind its first character.
ROOTS = 2


def code_points(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all words in one array, where each word starts in it, and its length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    return codes, np.cumsum(size) - size, size


@dataclass
class Automaton:
    """Edges sorted by (state, code point); the edge at position ``e`` leads to state ``e + ROOTS``.

    States are numbered by depth, so the edges of a depth are one slice between two ``levels``. ``ends``
    has the piece that ends at a state, or -1. Edges take 12 bytes each, and common prefixes share theirs.
    """

    keys: np.ndarray
    levels: list[int]
    ends: np.ndarray

    @staticmethod
    def build(pieces: Sequence[str], roots: Sequence[int]) -> Automaton:
        """Of equal pieces under one root the last one counts; empty pieces are never found."""
        codes, first, size = code_points(pieces)
        state = np.asarray(roots, dtype=np.int64).copy()
        keys, levels, ends = [np.zeros(0, np.int64)], [0], [np.full(ROOTS, -1, np.int32)]
        alive, depth = np.flatnonzero(size > 0), 0
        while len(alive):
            found, place = np.unique((state[alive] << CODE_BITS) | codes[first[alive] + depth], return_inverse=True)
            state[alive] = ROOTS + levels[-1] + place
            done = size[alive] == depth + 1
            end = np.full(len(found), -1, np.int32)
            end[place[done]] = alive[done]
            keys.append(found)
            ends.append(end)
            levels.append(levels[-1] + len(found))
            alive, depth = alive[~done], depth + 1
        return Automaton(np.concatenate(keys), levels, np.concatenate(ends))

    def search(self, codes: np.ndarray, at: np.ndarray, room: np.ndarray, state: np.ndarray) -> Iterator[tuple]:
        """``(length, places, pieces)`` for each length in rising order: the pieces that start at ``at``.

        ``room`` is the number of code points up to the end of the word, ``state`` the root to start from. A
        place is followed only as long as some piece goes on, so the work is bounded by places times
        the longest piece, whatever the words are.
        """
        for depth, (low, high) in enumerate(zip(self.levels, self.levels[1:])):
            inside = room > depth
            at, room, state = at[inside], room[inside], state[inside]
            level = self.keys[low:high]
            key = (state << CODE_BITS) | codes[at + depth]
            edge = np.minimum(np.searchsorted(level, key), len(level) - 1)
            goes = level[edge] == key
            at, room, state = at[goes], room[goes], edge[goes] + (low + ROOTS)
            if not len(at):
                return
            piece = self.ends[state]
            is_end = piece >= 0
            yield depth + 1, at[is_end], piece[is_end]
