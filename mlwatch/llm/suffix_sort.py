"""Suffix order of a text by induction from its S* suffixes, level by level, with runs on disk where memory is short."""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

RUN = 4_000_000


class Level:
    """One level of the recursion: a string of symbols, its S* positions, and tuples that stand for its suffixes.

    A suffix is of type S if it is smaller than the one after it, else L; S* positions are S ones after an L one. The tuple
    of a suffix is its symbols up to the next S* position, a mark above every symbol, and the rank of the S* suffix there.
    Tuples order as suffixes do: where one's symbols are the start of another's, the other goes on with an L suffix, which
    is smaller than the S* one. So sorting the S* suffixes, a third of all or less, induces the order of the rest.
    The last symbol must be a 0 that occurs nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        self.size = len(symbols)
        self.top = int(symbols.max()) + 1
        bits = max(1, int(self.top).bit_length())
        self.fit = max(1, 63 // bits)
        change = np.flatnonzero(symbols[1:] != symbols[:-1])
        rises = symbols[change + 1] > symbols[change]
        is_s = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
        is_s = np.concatenate([is_s, np.ones(self.size - len(is_s), bool)])
        self.stars = np.flatnonzero(np.concatenate([[False], is_s[1:] & ~is_s[:-1]]))
        self.next = np.full(self.size, self.size - 1, np.int64)
        ahead = np.searchsorted(self.stars, np.arange(self.size), "right")
        self.next[ahead < len(self.stars)] = self.stars[ahead[ahead < len(self.stars)]]
        padded = np.concatenate([symbols.astype(np.uint64), np.zeros(self.fit, np.uint64)])
        self.packed = np.zeros(self.size, np.uint64)
        for j in range(self.fit):
            self.packed = self.packed << np.uint64(bits) | padded[j : j + self.size]
        shift = [np.uint64(bits * (self.fit - m)) for m in range(self.fit + 1)]
        full = np.uint64((1 << bits * self.fit) - 1)
        self.mask = np.array([(full >> s << s) if int(s) < 64 else np.uint64(0) for s in shift], np.uint64)
        self.mark = np.array([np.uint64(self.top) << np.uint64(bits * (self.fit - m - 1)) if m < self.fit else np.uint64(0) for m in range(self.fit + 1)], np.uint64)

    def block(self, at: np.ndarray, k: int) -> np.ndarray:
        """The k-th few symbols of tuples, cut and marked at their ends."""
        left = np.clip(self.next[at] - at + 1 - k * self.fit, 0, self.fit)
        return self.packed[np.minimum(at + k * self.fit, self.size - 1)] & self.mask[left] | self.mark[left]

    def string_ranks(self, at: np.ndarray) -> np.ndarray:
        """For each position the number of positions whose tuples' symbols are smaller."""
        rank = firsts(self.block(at, 0))
        k = 1
        open_ = np.flatnonzero(self.next[at] - at + 1 >= self.fit)
        while len(open_):
            own = rank[open_]
            order = np.argsort(own, kind="stable")
            alone = np.ones(len(order), bool)
            same = own[order[1:]] == own[order[:-1]]
            alone[1:] &= ~same
            alone[:-1] &= ~same
            open_ = open_[order[~alone]]
            if not len(open_):
                break
            own, block = rank[open_], self.block(at[open_], k)
            order = np.lexsort((block, own))
            own, block = own[order], block[order]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            group = np.repeat(start, np.diff(np.append(start, len(own))))
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (block[1:] != block[:-1])]))
            rank[open_[order]] = own + np.repeat(new, np.diff(np.append(new, len(own)))) - group
            k += 1
            open_ = open_[self.next[at[open_]] - at[open_] + 1 >= k * self.fit]
        return rank

    def star_ranks(self) -> np.ndarray:
        """Rank of each S* suffix among them: names of their tuples' symbols, and where names repeat, the next level."""
        at = self.stars
        names = self.string_ranks(at)
        names = np.where(at == self.size - 1, 0, names + 1)
        if len(np.unique(names)) == len(names):
            return np.argsort(np.argsort(names))
        dense = np.unique(names, return_inverse=True)[1]
        return Level(dense).ranks()

    def ranks(self) -> np.ndarray:
        """Rank of every suffix."""
        out = np.empty(self.size, np.int64)
        out[np.fromiter(self.order(np.arange(self.size)), np.int64, self.size) if self.size > RUN else self.sorted(np.arange(self.size))] = np.arange(self.size)
        return out

    def tails(self) -> np.ndarray:
        found = getattr(self, "_tails", None)
        if found is None:
            found = np.zeros(self.size, np.int64)
            if len(self.stars):
                found[self.stars] = self.star_ranks()
            self._tails = found
        return found

    def sorted(self, at: np.ndarray) -> np.ndarray:
        """The positions in the order of their suffixes."""
        return at[np.lexsort((self.tails()[self.next[at]], self.string_ranks(at)))]

    def order(self, at: np.ndarray) -> Iterator[int]:
        """As ``sorted``, position by position: sorted runs wait on disk, and a queue holds the smallest tuple of each.

        A tuple's rank depends on the whole level, so runs are cut from ranks that are kept on disk as well.
        """
        with tempfile.TemporaryDirectory() as folder:
            strings = np.memmap(f"{folder}/strings", np.int64, "w+", shape=len(at))
            strings[:] = self.string_ranks(at)
            tails = self.tails()

            def run(begin: int) -> Iterator[tuple[int, int, int]]:
                own, key = at[begin : begin + RUN], strings[begin : begin + RUN]
                tail = tails[self.next[own]]
                order = np.lexsort((tail, key))
                held = np.memmap(f"{folder}/run{begin}", np.int64, "w+", shape=(len(own), 3))
                held[:, 0], held[:, 1], held[:, 2] = key[order], tail[order], own[order]
                for i in range(0, len(own), 8192):
                    yield from map(tuple, held[i : i + 8192].tolist())

            for _, _, i in heapq.merge(*[run(b) for b in range(0, len(at), RUN)]):
                yield i


def firsts(keys: np.ndarray) -> np.ndarray:
    """For each key the number of smaller ones."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(new, np.diff(np.append(new, len(own))))
    return out


def suffix_order(symbols: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """``wanted`` positions of a string of symbols above 0, ordered by the suffixes that start there."""
    level = Level(np.concatenate([symbols, np.zeros(1, symbols.dtype)]))
    if len(wanted) > RUN:
        return np.fromiter(level.order(wanted), np.int64, len(wanted))
    return level.sorted(wanted)
