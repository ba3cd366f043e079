"""Double-array tries over sequences of words, and the walk of all positions of a text through one at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

DENSE = 16
TRIES = 40


@dataclass
class Trie:
    """A child of the state ``s`` by the digit ``x`` lies in the cell ``base[s] + x`` if ``check`` of that cell is ``s``.

    The root is cell 0. A word is two digits, the halves of its place in ``labels``, so that no state has many children.
    ``accept`` has the row of ``sequences`` that ends in a state, or -1. ``sequences`` lists the words' places, -1 after the end.
    """

    labels: np.ndarray
    bits: int
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    sequences: np.ndarray

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in ``labels``, or -1."""
        if not len(self.labels):
            return np.full(len(words), -1, np.int32)
        at = np.searchsorted(self.labels, words)
        at[at == len(self.labels)] = 0
        return np.where(self.labels[at] == words, at, -1).astype(np.int32)

    def step(self, state: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.base[state] + digit
        return self.check[cell] == state, cell

    def accepted(self, ids: np.ndarray, piece: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of the sequences that begin at each position and stay inside its piece, length by length."""
        for _, ends in self.walked(ids, piece, np.arange(len(ids))):
            yield ends

    def walked(self, ids: np.ndarray, piece: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of the sequences that begin at the sorted positions ``at`` and stay inside a piece, length by length: where, and their rows.

        The states of all positions move on together; those without a next state leave.
        """
        at = at[ids[at] >= 0]
        state = np.zeros(len(at), np.int32)
        for d in range(self.sequences.shape[1]):
            at, state = (x[at + d < len(ids)] for x in (at, state))
            follows = (ids[at + d] >= 0) & (piece[at + d] == piece[at])
            at, state = at[follows], state[follows]
            found, cell = self.step(state, ids[at + d] >> self.bits)
            at, state = at[found], cell[found]
            found, cell = self.step(state, ids[at + d] & ((1 << self.bits) - 1))
            at, state = at[found], cell[found]
            if not len(at):
                return
            ends = self.accept[state]
            yield at[ends >= 0], ends[ends >= 0]


def placed(parent: np.ndarray, label: np.ndarray, span: int) -> tuple[np.ndarray, int]:
    """A base for every parent, so that no two children share a cell, and the number of cells. Edges are sorted by parent.

    States with many children get a block of their own; the others are tried at random places, the larger ones first, and
    go where all their cells are free; single children fill what is left.
    """
    rng = np.random.default_rng(1)
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]])) if len(parent) else np.empty(0, np.int64)
    count = np.diff(np.append(first, len(parent)))
    base = np.zeros(len(first), np.int64)
    dense = np.flatnonzero(count > DENSE)
    begin, end = label[first[dense]], label[first[dense] + count[dense] - 1]
    width = end - begin + 1
    base[dense] = span + np.concatenate([[0], np.cumsum(width)[:-1]])[: len(dense)] - begin
    size = int(span + width.sum() + 2 * count[count <= DENSE].sum() + 2 * span)
    taken = np.zeros(size, bool)
    taken[:span] = True
    rows = np.repeat(np.arange(len(first)), count)
    taken[(base[rows] + label)[np.isin(rows, dense)]] = True
    claim = np.full(size, -1, np.int64)
    for c in range(DENSE, 1, -1):
        left = np.flatnonzero(count == c)
        tries = 0
        while len(left):
            tries += 1
            if tries % TRIES == 0:
                taken = np.concatenate([taken, np.zeros(size // 4, bool)])
                claim = np.concatenate([claim, np.full(size // 4, -1, np.int64)])
                size = len(taken)
            at = rng.integers(span, size - span, len(left))
            cells = at[:, None] + label[first[left][:, None] + np.arange(c)]
            claim[cells] = left[:, None]
            fits = ((claim[cells] == left[:, None]) & ~taken[cells]).all(axis=1)
            base[left[fits]] = at[fits]
            taken[cells[fits]] = True
            left = left[~fits]
    single = np.flatnonzero(count == 1)
    free = np.flatnonzero(~taken[2 * span :]) + 2 * span
    if len(free) < len(single):
        free = np.append(free, np.arange(size, size + len(single) - len(free)))
    base[single] = free[: len(single)] - label[first[single]]
    return base, max(size, int(free[len(single) - 1]) + 1 if len(single) else 0) + span


def trie(words: np.ndarray) -> Trie:
    """The trie of sequences of words, one in a row, given as 64-bit hashes with 0 after a sequence's end."""
    labels = np.unique(words[words != 0])
    used = words != 0
    ids = np.where(used, np.searchsorted(labels, words), -1).astype(np.int32)
    bits = max(1, (max(1, len(labels) - 1).bit_length() + 1) // 2)
    sequences = ids[np.lexsort(ids.T[::-1])]
    digits = np.stack([sequences >> bits, np.where(sequences < 0, -1, sequences & ((1 << bits) - 1))], axis=2).reshape(len(ids), 2 * ids.shape[1])
    # prefixes of sorted rows are neighbours: a state begins where a row's first digits differ from the row before
    differs = np.ones(digits.shape, bool)
    differs[1:] = np.logical_or.accumulate(digits[1:] != digits[:-1], axis=1)
    node, n = np.zeros(digits.shape, np.int64), 1
    parents, labels_of, states = [], [], []
    for d in range(digits.shape[1]):
        new = differs[:, d] & (digits[:, d] >= 0)
        node[:, d] = np.cumsum(new) + n - 1
        parents.append(node[new, d - 1] if d else np.zeros(new.sum(), np.int64))
        labels_of.append(digits[new, d])
        states.append(node[new, d])
        n += int(new.sum())
    parent, label, state = (np.concatenate(x) for x in (parents, labels_of, states))
    order = np.lexsort((label, parent))
    parent, label, state = parent[order], label[order], state[order]
    base, size = placed(parent, label, 1 << bits)
    owners, row = np.unique(parent, return_inverse=True)
    cell = np.zeros(n, np.int64)
    cell[state] = base[row] + label
    out = Trie(labels, bits, np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), sequences)
    out.base[cell[owners]] = base
    out.check[cell[state]] = cell[parent]
    length = (digits >= 0).sum(axis=1)
    if len(sequences):
        out.accept[cell[node[np.arange(len(node)), length - 1]]] = np.arange(len(node))
    return out
