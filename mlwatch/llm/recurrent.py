"""A gated recurrent language model in numpy, with a softmax over classes and one over the words of a class."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

HIDDEN = 32
STEPS = 24
TRAIN_LANES = 192
SCORE_LANES = 256
SCORE_STEPS = 64
FAR = 80.0
BLOCK = 1 << 14


@dataclass
class Layout:
    """Symbols 0 ... words-1 are words with a place of their own, the end among them; ``groups`` more stand for all others.

    Words come in order of frequency, and class ``c`` holds those from ``cuts[c]`` to ``cuts[c + 1]``. Each group is a class
    without words.
    """

    words: int
    groups: int
    cuts: np.ndarray
    classes: np.ndarray = field(init=False)

    def __post_init__(self):
        sizes = np.diff(self.cuts)
        self.classes = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), len(sizes) + np.arange(self.groups)])

    @staticmethod
    def by_frequency(counts: np.ndarray, groups: int, classes: int = 40) -> Layout:
        """Classes of about equal sums of roots of counts: few frequent words, many rare ones."""
        root = np.sqrt(np.maximum(counts, 1))
        share = np.minimum((np.cumsum(root) - root) / root.sum() * classes, classes - 1).astype(int)
        cuts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1], [True]]))
        return Layout(len(counts), groups, cuts)


def softmax(logits: np.ndarray, rows: np.ndarray, at: np.ndarray, ones: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the place ``at`` in each row, and exponentials (in place of ``logits``) with their sums by row.

    Rows are shifted by their largest logit only where one is so far from 0 that exponentials could overflow or vanish;
    ``near`` says that none is.
    """
    if not near and logits.size and not (logits.max() < FAR and logits.min() > -FAR):
        logits -= logits.max(axis=1, keepdims=True)
    got = logits[rows, at]
    e = np.exp(logits, out=logits)
    s = e @ ones[: e.shape[1]]
    got -= np.log(s)
    return got, e, s


class Network:
    """Gate inputs by symbol, recurrent weights, class and word weights; all in 32 bits."""

    NAMES = ("x", "u", "wc", "bc", "wo", "bo")

    def __init__(self, layout: Layout, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = layout.words + layout.groups
        c = len(layout.cuts) - 1 + layout.groups
        self.layout, self.hidden = layout, hidden
        self.x = rng.normal(0, 0.1, (n, 3 * hidden)).astype(np.float32)
        self.u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)).astype(np.float32)
        self.wc = rng.normal(0, 0.1, (hidden, c)).astype(np.float32)
        self.bc = np.zeros(c, np.float32)
        self.wo = rng.normal(0, 0.1, (layout.words, hidden)).astype(np.float32)
        self.bo = np.zeros(layout.words, np.float32)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, np.array(flat[at : at + old.size], np.float32).reshape(old.shape))
            at += old.size
        return self

    def start(self, counts: np.ndarray, group_counts: np.ndarray) -> Network:
        """Let the untrained outputs have the words' frequencies."""
        both = np.concatenate([counts, group_counts]).astype(np.float64) + 1.0
        self.bo = np.log(both[: self.layout.words]).astype(np.float32)
        per_class = np.bincount(self.layout.classes, weights=both, minlength=len(self.bc))
        self.bc = np.log(per_class / per_class.sum()).astype(np.float32)
        return self

    def unroll(self, ids: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States after each step of (steps, lanes), from the states before; ``fresh`` lanes start a document at the step.

        Every gate has arrays of its own, one behind the other in memory: rows that are parts of wider ones cost some four times as much.
        """
        k, dtype = self.hidden, self.u.dtype
        inputs = self.x.reshape(-1, 3, k).transpose(1, 0, 2).copy()
        weights = self.u.reshape(k, 3, k).transpose(1, 0, 2).copy()
        for w in (inputs, weights):
            np.negative(w[:2], out=w[:2])  # the first two gates need exp(-input)
        out = np.empty((*ids.shape, k), dtype)
        spare = np.empty((3, ids.shape[1], k), dtype)
        any_fresh = fresh.any(axis=1)
        for t in range(len(ids)):
            if any_fresh[t]:
                h = h.copy()
                h[fresh[t]] = 0
            a = np.matmul(h, weights[:2], out=spare[:2])
            zr = inputs[:2].take(ids[t], axis=1)
            zr += a
            np.exp(zr, out=zr)
            zr += dtype.type(1)
            np.divide(dtype.type(1), zr, out=zr)
            z, r = zr
            an = np.matmul(h, weights[2])
            n = r * an
            n += inputs[2].take(ids[t], axis=0, out=spare[2], mode="clip")
            np.tanh(n, out=n)
            new = np.subtract(h, n, out=out[t])
            new *= z
            new += n
            if keep is not None:
                keep.append((h, z, r, n, an))
            h = new
        return out, h

    def loss(self, states: np.ndarray, targets: np.ndarray, gradients: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each target symbol given its state, by class and then by word; adds to ``gradients``."""
        layout = self.layout
        cls = layout.classes[targets]
        logits = states @ self.wc
        logits += self.bc
        rows, ones = np.arange(len(targets)), np.ones(max(len(targets), logits.shape[1], layout.words), logits.dtype)
        # states are within -1 and 1, which bounds the logits
        near = all(np.max(np.abs(w).sum(axis=axis) + np.abs(b), initial=0) < FAR for w, b, axis in ((self.wc, self.bc, 0), (self.wo, self.bo, 1)))
        near = near and float(np.max(np.abs(states), initial=0)) <= 1
        out, e, s = softmax(logits, rows, cls, ones, near)
        back = None
        if gradients is not None:
            e /= s[:, None]
            e[rows, cls] -= 1.0
            gradients["wc"] += states.T @ e
            gradients["bc"] += ones[: len(e)] @ e
            back = e @ self.wc.T
        order = np.argsort(cls.astype(np.uint8 if len(self.bc) < 256 else np.int64), kind="stable")
        ends = np.searchsorted(cls[order], np.arange(len(layout.cuts)))
        # rows in the order of their classes, so that each class is a slice
        order = order[: ends[-1]]
        sorted_states, sorted_targets = states[order], targets[order]
        words, steps = np.zeros(len(order), out.dtype), None if back is None else np.zeros_like(sorted_states)
        for c in range(len(layout.cuts) - 1):
            own = slice(ends[c], ends[c + 1])
            a, b = layout.cuts[c], layout.cuts[c + 1]
            if ends[c] == ends[c + 1] or b - a == 1:
                continue
            h, w = sorted_states[own], self.wo[a:b]
            logits = h @ w.T
            logits += self.bo[a:b]
            at, place = sorted_targets[own] - a, rows[: len(h)]
            words[own], e, s = softmax(logits, place, at, ones, near)
            if gradients is not None:
                e /= s[:, None]
                e[place, at] -= 1.0
                gradients["wo"][a:b] += e.T @ h
                gradients["bo"][a:b] += ones[: len(e)] @ e
                np.matmul(e, w, out=steps[own])
        out[order] += words
        if back is not None:
            back[order] += steps
        return out, back

    def gradients(self, ids: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray):
        """Gradients of the negative log likelihood over one window, backward through its steps only, and the last states."""
        keep: list = []
        states, last = self.unroll(ids, fresh, h, keep)
        k = self.hidden
        g = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        flat = valid.reshape(-1)
        got, back = self.loss(*chosen(flat, states.reshape(-1, k), targets.reshape(-1)), g)
        if len(back) < len(flat):
            some, back = back, np.zeros((len(flat), k), states.dtype)
            back[flat] = some
        back = back.reshape(states.shape)
        d_in = np.empty((*ids.shape, 3 * k), states.dtype)
        da = np.empty((len(h), 3 * k), states.dtype)
        dh = np.zeros(h.shape, states.dtype)
        left, product, into = np.empty_like(dh), np.empty_like(dh), np.empty_like(dh)
        wide = np.ascontiguousarray(self.u.T)
        any_fresh = fresh.any(axis=1)
        for t in range(len(ids) - 1, -1, -1):
            before, z, r, n, an = keep[t]
            dz, dr, dn = da[:, :k], da[:, k : 2 * k], da[:, 2 * k :]
            dh += back[t]
            np.subtract(1, z, out=left)
            np.subtract(before, n, out=product)
            product *= dh
            product *= z
            np.multiply(product, left, out=dz)
            left *= dh
            np.multiply(n, n, out=product)
            np.subtract(1, product, out=product)
            left *= product
            np.multiply(left, an, out=product)
            product *= r
            np.subtract(1, r, out=into)
            np.multiply(product, into, out=dr)
            dn[...] = left
            d_in[t] = da
            np.multiply(left, r, out=dn)
            g["u"] += before.T @ da
            dh *= z
            dh += np.matmul(da, wide, out=into)
            if any_fresh[t]:
                dh[fresh[t]] = 0
        rows, sums = sums_by_id(ids.reshape(-1), d_in.reshape(-1, 3 * k))
        g["x"][rows] += sums
        return g, last, float(got.sum()), int(flat.sum())


def sums_by_id(ids: np.ndarray, rows: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows.

    The first rows of all ids are added at once, then the second rows, and so on; ids with more than ``few`` rows are summed singly.
    """
    ones = np.ones(len(ids), rows.dtype)
    order = np.argsort(ids.astype(np.uint16) if ids.max(initial=0) < 1 << 16 else ids, kind="stable")
    own = ids[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])[: len(own)])
    size = np.diff(first, append=len(own))
    by_size = np.argsort(-size, kind="stable")
    first, size = first[by_size], size[by_size]
    sums = rows[order[first]]
    many = int(np.searchsorted(-size, -few, "left"))
    for i in range(many):
        sums[i] = ones[: size[i]] @ rows[order[first[i] : first[i] + size[i]]]
    for j in range(1, few):
        to = int(np.searchsorted(-size, -j, "left"))
        if to <= many:
            break
        sums[many:to] += rows[order[first[many:to] + j]]
    return own[first], sums


def chosen(flags: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """The flagged rows of arrays; the arrays themselves where all are."""
    return list(arrays) if flags.all() else [x[flags] for x in arrays]


def lanes(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first step of every document, longest documents first into the shortest lane, and the lanes' lengths.

    Lanes are numbered from the longest to the shortest, so that those still busy at a step are the first ones.
    """
    count = min(most, len(lengths))
    heap = [(0, i) for i in range(count)]
    lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    total = np.zeros(count, np.int64)
    for d in np.argsort(-lengths, kind="stable").tolist():
        size, i = heapq.heappop(heap)
        lane[d], at[d] = i, size
        total[i] = size + lengths[d]
        heapq.heappush(heap, (int(total[i]), i))
    order = np.argsort(-total, kind="stable")
    place = np.empty(count, np.int64)
    place[order] = np.arange(count)
    return place[lane], at, total[order]


def windows(symbols: np.ndarray, offsets: np.ndarray, end: int, most: int, steps: int) -> tuple[int, int, Iterator[tuple[np.ndarray, ...]]]:
    """Number of lanes and of windows, and inputs, targets, starts and documents of each window as (steps, busy lanes).

    A document's inputs are the end and its words, its targets its words and the end. Lanes lie one behind the other, so that
    besides the symbols themselves only one window is in memory, however unlike the lengths are. Document -1 is none.
    """
    size = np.diff(offsets) + 1
    lane, at, total = lanes(size, most)
    base = np.cumsum(total) - total
    start = base[lane] + at
    order = np.argsort(start)
    flat = np.full(int(total.sum()) + 1, end, np.int32)  # a target is the next input: after a document comes an end
    doc = np.repeat(order.astype(np.int32), size[order])
    for d in order.tolist():
        flat[start[d] + 1 : start[d] + size[d]] = symbols[offsets[d] : offsets[d + 1]]
    fresh = np.zeros(len(doc), bool)
    fresh[start] = True

    def each() -> Iterator[tuple[np.ndarray, ...]]:
        for t in range(0, int(total[0]), steps):
            busy = int(np.searchsorted(-total, -t, "left"))
            step = np.arange(t, min(t + steps, int(total[0])))[:, None]
            inside = step < total[:busy]
            cell = np.where(inside, base[:busy] + step, 0)
            yield flat[cell], flat[cell + 1], fresh[cell] & inside, np.where(inside, doc[cell], np.int32(-1))

    return len(total), -(-int(total[0]) // steps), each()


def log_likelihood(net: Network, symbols: np.ndarray, offsets: np.ndarray, end: int, most: int = SCORE_LANES) -> np.ndarray:
    """Natural log probability of each whole document; states go from one window to the next."""
    n = len(offsets) - 1
    if not n:
        return np.zeros(0)
    count, _, parts = windows(symbols, offsets, end, most, SCORE_STEPS)
    out = np.zeros(n)
    h = np.zeros((count, net.hidden), np.float32)
    for ids, targets, fresh, doc in parts:
        states, h = net.unroll(ids, fresh, h[: ids.shape[1]])
        own = doc.reshape(-1)
        flat = own >= 0
        own, *pair = chosen(flat, own, states.reshape(-1, net.hidden), targets.reshape(-1))
        got, _ = net.loss(*pair)
        out += np.bincount(own, weights=got, minlength=n)
    return out


def fit(net: Network, symbols: np.ndarray, offsets: np.ndarray, end: int, rate: float, decay: float, seed: int = 3) -> Network:
    """One pass of truncated backpropagation over documents, with Adam steps; states carry over windows, gradients don't."""
    n = len(offsets) - 1
    if not n:
        return net
    count, rounds, parts = windows(symbols, offsets, end, TRAIN_LANES, STEPS)
    m = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    v = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
    h = np.zeros((count, net.hidden), np.float32)
    for i, (ids, targets, fresh, doc) in enumerate(parts):
        g, h, _, count = net.gradients(ids, targets, fresh, doc >= 0, h[: ids.shape[1]])
        step = rate * (1.0 - (1.0 - decay) * i / rounds)
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values())) / count
        scale = np.float32(0.1 * min(1.0, 1.0 / max(norm, 1e-9)) / count)
        fix = np.float32(step * np.sqrt(1 - 0.99 ** (i + 1)) / (1 - 0.9 ** (i + 1)))
        for k in net.NAMES:
            whole = [x.reshape(-1) for x in (g[k], m[k], v[k], getattr(net, k))]
            for at in range(0, whole[0].size, BLOCK):
                own, mean, square, weight = (x[at : at + BLOCK] for x in whole)
                own *= scale  # holds a tenth, whose square is the hundredth that the mean square takes
                mean *= np.float32(0.9)
                mean += own
                own *= own
                square *= np.float32(0.99)
                square += own
                np.sqrt(square, out=own)
                own += np.float32(1e-7)
                np.divide(mean, own, out=own)
                own *= fix
                weight -= own
    return net
