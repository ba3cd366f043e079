"""Shortest ways through a lattice of turns by an auction: a path grows and shrinks while node prices rise."""

from __future__ import annotations

from functools import lru_cache
from math import inf

# What a row costs, and what stands for an edit in the audit: fixed values.
DELETE, REROLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
# What stands before a place: nothing, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
# The cheapest edits after the last row, by state.
ENDING = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))

Arc = tuple[int, int, str]


def initial_code(initial: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, START)


def arcs_of(codes: bytes) -> list[list[Arc]]:
    """(cost, next node, edit) from each node; node ``4 * i + state`` stands before row ``i``.

    A row's code is its initial (0 is none of s, u, a) plus 4 if it is truncated or 8 if it must go. Nothing is inserted after the last row:
    that place is the one before the next rows.
    """
    out: list[list[Arc]] = []
    for i, code in enumerate(codes):
        own, fault = code % STATES, code // STATES
        for state in range(STATES):
            then = ASSISTANT if state == USER else USER
            here = [(DELETE, STATES * (i + 1) + state, "D"), (INSERT, STATES * i + then, "I")]
            if fault < 2:
                more = LEFT_TRUNCATED * fault
                if own == then or (own == SYSTEM and state == START):
                    here.append((more, STATES * (i + 1) + own, "K"))
                if own != then:
                    here.append((REROLE + more, STATES * (i + 1) + then, "R"))
            out.append(here)
    return [*out, *([] for _ in range(STATES))]


def auction(arcs: list[list[Arc]], price: list[float], origin: int, sink: int, most: float) -> float:
    """The least cost from ``origin`` to ``sink``; infinite if there is no way that costs at most ``most``.

    ``price`` must not exceed an arc's cost plus the price of its end, and doesn't afterwards; prices of an
    earlier origin serve the next one. The path's last node is raised to its cheapest arc: if that raises it, the path shrinks by
    the node, else it grows by the arc. Circles have positive costs, so that a path never meets itself.
    """
    path = [origin]
    while path[-1] != sink:
        i = path[-1]
        best, to = inf, -1
        for cost, j, _ in arcs[i]:
            if cost + price[j] < best:
                best, to = cost + price[j], j
        if best > most:
            best = inf
        if price[i] < best:
            price[i] = best
            if i != origin:
                path.pop()
        elif to < 0 or best == inf:
            return inf
        else:
            path.append(to)
    return price[origin] - price[sink]


@lru_cache(maxsize=20_000)
def costs(codes: bytes) -> tuple[tuple[float, ...], ...]:
    """The least cost through some rows from each state before them to each state after them."""
    arcs, end = arcs_of(codes), STATES * len(codes)
    most = (REROLE + LEFT_TRUNCATED) * len(codes) + 2 * INSERT
    out = [[inf] * STATES for _ in range(STATES)]
    for after in range(STATES):
        price = [0.0] * len(arcs)
        for before in range(STATES):
            out[before][after] = auction(arcs, price, before, end + after, most)
    return tuple(map(tuple, out))


@lru_cache(maxsize=20_000)
def cheapest(codes: bytes, before: int, after: tuple[float, ...]) -> tuple[str, int]:
    """The cheapest edits of some rows, as initials, from a state to one whose later cost is ``after``; of equal ones
    the least initials, and the state that they lead to.

    Every cheapest way consists of tight arcs, whose cost is the difference of prices. Those that lead on to the end
    are followed, the least initial first.
    """
    arcs, end = arcs_of(codes), STATES * len(codes)
    sink = end + STATES
    for state, cost in enumerate(after):
        if cost < inf:
            arcs[end + state].append((cost, sink, ""))
    arcs.append([])
    price = [0.0] * len(arcs)
    most = (REROLE + LEFT_TRUNCATED) * len(codes) + 2 * INSERT + max(c for c in after if c < inf)
    auction(arcs, price, before, sink, most)
    tight = [[(edit, j) for cost, j, edit in own if price[i] < inf and cost + price[j] == price[i]] for i, own in enumerate(arcs)]
    back: list[list[int]] = [[] for _ in arcs]
    for i, own in enumerate(tight):
        for _, j in own:
            back[j].append(i)
    leads, todo = {sink}, [sink]
    while todo:
        for i in back[todo.pop()]:
            if i not in leads:
                leads.add(i)
                todo.append(i)
    edits, at = [], before
    while True:
        edit, j = min(x for x in tight[at] if x[1] in leads)
        if j == sink:
            return "".join(edits), at - end
        edits.append(edit)
        at = j
