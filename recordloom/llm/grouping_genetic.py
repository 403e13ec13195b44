"""Bin packing of one block of items by a grouping genetic algorithm, in numpy.

A solution is an array with the bin of each item. The first population best-fits the
items in orders that are only roughly falling. Crossover injects whole well-filled bins of
one parent into the other and removes the bins that hold the same items; displaced items
then take the place of one or two items of a bin where that fills it better, and what is
left is best-fitted, longest first. Fewer bins are better; among as many, those with
fuller bins (sum of squared fills).
"""

from __future__ import annotations

from bisect import bisect
from functools import lru_cache

import numpy as np

POPULATION = 6
CHILDREN = 40
PATIENCE = 8  # children in a row that don't save a bin, after which an epoch ends
SEED_NOISE = (0.01, 0.02)  # of the first seed, and what each further one has more
LOOSE = 64  # displaced items that are tried in pairs at a time
REFILLS = 3
PAIRED = 5  # items of a bin that are tried in pairs
INJECTED = 0.05
DISSOLVED = 0.05
WELL_FILLED = 0.995
NOISE = 0.05


def best_fit(lengths: np.ndarray, order: np.ndarray, bins: np.ndarray, fills: list[int], capacity: int) -> None:
    """Puts the items of ``order`` into the fullest bins that hold them; opens bins where none does."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for b, fill in enumerate(fills):
        if fill < capacity:
            free[capacity - fill].append(b)
            mask |= 1 << (capacity - fill)
    for item, need in zip(order.tolist(), lengths[order].tolist()):
        fitting = mask >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[item] = b
        fills[b] += need
        if room > need:
            free[room - need].append(b)
            mask |= 1 << (room - need)


def cost(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Number of bins and, as a tie-break, minus the mean squared fill."""
    if not len(bins):
        return 0, 0.0
    fills = np.bincount(bins, weights=lengths)
    return len(fills), -float(((fills / capacity) ** 2).mean())


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can beat: the total length over the capacity, and the items longer than half of it."""
    return max(-(-int(lengths.sum()) // capacity), int((2 * lengths > capacity).sum()))


def _decreasing(lengths: np.ndarray, noise: float, drawn: np.random.Generator) -> np.ndarray:
    return np.argsort(-(lengths * (1 + noise * drawn.random(len(lengths)))), kind="stable")


@lru_cache(LOOSE + 1)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def refill(lengths: np.ndarray, members: list[list[int]], fills: np.ndarray, loose: list[int], capacity: int, drawn: np.random.Generator) -> list[int]:
    """Puts displaced items in place of one or two items of a bin, never more than there are, where that
    fills the bin better; gives the items that are displaced then. ``fills`` belongs to ``members``; both are changed."""
    size = lengths.tolist()
    loose = sorted(loose, key=size.__getitem__)
    rest = []
    if len(loose) > LOOSE:
        chosen = set(drawn.choice(len(loose), LOOSE, replace=False).tolist())
        rest = [x for i, x in enumerate(loose) if i not in chosen]
        loose = [x for i, x in enumerate(loose) if i in chosen]
    small = np.uint16 if 2 * capacity < 2**16 else np.int64  # 16-bit numbers are sorted by their digits

    def sums():
        held = np.array([size[x] for x in loose], small)
        a, b = _pairs(len(loose))
        both = held[a] + held[b]
        order = np.argsort(both, kind="stable")
        return held.tolist(), both[order].tolist(), order

    if not loose:
        return rest
    held, both, order = sums()
    visited = drawn.permutation(len(members))
    visited = visited[fills[visited] < capacity]
    for m, room in zip(visited.tolist(), (capacity - fills[visited]).tolist()):
        mine = members[m]
        best = (0, None, None)
        for i, x in enumerate(mine[:PAIRED]):
            if best[0] == room:  # full: no later choice is better
                break
            at = bisect(held, size[x] + room) - 1
            if at >= 0 and held[at] - size[x] > best[0]:
                best = (held[at] - size[x], (i,), (at,))
            for j in range(i + 1, min(len(mine), PAIRED)):
                if best[0] == room:
                    break
                out = size[x] + size[mine[j]]
                at = bisect(both, out + room) - 1
                if at >= 0 and both[at] - out > best[0]:
                    best = (both[at] - out, (i, j), tuple(int(p[order[at]]) for p in _pairs(len(loose))))
        if best[1]:
            gone, come = [mine[i] for i in best[1]], [loose[k] for k in best[2]]
            members[m] = [x for x in mine if x not in gone] + come
            fills[m] += best[0]
            loose = sorted([x for x in loose if x not in come] + gone, key=size.__getitem__)
            held, both, order = sums()
    return loose + rest


def crossover(mine: np.ndarray, theirs: np.ndarray, lengths: np.ndarray, capacity: int, drawn: np.random.Generator) -> np.ndarray:
    """A child of two parents, as described above; the emptiest bins, and some others that are not full, are dissolved too."""
    fills = np.bincount(theirs, weights=lengths)
    injected = ((fills >= WELL_FILLED * capacity) & (drawn.random(len(fills)) < INJECTED))[theirs]
    own = np.bincount(mine, weights=lengths)
    removed = np.zeros(len(own), dtype=bool)
    removed[mine[injected]] = True
    emptiest = max(1, int(DISSOLVED * len(own)))
    removed[np.argpartition(own, emptiest - 1)[:emptiest]] = True
    open_ = np.flatnonzero(own < capacity)
    removed[open_[drawn.random(len(open_)) < 2 * DISSOLVED]] = True
    displaced = removed[mine] & ~injected
    kept = np.flatnonzero(~displaced)
    bins = np.where(injected, theirs + len(own), mine)[kept]
    order = np.argsort(bins, kind="stable")
    flat, starts = kept[order].tolist(), [0, *(np.flatnonzero(np.diff(bins[order])) + 1).tolist(), len(kept)]
    members = [flat[a:b] for a, b in zip(starts, starts[1:])] if len(kept) else []
    placed = np.add.reduceat(lengths[kept[order]], starts[:-1]).astype(np.int64) if len(kept) else np.zeros(0, np.int64)
    loose = np.flatnonzero(displaced).tolist()
    for _ in range(REFILLS):
        loose = refill(lengths, members, placed, loose, capacity, drawn)
    loose = np.array(loose, np.int64)
    child = np.full(len(lengths), -1, dtype=mine.dtype)
    child[[x for items in members for x in items]] = np.repeat(np.arange(len(members)), [len(items) for items in members])
    best_fit(lengths, loose[_decreasing(lengths[loose], NOISE, drawn)], child, placed.tolist(), capacity)
    return child


def evolve(lengths: np.ndarray, capacity: int, population: list[np.ndarray], seed: list[int], children: int = CHILDREN) -> list[np.ndarray]:
    """One island's generations from ``population`` (may be empty); the result is sorted, the best solution first.

    It ends early where the number of bins has reached ``least_bins``, or stays for PATIENCE children.
    """
    drawn = np.random.default_rng(seed)
    bound = least_bins(lengths, capacity)
    while len(population) < POPULATION:
        bins, fills = np.full(len(lengths), -1, dtype=np.int32), []
        best_fit(lengths, _decreasing(lengths, SEED_NOISE[0] + SEED_NOISE[1] * len(population), drawn), bins, fills, capacity)
        population = [*population, bins]
    scored = sorted(((cost(p, lengths, capacity), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    fewest, since = scored[0][0][0], 0
    for n in range(children):
        if scored[0][0][0] <= bound or len(scored) < 2 or since >= PATIENCE:
            break
        a, b = (int(x) for x in np.sort(drawn.choice(len(scored), 2, replace=False)))
        child = crossover(scored[a][2], scored[b][2], lengths, capacity, drawn).astype(np.int32)
        scored.append((cost(child, lengths, capacity), POPULATION + n, child))
        scored = sorted(scored, key=lambda x: x[:2])[:POPULATION]
        fewest, since = (scored[0][0][0], 0) if scored[0][0][0] < fewest else (fewest, since + 1)
    return [p for _, _, p in scored]
