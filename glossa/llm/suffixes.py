"""Suffix and longest-common-prefix arrays by external induced sorting, in one task and a stated number of symbols of memory.

A string of numbers ends with its only 0. A suffix is small (S) if it is below the one that follows it, else large (L); an S
suffix after an L one is a seed. From the seeds in order, a queue hands out suffixes in order and takes those that stand one
place before them: first L suffixes upwards, then S suffixes downwards. The tuples in the queue are (symbol, place, common
prefix with the tuple of that symbol before it), ordered by symbol and arrival. Common prefixes are induced as well: one more
than the least common prefix of all that was handed out between the two sources.

1. Seeds in any order, those of one symbol taken as equal: that sorts the pieces between seeds and names them, equal pieces alike.
2. The string of names is sorted by the same function (recursion), or by doubling once it fits in memory.
3. Seeds in the order of their names' suffixes: that sorts all suffixes.

On disk (unlinked scratch files, gone with the process): queues' buckets, text, types, results, of strings above `memory`
symbols. In memory: batches, and queue buckets being handed out. A batch is as long as none of its own tuples belongs inside.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from math import isqrt

import numpy as np

#: Symbols that may be sorted in memory.
MEMORY = 1 << 21
#: Stands for "equal as far as pieces go" in the first sort.
EQUAL = np.iinfo(np.int32).max
_FEW = 512


def scratch(n: int, kind: type | str, memory: int) -> np.ndarray:
    """n zeros; on disk if there are more than `memory`."""
    if n <= memory:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as f:
        return np.memmap(f, kind, "w+", shape=n)


def range_min(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """min(values[first:end]) for many ranges, none empty."""
    out = np.empty(len(first), values.dtype)
    level = np.frexp((end - first).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    ends = np.searchsorted(level[order], np.arange(int(level.max(initial=-1)) + 2))
    table = values
    for k in range(len(ends) - 1):
        at = order[ends[k] : ends[k + 1]]
        out[at] = np.minimum(table[first[at]], table[end[at] - (1 << k)])
        if k + 2 < len(ends):
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
    return out


def run_lengths(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often the symbol at each place stands there in a row."""
    out, open_ = np.ones(len(at), np.int64), np.arange(len(at))
    for step in range(1, 16):
        open_ = open_[at[open_] + step < len(x)]
        open_ = open_[x[at[open_] + step] == x[at[open_]]]
        if not len(open_):
            return out
        out[open_] += 1
    for k in open_.tolist():
        a, size = int(at[k]), 64
        z = a + int(out[k])
        while z < len(x):
            other = np.flatnonzero(x[z : z + size] != x[a])
            z, size = (z + int(other[0]), 0) if len(other) else (min(z + size, len(x)), 2 * size)
            if not size:
                break
        out[k] = z - a
    return out


class _Queue:
    """Tuples by symbol and, of one symbol, by arrival. Buckets of neighbouring symbols lie in one array in the order of symbols,
    each as long as its symbols' number of tuples, which is known; a bucket of one symbol is handed out as it lies, others are sorted."""

    def __init__(self, counts: np.ndarray, memory: int):
        total = int(counts.sum())
        before = np.cumsum(counts) - counts
        of = np.arange(len(counts)) if len(counts) <= _FEW else before // max(1024, 8 * isqrt(total))
        self.bucket = np.cumsum(np.diff(of, prepend=of[:1]) > 0)
        starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        self.single = np.diff(np.append(starts, len(counts))) == 1
        self.start, self.read, self.fill = before[starts], before[starts].copy(), before[starts].copy()
        self.store = tuple(scratch(total, k, memory) for k in (np.int32, np.int64, np.int32))
        self.fronts: dict[int, list[np.ndarray]] = {}
        self.left, self.low = 0, 0

    def push(self, symbols: np.ndarray, places: np.ndarray, common: np.ndarray) -> None:
        """Tuples in the order of their symbols."""
        if not len(symbols):
            return
        rows, of = (symbols, places, common), self.bucket[symbols]
        edges = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            b = int(of[a])
            if b in self.fronts:
                both = [np.concatenate([f, v[a:z]]) for f, v in zip(self.fronts[b], rows, strict=True)]
                by = np.argsort(both[0], kind="stable")
                self.fronts[b] = [v[by] for v in both]
            else:
                at = int(self.fill[b])
                for s, v in zip(self.store, rows, strict=True):
                    s[at : at + z - a] = v[a:z]
                self.fill[b] = at + z - a
        self.left += len(symbols)
        self.low = min(self.low, int(of[0]))

    def peek(self, most: int) -> list[np.ndarray]:
        """The first tuples, at most so many, all of one bucket."""
        if not self.left:
            return [s[:0] for s in self.store]
        while self.read[self.low] == self.fill[self.low] and not (self.low in self.fronts and len(self.fronts[self.low][0])):
            self.fronts.pop(self.low, None)
            self.low += 1
        b = self.low
        a, z = int(self.read[b]), int(self.fill[b])
        if self.single[b]:
            return [np.asarray(s[a : min(z, a + most)]) for s in self.store]
        if b not in self.fronts:
            rows = [np.asarray(s[a:z]) for s in self.store]
            by = np.argsort(rows[0], kind="stable")
            self.fronts[b], self.read[b] = [v[by] for v in rows], z
        return [v[:most] for v in self.fronts[b]]

    def take(self, n: int) -> None:
        self.left -= n
        if self.single[self.low]:
            self.read[self.low] += n
        elif n:
            self.fronts[self.low] = [v[n:] for v in self.fronts[self.low]]


def _kinds(x: np.ndarray, memory: int) -> np.ndarray:
    """Whether the suffix at each place is small."""
    small = scratch(len(x), bool, memory)
    small[-1] = True
    for z in range(len(x) - 1, 0, -memory):
        a = max(0, z - memory)
        step = np.sign(x[a + 1 : z + 1].astype(np.int64) - x[a:z])
        at = np.where(step != 0, np.arange(z - a), z - a)
        at = np.minimum.accumulate(at[::-1])[::-1]
        small[a:z] = np.append(step > 0, small[z])[at]
    return small


def _counted(x: np.ndarray, small: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """L and S suffixes of each symbol."""
    top = max(int(x[a : a + memory].max()) for a in range(0, len(x), memory)) + 1
    out = np.zeros((2, top), np.int64)
    for a in range(0, len(x), memory):
        out += np.bincount(x[a : a + memory].astype(np.int64) + top * small[a : a + memory], minlength=2 * top).reshape(2, top)
    return out[0], out[1]


def _handed_out(x: np.ndarray, small: np.ndarray, kind: bool, counts: np.ndarray, places: np.ndarray, common: np.ndarray, rough: bool, memory: int) -> Iterator[tuple[np.ndarray, ...]]:
    """One way of induction: batches of (from the queue?, symbol, place, common prefix with the one before) in order.

    places, common: what is given, in order. kind: the kind of suffixes to be induced; for small ones symbols count downwards.
    rough: the first sort, in which only the first symbol of a given suffix counts.
    """
    top = len(counts) - 1
    turned = (lambda s: top - s) if kind else (lambda s: s)
    queue = _Queue(counts[::-1] if kind else counts, memory)
    number = np.uint16 if 4 * top + 5 < 1 << 16 else np.int64  # short numbers are sorted by counting
    last = scratch(top + 1, np.int64, memory)  # 1 + the number of the latest source of the symbol
    least_at, least = np.zeros(0, np.int64), np.zeros(0, np.int32)  # suffix minima of what was handed out
    done, given, most, before = 0, 0, 256, (-1, False, -1)
    held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    while queue.left or given < len(places) or len(held[0]):
        if len(held[0]) < most and given < len(places):
            at = np.asarray(places[given : given + max(most, 4096)])
            more = [turned(x[at].astype(np.int32)), at, np.asarray(common[given : given + len(at)])]
            held, given = [np.concatenate(v) for v in zip(held, more, strict=True)], given + len(at)
        q, s = queue.peek(most), [v[:most] for v in held]
        # Neither side may go beyond what the other has shown so far.
        above = 2 * int(q[0][-1]) if len(q[0]) < queue.left else 4 * top + 4
        bound = 2 * int(s[0][-1]) + 1 if len(s[0]) < len(held[0]) or given < len(places) else 4 * top + 4
        q, s = ([v[: np.searchsorted(w[0], most_of, side="right")] for v in w] for w, most_of in ((q, bound // 2), (s, (above - 1) // 2)))
        keys = np.concatenate([2 * q[0].astype(number), 2 * s[0].astype(number) + number(1)])
        order = np.argsort(keys, kind="stable") if len(q[0]) and len(s[0]) else np.arange(len(keys))
        n = len(order)
        queued = order < len(q[0])
        symbol, place, shared = (np.concatenate([a, b])[order] for a, b in zip(q, s, strict=True))
        previous = np.maximum(place - 1, 0)
        induces = (place > 0) & (small[previous] == kind)
        target = turned(x[previous].astype(np.int32))
        earliest = np.minimum.accumulate(np.where(induces, 2 * target.astype(number), number(4 * top + 4)))
        late = np.flatnonzero(keys[order][1:] > earliest[:-1])
        if len(late):
            n = int(late[0]) + 1
            most = max(256, 2 * n)
        else:
            most = min(2 * most, max(4096, memory // 4))
        queued, symbol, place, shared, induces, target = (v[:n] for v in (queued, symbol, place, shared, induces, target))
        taken = int(queued.sum())
        queue.take(taken)
        held = [v[n - taken :] for v in held]
        # Common prefixes with the one handed out before.
        same = np.append(symbol[:1] == before[0], symbol[1:] == symbol[:-1])
        shared = np.where(same, shared, 0).astype(np.int32)
        seam = np.flatnonzero(same & ~queued & np.append(before[1], queued[:-1]))
        if len(seam):
            left = np.where(seam > 0, place[seam - 1], before[2])
            shared[seam] = 1 if rough else np.minimum(run_lengths(x, left), run_lengths(x, place[seam]))
        before = (int(symbol[-1]), bool(queued[-1]), int(place[-1]))
        yield queued, symbol, place, shared
        # What is induced, and its common prefix with the one of its symbol before it.
        source = np.flatnonzero(induces)
        if len(source):
            to = target[source]
            by = np.argsort(to.astype(number), kind="stable")
            first = np.append(True, to[by][1:] != to[by][:-1])
            to_common = np.zeros(len(source), np.int32)
            again = by[~first]
            to_common[again] = range_min(shared, source[by[np.flatnonzero(~first) - 1]] + 1, source[again] + 1)
            new = by[first]
            known = last[to[new]] > 0
            old = new[known]
            if len(old):
                far = np.searchsorted(least_at, last[to[old]] - 1, side="right")
                far = np.where(far < len(least), np.append(least, EQUAL)[np.minimum(far, len(least))], EQUAL)
                to_common[old] = np.minimum(far, np.minimum.accumulate(shared)[source[old]])
            to_common = np.where(to_common < EQUAL, to_common + 1, EQUAL).astype(np.int32)
            to_common[new[~known]] = 0
            queue.push(to[by], place[source[by]] - 1, to_common[by])
            ends = np.append(np.flatnonzero(first)[1:] - 1, len(by) - 1)
            last[to[by[ends]]] = done + source[by[ends]] + 1
        suffix = np.minimum.accumulate(shared[::-1])[::-1]
        record = np.flatnonzero(np.append(shared[:-1] < suffix[1:], True))
        keep = least < suffix[0]
        least_at, least = np.concatenate([least_at[keep], done + record]), np.concatenate([least[keep], shared[record]])
        done += n


def _induced(x: np.ndarray, small: np.ndarray, places: np.ndarray, common: np.ndarray, rough: bool, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and common prefixes with the one before, from the seeds in order."""
    large_of, small_of = _counted(x, small, memory)
    suffixes, shared = scratch(len(x), np.int64, memory), scratch(len(x), np.int32, memory)
    total = int(large_of.sum())
    large, large_common = scratch(total, np.int64, memory), scratch(total + 1, np.int32, memory)
    small_before, large_after = np.cumsum(small_of) - small_of, np.cumsum(large_of[::-1])[::-1] - large_of
    n = 0
    for queued, symbol, place, c in _handed_out(x, small, False, large_of, places, common, rough, memory):
        symbol, place, c = symbol[queued], place[queued], c[queued]
        large[n : n + len(place)], large_common[n : n + len(place)] = place, c
        at = np.arange(n, n + len(place)) + small_before[symbol]
        suffixes[at], shared[at] = place, c
        n += len(place)
    n, top, tail, was = 0, len(small_of) - 1, 0, False
    suffixes[0] = len(x) - 1
    # Downwards, a common prefix is with the larger neighbour and is stored there; of the first large suffix after small ones, with the latter.
    for queued, symbol, place, c in _handed_out(x, small, True, small_of, large[::-1], large_common[1:][::-1], rough, memory):
        at = len(x) - 1 - np.arange(n, n + int(queued.sum())) - large_after[top - symbol[queued]]
        suffixes[at] = place[queued]
        up = c[queued] > 0
        shared[at[up] + 1] = c[queued][up]
        seam = np.flatnonzero(~queued & (c > 0) & np.append(was, queued[:-1]))
        shared[np.append(tail, at)[np.cumsum(queued)[seam]]] = c[seam]
        tail, was, n = int(at[-1]) if len(at) else tail, bool(queued[-1]), n + len(at)
    return suffixes, shared


def _doubled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same in memory: ranks by 1, 2, 4, ... symbols."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank.astype(np.int32)], 1
    while True:
        key = (rank << 32) | np.append(rank[width:] + 1, np.zeros(min(width, n), np.int64))[:n]
        order = np.argsort(key)
        new = np.append(False, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank.astype(np.int32))
        width *= 2
    common = np.zeros(n, np.int32)
    a, b = order[:-1], order[1:]
    for k in reversed(range(len(ranks))):
        i, j = np.minimum(a + common[1:], n - 1), np.minimum(b + common[1:], n - 1)
        common[1:] += (ranks[k][i] == ranks[k][j]).astype(np.int32) << k
    return order, common


def ordered(x: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Places of x's suffixes in order, and each one's common prefix with the one before (0 for the first). x ends with its only 0."""
    return _doubled(np.asarray(x)) if len(x) <= memory else by_induction(x, memory)


def by_induction(x: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """As `ordered`, by induction for strings of any length from 2."""
    small = _kinds(x, memory)
    chunks = [(a, min(a + memory, len(x))) for a in range(0, len(x), memory)]
    is_seed = lambda a, z: small[a:z] & ~np.append(small[a - 1] if a else True, small[a : z - 1])
    total = sum(int(is_seed(a, z).sum()) for a, z in chunks)
    seeds = scratch(total, np.int64, memory)
    n, number = 0, scratch(len(x), np.int32, memory)  # of the seed at each place
    for a, z in chunks:
        found = np.flatnonzero(is_seed(a, z)) + a
        seeds[n : n + len(found)], number[found] = found, np.arange(n, n + len(found))
        n += len(found)
    # 1. Pieces: seeds by their first symbol, equal ones among themselves.
    by_symbol = scratch(total, np.int64, memory)
    counts = _counted(x[seeds], np.zeros(total, bool), memory)[0]
    free = np.cumsum(counts) - counts
    for a in range(0, total, memory):
        at = np.asarray(seeds[a : a + memory])
        order = np.argsort(x[at], kind="stable")
        symbols = x[at][order].astype(np.int64)
        first = np.flatnonzero(np.diff(symbols, prepend=-1))
        by_symbol[free[symbols] + np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))] = at[order]
        free += np.bincount(symbols, minlength=len(free))
    suffixes, shared = _induced(x, small, by_symbol, np.broadcast_to(np.int32(EQUAL), total), True, memory)
    names, least = scratch(total, np.int32, memory), []
    so_far, name, carry = 0, -1, EQUAL
    for a, z in chunks:
        place, c = np.asarray(suffixes[a:z]), np.asarray(shared[a:z])
        here = np.flatnonzero(small[place] & ~(small[np.maximum(place - 1, 0)] | (place == 0)))
        if not len(here):
            carry = min(carry, int(c.min()))
            continue
        low = np.minimum.reduceat(c[: here[-1] + 1], np.append(0, here[:-1] + 1))
        low[0] = min(int(low[0]), carry)
        carry = int(c[here[-1] + 1 :].min(initial=EQUAL))
        new = low < EQUAL
        new[0] |= name < 0
        named = name + np.cumsum(new)
        names[number[place[here]]] = named
        least.append(low[new])
        name, so_far = int(named[-1]), so_far + len(here)
    least = np.concatenate(least)
    del suffixes, shared, number
    # 2. The order of the seeds' suffixes is that of the string of names.
    if name + 1 == total:
        order, common = scratch(total, np.int64, memory), np.broadcast_to(np.int32(0), total)
        for a in range(0, total, memory):
            order[names[a : a + memory]] = np.arange(a, min(a + memory, total))
    else:
        order, common = ordered(names, memory)
    places, exact = scratch(total, np.int64, memory), scratch(total, np.int32, memory)
    for a in range(0, total, memory):
        own = np.asarray(order[a : a + memory])
        places[a : a + memory] = seeds[own]
        up, own, c = (np.asarray(order[max(a - 1, 0) : a + len(own) - 1]), own[not a :], np.asarray(common[max(a, 1) : a + memory]).astype(np.int64))
        if len(own):
            low = range_min(least, names[up + c].astype(np.int64) + 1, names[own + c].astype(np.int64) + 1)
            i, j = seeds[up], seeds[own]
            length = seeds[own + c] - j + low
            open_ = np.arange(len(own))
            while len(open_):
                open_ = open_[np.maximum(i, j)[open_] + length[open_] < len(x)]
                open_ = open_[x[i[open_] + length[open_]] == x[j[open_] + length[open_]]]
                one, two = run_lengths(x, i[open_] + length[open_]), run_lengths(x, j[open_] + length[open_])
                length[open_] += np.minimum(one, two)
                open_ = open_[one == two]
            exact[max(a, 1) : a + memory] = length
    # 3. All suffixes.
    return _induced(x, small, places, exact, False, memory)
