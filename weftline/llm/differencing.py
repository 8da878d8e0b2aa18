"""Multiway differencing: items into a number of near-equal windows. Pure functions; :mod:`weftline.llm.packing` applies them."""

from __future__ import annotations

import heapq

import numpy as np


def partition(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, sizes of the windows) by Karmarkar-Karp multiway differencing.

    Every partial partition is a row of ``k`` window sums, of which only those that hold anything are kept, largest first. The two
    of greatest imbalance are merged, the largest window of one with the smallest of the other and so on, so that their imbalances
    cancel, until one is left. Windows are joined as linked lists, so that a merge costs only the ordering of ``k`` numbers. While a
    row has empty windows, its imbalance is its largest window, which no single item left exceeds: it would be merged with the next
    largest items one by one, and takes them all at once.
    """
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(k, np.int64)
    if k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    after = np.full(n, -1, np.int64)  # the next item of the same window
    order = np.argsort(-sizes, kind="stable")
    singles = sizes[order]
    rest = [*singles.tolist(), 0]
    at = 0  # the first item that is in no row yet
    rows: dict[int, tuple] = {}
    heap: list[tuple[int, int]] = []

    def pop() -> tuple:
        nonlocal at
        if at < n and (not heap or singles[at] >= -heap[0][0]):
            at += 1
            return singles[at - 1 : at], order[at - 1 : at], order[at - 1 : at]
        return rows.pop(heapq.heappop(heap)[1])

    turn = 0
    while True:
        s, first, last = pop()
        free = k - len(s)
        if free and at < n:
            # of equal imbalance, rows come after items
            low = -heap[0][0] if heap else 0
            stop = min(at + free, at + int(np.searchsorted(-singles[at:], -low, "right")))
            if stop > at:
                s, first, last = np.concatenate([s, singles[at:stop]]), np.concatenate([first, order[at:stop]]), np.concatenate([last, order[at:stop]])
                at = stop
                heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), turn))
                rows[turn] = s, first, last
                turn += 1
                continue
        if not free and at < n:
            # a full row and the next item are the two of greatest imbalance, mostly many times in turn: each item goes onto the smallest window
            low = -heap[0][0] if heap else -1
            sums, ends, top, begun = s.tolist(), last.tolist(), int(s[0]), at
            windows = [(x, i) for i, x in enumerate(sums)]
            windows.reverse()  # ascending, so a heap
            while at < n and rest[at] >= low and (gap := top - windows[0][0]) >= rest[at + 1] and gap >= low:
                x, i = windows[0]
                x += rest[at]
                heapq.heapreplace(windows, (x, i))
                after[ends[i]] = ends[i] = order[at]
                sums[i], top, at = x, max(top, x), at + 1
            if at > begun:
                s, last = np.array(sums), np.array(ends)
                o = np.argsort(-s, kind="stable")
                s, first, last = s[o], first[o], last[o]
                heapq.heappush(heap, (-int(s[0] - s[-1]), turn))
                rows[turn] = s, first, last
                turn += 1
                continue
        if not heap and at >= n:
            break
        sb, fb, lb = pop()
        if len(s) < len(sb):
            (s, first, last), (sb, fb, lb) = (sb, fb, lb), (s, first, last)
        m = len(s)
        fresh = min(k - m, len(sb))  # the largest windows of the other row go where this one is empty, the rest onto its smallest
        on = np.arange(m - (len(sb) - fresh), m)[::-1]
        s, first, last = s.copy(), first.copy(), last.copy()
        s[on] += sb[fresh:]
        after[last[on]] = fb[fresh:]
        last[on] = lb[fresh:]
        s, first, last = np.concatenate([s, sb[:fresh]]), np.concatenate([first, fb[:fresh]]), np.concatenate([last, lb[:fresh]])
        o = np.argsort(-s, kind="stable")
        s, first, last = s[o], first[o], last[o]
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), turn))
        rows[turn] = s, first, last
        turn += 1
    window = np.full(n, -1, np.int64)
    here, which = first.copy(), np.arange(len(first))
    while len(here):
        window[here] = which
        here = after[here]
        which, here = which[here >= 0], here[here >= 0]
    return window, np.concatenate([s, np.zeros(k - len(s), s.dtype)])


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, none above ``capacity``; every size must be positive and at most the capacity.

    Begins with the fewest windows that the total needs, or that the items above half the capacity do. While one exceeds the capacity,
    their number rises, by twice as much each time; of the numbers passed over the least that will do is then searched by halving.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    low, step = max(1, -(-int(sizes.sum()) // capacity), int((2 * sizes > capacity).sum())) - 1, 1
    while True:
        k = min(low + step, len(sizes))
        window, sums = partition(sizes, k)
        excess = int(np.maximum(sums - capacity, 0).sum())
        if not excess:
            break
        low, step = k, max(2 * step, excess // capacity)
    while k - low > 1:
        middle = (low + k) // 2
        tried, sums = partition(sizes, middle)
        if sums.max() > capacity:
            low = middle
        else:
            k, window = middle, tried
    return window
