"""Karmarkar-Karp multiway differencing: items into windows with nearly equal sums."""

from __future__ import annotations

import heapq

import numpy as np


def near_equal(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number of each item and the sum of each of ``k`` windows.

    Every item starts as a partial partition of its own. The two whose windows
    differ most are merged, largest sums onto smallest, until one is left. Ties
    go by the order of the items, so the result depends on the sizes alone.
    """
    if k == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64), np.array([sizes.sum()] + [0] * (k - 1), np.int64)
    # A partial partition: its window sums less the smallest, ascending, and the merges it came from.
    heap: list[tuple[int, int, np.ndarray, tuple]] = []
    for i, size in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[-1] = size
        heap.append((-size, i, sums, (i,)))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        _, _, a, from_a = heapq.heappop(heap)
        _, _, b, from_b = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(sums, kind="stable")
        sums = sums[order]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), made, sums, (from_a, from_b, order)))
        made += 1
    # Undo the merges: where each window of a part ended up.
    window = np.zeros(len(sizes), np.int64)
    todo = [(heap[0][3], np.arange(k))]
    while todo:
        tree, places = todo.pop()
        if len(tree) == 1:
            window[tree[0]] = places[-1]
        else:
            from_a, from_b, order = tree
            before = np.empty(k, np.int64)
            before[order] = places
            todo += [(from_a, before), (from_b, before[::-1])]
    return window, np.bincount(window, sizes, k).astype(np.int64)


def windows_within(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """``near_equal`` with the fewest tried windows whose sums all stay within ``capacity``.

    No item may be larger than ``capacity``. The window count starts at the
    smallest that could hold the total and rises whenever a window is too full.
    """
    total = int(sizes.sum())
    if not total:
        return np.zeros(len(sizes), np.int64), np.zeros(min(1, len(sizes)), np.int64)
    k = max(1, -(-total // capacity))
    while True:
        window, sums = near_equal(sizes, k)
        if sums.max() <= capacity or k >= len(sizes):
            break
        k += 1
    if sums.max() > capacity:  # as many windows as items: one each
        window, sums = np.arange(len(sizes)), sizes.astype(np.int64)
    return window, sums
