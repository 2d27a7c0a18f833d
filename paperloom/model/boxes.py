"""Pairs of boxes that meet, counted without listing them."""

from __future__ import annotations

import numpy as np


def below(px: np.ndarray, py: np.ndarray, weights: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the sums of the weights (a row per point) of points with px <= qx and py <= qy.

    Points in the order of px are cut into blocks of 1, 2, 4, ... by place; the points that a query's x takes are whole
    blocks, one for each bit of their number, and within a block sorted by py a query finds its place by bisection. So n
    points and queries take n log(n)^2 steps and the memory of a few columns.
    """
    out = np.zeros((len(qx), weights.shape[1]), dtype=np.int64)
    n = len(px)
    if not n or not len(qx):
        return out
    order = np.argsort(px, kind="stable")
    taken = np.searchsorted(px[order], qx, side="right")
    heights = np.sort(py)
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(py[order], kind="stable")] = np.arange(n)
    least = np.searchsorted(heights, qy, side="right")  # so many points are as low as qy: those of a lower rank
    weights = weights[order]
    place = np.arange(n, dtype=np.int64)
    for bit in range(int(n).bit_length()):
        asks = np.nonzero(taken >> bit & 1)[0]
        if not len(asks):
            continue
        key = (place >> bit) * (n + 1) + rank
        by = np.argsort(key, kind="stable")
        block = (taken[asks] >> bit) - 1  # the last whole block of this size
        sums = np.concatenate([np.zeros((1, weights.shape[1]), dtype=np.int64), np.cumsum(weights[by], axis=0)])
        out[asks] += sums[np.searchsorted(key[by], block * (n + 1) + least[asks])] - sums[block << bit]
    return out


def _apart(a0: np.ndarray, a1: np.ndarray, w: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> int:
    """Sums over the pairs of intervals that don't meet."""
    nothing, none = np.zeros(len(a0)), np.zeros(len(b0))
    return below(a1, nothing, w, b0, none) + below(-a0, nothing, w, -b1, none)


def meeting(a: np.ndarray, ids: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each box of b (columns x0, y0, x1, y1, with x0 < x1 and y0 < y1) how many boxes of a meet its inside, and the sum of their ids.

    All of a, less those apart in x, less those apart in y, and those apart in both again: a box lies on one side only."""
    w = np.stack([np.ones(len(a), dtype=np.int64), ids], axis=1)
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = a.T, b.T
    both = sum(below(px, py, w, qx, qy) for px, qx in ((ax1, bx0), (-ax0, -bx1)) for py, qy in ((ay1, by0), (-ay0, -by1)))
    return w.sum(axis=0) - _apart(ax0, ax1, w, bx0, bx1) - _apart(ay0, ay1, w, by0, by1) + both


def cell_sums(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, cell: float, cx: int, cy: int) -> tuple[int, int, int]:
    """(pairs, sum of a's ids, sum of b's ids) over the pairs that meet and whose shared part has its lower left corner in the
    cell (cx, cy) of a grid, which all boxes touch: pairs of which both begin before the cell belong to another one."""
    if not len(a) or not len(b):
        return 0, 0, 0
    found = meeting(a, a_ids, b)
    early = [(np.floor(box[:, 0] / cell) < cx, np.floor(box[:, 1] / cell) < cy) for box in (a, b)]
    w = np.stack([np.ones(len(a), dtype=np.int64), a_ids], axis=1)
    for axis in (0, 1):  # both begin before the cell in one direction, so they meet there: apart or not in the other
        p, q, low, high = early[0][axis], early[1][axis], 1 - axis, 3 - axis
        found[q] -= w[p].sum(axis=0) - _apart(a[p, low], a[p, high], w[p], b[q, low], b[q, high])
    p, q = (e[0] & e[1] for e in early)
    found[q] += w[p].sum(axis=0)
    pairs = found[:, 0]
    if int(pairs.sum()) * int(np.abs(np.concatenate([a_ids, b_ids])).max()) >= 1 << 63:
        raise OverflowError("sums of identifiers beyond 64 bits")
    return int(pairs.sum()), int(found[:, 1].sum()), int((pairs * b_ids).sum())
