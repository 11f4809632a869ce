"""Average linkage on the distances of a mined result (numpy; k x k numbers, k itemsets)."""

from __future__ import annotations

import numpy as np

def average_linkage(ids: np.ndarray, distance: np.ndarray) -> list[tuple[int, int, int, float, int]]:
    """Merges (step, left, right, distance, size); clusters are named by their smallest id, ties merge the smallest names first.

    distance: square matrix in the order of the sorted ids.  Each cluster's least distance is kept and only looked for anew where a
    merge takes it away, so that k itemsets take about k * k steps and k * k numbers of memory.
    """
    k = len(ids)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size = np.ones(k, int)
    alive = np.ones(k, bool)
    out = []
    nearest = d.min(axis=1) if k > 1 else np.zeros(k)
    for step in range(k - 1):
        low = np.where(alive, nearest, np.inf).min()
        tied = np.flatnonzero(alive & (nearest <= low + 1e-12))
        i = int(tied[0])  # rows stand in the order of the smallest ids
        j = int(np.flatnonzero(alive & (d[i] <= low + 1e-12))[0])
        i, j = min(i, j), max(i, j)
        out.append((step, int(ids[i]), int(ids[j]), float(d[i, j]), int(size[i] + size[j])))
        lost = alive & ((nearest == d[i]) | (nearest == d[j]))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        nearest = np.minimum(nearest, d[i])
        lost[i] = True
        nearest[lost] = d[lost].min(axis=1)
        nearest[j] = np.inf
    return out
