"""Suffix arrays of many short sequences at once, and the repeats they show (NumPy)."""

from __future__ import annotations

import tempfile

import numpy as np

#: Rank levels of longer inputs are laid on the executor's disk, so that memory does not grow with their number.
IN_MEMORY = 1 << 22


def _kept(level: np.ndarray) -> np.ndarray:
    """One level of ranks, on disk where it is long: a spill file that goes with the array."""
    level = level.astype(np.int32) if len(level) < 1 << 31 else level
    if len(level) < IN_MEMORY:
        return level
    held = np.memmap(tempfile.TemporaryFile(), level.dtype, "w+", shape=level.shape)
    held[:] = level
    held.flush()
    return held


def ranks_by_doubling(first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Rank levels of all suffixes of many sequences laid end to end.

    ``first``: a number for each token, different between sequences. ``end``: for each position, where its sequence
    ends. Level k holds equal numbers for two positions exactly when their first 2**k tokens are equal;
    the last level orders all suffixes. Each level sorts only the positions that are still tied.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    ordered = first[order]
    starts = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    levels, step = [_kept(rank)], 1
    size = np.bincount(rank, minlength=n)
    active = np.flatnonzero(size[rank] > 1)
    while len(active):
        after = active + step
        inside = after < end[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[after[inside]] + 1
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered, group = key[order], rank[active[order]]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        at = np.arange(len(order))
        since = np.maximum.accumulate(np.where(new_key, at, 0)) - np.maximum.accumulate(np.where(new_group, at, 0))
        rank = rank.copy()
        rank[active[order]] = group + since
        levels.append(_kept(rank))
        step *= 2
        size = np.bincount(rank, minlength=n)
        active = active[size[rank[active]] > 1]
    return levels


def common_prefix(levels: list[np.ndarray], end: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffix pairs, from the coarsest level down."""
    a, b = a.copy(), b.copy()
    length = np.zeros(len(a), np.int64)
    top = len(levels[0]) - 1
    for k in range(len(levels) - 1, -1, -1):
        same = (a + (1 << k) <= end[np.minimum(a - length, top)]) & (b + (1 << k) <= end[np.minimum(b - length, top)])
        same &= levels[k][np.minimum(a, top)] == levels[k][np.minimum(b, top)]
        a[same] += 1 << k
        b[same] += 1 << k
        length[same] += 1 << k
    return length


def longest_matches(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position: the longest prefix of its suffix that occurs at another position of its sequence.

    These are the longest-common-prefix intervals seen from each suffix: the larger of its two neighbours in the
    suffix array. The spans [i, i + length) are the maximal repeated substrings and their tails.
    """
    n = len(first)
    if n < 2:
        return np.zeros(n, np.int64)
    levels = ranks_by_doubling(first, end)
    array = np.empty(n, np.int64)
    array[levels[-1]] = np.arange(n)
    near = common_prefix(levels, end, array[:-1], array[1:])
    out = np.zeros(n, np.int64)
    out[array[:-1]] = near
    out[array[1:]] = np.maximum(out[array[1:]], near)
    return out


def covered(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans [start, stop)."""
    change = np.bincount(start, minlength=n + 1) - np.bincount(stop, minlength=n + 1)
    return np.cumsum(change[:n]) > 0
