"""Runs of bytes in texts that lie end to end."""
import numpy as np


def runs(inside: np.ndarray, at: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal runs of True that are `least` long or more; a run ends at every place in `at`."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= least
    return start[long], end[long]


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All places of the spans, in order."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
