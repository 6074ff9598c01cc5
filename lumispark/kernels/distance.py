"""Exact Euclidean distances on arrays."""

from __future__ import annotations

import numpy as np

FAR = 1 << 40


def nearest_background(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance to the nearest pixel outside the mask, that pixel's flat index).

    One axis after the other: along an axis the best of all pixels of the line, seen from each, by
    shifts of growing length that stop when no longer shift can help. Without a pixel outside, the
    distance is FAR and the index -1."""
    square = np.where(mask, FAR, 0).astype(np.int64)
    source = np.where(mask, -1, np.arange(mask.size).reshape(mask.shape))
    for axis in range(mask.ndim):
        square, source = np.moveaxis(square, axis, 0), np.moveaxis(source, axis, 0)
        best, origin = square.copy(), source.copy()
        for step in range(1, len(square)):
            if step * step >= best.max():
                break
            for to, of in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                other = square[of] + step * step
                closer = other < best[to]
                best[to] = np.where(closer, other, best[to])
                origin[to] = np.where(closer, source[of], origin[to])
        square, source = np.moveaxis(best, 0, axis), np.moveaxis(origin, 0, axis)
    return np.where(source < 0, FAR, square), source


def distances(mask: np.ndarray) -> np.ndarray:
    """Distance of each pixel of the mask to the nearest one outside; 0 outside."""
    square, _ = nearest_background(mask.astype(bool))
    return np.where(mask, np.sqrt(square.astype(float)), 0.0)


def expand(labels: np.ndarray, reach: float) -> np.ndarray:
    """Labels grown over background within the distance; the nearest label wins."""
    square, source = nearest_background(labels == 0)
    near = (square <= reach * reach) & (source >= 0)
    return np.where(near, labels.ravel()[np.maximum(source, 0)], 0)


def ring(mask: np.ndarray, inner: float, outer: float) -> np.ndarray:
    """Pixels around the mask farther than inner and not farther than outer."""
    square, _ = nearest_background(~mask.astype(bool))
    return (square > inner * inner) & (square <= outer * outer)


def signed_distances(mask: np.ndarray) -> np.ndarray:
    """Distance to the mask outside it, minus the distance to its outside within."""
    return distances(~mask.astype(bool)) - distances(mask)
