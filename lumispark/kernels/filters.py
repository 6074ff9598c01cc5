"""Smoothing, resampling and thresholds of arrays."""

from __future__ import annotations

import numpy as np


def gaussian(image: np.ndarray, sigma: float | tuple[float, ...]) -> np.ndarray:
    """Separable blur, cut at four sigma, edges continued by their nearest value."""
    out = image.astype(float)
    sigmas = (sigma,) * image.ndim if np.isscalar(sigma) else sigma
    for axis, s in enumerate(sigmas):
        if s <= 0:
            continue
        radius = int(4 * s + 0.5)
        weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / s) ** 2)
        weights /= weights.sum()
        moved = np.moveaxis(out, axis, 0)
        padded = np.concatenate([np.repeat(moved[:1], radius, axis=0), moved, np.repeat(moved[-1:], radius, axis=0)])
        out = np.moveaxis(sum(w * padded[k : k + len(moved)] for k, w in enumerate(weights)), 0, axis)
    return out


def laplace(image: np.ndarray) -> np.ndarray:
    """Twice the number of axes times each value, minus its neighbours; edges continued."""
    out = 2.0 * image.ndim * image
    for axis in range(image.ndim):
        moved = np.moveaxis(image, axis, 0)
        both = np.concatenate([moved[:1], moved[:-1]]) + np.concatenate([moved[1:], moved[-1:]])
        out -= np.moveaxis(both, 0, axis)
    return out


def rolling_ball(image: np.ndarray, radius: int) -> np.ndarray:
    """Background under a ball rolled below the surface: a grey opening by the ball's upper cap."""
    grid = np.arange(-radius, radius + 1)
    far = grid[:, None] ** 2 + grid[None, :] ** 2
    cap = {(int(dy), int(dx)): np.sqrt(radius**2 - d) - radius for (i, j), d in np.ndenumerate(far) if d <= radius**2 for dy, dx in [(grid[i], grid[j])]}
    padded = np.pad(image.astype(float), radius, constant_values=np.inf)
    h, w = image.shape
    at = lambda a, dy, dx: a[radius + dy : radius + dy + h, radius + dx : radius + dx + w]
    touch = np.full(image.shape, np.inf)
    for (dy, dx), z in cap.items():
        touch = np.minimum(touch, at(padded, dy, dx) - z)
    top = np.pad(touch, radius, constant_values=-np.inf)
    out = np.full(image.shape, -np.inf)
    for (dy, dx), z in cap.items():
        out = np.maximum(out, at(top, dy, dx) + z)
    return out


def rescale(image: np.ndarray, factors: tuple[float, ...]) -> np.ndarray:
    """Linear resampling to round(size * factor) on each axis, pixel centres aligned, no smoothing."""
    out = image.astype(float)
    for axis, factor in enumerate(factors):
        size = out.shape[axis]
        new = max(1, int(np.round(size * factor)))
        if new == size:
            continue
        place = np.clip((np.arange(new) + 0.5) * size / new - 0.5, 0, size - 1)
        low = np.floor(place).astype(int)
        high = np.minimum(low + 1, size - 1)
        share = (place - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        out = out.take(low, axis) * (1 - share) + out.take(high, axis) * share
    return out


def to_bytes(image: np.ndarray) -> np.ndarray:
    """Values from their own range to 0..255, truncated; a constant image becomes 0."""
    low, high = image.min(), image.max()
    if low == high:
        return np.zeros(image.shape, np.uint8)
    return ((image.astype(float) - low) * (255.0 / (float(high) - float(low)))).astype(np.uint8)


def clip_quantiles(image: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip(image, np.quantile(image, low), np.quantile(image, high))


def _histogram(image: np.ndarray, bins: int = 256) -> tuple[np.ndarray, np.ndarray]:
    counts, edges = np.histogram(image, bins)
    return counts.astype(float), (edges[1:] + edges[:-1]) / 2


def otsu(image: np.ndarray) -> float:
    """The threshold with the most variance between its sides; of a constant image, its value."""
    if image.min() == image.max():
        return float(image.min())
    n, centre = _histogram(image)
    w1, m1 = np.cumsum(n)[:-1], np.cumsum(n * np.arange(len(n)))[:-1]
    w2, m2 = n.sum() - w1, (n * np.arange(len(n))).sum() - m1
    return float(centre[np.argmax((m1 * w2 - m2 * w1) ** 2 / (w1 * w2))])


def yen(image: np.ndarray) -> float:
    if image.min() == image.max():
        return float(image.min())
    n, centre = _histogram(image)
    c, s = np.cumsum(n)[:-1], np.cumsum(n * n)[:-1]
    return float(centre[np.argmax((c * (n.sum() - c)) ** 2 / (s * ((n * n).sum() - s)))])


def triangle(image: np.ndarray) -> float:
    if image.min() == image.max():
        return float(image.min())
    n, centre = _histogram(image)
    first, last = np.flatnonzero(n)[[0, -1]]
    peak = int(n.argmax())
    if peak - first < last - peak:
        x = np.arange(last - peak)
        return float(centre[last - np.argmax(n[peak] * x - (last - peak) * n[last - x])])
    x = np.arange(peak - first)
    return float(centre[first + np.argmax(n[peak] * x - (peak - first) * n[first + x])])


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3].astype(float) @ np.array([0.2125, 0.7154, 0.0721])
