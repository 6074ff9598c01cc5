"""Binary morphology, connected components and object filters on arrays of two or three axes."""

from __future__ import annotations

import itertools

import numpy as np


def ball(radius: int, axes: int) -> np.ndarray:
    """Offsets of the lattice points within the radius (a disk on two axes)."""
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * axes, indexing="ij"), axis=-1).reshape(-1, axes)
    return grid[(grid**2).sum(axis=1) <= radius**2]


def shifted(array: np.ndarray, offset: tuple[int, ...], fill) -> np.ndarray:
    """out[p] = array[p + offset], fill outside."""
    out = np.full_like(array, fill)
    to = tuple(slice(max(0, -o), n - max(0, o)) for o, n in zip(offset, array.shape))
    of = tuple(slice(max(0, o), n - max(0, -o)) for o, n in zip(offset, array.shape))
    if all(abs(o) < n for o, n in zip(offset, array.shape)):
        out[to] = array[of]
    return out


def dilate(array: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Maximum over the offsets; on labels the larger label wins. Nothing lies outside."""
    out = np.zeros_like(array)
    for o in offsets:
        np.maximum(out, shifted(array, tuple(-o), 0), out=out)
    return out


def erode(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minimum over the offsets; what lies outside doesn't erode."""
    out = np.ones_like(mask)
    for o in offsets:
        np.minimum(out, shifted(mask, tuple(o), 1), out=out)
    return out


def closing(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return erode(dilate(mask, offsets), offsets)


def label(mask: np.ndarray, connectivity: int | None = None) -> np.ndarray:
    """Objects numbered from 1 in scan order of their first pixel; by default diagonals connect."""
    axes = mask.ndim
    most = axes if connectivity is None else connectivity
    names = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    half = [o for o in itertools.product((-1, 0, 1), repeat=axes) if o > (0,) * axes and np.abs(o).sum() <= most]
    root = np.arange(mask.size + 1)
    pairs = []
    for o in half:
        other = shifted(names, o, 0)
        both = (names > 0) & (other > 0)
        pairs.append(np.stack([names[both], other[both]]))
    a, b = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), int)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    found = root[names]
    _, inverse = np.unique(np.append(0, found[mask.astype(bool)]), return_inverse=True)
    out = np.zeros(mask.shape, np.int32)
    out[mask.astype(bool)] = inverse[1:]
    return out


def areas(labels: np.ndarray) -> np.ndarray:
    """Pixels of each label, background as 0."""
    counts = np.bincount(labels.ravel())
    counts[:1] = 0
    return counts


def without_small(mask: np.ndarray, least: int, connectivity: int = 1) -> np.ndarray:
    """The mask without objects of fewer than `least` pixels."""
    labels = label(mask, connectivity)
    return (areas(labels) >= least)[labels] & (labels > 0)


def without_holes(mask: np.ndarray, least: int, connectivity: int = 1) -> np.ndarray:
    """The mask with holes of fewer than `least` pixels filled."""
    return ~without_small(~mask.astype(bool), least, connectivity)


def largest(labels: np.ndarray) -> tuple[np.ndarray, bool]:
    """(mask of the largest object, whether others are as large); of equals the smallest label."""
    sizes = areas(labels)
    if not sizes.any():
        return np.zeros(labels.shape, bool), False
    return labels == sizes.argmax(), bool((sizes == sizes.max()).sum() > 1)


def clear_border(labels: np.ndarray) -> np.ndarray:
    """Labels without the objects that touch a face."""
    edge = set()
    for axis in range(labels.ndim):
        edge |= set(np.unique(labels.take([0, -1], axis=axis)).tolist())
    keep = np.ones(int(labels.max(initial=0)) + 1, bool)
    keep[list(edge)] = False
    keep[0] = False
    return np.where(keep[labels], labels, 0)


def relabelled(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered from 1 without gaps, in their order."""
    names = np.unique(labels[labels > 0])
    return np.where(labels > 0, np.searchsorted(names, labels) + 1, 0).astype(np.int32)


def filled_from_corners(mask: np.ndarray) -> np.ndarray:
    """Pixels of the mask's value 1 that connect to a corner of the plane, diagonals included."""
    labels = label(mask)
    corners = {int(labels[c]) for c in itertools.product(*[(0, n - 1) for n in mask.shape])} - {0}
    return np.isin(labels, list(corners))
