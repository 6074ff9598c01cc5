"""Segmentation recipes on arrays: what one task does with one image.

Sizes, smoothing and thresholds are the workflows' own values, as defaults of named parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lumispark.kernels import distance, filters, morphology, segmentation


def channel_sum(a: np.ndarray, b: np.ndarray, overflow: str = "wrap") -> np.ndarray:
    """Sum of two byte channels: modulo 256 ("wrap"), or in wider integers ("widen")."""
    return a + b if overflow == "wrap" else a.astype(np.int32) + b


@dataclass(frozen=True)
class AcinusRule:
    """How one acinus is cut out of its image."""

    blur: float = 4.0
    holes: int = 100_000
    objects: int = 10_000
    erode_by: int = 8
    limit: float = 0.55
    measure: str = "roundness"  # or "eccentricity", for planes: below the limit the object is split

    def is_whole(self, mask: np.ndarray) -> bool:
        value = segmentation.roundness(mask) if self.measure == "roundness" else segmentation.eccentricity(mask)
        return value is not None and value >= self.limit


def acinus_mask(image: np.ndarray, rule: AcinusRule = AcinusRule()) -> tuple[np.ndarray, str]:
    """(mask of the largest object, flag). Flags, later ones overwriting earlier: None,
    multiple_acini_split, Hole, and No Area where nothing is found. Of equal objects the first."""

    def objects(sigma: float) -> np.ndarray:
        smooth = filters.gaussian(image, sigma)
        mask = morphology.without_holes(smooth > filters.otsu(smooth), rule.holes)
        return morphology.without_small(mask, rule.objects)

    mask, _ = morphology.largest(morphology.label(objects(rule.blur)))
    if not mask.any():
        return mask, "No Area"
    flag = "None"
    if not rule.is_whole(mask):
        eroded = morphology.erode(objects(1), morphology.ball(rule.erode_by, image.ndim))
        part, _ = morphology.largest(morphology.label(eroded.astype(bool)))
        if not part.any():
            return part, "No Area"
        mask, flag = distance.expand(part.astype(int), rule.erode_by) > 0, "multiple_acini_split"
    if morphology.label(~mask).max() > 1:
        flag = "Hole"
    return mask, flag


def shrink_factors(px: float, pz: float, by: float = 0.25) -> tuple[float, float, float]:
    """Resampling to cubic voxels of px / by."""
    return by * pz / px, by, by


def acinus(stack: np.ndarray, px: float, pz: float, nuclear: int = 0, membrane: int = 1, overflow: str = "wrap", rule: AcinusRule = AcinusRule()) -> dict:
    """Volume and roundness of the acinus in a (z, c, y, x) stack."""
    bytes_ = filters.to_bytes(stack)
    image = filters.rescale(channel_sum(bytes_[:, nuclear], bytes_[:, membrane], overflow), shrink_factors(px, pz))
    mask, flag = acinus_mask(filters.clip_quantiles(image, 0.10, 0.85), rule)
    if not mask.any():
        return {"vol_um": None, "roundness": None, "flag": flag}
    return {"vol_um": float(mask.sum()) * (4 * px) ** 3, "roundness": segmentation.roundness(mask), "flag": flag}


def split_nuclei(binary: np.ndarray, px: float, min_radius_um: float = 2.0) -> np.ndarray:
    """Nuclei of a binary stack by watershed on its distance map; px is of the shrunk voxel."""
    smooth = filters.gaussian(binary.astype(float), 1)
    mask = morphology.without_holes(smooth > filters.otsu(smooth), 1000)
    far = distance.distances(morphology.erode(mask, morphology.ball(3, mask.ndim)).astype(bool))
    points = segmentation.peaks(far, max(1, int(4 / px)))
    parts = segmentation.watershed(-far, segmentation.seeds(mask.shape, points, 2), mask)
    parts = morphology.clear_border(parts)
    big = morphology.areas(parts) >= 4 / 3 * np.pi * (min_radius_um / px) ** 3
    return np.where(big[parts], parts, 0)


def split_cells(membrane: np.ndarray, nuclei: np.ndarray, within: np.ndarray, grow: int = 12) -> np.ndarray:
    """Cells around nuclei: watershed in the inverse of the membrane, seeded at truncated centroids."""
    smooth = filters.gaussian(membrane.astype(float), 1)
    inner = ~(smooth > filters.otsu(smooth))
    centres = segmentation.centroids(nuclei).astype(int)
    cells = segmentation.watershed(-distance.distances(inner), segmentation.seeds(nuclei.shape, centres, 2), inner)
    return np.where(within, distance.expand(morphology.clear_border(cells), grow), 0)


def cells(stack: np.ndarray, nuclear_binary: np.ndarray, membrane_binary: np.ndarray, px: float, pz: float, nuclear: int = 0, membrane: int = 1, overflow: str = "wrap") -> tuple[np.ndarray, np.ndarray, str]:
    """(nucleus labels, cell labels, flag) on the shrunk grid. Masks are 0 and 1, whatever their label was."""
    factors = shrink_factors(px, pz)
    raw = [filters.rescale(filters.to_bytes(stack[:, c]), factors) for c in (nuclear, membrane)]
    both = channel_sum(raw[0].astype(np.uint8), raw[1].astype(np.uint8), overflow).astype(float)
    mask, flag = acinus_mask(filters.clip_quantiles(both, 0.0, 0.95))
    inside = [filters.rescale(b.astype(float), factors) * mask for b in (nuclear_binary, membrane_binary)]
    nuclei = split_nuclei(inside[0], 4 * px)
    return nuclei, split_cells(inside[1], nuclei, mask), flag


def radial_distances(image: np.ndarray, rule: AcinusRule, expand_by: int = 3, radius_rule: str = "code") -> tuple[np.ndarray, np.ndarray, float, str]:
    """(mask, distances within, radius, flag) of the acinus of an image, solid or plane.

    A plane's radius keeps the ball's factor 3 by default; radius_rule "disc" drops it."""
    mask, flag = acinus_mask(image, rule)
    mask = distance.expand(mask.astype(int), expand_by) > 0 if mask.any() else mask
    size = float(mask.sum())
    radius = np.cbrt(3 * size / (4 * np.pi)) if image.ndim == 3 else np.sqrt((3 if radius_rule == "code" else 1) * size / np.pi)
    return mask, distance.distances(mask), float(radius), flag


def frame_nuclei(binary_of: np.ndarray) -> np.ndarray:
    """Nucleus labels of one frame of summed channels."""
    disk = morphology.ball(2, 2)
    mask = morphology.without_small(morphology.closing(binary_of > filters.otsu(binary_of), disk).astype(bool), 100)
    far = distance.distances(morphology.erode(mask, disk).astype(bool))
    parts = segmentation.watershed(-far, segmentation.seeds(mask.shape, segmentation.peaks(far, 8), 2), mask)
    return morphology.relabelled(morphology.clear_border(parts))


def frame_mask(channel: np.ndarray) -> np.ndarray:
    """Where one colour of one frame is above its threshold."""
    return morphology.without_small(morphology.closing(channel > filters.otsu(channel), morphology.ball(2, 2)).astype(bool), 100)


def movie_nuclei(movie: np.ndarray, z_um: float = 6.08, xy_um: float = 0.1700744, power: int = 2) -> np.ndarray:
    """Nucleus labels of a (t, z, y, x) movie on a grid of half the width; the blur runs over time too.

    power is the exponent of the smallest volume's radius: 2 as the workflow has it, 3 for a ball."""
    small = filters.rescale(filters.to_bytes(movie), (1, 0.5 * z_um / xy_um, 0.5, 0.5))
    smooth = filters.gaussian(small, 2)
    limit, px = filters.otsu(smooth), 2 * xy_um
    out = np.zeros(smooth.shape, np.int32)
    for t, frame in enumerate(smooth > limit):
        far = distance.distances(morphology.erode(frame, morphology.ball(3, 3)).astype(bool))
        parts = segmentation.watershed(-far, segmentation.seeds(frame.shape, segmentation.peaks(far, 20), 2), frame)
        out[t] = np.where((morphology.areas(parts) >= 4 / 3 * np.pi * (4 / px) ** power)[parts], parts, 0)
    return out


def brightfield(image: np.ndarray, method: str = "intensity") -> np.ndarray:
    """Acinus labels of a brightfield plane, by intensity or by edges."""
    inverted = image.max() - image.astype(float)
    flat = inverted - filters.rolling_ball(inverted, 10 if method == "intensity" else 5)
    if method == "intensity":
        smooth = filters.gaussian(flat, 2)
        back = smooth.max() - smooth
        mask = morphology.without_holes(back > filters.triangle(back), 100_000)
        mask = morphology.without_small(morphology.erode(mask, morphology.ball(2, 2)).astype(bool), 500)
        return morphology.clear_border(morphology.label(mask))
    smooth = filters.gaussian(flat, 2)
    back = smooth.max() - smooth
    edges = filters.laplace(filters.gaussian(back, 15))
    sharp = 10 * (edges.max() - edges) + back
    mask = morphology.closing(sharp > filters.triangle(sharp), morphology.ball(10, 2)).astype(bool)
    mask = morphology.erode(morphology.without_holes(mask, 100_000), morphology.ball(3, 2)).astype(bool)
    labels = morphology.label(morphology.without_small(mask, 1000))
    ragged = [k for k, own in segmentation.objects(labels) if segmentation.solidity(own) < 0.4]
    return morphology.clear_border(np.where(np.isin(labels, ragged), 0, labels))


def collagen(rgb: np.ndarray, waves: int = 12, order: str = "rc") -> dict[str, np.ndarray]:
    """Ring around the duct of an RGB plane, with normals to it and orientation of the fibres."""
    clipped = np.minimum(rgb.astype(float), np.quantile(rgb, 0.95))
    dark = filters.gaussian(filters.grey(clipped), 5)
    outside = ~(dark > filters.yen(dark))
    lumen = morphology.without_holes(outside & ~morphology.filled_from_corners(outside), 500)
    duct, _ = morphology.largest(morphology.label(lumen))
    duct = segmentation.smoothed_fill(duct, waves) if duct.any() else duct
    gy, gx = np.gradient(distance.signed_distances(duct)) if duct.any() else (np.zeros(duct.shape),) * 2
    length = np.hypot(gy, gx) + 1e-8
    angle = segmentation.orientation(filters.gaussian(filters.grey(rgb), 2), 3, order)
    ring = distance.ring(duct, 1, 60) if duct.any() else np.zeros(duct.shape, bool)
    return {"ring": ring, "ny": gy / length, "nx": gx / length, "angle": angle}
