"""Colours for labels and plots."""

from __future__ import annotations

import colorsys
import random

#: The base colours of label images.
LABEL_BASES = ("#32CD32", "#1E90FF", "#FF8C00", "#FF0000", "#FFFF00", "#9400D3", "#FF1493")


def shades(base: str, many: int, darkest: float = 0.7, lightest: float = 1.3) -> list[tuple[float, float, float]]:
    """`many` colours of one hue and saturation, as RGB from 0 to 1: the base's lightness times even
    steps from darkest to lightest, held within 0 and 1."""
    hue, lightness, saturation = colorsys.rgb_to_hls(*(int(base[k : k + 2], 16) / 255 for k in (1, 3, 5)))
    step = (lightest - darkest) / (many - 1) if many > 1 else 0.0
    return [colorsys.hls_to_rgb(hue, min(1.0, max(0.0, lightness * (darkest + k * step))), saturation) for k in range(many)]


def wide_shades(base: str, many: int = 14) -> list[tuple[float, float, float]]:
    return shades(base, many, 0.6, 1.4)


def label_colours(n_labels: int, seed: int = 0) -> dict[int, tuple[float, ...]]:
    """Label to colour: 0 is transparent, the others are shades of the bases in a seeded shuffle, at
    least one for each label."""
    each = -(-n_labels // len(LABEL_BASES))
    colours: list[tuple[float, ...]] = [c for base in LABEL_BASES for c in shades(base, each)]
    random.Random(seed).shuffle(colours)
    return {0: (0.0, 0.0, 0.0, 0.0)} | dict(enumerate(colours, 1))
