"""Numeric expressions with the rounding and overflow that image tools use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value, places)


def wrapped_sum(*channels: Column) -> Column:
    """Sum in unsigned bytes: modulo 256."""
    return F.pmod(reduce(lambda a, b: a + b, (c.cast("int") for c in channels)), F.lit(256))


def widened_sum(*channels: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.cast("int") for c in channels))


def rescaled(value: Column, low: Column, high: Column, top: int = 255) -> Column:
    """value from [low, high] to [0, top], truncated; null where low equals high."""
    return F.try_divide((value - low) * F.lit(float(top)), high - low).cast("int")


def clipped(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def grey(red: Column, green: Column, blue: Column) -> Column:
    """Luminance of a colour."""
    return F.lit(0.2125) * red + F.lit(0.7154) * green + F.lit(0.0721) * blue


def hue(red: Column, green: Column, blue: Column) -> Column:
    """Hue in [0, 1); 0 where the colour is grey."""
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    span = top - low
    sixth = (
        F.when(span == 0, F.lit(0.0))
        .when(top == red, F.try_divide(green - blue, span))
        .when(top == green, F.lit(2.0) + F.try_divide(blue - red, span))
        .otherwise(F.lit(4.0) + F.try_divide(red - green, span))
    )
    turned = sixth / F.lit(6.0)
    return F.when(turned < 0, turned + 1).otherwise(turned)


def saturation(red: Column, green: Column, blue: Column) -> Column:
    top, low = F.greatest(red, green, blue), F.least(red, green, blue)
    return F.coalesce(F.try_divide(top - low, top), F.lit(0.0))


def sphere_volume(radius: float) -> float:
    return 4 / 3 * 3.141592653589793 * radius**3


def volume_radius(volume: Column) -> Column:
    """Radius of the ball of a volume."""
    return F.cbrt(F.lit(3.0) * volume / (F.lit(4.0) * F.pi()))


def area_radius(area: Column, rule: str = "code") -> Column:
    """Radius for an area: by default with the factor of the ball's formula kept; "disc" for a disc's."""
    return F.sqrt((F.lit(3.0) if rule == "code" else F.lit(1.0)) * area / F.pi())


def spacing(tags: Column) -> Column:
    """z step from image tags: the third comma-separated entry after nscales= of the metadata tag,
    else what follows spacing= in the description, else null."""
    scales = F.regexp_extract(F.try_element_at(tags, F.lit("IJMetadata")), r"nscales=([^\n]*)", 1)
    third = F.try_element_at(F.split(scales, ","), F.lit(3)).try_cast("double")
    return F.coalesce(third, number_after(F.try_element_at(tags, F.lit("ImageDescription")), "spacing"))


def whole_steps(value: Column) -> Column:
    """The smallest whole number that isn't below the value."""
    return F.ceil(value)


def number_after(text: Column, label: str) -> Column:
    """The number after label= in a text; null where there is none or it doesn't parse."""
    return F.regexp_extract(text, label + r"=([0-9.eE+-]+)", 1).try_cast("double")
