"""Whether two images can be used together. Geometry is given as {axis: size} and {axis: pixel size}."""

from __future__ import annotations

import math


class GeometryError(ValueError):
    """Two images that do not fit."""


def _shared(reference: dict[str, int], other: dict[str, int]) -> list[str]:
    return [a for a in reference if a in other and a != "c"]


def axes_match(reference: dict[str, int], other: dict[str, int]) -> bool:
    """The same axes in the same order, but for channels."""
    return [a for a in reference if a != "c"] == [a for a in other if a != "c"]


def dimensions_match(reference: dict[str, int], other: dict[str, int], allow_singleton: bool = False) -> bool:
    """Equal sizes of all axes but channels; an axis that one image lacks counts as one pixel, which fits any size if allowed."""
    for a in {*reference, *other} - {"c"}:
        m, n = reference.get(a, 1), other.get(a, 1)
        if m != n and not (allow_singleton and 1 in (m, n)):
            return False
    return True


def rescalable(reference: dict[str, int], other: dict[str, int], pixel: dict[str, float], other_pixel: dict[str, float]) -> bool:
    """The other image covers the reference at another resolution: each size lies within the rounded ones of size times ratio of pixel sizes."""
    if not axes_match(reference, other):
        return False
    for a in _shared(reference, other):
        expected = reference[a] * pixel.get(a, 1.0) / other_pixel.get(a, 1.0)
        if not math.floor(expected + 1e-9) <= other[a] <= math.ceil(expected - 1e-9):
            return False
    return True


def require_axes_match(reference: dict[str, int], other: dict[str, int]) -> None:
    if not axes_match(reference, other):
        raise GeometryError(f"axes {list(reference)} and {list(other)}")


def require_dimensions_match(reference: dict[str, int], other: dict[str, int], allow_singleton: bool = False) -> None:
    if not dimensions_match(reference, other, allow_singleton):
        raise GeometryError(f"shapes {reference} and {other}")


def require_rescalable(reference: dict[str, int], other: dict[str, int], pixel: dict[str, float], other_pixel: dict[str, float]) -> None:
    if not rescalable(reference, other, pixel, other_pixel):
        raise GeometryError(f"shapes {reference} and {other} at pixel sizes {pixel} and {other_pixel}")
