"""Physical scale and coordinate arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite

MM_PER_INCH = 25.4


def support_size(size: Column, ppi: Column, reference_ppi: float) -> Column:
    """a support size at the reference resolution, in this image's pixels; null unless all are finite and positive."""
    good = finite(size.cast("double")) & (size > 0) & finite(ppi.cast("double")) & (ppi > 0)
    return F.when(good, size.cast("double") * ppi.cast("double") / F.lit(float(reference_ppi)))


def pixels_to_mm(pixels: Column, ppi: Column) -> Column:
    """F12."""
    return pixels * F.lit(MM_PER_INCH) / ppi


def mm_to_pixels(mm: Column, ppi: Column) -> Column:
    """F12."""
    return mm * ppi / F.lit(MM_PER_INCH)


def cycles_per_mm(cycles_per_pixel: Column, ppi: Column) -> Column:
    """F12."""
    return cycles_per_pixel * ppi / F.lit(MM_PER_INCH)


def pixel_centre(c: Column, source: Column, target: Column) -> Column:
    """((c + 0.5)·target / source) − 0.5; null outside the target."""
    x = (c + 0.5) * target / source - 0.5
    return F.when((x >= -0.5) & (x <= target - 0.5), x)


def dpi_fault(dpi: Column, least: float = 100, most: float = 4000) -> Column:
    """there is no default resolution; null where the value is usable, else the reason."""
    x = dpi.cast("double")
    return F.when(x.isNull(), "missing_dpi").when(~finite(x), "non_finite_dpi").when((x < least) | (x > most), "dpi_out_of_range")


def to_reference(x: Column, ppi: Column, reference_ppi: float) -> Column:
    """K2: a coordinate at the reference resolution."""
    return x * (F.lit(float(reference_ppi)) / ppi)


def decomposition(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct<determinant, scale, rotation_degrees> of the linear part [[a, b], [c, d]]."""
    det = a * d - b * c
    return F.struct(det.alias("determinant"), F.sqrt(F.abs(det)).alias("scale"), F.degrees(F.atan2(c, a)).alias("rotation_degrees"))


def inside(x: Column, y: Column, width: Column, height: Column) -> Column:
    """a keypoint is finite and inside the image."""
    return finite(x) & finite(y) & (x >= 0) & (y >= 0) & (x < width) & (y < height)
