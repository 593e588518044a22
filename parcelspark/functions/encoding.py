"""Inputs of an encoder: reflectance, time and place encodings, band wavelengths, seeds."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band centre wavelengths in nanometres.
WAVELENGTHS = {
    "B02": 492.4,
    "B03": 559.8,
    "B04": 664.6,
    "B08": 832.8,
    "B05": 704.1,
    "B06": 740.5,
    "B07": 782.8,
    "B8A": 864.7,
    "B11": 1613.7,
    "B12": 2202.4,
}
REFLECTANCE_SCALE = 10_000.0


def reflectance(pixels: Column) -> Column:
    """Integer pixels, one array per band, as reflectance."""
    return F.transform(pixels, lambda band: F.transform(band, lambda v: v / REFLECTANCE_SCALE))


def time_encoding(day: Column) -> Column:
    """Sine and cosine of the day of the year, and of noon."""
    angle = F.dayofyear(day) / 365.25 * (2 * pi)
    return F.array(F.sin(angle), F.cos(angle), F.lit(0.0), F.lit(1.0))


def place_encoding(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.array(F.sin(la), F.cos(la), F.sin(lo), F.cos(lo))


def parcel_seed(parcel_id: Column) -> Column:
    """The first eight hexadecimal digits of the id's MD5 as a number."""
    return F.conv(F.substring(F.md5(parcel_id.cast("string")), 1, 8), 16, 10).cast("long")


def wavelengths(bands: Column) -> Column:
    """Wavelength of each band, 0 for unknown ones."""
    known = F.create_map(*[F.lit(x) for pair in WAVELENGTHS.items() for x in pair])
    return F.transform(bands, lambda b: F.coalesce(F.try_element_at(known, b), F.lit(0.0)))
