"""Spectral indices as column expressions over reflectance bands. Division by zero gives NULL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import clamp, known


def normalized_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


def savi(nir: Column, red: Column, soil: float = 0.5) -> Column:
    return F.try_divide((nir - red) * (1 + soil), nir + red + soil)


@dataclass(frozen=True)
class Bands:
    """Column names of the bands an index may use."""

    green: str = "green"
    red: str = "red"
    nir: str = "nir"
    swir1: str = "swir1"
    swir2: str = "swir2"
    tir: str = "tir"


def index(name: str, bands: Bands = Bands()) -> Column:
    """An index by name: NDVI, NDBI, NDWI, NBR, UI, MNDWI, SAVI, BU, IBI, NDISI or EBBI."""
    green, red, nir, swir1, swir2, tir = (F.col(getattr(bands, b)) for b in ("green", "red", "nir", "swir1", "swir2", "tir"))
    nd = normalized_difference
    plain = {"NDVI": (nir, red), "NDBI": (swir1, nir), "NDWI": (green, nir), "NBR": (nir, swir2), "UI": (swir2, nir), "MNDWI": (green, swir1)}
    if name in plain:
        return nd(*plain[name])
    if name == "SAVI":
        return savi(nir, red)
    if name == "BU":
        return nd(swir1, nir) - nd(nir, red)
    if name == "IBI":
        mean = (savi(nir, red) + nd(green, swir1)) / 2
        return clamp(nd(nd(swir1, nir), mean), -1, 1)
    if name == "NDISI":
        heat = clamp(tir / 50, 0, 1)
        mean = ((nd(green, swir1) + 1) / 2 + clamp(nir, 0, 1) + clamp(swir1, 0, 1)) / 3
        return clamp(nd(heat, mean), -1, 1)
    if name == "EBBI":
        return known((swir1 - nir) / (F.sqrt(F.greatest(swir1 + tir, F.lit(1e-6))) * 10) * 100, swir1, nir, tir)
    raise ValueError(f"no index {name}; there are {', '.join([*plain, 'SAVI', 'BU', 'IBI', 'NDISI', 'EBBI'])}")


# fixed values: direction of the change looked for, thresholds of affected and severe cells, display range
METHODS = {
    "NDVI": ("loss", -0.15, -0.30, 0.6),
    "NDBI": ("gain", 0.10, 0.20, 0.5),
    "UI": ("gain", 0.08, 0.18, 0.5),
    "BU": ("gain", 0.10, 0.25, 0.8),
    "IBI": ("gain", 0.10, 0.25, 1.0),
    "NDWI": ("gain", 0.10, 0.25, 0.6),
    "NBR": ("loss", -0.10, -0.27, 0.6),
}


def reflectance_s2(dn: Column) -> Column:
    return dn / 10000


def harmonised_s2(dn: Column, acquired: Column) -> Column:
    """Digital numbers of scenes from 2022-01-25 on without the offset of 1000 that their baseline has."""
    return F.when(acquired >= F.lit("2022-01-25").cast("timestamp"), F.when(dn.isNotNull(), F.greatest(dn - 1000, F.lit(0)))).otherwise(dn)


def reflectance_landsat(dn: Column) -> Column:
    return dn * 0.0000275 - 0.2


def celsius_landsat(dn: Column) -> Column:
    return dn * 0.00341802 + 149 - 273.15


def decibels(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(power))
