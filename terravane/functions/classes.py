"""Class lookups. Queries carry codes; labels belong to the output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: lower bounds from high to low (a bound belongs to its class), or upper bounds (inclusive) for ISPU
SPI = (2.0, 1.5, 1.0, -1.0, -1.5, -2.0, -99.0)
VHI = (40.0, 30.0, 20.0, 10.0, -1.0)
ENSO = (2.0, 1.5, 1.0, 0.5, -0.5, -1.0, -1.5, -99.0)
IOD = (0.4, -0.4, -99.0)
ISPU = (15.5, 55.4, 150.4, 250.4)


def class_from_above(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that the value reaches; NULL if none is."""
    out = F.when(value >= bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(value >= b, k)
    return out


def class_up_to(value: Column, bounds: Sequence[float]) -> Column:
    """Index of the first bound that the value doesn't exceed, or their number."""
    out = F.when(value <= bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(value <= b, k)
    return out.when(value.isNotNull(), len(bounds))


def drought_class(rain_z: Column, soil_z: Column, vhi: Column) -> Column:
    """0 normal, 1 watch, 2 warning, 3 alert, 4 soil or vegetation only."""
    dry, soil, stressed = rain_z < -1, soil_z < -1, vhi < 40
    return F.when(~dry & (soil | stressed), 4).when(dry & soil & stressed, 3).when(dry & soil, 2).when(dry, 1).otherwise(0)


def population_class(before: Column, after: Column, neutral_pct: float, least: float) -> Column:
    """0 empty, 1 steady, 2 gain, 3 loss. NULL counts as no population."""
    before, after = F.coalesce(before, F.lit(0.0)), F.coalesce(after, F.lit(0.0))
    pct = population_pct(before, after)
    return F.when(F.greatest(before, after) < least, 0).when(pct > neutral_pct, 2).when(pct < -neutral_pct, 3).otherwise(1)


def population_pct(before: Column, after: Column) -> Column:
    """Percent of change; 999 where there was none before."""
    return F.when(before > 0, 100 * (after - before) / F.when(before > 0, before)).when(after > 0, F.lit(999.0)).otherwise(0.0)
