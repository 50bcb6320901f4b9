"""Fire weather: humidity, the six codes of the Canadian system and class lookups, as column expressions. A code is NULL wherever one
of its inputs is."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .masks import clamp, known

# fixed values: start of season, and day-length factors by month north of the tropics
START = {"ffmc": 85.0, "dmc": 6.0, "dc": 15.0}
DMC_DAYLENGTH = (6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0)
DC_DAYLENGTH = (-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6)
DMC_TROPICS, DC_TROPICS, TROPICS = 9.0, 1.4, 15.0

# fixed values: lower bounds of the classes moderate, high and extreme of each code
BREAKS = {"FFMC": (73, 78, 82), "DMC": (5, 15, 29), "DC": (141, 261, 350), "BUI": (7, 20, 33), "ISI": (2, 4, 5), "FWI": (2, 7, 13)}


def relative_humidity(t: Column, dew: Column, a: float = 17.625, b: float = 243.04) -> Column:
    """Percent, by Magnus' formula, from temperature and dew point in degrees Celsius."""
    return clamp(F.exp(a * dew / (dew + b) - a * t / (t + b)) * 100, 0, 100)


def wet_bulb(t: Column, rh: Column) -> Column:
    """Degrees Celsius, by Stull's formula."""
    rh = clamp(rh, 1, 100)
    return t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, F.lit(1.5)) * F.atan(0.023101 * rh) - 4.686035


def wind_kmh(u: Column, v: Column) -> Column:
    return F.hypot(u, v) * 3.6


def noon_utc_hour(lon: Column) -> Column:
    """UTC hour nearest to solar noon; halves go to the even hour."""
    return F.pmod(F.bround(12 - lon / 15).cast("int"), F.lit(24))


def day_length(lat: Column, day: Column, which: str) -> Column:
    table, tropical = (DMC_DAYLENGTH, DMC_TROPICS) if which == "dmc" else (DC_DAYLENGTH, DC_TROPICS)
    return F.when(F.abs(lat) < TROPICS, F.lit(tropical)).when(lat.isNotNull(), F.element_at(F.array(*map(F.lit, table)), F.month(day)))


def _moisture(ffmc: Column) -> Column:
    return 147.2 * (101 - ffmc) / (59.5 + ffmc)


def ffmc_next(before: Column, t: Column, h: Column, w: Column, rain: Column) -> Column:
    """Fine fuel moisture code a day on."""
    was = _moisture(before)
    fell = rain - 0.5
    wet = was + 42.5 * fell * F.exp(-100 / (251 - was)) * (1 - F.exp(-6.93 / fell))
    wet = wet + F.when(was > 150, 0.0015 * (was - 150) * (was - 150) * F.sqrt(fell)).otherwise(0.0)
    m = F.when(rain > 0.5, F.least(wet, F.lit(250.0))).otherwise(was)
    heat = 0.18 * (21.1 - t) * (1 - F.exp(-0.115 * h))
    drying = 0.942 * F.pow(h, F.lit(0.679)) + 11 * F.exp((h - 100) / 10) + heat
    wetting = 0.618 * F.pow(h, F.lit(0.753)) + 10 * F.exp((h - 100) / 10) + heat

    def rate(x: Column) -> Column:
        return 0.581 * F.exp(0.0365 * t) * (0.424 * (1 - F.pow(x, F.lit(1.7))) + 0.0694 * F.sqrt(w) * (1 - F.pow(x, F.lit(8.0))))

    dry = drying + (m - drying) * F.pow(F.lit(10.0), -rate(h / 100))
    damp = wetting - (wetting - m) * F.pow(F.lit(10.0), -rate((100 - h) / 100))
    now = F.when((m < drying) & (m < wetting), damp).when(m > drying, dry).otherwise(m)
    return known(clamp(59.5 * (250 - now) / (147.2 + now), 0, 101), before, t, h, w, rain)


def dmc_next(before: Column, t: Column, h: Column, rain: Column, daylength: Column) -> Column:
    """Duff moisture code a day on."""
    fell = 0.92 * rain - 1.27
    was = 20 + F.exp(5.6348 - before / 43.43)
    slope = F.when(before > 65, 6.2 * F.ln(before) - 17.2).when(before > 33, 14 - 1.3 * F.ln(before)).otherwise(100 / (0.5 + 0.3 * before))
    wet = was + 1000 * fell / (48.77 + slope * fell)
    start = F.when(rain > 1.5, F.greatest(244.72 - 43.43 * F.ln(wet - 20), F.lit(0.0))).otherwise(before)
    return known(F.greatest(start + 1.894e-4 * (F.greatest(t, F.lit(-1.1)) + 1.1) * (100 - h) * daylength, F.lit(0.0)), before, t, h, rain, daylength)


def _drought(before, t, rain, daylength, exp, ln, most, where):
    """The formula of the drought code, over columns or numbers alike."""
    wet = 800 * exp(-before / 400) + 3.937 * (0.83 * rain - 1.27)
    start = where(rain > 2.8, most(400 * ln(800 / wet), 0.0), before)
    return most(start + 0.5 * most(0.36 * (most(t, -2.8) + 2.8) + daylength, 0.0), 0.0)


def dc_next(before: Column, t: Column, rain: Column, daylength: Column) -> Column:
    """Drought code a day on."""
    columns = F.exp, F.ln, lambda x, low: F.greatest(x, F.lit(low)), lambda rule, x, other: F.when(rule, x).otherwise(other)
    return known(_drought(before, t, rain, daylength, *columns), before, t, rain, daylength)


def dc_fold(before: float, days: Iterable[tuple[float, float, float]]) -> list[float]:
    """The drought code after each day (t, rain, day-length factor), by the same formula over numbers; NaN stands for masked, and stays."""
    out = []
    with np.errstate(invalid="ignore", divide="ignore"):
        for t, rain, daylength in days:
            known_ = not (np.isnan(before) or np.isnan(t) or np.isnan(rain))
            before = float(_drought(np.float64(before), t, rain, daylength, np.exp, np.log, np.maximum, np.where)) if known_ else np.nan
            out.append(before)
    return out


def isi(ffmc: Column, w: Column) -> Column:
    m = _moisture(ffmc)
    return 0.208 * F.exp(0.05039 * w) * 91.9 * F.exp(-0.1386 * m) * (1 + F.pow(m, F.lit(5.31)) / 4.93e7)


def bui(dmc: Column, dc: Column) -> Column:
    both = F.try_divide(0.8 * dc, dmc + 0.4 * dc)
    high = dmc - (1 - both) * (0.92 + F.pow(0.0114 * dmc, F.lit(1.7)))
    return F.greatest(F.when(dmc > 0.4 * dc, high).otherwise(both * dmc), F.when(dmc.isNotNull() & dc.isNotNull(), 0.0))


def fwi(spread: Column, buildup: Column) -> Column:
    weight = F.when(buildup > 80, 1000 / (25 + 108.64 * F.exp(-0.023 * buildup))).otherwise(0.626 * F.pow(buildup, F.lit(0.809)) + 2)
    b = 0.1 * spread * weight
    return known(F.when(b > 1, F.exp(2.72 * F.pow(0.434 * F.ln(F.when(b > 1, b)), F.lit(0.647)))).otherwise(F.greatest(b, F.lit(0.0))), spread, buildup)


def danger_class(code: str, value: Column) -> Column:
    """0 low, 1 moderate, 2 high, 3 extreme; a bound belongs to the class above it. NULL stays NULL."""
    low, middle, high = BREAKS[code]
    return F.when(value >= high, 3).when(value >= middle, 2).when(value >= low, 1).when(value.isNotNull(), 0)
