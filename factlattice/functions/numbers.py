"""Numbers: coercion, half-even rounding, shares, bins, and distances on the earth."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS-84 ellipsoid: equatorial radius in metres, flattening; metres in a mile; mean radius in km (fixed values).
RADIUS, FLATTENING, MILE, MEAN_KM = 6_378_137.0, 1 / 298.257223563, 1_609.344, 6_371.0088


def numeric(text: Column) -> Column:
    """A number; NULL where the text is none."""
    return F.trim(text.cast("string")).try_cast("double")


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounded, halves to the even neighbour."""
    return F.bround(value.cast("double"), digits)


def ratio(a: Column, b: Column) -> Column:
    """a / b; NULL where b is 0."""
    return F.when(b != 0, a.cast("double") / b)


def percent_of(value: Column, total: Column, digits: int = 1) -> Column:
    """What share of the total, in percent, half-even; NULL stays NULL."""
    return half_even(100 * ratio(value, total), digits)


def percent_change(value: Column, base: Column) -> Column:
    return 100 * ratio(value - base, base)


def binned(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the bin [edges[i], edges[i + 1]) that holds the value; NULL outside and for NULL."""
    out = F.lit(None).cast("string")
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        out = F.when((value >= low) & (value < high), F.lit(label)).otherwise(out)
    return out


def great_circle_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a sphere, within half a percent of the ellipsoid's; built-in functions only."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def ellipsoid_miles(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Geodesic distance on WGS-84 by Vincenty's inverse formula; nearly antipodal points, where it
    doesn't converge, are NaN."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    l0 = np.radians(lon2 - lon1)
    l, error = l0.copy(), np.full_like(l0, np.inf)
    with np.errstate(all="ignore"):
        for _ in range(200):
            sin_s = np.hypot(np.cos(u2) * np.sin(l), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(l))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(l)
            s = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(l) / sin_s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2)
            c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            fresh = l0 + (1 - c) * FLATTENING * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            error, l = np.abs(fresh - l), fresh
            if not (error > 1e-12).any():
                break
        k = cos2 * (1 / (1 - FLATTENING) ** 2 - 1)
        a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        turn = b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        out = RADIUS * (1 - FLATTENING) * a * (s - turn) / MILE
    return np.where(error > 1e-9, np.nan, out)


def geodesic_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles between two points on WGS-84; NULL where a coordinate is."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        out = pd.Series(ellipsoid_miles(*(x.to_numpy(dtype=float) for x in (a, b, c, d))))
        return out.where(out.notna(), None)

    return run(*(c.cast("double") for c in (lat1, lon1, lat2, lon2)))
