"""Lambert's azimuthal equal-area projection of the WGS 84 ellipsoid, by the usual published formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid, and the centre (latitude, longitude) from which longitudes of 19 to 190 degrees have no break.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
CENTRE = (60.0, 105.0)

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sine: float) -> float:
    return (1 - _E2) * (sine / (1 - _E2 * sine * sine) - math.log((1 - _E * sine) / (1 + _E * sine)) / (2 * _E))


_QP = _q(1.0)
#: Radius of the sphere with the ellipsoid's area.
RADIUS = AXIS * math.sqrt(_QP / 2)


def _centre(centre: tuple[float, float]) -> tuple[float, float, float, float]:
    """Sine and cosine of the centre's authalic latitude, the scale between the axes, and the longitude in radians."""
    sine, cosine = math.sin(math.radians(centre[0])), math.cos(math.radians(centre[0]))
    beta = math.asin(_q(sine) / _QP)
    scale = AXIS * cosine / math.sqrt(1 - _E2 * sine * sine) / (RADIUS * math.cos(beta))
    return math.sin(beta), math.cos(beta), scale, math.radians(centre[1])


def forward(lat: Column, lon: Column, centre: tuple[float, float] = CENTRE) -> tuple[Column, Column]:
    """Metres east and north of the centre; null where a coordinate is null. The point opposite the centre has no place."""
    sine1, cosine1, scale, lon0 = _centre(centre)
    s = F.sin(F.radians(lat))
    q = (1 - _E2) * (s / (1 - _E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))
    sb = F.when(q.isNotNull(), F.greatest(F.least(q / _QP, F.lit(1.0)), F.lit(-1.0)))
    cb, turn = F.sqrt(1 - sb * sb), F.radians(lon) - lon0
    b = RADIUS * F.sqrt(2 / (1 + sine1 * sb + cosine1 * cb * F.cos(turn)))
    return b * scale * cb * F.sin(turn), b / scale * (cosine1 * sb - sine1 * cb * F.cos(turn))


def backward(x: Column, y: Column, centre: tuple[float, float] = CENTRE) -> tuple[Column, Column]:
    """Latitude and longitude in degrees, longitudes from -180 to 180; the inverse of :func:`forward`. Null where a coordinate is null."""
    sine1, cosine1, scale, lon0 = _centre(centre)
    u, v = x / scale, y * scale
    rho = F.sqrt(u * u + v * v)
    c = 2 * F.asin(F.least(rho / (2 * RADIUS), F.lit(1.0)))
    ratio = F.when(rho > 0, v / F.nullif(rho, F.lit(0.0))).otherwise(0.0)
    beta = F.when(rho.isNotNull(), F.asin(F.greatest(F.least(F.cos(c) * sine1 + F.sin(c) * cosine1 * ratio, F.lit(1.0)), F.lit(-1.0))))
    e4, e6 = _E2**2, _E2**3
    lat = (
        beta
        + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
        + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    lon = F.degrees(lon0 + F.atan2(u * F.sin(c), rho * cosine1 * F.cos(c) - v * sine1 * F.sin(c)))
    return F.degrees(lat), F.when(lon > 180, lon - 360).when(lon <= -180, lon + 360).otherwise(lon)
