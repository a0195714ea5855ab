"""Transverse Mercator on WGS84 as Column expressions (Krüger's series to the third order in n)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of WGS84 and UTM.
A, F_INV, K0, E0 = 6378137.0, 298.257223563, 0.9996, 500000.0
_N = (1 / F_INV) / (2 - 1 / F_INV)
_R = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def forward(lon: Column, lat: Column, zone_: Column, south: Column | bool = False) -> Column:
    """``struct<x, y>`` in metres of a UTM zone."""
    phi, lam = F.radians(lat), F.radians(lon - (zone_ * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - c * F.atanh(c * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    north = F.when(F.lit(south) if isinstance(south, bool) else south, F.lit(1e7)).otherwise(F.lit(0.0))
    return F.struct((E0 + K0 * _R * x).alias("x"), (north + K0 * _R * y).alias("y"))


def inverse(x: Column, y: Column, zone_: Column, south: Column | bool = False) -> Column:
    """``struct<lon, lat>`` in degrees."""
    north = F.when(F.lit(south) if isinstance(south, bool) else south, F.lit(1e7)).otherwise(F.lit(0.0))
    xi0, eta0 = (y - north) / (K0 * _R), (x - E0) / (K0 * _R)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct((zone_ * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi)))).alias("lon"), F.degrees(phi).alias("lat"))
