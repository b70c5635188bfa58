"""Scalar functions as Column expressions. NULL stands for no data everywhere; NaN never arises."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed floor of the power before it is turned into decibels.
POWER_FLOOR = 1e-5
EPS = 1e-6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded value; NULL stays NULL, which greatest() and least() alone would not grant."""
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(col(c).isNotNull(), out)


def decibel(power: str | Column) -> Column:
    return 10 * F.log10(clip(power, POWER_FLOOR))


def positive(power: str | Column) -> Column:
    """Power that is a measurement: not NULL, not NaN and above 0."""
    return F.when(~F.isnan(col(power)) & (col(power) > 0), col(power))


def normalised_difference(a: str | Column, b: str | Column) -> Column:
    return (col(a) - col(b)) / (col(a) + col(b) + EPS)


def optical_indices(blue: str = "B02", green: str = "B03", red: str = "B04", nir: str = "B08", swir: str = "B11") -> dict[str, Column]:
    """Vegetation, water and bare-soil index, and brightness."""
    b, g, r, n, s = (F.col(c) for c in (blue, green, red, nir, swir))
    return {
        "ndvi": normalised_difference(n, r),
        "mndwi": normalised_difference(g, s),
        "bsi": ((s + r) - (n + b)) / ((s + r) + (n + b) + EPS),
        "bright": (b + g + r) / 3,
    }


def reflectance(dn: str | Column, scl: str | Column, baseline: str | Column) -> Column:
    """Surface reflectance of a digital number: offset 1000 from baseline 4 on, bad scene classes NULL."""
    # Scene classes that are no clear look, offset, scale.
    bad = (1, 3, 8, 9, 10)
    offset = F.when(col(baseline).cast("double") >= 4, F.lit(1000)).otherwise(F.lit(0))
    return F.when(col(scl).isNotNull() & (col(scl) != 0) & ~col(scl).isin(*bad) & (col(dn) != 0), (col(dn) - offset) / 10000.0)


def clear_look(scl: str | Column) -> Column:
    """Fixed set of clear scene classes; no data is not clear."""
    return F.coalesce(col(scl).isin(2, 4, 5, 6, 7, 11), F.lit(False))


def softmax(logits: str | Column) -> Column:
    """Stable softmax of an array."""
    top = F.array_max(col(logits))
    powers = F.transform(col(logits), lambda z: F.exp(z - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def argmax(values: str | Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(col(values), F.array_max(col(values))) - 1).cast("int")


def place_km(lon: Column, lat: Column, centre_lon: Column, centre_lat: Column) -> Column:
    """Equirectangular distance to a centre, a degree being 111.32 km of longitude at its latitude and 110.57 of latitude."""
    return F.hypot((lon - centre_lon) * 111.32 * F.cos(F.radians(centre_lat)), (lat - centre_lat) * 110.57)


def box_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.abs(east - west) * 111.32 * F.cos(F.radians((south + north) / 2)) * F.abs(north - south) * 110.57


def expand_box(box: tuple[float, float, float, float], km: float) -> tuple[float, float, float, float]:
    """A lon/lat box widened by ``km`` on every side; far north and south the cosine is held at 0.2."""
    west, south, east, north = box
    lat = km / 111.0
    lon = km / (111.0 * max(math.cos(math.radians((south + north) / 2)), 0.2))
    return west - lon, south - lat, east + lon, north + lat


def cache_key(*parts: Column, length: int = 24) -> Column:
    """Hexadecimal SHA-1 prefix of the parts joined by a vertical bar."""
    return F.left(F.sha1(F.concat_ws("|", *[p.cast("string") for p in parts])), F.lit(length))


def display_name(name_en: Column, name: Column) -> Column:
    """English name if there is one that isn't empty, else the name if that isn't."""
    return F.coalesce(F.nullif(name_en, F.lit("")), F.nullif(name, F.lit("")))


def visitor(token: Column, secret: str, client: Column, edge: Column) -> Column:
    """Who asks: the client that a trusted edge names, else the edge's own header; NULL, who is never limited, without either."""
    return F.coalesce(F.when((token == secret) & F.lit(bool(secret)), F.nullif(client, F.lit(""))), F.nullif(edge, F.lit("")))


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for plain, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def shown(number: Column, unit: str = "") -> Column:
    """A number for a report: thousands separated, two decimals if it has any, a dash for NULL."""
    text = F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 2))
    return F.coalesce(F.concat(text, F.lit(unit)), F.lit("—"))


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)


# WGS 84 and the Krüger series of third order.
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _E0 = 0.9996, 500000.0


def to_utm(lon: Column, lat: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _A * x, _K0 * _A * y + F.when(south, 10000000.0).otherwise(0.0)


def from_utm(easting: Column, northing: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    xi = (northing - F.when(south, 10000000.0).otherwise(0.0)) / (_K0 * _A)
    eta = (easting - _E0) / (_K0 * _A)
    x, y = xi, eta
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(lat)


def web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * 6378137.0, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * 6378137.0
