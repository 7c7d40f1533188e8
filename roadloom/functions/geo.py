"""Spatial, heading and solar expressions, all native Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the geohash alphabet
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """x moved into [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it; without this each mention is an expression of its own."""
    return F.transform(F.array(value), use)[0]


def _cell(v: Column, low: float, span: float, bits: int) -> Column:
    """The number of v's cell among 2**bits equal ones. A floor, then moved to agree with the cells' exact edges."""
    n = 1 << bits
    step = span / n  # a power-of-two fraction: edges are exact
    i = F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), F.lit(n - 1))
    moved = i + (v >= F.lit(low) + (i + 1) * F.lit(step)).cast("int") - (v < F.lit(low) + i * F.lit(step)).cast("int")
    return F.least(F.greatest(moved, F.lit(0)), F.lit(n - 1)).cast("bigint")


#: The digits of base 32 as conv() writes them; BASE32 has a hash's letters in the same places.
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Geohash text; bits alternate, longitude first, and a value on an edge belongs to the upper cell.

    Binary digits read in base 4 are spread to every other bit, so two sums and two changes of base are all.
    """
    bits = 5 * precision
    x, y = _cell(lon, -180.0, 360.0, (bits + 1) // 2), _cell(lat, -90.0, 180.0, bits // 2)
    spread = lambda c: F.conv(F.bin(c), 4, 10).cast("bigint")
    last, other = (x, y) if bits % 2 else (y, x)
    number = spread(last) + 2 * spread(other)
    text = F.translate(F.lpad(F.conv(number.cast("string"), 10, 32), precision, "0"), DIGITS, BASE32)
    return F.when(lat.isNotNull() & lon.isNotNull(), text)


def geohash_center(text: Column, precision: int = 7) -> Column:
    """struct(lat, lon) of the cell's centre; null for text with other letters or of another length."""
    bits = 5 * precision
    digits = F.conv(F.conv(F.translate(text, BASE32, DIGITS), 32, 10), 10, 4)  # of each, the lower bit is the last coordinate's
    bit = lambda to: F.conv(F.translate(digits, "0123", to), 2, 10).cast("bigint")
    x, y = (bit("0101"), bit("0011")) if bits % 2 else (bit("0011"), bit("0101"))
    dx, dy = 360.0 / (1 << (bits + 1) // 2), 180.0 / (1 << bits // 2)
    centre = F.struct((F.lit(-90.0) + (y + F.lit(0.5)) * dy).alias("lat"), (F.lit(-180.0) + (x + F.lit(0.5)) * dx).alias("lon"))
    return F.when(text.rlike(f"^[{BASE32}]{{{precision}}}$"), centre)


def positive_mod(x: Column, m: float) -> Column:
    return F.pmod(x.cast("double"), F.lit(float(m)))


def heading_bucket(bearing: Column) -> Column:
    """Octant of a bearing, 0 around north."""
    return F.pmod(F.floor((positive_mod(bearing, 360.0) + 22.5) / 45.0), F.lit(8)).cast("int")


def segment_key(hash7: Column, bucket: Column) -> Column:
    return F.when(hash7.isNotNull() & bucket.isNotNull(), F.concat_ws(":", hash7, bucket.cast("string")))


def decode_segment_key(key: Column) -> Column:
    """struct(geohash7, heading_bucket), split at the last colon."""
    bucket = F.substring_index(key, ":", -1)
    return F.struct(F.substring(key, F.lit(1), F.length(key) - F.length(bucket) - 1).alias("geohash7"), bucket.try_cast("int").alias("heading_bucket"))


def segment_for(lat: Column, lon: Column, bearing: Column, has_bearing: Column) -> Column:
    """The segment key of a fix, null without a bearing."""
    return F.when(has_bearing, segment_key(geohash(lat, lon), heading_bucket(bearing)))


def solar_position(epoch_ms: Column, lat: Column, lon: Column) -> Column:
    """struct(elevation, azimuth) in degrees: the low-precision almanac formulas."""
    deg = math.pi / 180.0
    days = epoch_ms / F.lit(86_400_000.0) + F.lit(2440587.5 - 2451545.0)
    mean_longitude = positive_mod(280.460 + 0.9856474 * days, 360.0)
    anomaly = positive_mod(357.528 + 0.9856003 * days, 360.0) * deg
    hours = (epoch_ms % 86_400_000) / F.lit(3_600_000.0)
    sidereal = positive_mod(positive_mod(6.697375 + 0.0657098242 * days + hours, 24.0) + lon / 15.0, 24.0)
    mean = F.struct(mean_longitude.alias("longitude"), anomaly.alias("anomaly"), ((23.439 - 0.0000004 * days) * deg).alias("tilt"), (sidereal * (15.0 * deg)).alias("sidereal"), (lat * deg).alias("phi"))

    def along(m: Column) -> Column:
        ecliptic = (m["longitude"] + 1.915 * F.sin(m["anomaly"]) + 0.020 * F.sin(2 * m["anomaly"])) * deg
        return F.struct(ecliptic.alias("ecliptic"), *[m[c].alias(c) for c in ("tilt", "sidereal", "phi")])

    def seen(m: Column) -> Column:
        ascension = F.atan2(F.cos(m["tilt"]) * F.sin(m["ecliptic"]), F.cos(m["ecliptic"]))
        declination = F.asin(F.sin(m["tilt"]) * F.sin(m["ecliptic"]))
        return F.struct((m["sidereal"] - ascension).alias("angle"), declination.alias("dec"), m["phi"].alias("phi"))

    def place(m: Column) -> Column:
        angle, dec, phi = m["angle"], m["dec"], m["phi"]
        elevation = F.asin(F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(angle))
        azimuth = F.atan2(-F.sin(angle), F.tan(dec) * F.cos(phi) - F.sin(phi) * F.cos(angle))
        return F.struct((elevation / deg).alias("elevation"), positive_mod(azimuth / deg + 360.0, 360.0).alias("azimuth"))

    return let(let(let(mean, along), seen), place)


def time_bucket(elevation: Column) -> Column:
    """DAY above 6 degrees, NIGHT below -6, DUSK_DAWN between; DAY without an elevation."""
    return F.when(elevation.isNull() | (elevation > 6.0), "DAY").when(elevation >= -6.0, "DUSK_DAWN").otherwise("NIGHT")


def distance_delta(speed: Column, dt_ns: Column) -> Column:
    """Metres since the frame before, 0 for the first one, at most 100."""
    return F.coalesce(clamp(speed * F.greatest(dt_ns, F.lit(0)) / 1e9, 0.0, 100.0), F.lit(0.0))


def gravity_projection(ax: Column, ay: Column, az: Column, gx: Column, gy: Column, gz: Column) -> Column:
    """Acceleration without gravity, along gravity."""
    norm = F.sqrt(gx * gx + gy * gy + gz * gz) + 1e-6
    return ((ax - gx) * gx + (ay - gy) * gy + (az - gz) * gz) / norm


def magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 for an empty union."""
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    area = lambda r: F.greatest(r["x1"] - r["x0"], F.lit(0.0)) * F.greatest(r["y1"] - r["y0"], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def plate_strip(box: Column) -> Column:
    """Where a number plate is looked for inside a vehicle box."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return F.struct((box["x0"] + 0.20 * w).alias("x"), (box["y0"] + 0.62 * h).alias("y"), (0.60 * w).alias("w"), (0.36 * h).alias("h"))


METRES_PER_DEGREE = 111_320.0


def project_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Equirectangular metres east and north of (lat0, lon0)."""
    return F.struct(((lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(lat0))).alias("x"), ((lat - lat0) * METRES_PER_DEGREE).alias("y"))
