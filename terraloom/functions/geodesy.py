"""Map projections and distances as staged column expressions.

The projections take and return DataFrames because each one builds on several named intermediate
columns; the intermediates are dropped again, so they cost no output width.
Formulas: Snyder, Map Projections - A Working Manual (USGS PP 1395), and the haversine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sphere of the equal-area grid, mean earth radius, WGS 84, UTM.
SINUSOIDAL_RADIUS_M = 6_371_007.181
MEAN_RADIUS_M = 6_371_008.8
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
UTM_FALSE_NORTHING_SOUTH = 10_000_000.0

E2 = WGS84_F * (2 - WGS84_F)
EP2 = E2 / (1 - E2)
METRES_PER_DEGREE = MEAN_RADIUS_M * 3.141592653589793 / 180.0


def sinusoidal_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    phi = F.radians(lat)
    return F.lit(SINUSOIDAL_RADIUS_M) * F.radians(lon) * F.cos(phi), F.lit(SINUSOIDAL_RADIUS_M) * phi


def sinusoidal_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    phi = y / F.lit(SINUSOIDAL_RADIUS_M)
    return F.degrees(x / (F.lit(SINUSOIDAL_RADIUS_M) * F.cos(phi))), F.degrees(phi)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * MEAN_RADIUS_M) * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def with_utm_forward(
    frame: DataFrame, lon: str, lat: str, x: str, y: str, zone: int, south: bool
) -> DataFrame:
    """Add easting `x` and northing `y` of the point (`lon`, `lat`)."""
    m0 = 1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256
    m2 = 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024
    m4 = 15 * E2**2 / 256 + 45 * E2**3 / 1024
    m6 = 35 * E2**3 / 3072
    p, n, t, c, a, m = (F.col(f"__{k}") for k in ("phi", "n", "t", "c", "a", "m"))
    out = frame.withColumn("__phi", F.radians(F.col(lat)))
    out = out.withColumns(
        {
            "__n": F.lit(WGS84_A) / F.sqrt(1 - F.lit(E2) * F.sin(p) * F.sin(p)),
            "__t": F.tan(p) * F.tan(p),
            "__c": F.lit(EP2) * F.cos(p) * F.cos(p),
            "__a": F.radians(F.col(lon) - F.lit(central_meridian(zone))) * F.cos(p),
            "__m": F.lit(WGS84_A)
            * (m0 * p - m2 * F.sin(2 * p) + m4 * F.sin(4 * p) - m6 * F.sin(6 * p)),
        }
    )
    a2 = a * a
    east = n * a * (
        1
        + a2 * (1 - t + c) / 6
        + a2 * a2 * (5 - 18 * t + t * t + 72 * c - 58 * EP2) / 120
    )
    north = m + n * F.tan(p) * a2 * (
        F.lit(0.5)
        + a2 * (5 - t + 9 * c + 4 * c * c) / 24
        + a2 * a2 * (61 - 58 * t + t * t + 600 * c - 330 * EP2) / 720
    )
    shift = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    return out.withColumns(
        {x: F.lit(UTM_SCALE) * east + UTM_FALSE_EASTING, y: F.lit(UTM_SCALE) * north + shift}
    ).drop("__phi", "__n", "__t", "__c", "__a", "__m")


def with_utm_inverse(
    frame: DataFrame, x: str, y: str, lon: str, lat: str, zone: int, south: bool
) -> DataFrame:
    """Add longitude and latitude of the point (`x`, `y`)."""
    e1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
    f2 = 3 * e1 / 2 - 27 * e1**3 / 32
    f4 = 21 * e1**2 / 16 - 55 * e1**4 / 32
    f6 = 151 * e1**3 / 96
    f8 = 1097 * e1**4 / 512
    m0 = WGS84_A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256)
    shift = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    mu, p, n, r, t, c, d = (F.col(f"__{k}") for k in ("mu", "phi", "n", "r", "t", "c", "d"))
    # Multiple angles from one sine and cosine: sin 2a, sin 3a and sin 4a in terms of sin a, cos a.
    s2, c2 = F.sin(2 * mu), F.cos(2 * mu)
    series = (
        s2 * (f2 + f6 * (3 - 4 * s2 * s2)) + 2 * s2 * c2 * (f4 + 2 * f8 * (1 - 2 * s2 * s2))
    )
    out = frame.withColumn("__mu", (F.col(y) - shift) / F.lit(UTM_SCALE * m0))
    out = out.withColumn("__phi", mu + series)
    out = out.withColumns({"__sin": F.sin(p), "__cos": F.cos(p)})
    sine, cosine = F.col("__sin"), F.col("__cos")
    out = out.withColumn("__w", 1 - F.lit(E2) * sine * sine)
    out = out.withColumns(
        {
            "__n": F.lit(WGS84_A) / F.sqrt(F.col("__w")),
            "__r": F.lit(WGS84_A * (1 - E2)) / (F.col("__w") * F.sqrt(F.col("__w"))),
            "__t": (sine / cosine) * (sine / cosine),
            "__c": F.lit(EP2) * cosine * cosine,
        }
    )
    out = out.withColumn("__d", (F.col(x) - UTM_FALSE_EASTING) / (n * UTM_SCALE))
    d2 = d * d
    phi = p - (n * sine / (cosine * r)) * d2 * (
        F.lit(0.5)
        - d2 * (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) / 24
        + d2 * d2 * (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) / 720
    )
    lam = d * (
        1
        - d2 * (1 + 2 * t + c) / 6
        + d2 * d2 * (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) / 120
    )
    return out.withColumns(
        {
            lon: F.lit(central_meridian(zone)) + F.degrees(lam / cosine),
            lat: F.degrees(phi),
        }
    ).drop("__mu", "__phi", "__sin", "__cos", "__w", "__n", "__r", "__t", "__c", "__d")
