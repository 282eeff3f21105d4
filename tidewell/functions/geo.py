"""Distances and map positions as column expressions. An unknown coordinate makes an unknown distance, never zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRES_A_MINUTE = 80

# Where neighbourhoods lie on the drawn map, by name.
CENTROIDS = {
    "vanalinn": (1100, 720), "old town": (1100, 720), "kalamaja": (450, 550), "telliskivi": (700, 480),
    "põhja-tallinn": (450, 380), "pohja-tallinn": (450, 380), "north tallinn": (450, 380), "kadriorg": (1430, 650),
    "noblessner": (700, 280), "rotermann": (1180, 740), "pirita": (1700, 620), "mustamäe": (350, 980), "mustamae": (350, 980),
    "lasnamäe": (1700, 950), "lasnamae": (1700, 950), "ülemiste": (1500, 1000), "ulemiste": (1500, 1000),
    "kristiine": (550, 800), "haabersti": (150, 700), "nõmme": (450, 1100), "nomme": (450, 1100),
}


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in the radius's unit."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    # least() would turn an unknown distance into half the globe.
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def walk_minutes(metres: Column) -> Column:
    return F.greatest(F.lit(1), F.round(metres / METRES_A_MINUTE).cast("int")) + F.when(metres.isNull(), None).otherwise(0)


def distance_label(metres: Column) -> Column:
    """'550 m' to the nearest ten below a kilometre, else '1.4 km'."""
    near = F.concat((F.round(metres / 10) * 10).cast("long").cast("string"), F.lit(" m"))
    return F.when(metres < 1000, near).when(metres >= 1000, F.format_string("%.1f km", metres / 1000))


def parse_within(text: Column) -> Column:
    """A radius in metres: numbers from 100 are metres, smaller ones minutes of walking; anything else is 0."""
    n = F.coalesce(F.regexp_extract(F.trim(text), r"^(\d+)", 1).try_cast("int"), F.lit(0))
    return F.when(n >= 100, n).otherwise(n * METRES_A_MINUTE)


def within(metres: Column, limit: Column) -> Column:
    """Passes when there is no limit or no known distance."""
    return metres.isNull() | F.coalesce(limit <= 0, F.lit(True)) | (metres <= limit)


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    """Rows without a position are dropped, unlike in `within`."""
    return F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def jitter(seed: Column, axis: str, spread: int) -> Column:
    """A stable number from -spread to spread, from the seed's md5."""
    n = F.conv(F.substring(F.md5(F.concat(F.coalesce(seed, F.lit("")), F.lit(axis))), 1, 8), 16, 10).cast("long")
    return (n % (2 * spread + 1) - spread).cast("int")


def map_position(neighborhood: Column, lat: Column, lng: Column, seed: Column) -> Column:
    """struct(x, y) on the drawn map: the neighbourhood's centroid, else a linear fit of the position, else the centre."""
    at = F.create_map(*(c for n, (x, y) in CENTROIDS.items() for c in (F.lit(n), F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")))))
    centre = F.try_element_at(at, F.lower(F.coalesce(neighborhood, F.lit(""))))
    fit = lambda v, low, high: F.greatest(F.lit(low), F.least(F.lit(high), F.round(v).cast("int")))
    known = lat.isNotNull() & lng.isNotNull()
    x = F.when(centre.isNotNull(), centre["x"] + jitter(seed, "x", 60)).when(known, fit((lng - 24.65) / 0.22 * 1500 + 200, 100, 1700)).otherwise(F.lit(900) + jitter(seed, "x", 200))
    y = F.when(centre.isNotNull(), centre["y"] + jitter(seed, "y", 60)).when(known, fit((59.475 - lat) / 0.07 * 850 + 200, 100, 1100)).otherwise(F.lit(700) + jitter(seed, "y", 200))
    return F.struct(x.alias("x"), y.alias("y"))
