"""Shelves of what is near and open, for many readers at once.

Places are met by cells: the globe is cut into bands of latitude as high as the search is wide, and each band into cells
that are nowhere narrower than that. A reader looks into the cells around, three in each of three bands, so pairs are
only made between neighbours; exact distances decide. Opening hours are intervals of minutes of the week: of the places
only those open at the present minute take part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, METRES_A_MINUTE, haversine
from .rank import first_n

DAY, WEEK = 1440, 7 * 1440


def week_minutes(day: Column, opens: Column, closes: Column) -> Column:
    """Intervals [start, end) of minutes of the week for one day's hours; day: 0 for Monday. Closing at or before opening
    means the next day, and what runs over Sunday's end goes on at Monday's start."""
    start = day * DAY + opens
    end = start + F.when(closes <= opens, closes + DAY).otherwise(closes) - opens
    part = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    whole = F.array(part(start, F.least(end, F.lit(WEEK))))
    return F.when(opens.isNull() | closes.isNull(), F.slice(whole, 1, 0)).when(end > WEEK, F.concat(whole, F.array(part(F.lit(0), end - WEEK)))).otherwise(whole)


def intervals(hours: DataFrame, place: str, day: str, opens: str, closes: str) -> DataFrame:
    """(place, start, end): each day's hours in minutes of the week."""
    return hours.select(place, F.explode(week_minutes(F.col(day), F.col(opens), F.col(closes))).alias("x")).select(place, "x.*")


def _band(lat: Column, height: float) -> Column:
    return F.floor((lat + 90) / height)


def _cells(band: Column, height: float) -> Column:
    """How many cells a band has: none narrower than its height at the edge that is nearer to a pole."""
    edge = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    return F.greatest(F.lit(1), F.floor(F.lit(360 / height) * F.cos(F.radians(F.least(edge, F.lit(90.0))))))


def near(readers: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """All pairs of a reader (with r_lat, r_lng) and a place (lat, lng) within so many metres, with `metres`. Rows without a
    position make no pair."""
    height = math.degrees(metres / EARTH_M) * 1.0001
    at = lambda lng, n: F.floor(F.pmod(lng + 180, F.lit(360.0)) / 360 * n)
    known = lambda df, lat, lng: df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    p = known(places, "lat", "lng").withColumn("__band", _band(F.col("lat"), height))
    p = p.withColumn("__cell", at(F.col("lng"), _cells(F.col("__band"), height)))
    r = known(readers, "r_lat", "r_lng").withColumn("__band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: _band(F.col("r_lat"), height) + k)))
    n = _cells(F.col("__band"), height)
    around = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(at(F.col("r_lng"), n) + k, n))
    r = r.withColumn("__cell", F.explode(F.array_distinct(around)))  # where a band has one or two cells, each once
    d = haversine(F.col("r_lat"), F.col("r_lng"), F.col("lat"), F.col("lng"))
    return r.join(p, ["__band", "__cell"]).withColumn("metres", d).where(F.col("metres") <= metres).drop("__band", "__cell")


def open_now(places: DataFrame, hours: DataFrame, place: str, minute: Column) -> DataFrame:
    """Places with an interval that holds a minute of the week. Those whose hours aren't known are not open."""
    return places.join(hours.where((F.col("start") <= minute) & (F.col("end") > minute)).select(place), place, "left_semi")


def shelf(readers: DataFrame, places: DataFrame, hours: DataFrame, reader: str, place: str, minute: Column, walk: int = 20, size: int = 10) -> DataFrame:
    """(reader, place, metres, rank): for each reader the nearest open places within so many minutes on foot."""
    found = near(readers, open_now(places, hours, place, minute), walk * METRES_A_MINUTE)
    return first_n(found.select(reader, place, "metres"), [reader], [F.asc("metres"), F.asc(place)], size, "rank")


def by_distance_or_name(places: DataFrame, metres: Column, name: str, key: str, locale: str = "UNICODE") -> DataFrame:
    """All places, nearest first, those of unknown distance after them in a locale's order of names."""
    return places.withColumn("metres", metres).orderBy(F.asc_nulls_last("metres"), F.asc_nulls_last(F.collate(F.coalesce(name, F.lit("")), locale)), F.asc(key))
