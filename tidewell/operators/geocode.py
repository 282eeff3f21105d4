"""Looking up positions: an answer is a hit, none, or an error. Only `none` is asked again, with more of the address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_parts

OUTCOMES = ("hit", "none", "error")


def address_of(parts: Column, shown: Column) -> Column:
    """Road and number, postcode and city, those that there are; else the first three parts of the name shown."""
    street = join_parts(" ", parts["road"], parts["house_number"])
    made = join_parts(", ", street, parts["postcode"], parts["city"])
    return F.coalesce(F.nullif(made, F.lit("")), F.nullif(F.array_join(F.slice(F.split(shown, ","), 1, 3), ","), F.lit("")))


def asked(rows: DataFrame, query: Column, answers: DataFrame) -> DataFrame:
    """rows with outcome, lat, lng, address and error. answers: one row a query (query, status, rows: array of (lat, lng,
    address, display_name)); status null: no reply came. A query that has no answer was never sent: an error, too."""
    hit = F.get(F.col("rows"), F.lit(0))
    ok = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    outcome = F.when(~ok, "error").when(hit.isNull(), "none").otherwise("hit")
    of_hit = {"lat": hit["lat"].cast("double"), "lng": hit["lng"].cast("double"), "address": address_of(hit["address"], hit["display_name"])}
    told = answers.select("query", outcome.alias("outcome"), *(F.when(ok, v).alias(c) for c, v in of_hit.items()), F.when(~ok, F.col("status")).alias("error"))
    out = rows.withColumn("query", query).join(told, "query", "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.lit("error")))


def geocoded(places: DataFrame, answers: DataFrame) -> DataFrame:
    """places (venue, neighborhood, city and others) with query (the last one asked), outcome, lat, lng, address and error:
    venue and city first; where that finds none and there is a neighborhood, with the neighborhood between. Errors stay as
    they are."""
    first = asked(places, join_parts(", ", F.col("venue"), F.col("city")), answers)
    again = (F.col("outcome") == "none") & (F.coalesce(F.col("neighborhood"), F.lit("")) != "")
    second = asked(first.where(again).select(*places.columns), join_parts(", ", F.col("venue"), F.col("neighborhood"), F.col("city")), answers)
    return first.where(~again).unionByName(second)


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """geocode_failed_at: now where none was found, so that it waits; an error is no answer and may be asked next time."""
    return rows.withColumn("geocode_failed_at", F.when(F.col("outcome") == "none", now))
