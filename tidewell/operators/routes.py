"""Walking routes: legs, lengths, schedules and the latest time to leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hours as H
from ..functions.geo import haversine, walk_minutes

# Minutes spent at a stop, and for a leg of unknown length.
AT_STOP, UNKNOWN_WALK = 15, 8
# How far ahead leaving is tried, in steps of ten minutes.
STEPS, STEP = 72, 10


def legs(stops: DataFrame, route: str, pos: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Each stop with metres from the one before (null for the first or an unknown place) and minutes after the start."""
    w = Window.partitionBy(route).orderBy(pos)
    metres = haversine(F.lag(lat).over(w), F.lag(lng).over(w), F.col(lat), F.col(lng))
    first = F.lag(pos).over(w).isNull()
    out = stops.withColumns({"metres": metres, "__first": first})
    step = F.when(F.col("__first"), 0).otherwise(F.coalesce(walk_minutes(F.col("metres")), F.lit(UNKNOWN_WALK)) + AT_STOP)
    return out.withColumn("after", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__first")


def lengths(stops: DataFrame, route: str) -> DataFrame:
    """By route the known legs' sum, and the sum only if every leg is known."""
    lost = F.count_if(F.col("metres").isNull() & (F.col("after") > 0))
    return stops.groupBy(route).agg(F.sum("metres").alias("known_metres"), F.when(lost == 0, F.coalesce(F.sum("metres"), F.lit(0.0))).alias("metres"))


def schedule(stops: DataFrame, route: str, pos: str, start: Column, day: Column) -> DataFrame:
    """stops (with legs and parsed hours) as a walk from a minute of a weekday finds them: arrival and state."""
    at = start + F.col("after")
    arrive = F.pmod(at, F.lit(1440))
    weekday = F.pmod(day + F.floor(at / 1440).cast("int"), F.lit(7))
    return stops.withColumns({"arrive": arrive, "state": H.state(F.col("hours"), weekday, arrive)})


def summary(scheduled: DataFrame, route: str, pos: str) -> DataFrame:
    """By route the first stop found shut, and whether any stop's hours are unknown."""
    shut = F.col("state.known") & ~F.col("state.open")
    return scheduled.groupBy(route).agg(F.min(F.when(shut, F.col(pos))).alias("first_shut"), F.bool_or(~F.col("state.known")).alias("any_unknown"), F.max("after").alias("minutes"))


def leave_by(stops: DataFrame, route: str, pos: str, start: int, day: int) -> DataFrame:
    """By route the latest start, in steps of ten minutes, that finds all doors open, trying until the first failure;
    null if the first fails."""
    tries = stops.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS))))
    walked = schedule(tries, route, pos, F.lit(start) + F.col("step") * STEP, F.lit(day))
    ok = walked.groupBy(route, "step").agg(F.bool_and(F.coalesce(F.col("state.open"), F.lit(False))).alias("ok"))
    failed = F.min(F.when(~F.col("ok"), F.col("step")))
    last = ok.groupBy(route).agg(F.coalesce(failed - 1, F.lit(STEPS)).alias("last"))
    return last.select(route, F.when(F.col("last") >= 0, F.lit(start) + F.col("last") * STEP).alias("leave_by"))
