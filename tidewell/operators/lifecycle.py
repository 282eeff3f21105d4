"""The catalogue's life: absence, health, queue, expiry, rotation. The present is a parameter everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facets import collected
from .rank import first_n, top_k


def absent(rows: DataFrame, source: list[str], key: str, last_seen: str, now: Column, grace_days: int, most: int = 50) -> DataFrame:
    """By source the rows not seen for longer than the grace: how many, and the first `most` keys."""
    gone = rows.where(F.col(last_seen) < F.timestamp_add("DAY", F.lit(-grace_days), now))
    return collected(gone, source, key, most).withColumnRenamed("n", "absent").select(*source, "absent", "ids")


def reconcile(picks: DataFrame, absent_ids: DataFrame, now: Column, enforce: bool) -> DataFrame:
    """Archives absent picks if enforced; a dry run returns them as they are."""
    if not enforce:
        return picks
    from .match import flagged
    from .upsert import soft_archive

    marked = flagged(picks, absent_ids, "id", "__absent")
    return soft_archive(marked, F.col("__absent") & F.col("archived_at").isNull(), now, "absent from source").drop("__absent")


def zero_yield(log: DataFrame, by: str, stamp: str, key: str, idle: Column, since: Column, n: int = 3) -> DataFrame:
    """Groups whose last n runs since a time were all idle: (group, runs, last_run)."""
    last = first_n(log.where(F.col(stamp) >= since).withColumn("__idle", F.coalesce(idle, F.lit(False))), [by], [F.desc_nulls_last(stamp), F.desc(key)], n)
    runs = last.groupBy(by).agg(F.count("*").alias("runs"), F.max(stamp).alias("last_run"), F.bool_and("__idle").alias("idle"))
    return runs.where((F.col("runs") == n) & F.col("idle")).drop("idle")


def claim(queue: DataFrame, now: Column, lease_minutes: int = 15) -> DataFrame:
    """The queue's next row: new ones first, then those whose lease ran out, by id; marked as taken."""
    ready = (F.col("status") == "new") | ((F.col("status") == "in_progress") & (F.col("claimed_at") < F.timestamp_add("MINUTE", F.lit(-lease_minutes), now)))
    return top_k(queue.where(ready), [F.asc(F.col("status") != "new"), F.asc("id")], 1).withColumns({"status": F.lit("in_progress"), "claimed_at": now})


def expire(picks: DataFrame, now: Column, tonight_hours: int = 36) -> DataFrame:
    """Archives picks past their end of validity and clears tonight flags older than 36 hours."""
    over = F.col("archived_at").isNull() & (F.col("valid_until") < now)
    old = F.col("tonight") & (F.col("created_at") < F.timestamp_add("HOUR", F.lit(-tonight_hours), now))
    return picks.withColumns({
        "archived_at": F.when(over, now).otherwise(F.col("archived_at")),
        "archive_reason": F.when(over, "expired").otherwise(F.col("archive_reason")),
        "tonight": F.when(over | old, False).otherwise(F.col("tonight")),
    })


def close_absent_venues(venues: DataFrame, now: Column, days: int = 90) -> DataFrame:
    gone = (F.col("status") == "active") & (F.col("last_seen_at") < F.timestamp_add("DAY", F.lit(-days), now))
    return venues.withColumn("status", F.when(gone, "possibly_closed").otherwise(F.col("status")))


def cascade(picks: DataFrame, closed: DataFrame, keys: list[str], now: Column, reason: str = "venue closed") -> DataFrame:
    """Archives live picks at closed venues."""
    marks = closed.select(*keys).distinct().withColumn("__closed", F.lit(True))
    hit = F.coalesce(F.col("__closed"), F.lit(False)) & F.col("archived_at").isNull()
    return picks.join(marks, keys, "left").withColumns({"archived_at": F.when(hit, now).otherwise(F.col("archived_at")), "archive_reason": F.when(hit, reason).otherwise(F.col("archive_reason"))}).drop("__closed")


def rotate_tonight(picks: DataFrame, today_name: str) -> DataFrame:
    """Chooses a pick for tonight among live ones of today: those at a named venue first, then by order and age."""
    from ..functions.text import is_generic_venue

    live = picks.where(F.col("archived_at").isNull() & F.col("day").isin("Tonight", today_name) & ~F.coalesce(F.col("pending_review"), F.lit(False)))
    return top_k(live, [F.asc(is_generic_venue(F.col("venue"))), F.asc_nulls_last("sort_order"), F.desc_nulls_last("created_at"), F.asc("id")], 1)
