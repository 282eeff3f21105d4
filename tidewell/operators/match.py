"""Joins of the catalogue: normalised keys, fallbacks, priorities, anti and existence joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import keep_best


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def left_by_name(left: DataFrame, right: DataFrame, name: str, right_name: str, on: list[str] | None = None, how: str = "left") -> DataFrame:
    """Join on trimmed, lower-cased names (and further equal columns)."""
    key = "__name"
    return left.withColumn(key, name_key(F.col(name))).join(right.withColumn(key, name_key(F.col(right_name))), [key, *(on or [])], how).drop(key)


def missing(df: DataFrame, other: DataFrame, key: str, order: list[Column], limit: int) -> DataFrame:
    """Rows without a partner, first ones by order."""
    return df.join(other.select(key), key, "left_anti").orderBy(*order).limit(max(limit, 1))


def flagged(df: DataFrame, other: DataFrame, key: str, flag: str) -> DataFrame:
    """df with whether a partner exists, and no row twice."""
    keys = other.select(key).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def fallback(df: DataFrame, other: DataFrame, keys: list[str], order: list[Column], cols: list[str]) -> DataFrame:
    """Columns where df has all of them, else those of the first partner by order."""
    first = keep_best(other, keys, order).select(*keys, *(F.col(c).alias(f"__f_{c}") for c in cols))
    own = F.lit(True)
    for c in cols:
        own = own & F.col(c).isNotNull()
    return df.join(first, keys, "left").select(*(F.when(own, F.col(c)).otherwise(F.col(f"__f_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns))


def priority_match(df: DataFrame, rules: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """The first rule with a partner gives (value, reason). rules: (reason, table with one row a key, key columns)."""
    hits = []
    for i, (_, table, keys) in enumerate(rules):
        df = df.join(table.select(*keys, F.col(value).alias(f"__v{i}")), keys, "left")
        hits.append(F.col(f"__v{i}"))
    reason = F.coalesce(*(F.when(h.isNotNull(), F.lit(r[0])) for h, r in zip(hits, rules, strict=True)))
    return df.withColumns({value: F.coalesce(*hits), "reason": reason}).drop(*(f"__v{i}" for i in range(len(rules))))


def union_without(first: DataFrame, second: DataFrame, email: str) -> DataFrame:
    """Both lists, without those of the second whose address is in the first; addresses are equal without case."""
    key = "__email"
    seen = first.select(F.lower(F.col(email)).alias(key))
    return first.unionByName(second.withColumn(key, F.lower(F.col(email))).join(seen, key, "left_anti").drop(key), allowMissingColumns=True)


def not_blocked(df: DataFrame, name: str, blocklist: list[str]) -> DataFrame:
    """Rows whose name does not begin with a blocked word: 'apollo' blocks 'Apollo Kino', not 'Apollonia'."""
    words = [w.strip() for w in blocklist if w and w.strip()]
    if not words:
        return df
    pattern = "(?i)^(" + "|".join(re.escape(w) for w in words) + r")\b"
    return df.where(~F.coalesce(F.col(name).rlike(pattern), F.lit(False)))


def merge_sides(base: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Full outer join where the second table's values win if not null."""
    b, c = base.alias("b"), changed.alias("c")
    cols = [x for x in base.columns if x != key]
    pick = lambda x: F.coalesce(F.col(f"c.{x}"), F.col(f"b.{x}")).alias(x) if x in changed.columns else F.col(f"b.{x}").alias(x)
    return b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer").select(F.coalesce(F.col(f"c.{key}"), F.col(f"b.{key}")).alias(key), *(pick(x) for x in cols))


def merge_lists(local: DataFrame, cloud: DataFrame, key: str, items: str) -> DataFrame:
    """Lists of two stores: one that either has exists. The cloud's values win where not null; items are those of the local
    list in their order, then those that only the cloud has, each once."""
    both = merge_sides(local.drop(items), cloud.drop(items), key)
    sides = local.select(key, F.col(items).alias("__local")).join(cloud.select(key, F.col(items).alias("__cloud")), key, "full_outer")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(local.schema[items].dataType))
    return both.join(sides.select(key, F.array_union(none("__local"), none("__cloud")).alias(items)), key)


def ordered_stops(routes: DataFrame, venues: DataFrame, venue_cols: list[str]) -> DataFrame:
    """Routes' stops joined to venues by id, in order; `dropped` counts a route's stops without a venue."""
    stops = routes.select(F.col("id").alias("route"), F.posexplode("stops").alias("pos", "stop")).select("route", "pos", F.col("stop.id").alias("id"), F.col("stop.note").alias("note"))
    found = stops.join(venues.select("id", *venue_cols, F.lit(True).alias("__found")), "id", "left")
    lost = found.groupBy("route").agg(F.count_if(F.col("__found").isNull()).alias("dropped"))
    return found.where("__found").drop("__found").join(lost, "route")
