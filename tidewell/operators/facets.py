"""Filters, facet counts and small aggregates. Facets are counted in one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rank


def all_of(filters: dict[str, Column], skip: str | None = None) -> Column:
    """All predicates but the skipped one; null counts as false."""
    out = F.lit(True)
    for name, p in filters.items():
        if name != skip:
            out = out & F.coalesce(p, F.lit(False))
    return out


def facet_counts(df: DataFrame, facets: list[str], filters: dict[str, Column]) -> DataFrame:
    """(facet, value, n): how many rows each value would have under all filters but the facet's own. Values that the
    filters leave empty stay with n = 0. One scan, one shuffle of partial counts."""
    rows = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value"), all_of(filters, f).alias("hit")) for f in facets))
    each = df.select(F.explode(rows).alias("r")).select("r.*").where(F.col("value").isNotNull())
    return each.groupBy("facet", "value").agg(F.count_if("hit").alias("n"))


def strip(df: DataFrame, date: str, today: Column, days: int = 7, tallest: int = 34) -> DataFrame:
    """(date, n, height) of the days from today on, empty ones too. Heights are shares of the peak, 4 at least."""
    spark = df.sparkSession
    axis = spark.range(1).select(F.explode(F.sequence(today, F.date_add(today, days - 1))).alias("date"))
    counted = df.where(F.col(date).between(today, F.date_add(today, days - 1))).groupBy(F.col(date).alias("date")).agg(F.count("*").alias("n"))
    full = axis.join(counted, "date", "left").select("date", F.coalesce("n", F.lit(0)).alias("n"))
    peak = F.max("n").over(Window.partitionBy(F.lit(0)))  # over `days` rows
    height = F.when(F.col("n") == 0, 0).otherwise(F.greatest(F.lit(4), F.round(F.col("n") / peak * tallest).cast("int")))
    return full.withColumn("height", height)


def window_counts(df: DataFrame, windows: dict[str, Column]) -> DataFrame:
    """One row: how many rows fall in each named window."""
    return df.agg(*(F.count_if(p).alias(name) for name, p in windows.items()))


def mode(df: DataFrame, by: list[str], value: str, fallback: str | None = None, excluding: list[str] | None = None) -> DataFrame:
    """Each group's commonest value (ties: the smallest), without excluded ones; the fallback if none is left."""
    allowed = F.col(value).isNotNull() & ~F.col(value).isin(excluding or [])
    counted = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.when(allowed, F.col(value)), F.when(allowed, F.struct((-F.col("n")).alias("n"), F.col(value))))
    return counted.groupBy(*by).agg(F.coalesce(best, F.lit(fallback)).alias(value))


def tally(df: DataFrame, by: str, kind: str, values: dict[str, str]) -> DataFrame:
    """How often each value of a column occurs with each key, in one pass: names -> values."""
    return df.groupBy(by).agg(*(F.count_if(F.col(kind) == v).alias(name) for name, v in values.items()))


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def collected(df: DataFrame, by: list[str], key: str, most: int | None = None) -> DataFrame:
    """Each group's keys in order, and how many there are. `most` cuts the list, not the count: then a group is ranked
    in its tasks first, and no more than its first keys are gathered."""
    ids = F.array_sort(F.collect_list(key)).alias("ids")
    if not most:
        return df.groupBy(*by).agg(ids, F.count(key).alias("n"))
    first = rank.first_n(df.where(F.col(key).isNotNull()), by, [F.asc(key)], most).groupBy(*(F.col(c).alias(f"__{c}") for c in by)).agg(ids)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    counts = df.groupBy(*by).agg(F.count(key).alias("n"))
    return counts.join(first, same, "left").select(*by, F.coalesce("ids", F.array()).alias("ids"), "n")


def extent(df: DataFrame, lat: str, lng: str) -> DataFrame:
    placed = df.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    return placed.agg(F.min(lat).alias("south"), F.min(lng).alias("west"), F.max(lat).alias("north"), F.max(lng).alias("east"))


def first_spelling(df: DataFrame, name: str, order: str) -> DataFrame:
    """Distinct names without regard to case, each as it was first written."""
    return df.groupBy(F.lower(name).alias("key")).agg(F.min_by(name, order).alias(name))


def looser_filter(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """The filter whose removal lets most rows in (ties: by name), if any row comes in."""
    counts = df.agg(*(F.count_if(all_of(filters, f)).alias(f) for f in filters))
    stacked = counts.select(F.explode(F.array(*(F.struct(F.lit(f).alias("drop"), F.col(f).alias("n")) for f in filters))).alias("s")).select("s.*")
    return stacked.where("n > 0").orderBy(F.desc("n"), "drop").limit(1)


def contains_text(term: str, *cols: Column) -> Column:
    """Case-insensitive search over several columns; null columns count as empty."""
    return F.contains(F.lower(F.concat_ws(" ", *cols)), F.lit(term.lower()))
