"""Lists of ids and what is looked up for them: membership, enrichment, top kinds, totals and reports.

Lookups are left joins whose kind Spark chooses by size; aggregates have partial counts in each task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def follow_key(city: Column, source: Column) -> Column:
    """A city's own name space for sources."""
    return F.concat_ws("|", city, F.lower(F.trim(source)))


def follows_in(key: Column, city: Column) -> Column:
    return key.startswith(F.concat(city, F.lit("|")))


def of_type(types: Column, allowed: list[str]) -> Column:
    """Whether any of a thing's types is allowed; no types, no."""
    return F.coalesce(F.arrays_overlap(types, F.array(*(F.lit(x) for x in allowed))), F.lit(False))


def enriched(df: DataFrame, notes: DataFrame, key: str, note: str, name: str, sep: str = ", ") -> DataFrame:
    """df with all notes of its key as one text, sorted; empty if there are none."""
    told = notes.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(note)), sep).alias(name))
    return df.join(told, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def looked_up(df: DataFrame, table: DataFrame, key: str, values: list[str]) -> DataFrame:
    """df with the values that a table with one row a key has for it, else nulls."""
    return df.join(table.select(key, *values), key, "left")


def cached(df: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, hit) for each distinct key, so that a key is asked for once."""
    return looked_up(df.select(key).where(F.col(key).isNotNull()).distinct(), cache, key, [value]).withColumn("hit", F.col(value).isNotNull())


def report(df: DataFrame, order: list[str], name: str = "report") -> DataFrame:
    """One row: a JSON list of all rows; "[]" for none. For reports of bounded size."""
    return df.agg(F.coalesce(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order))))), F.lit("[]")).alias(name))


def top_kinds(seen: DataFrame, who: str, kind: str, least: int = 5, most: int = 4, lead: int = 2) -> DataFrame:
    """(who, seen, kinds, lead): the kinds that each has seen most, null below `least` seen rows."""
    n = seen.groupBy(who, kind).agg(F.count("*").alias("n"))
    w = Window.partitionBy(who)
    ranked = n.withColumn("seen", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), kind))).where(F.col("rn") <= most)
    listed = ranked.groupBy(who, "seen").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(kind).alias("kind")))), lambda s: s["kind"]).alias("kinds"))
    enough = F.col("seen") >= least
    return listed.select(who, "seen", F.when(enough, F.col("kinds")).alias("kinds"), F.when(enough, F.slice("kinds", 1, lead)).alias("lead"))


def totals(df: DataFrame, by: str, counters: list[str], all_name: str = "all") -> DataFrame:
    """Each counter's sum by group, and over all groups."""
    summed = df.rollup(by).agg(F.grouping(by).alias("every"), *(F.sum(c).alias(c) for c in counters))
    return summed.select(F.when(F.col("every") == 1, F.lit(all_name)).otherwise(F.col(by)).alias(by), *counters)


def members(listed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """The rows of a list that are there."""
    return listed.join(present.select(key), key, "left_semi")


def purged(lists: DataFrame, ids: str, gone: Column) -> DataFrame:
    """Every list without an id."""
    return lists.withColumn(ids, F.array_remove(ids, gone))


def half_hour(minutes: Column) -> Column:
    """'18:30': the nearest half hour, a quarter past rounding up."""
    m = F.pmod(F.floor((minutes + 15) / 30) * 30, F.lit(1440))
    return F.format_string("%02d:%02d", F.floor(m / 60), m % 60)


def prose(parts: list[tuple[str, Column]], blurb: Column | None = None, most: int = 600) -> Column:
    """Labelled lines, empty ones left out, and a text cut to its first characters."""
    lines = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{name}: "), F.trim(v.cast("string")))) for name, v in parts]
    if blurb is not None:
        lines.append(F.when(F.trim(blurb) != "", F.substring(F.trim(blurb), 1, most)))
    return F.concat_ws("\n", *lines)


def listing_rows(pages: DataFrame, page: str, body: str, row: str, size: int = 50, most: int | None = 4) -> DataFrame:
    """The rows of a nested listing, data.listing.rows beside data.listing.total, page after page: up to `most` pages (None:
    all), none that starts beyond the total. row: the rows' type."""
    read = pages.select(page, F.from_json(body, f"data struct<listing struct<total long, rows array<{row}>>>").alias("b")).select(page, "b.data.listing.*")
    kept = read.where((F.lit(True) if most is None else F.col(page) < most) & (F.col(page) * size < F.col("total")))
    return kept.select(page, F.explode("rows").alias("row")).select(page, "row.*")
