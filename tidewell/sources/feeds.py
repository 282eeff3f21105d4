"""JSON sources: event feeds, open data, map elements, knowledge claims, and tables with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..functions.text import kind_of_tags, or_null, slug_folded
from ..functions.web import social_url
from ..functions.when import offset_timestamp


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table, or an empty one of the declared schema where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema)


def ticket_events(events: DataFrame, now: Column, longest_days: int = 180, offset: str = "+02:00") -> DataFrame:
    """Events on sale: with id, title and start, scheduled, not over for a day, and not spanning half a year. Stamps
    have no zone and are read at a fixed offset."""
    start, end = offset_timestamp(F.col("starts_at"), offset), offset_timestamp(F.col("ends_at"), offset)
    long = F.coalesce(F.unix_timestamp(end) - F.unix_timestamp(start) > longest_days * 86400, F.lit(False))
    ok = F.col("id").isNotNull() & or_null(F.col("title")).isNotNull() & start.isNotNull() & (F.coalesce(or_null(F.col("event_status")), F.lit("scheduled")) == "scheduled")
    return events.where(ok & (start >= F.timestamp_add("DAY", F.lit(-1), now)) & ~long).withColumns({"starts_at": start, "ends_at": end})


def localized(c: Column, languages: tuple[str, ...] = ("en", "fi", "sv")) -> Column:
    """The first language that a struct or map of texts has."""
    return F.coalesce(*(or_null(c[x]) for x in languages), F.lit(""))


def skip_reason(events: DataFrame, venues: list[str], patterns: list[str]) -> Column:
    """Why an open-data event is skipped, the first reason that holds; null to keep it."""
    status, kind, name = F.col("event_status"), F.col("type_id"), localized(F.col("name"))
    venue = F.lower(localized(F.col("location.name")))
    text = F.lower(F.concat_ws(" ", name, localized(F.col("short_description")), localized(F.col("description"))))
    return F.coalesce(
        F.when((status != "") & ~status.isin("EventScheduled", "EventRescheduled"), F.concat(F.lit("status:"), status)),
        F.when((kind != "") & (kind != "General"), F.concat(F.lit("type:"), kind)),
        F.when(name == "", F.lit("no-name")),
        *(F.when(venue.contains(v), F.lit(f"venue:{v}")) for v in venues),
        *(F.when(text.contains(p), F.lit(f"pattern:{p}")) for p in patterns),
    )


def reason_tally(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))


def any_free(offers: Column) -> Column:
    """Is any offer free; unknown without offers."""
    return F.when(F.size(offers) > 0, F.exists(offers, lambda o: F.coalesce(o["is_free"], F.lit(False))))


def nested_of_type(items: Column, kind: str, field: str) -> Column:
    """A field of the first nested element of a type."""
    return F.get(F.filter(items, lambda d: d["type"] == kind), F.lit(0))[field]


def map_places(elements: DataFrame, city: str) -> DataFrame:
    """Map elements (id, lat, lon, center, tags) -> venues. Those without a name, a position or a known kind go."""
    tag = lambda *names: F.coalesce(*(or_null(F.try_element_at(F.col("tags"), F.lit(n))) for n in names))
    name = tag("name:en", "name")
    rows = elements.select(
        F.concat_ws("-", slug_folded(name), F.col("id").cast("string")).alias("id"),
        F.lit(city).alias("city"),
        name.alias("name"),
        kind_of_tags(F.col("tags")).alias("kind"),
        F.coalesce("lat", "center.lat").alias("lat"),
        F.coalesce("lon", "center.lon").alias("lng"),
        F.col("id").alias("osm_id"),
        tag("opening_hours").alias("opening_hours"),
        tag("website", "contact:website").alias("website"),
        social_url(tag("contact:facebook", "facebook"), "https://www.facebook.com/").alias("facebook"),
        social_url(tag("contact:instagram", "instagram"), "https://www.instagram.com/").alias("instagram"),
    )
    return rows.where(F.col("name").isNotNull() & F.col("kind").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull())


def closed_elements(elements: DataFrame) -> DataFrame:
    """Elements tagged as disused or abandoned: id, name, reason (the first three such tags)."""
    marks = F.filter(F.map_keys("tags"), lambda k: k.startswith("disused:") | k.startswith("abandoned:"))
    name = F.coalesce(*(F.try_element_at(F.col("tags"), F.lit(n)) for n in ("name", "disused:name", "abandoned:name")))
    return elements.where(F.size(marks) > 0).select("id", name.alias("name"), F.array_join(F.slice(marks, 1, 3), ", ").alias("reason"))


def claims(entities: DataFrame, key: str, properties: dict[str, tuple[str, str]]) -> DataFrame:
    """Knowledge-base claims (map of property -> values) to columns: property -> (column, template with {})."""
    cols = []
    for prop, (name, template) in properties.items():
        value = F.get(F.try_element_at(F.col("claims"), F.lit(prop)), F.lit(0))
        before, _, after = template.partition("{}")
        cols.append(F.concat(F.lit(before), value, F.lit(after)).alias(name))
    return entities.select(key, *cols)


def bulk_places(rows: DataFrame, kinds: list[str], least: float = 0.55) -> DataFrame:
    """A bulk load of places: known kinds with enough confidence, one row for each city and name, the surest."""
    from ..operators.rank import keep_best

    ok = rows.where(F.col("kind").isin(kinds) & (F.col("confidence") >= least))
    return keep_best(ok, ["city", F.lower("name")], [F.desc_nulls_last("confidence"), F.asc("id")])


def routes(spark: SparkSession, path: str) -> DataFrame:
    from ..schemas import WALKS

    return spark.read.schema(WALKS).option("multiLine", True).json(path)


def with_defaults(config: DataFrame, defaults: dict[str, str]) -> dict[str, str]:
    """Configuration rows (key, value) over defaults; only the known keys are read, so the driver gets that many rows."""
    found = {r["key"]: r["value"] for r in config.where(F.col("key").isin(list(defaults))).select("key", "value").collect()}
    return defaults | {k: v for k, v in found.items() if v is not None}
