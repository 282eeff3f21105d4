"""Schemas of the event-and-place catalogue. All columns may be null: unknown is an answer of its own."""

from __future__ import annotations

from pyspark.sql import types as T

ENTITIES = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("role", T.StringType())]))
STOPS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("note", T.StringType())]))
SPANS = T.ArrayType(T.StructType([T.StructField("open", T.IntegerType()), T.StructField("close", T.IntegerType())]))
#: Parsed opening hours: spans of each weekday from Monday, and those of public holidays (null: no such clause).
HOURS = T.StructType([T.StructField("week", T.ArrayType(SPANS)), T.StructField("ph", SPANS)])

_TYPES = {
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "float": T.FloatType(),
    "timestamp": T.TimestampType(),
    "money": T.DecimalType(10, 2),
    "strings": T.ArrayType(T.StringType()),
    "links": T.MapType(T.StringType(), T.StringType()),
    "entities": ENTITIES,
    "stops": STOPS,
}


def _struct(fields: str) -> T.StructType:
    """'name type, name type': built without a session, as workers import this module too."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


PAYLOAD = _struct(
    "source string, description string, starts_at string, ends_at string, venue string, address string, ticket_url string, image_url string,"
    " is_free boolean, price_min double, price_max double, price_text string, currency string, categories strings, entities entities"
)

PICKS = _struct(
    "id string, city string, title string, title_original string, venue string, neighborhood string, kind string, day string, time string, quote string,"
    " handle string, thumb_initials string, image_url string, image_attr string, tonight boolean, this_week boolean, mood_tags strings, lat double,"
    " lng double, address string, coords_source string, coords_locked boolean, sort_order int, created_at timestamp, last_seen_at timestamp,"
    " valid_until timestamp, archived_at timestamp, archive_reason string, auto_generated boolean, source_message_id long, venue_id string,"
    " source_url string, pending_review boolean, description string, starts_at timestamp, ends_at timestamp, ticket_url string, is_free boolean,"
    " price_min money, price_max money, currency string, links links, entities entities, links_resolved_at timestamp"
)

VENUES = _struct(
    "id string, city string, name string, neighborhood string, kind string, lat double, lng double, osm_id long, opening_hours string, website string,"
    " facebook string, instagram string, image_url string, image_attr string, status string, closed_at timestamp, last_seen_at timestamp, updated_at timestamp"
)

STAGING = _struct(
    "id long, source_id long, channel string, message_id long, text string, payload string, posted_at timestamp, permalink string, status string,"
    " rejection string, pick_id string, processed_at timestamp, claimed_at timestamp"
)

SOURCES = _struct("id long, kind string, channel string, curator_handle string, city string, enabled boolean, feed_url string, last_message_id long, last_scraped_at timestamp, reconcile_absences boolean")

INGEST_LOG = _struct("id long, fn string, status string, inserted int, rejected int, error string, detail string, finished_at timestamp")

PLACES_INDEX = _struct("id string, city string, name string, kind string, category string, lat double, lng double, address string, postcode string, locality string, website string, facebook string, instagram string, confidence float, source string, created_at timestamp")

PICK_CHANGES = _struct("id long, pick_id string, old_day string, new_day string, old_time string, new_time string, changed_at timestamp")

WALKS = _struct("id string, city string, title string, blurb string, stops stops")
