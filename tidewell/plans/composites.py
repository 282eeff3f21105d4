"""Parsers and composite queries of the catalogue bound to the test tables, with their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import hours as H
from ..functions import text, web
from ..operators import match, routes
from ..schemas import PICKS, VENUES
from ..sources import feeds, markup
from . import catalogue
from .bindings import query, t
from .scalars import one_of, one_of_sql

# --- feeds -----------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT n_nationkey, s_suppkey, 'Show ' || s_suppkey AS title, CASE s_suppkey % 3 WHEN 0 THEN 'Body & more' WHEN 1 THEN 'x < y' END AS body, CAST(DATE '2024-01-01' + CAST(s_suppkey % 200 AS INTEGER) AS TIMESTAMP) + INTERVAL 9 HOUR AS posted FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT n_nationkey, CAST(epoch(posted) AS BIGINT) AS message_id, concat_ws(chr(10) || chr(10), title, body) AS text, 'https://x.test/' || s_suppkey AS permalink FROM s WHERE s_suppkey % 5 IN (0, 2) AND s_suppkey % 11 <> 3
""")
def feed_routed(spark, d):
    """A feed a nation of its suppliers as items; those of two categories are kept, and those without a date go."""
    k = F.col("s_suppkey")
    at = F.timestamp_add("HOUR", F.lit(9), F.date_add(F.lit("2024-01-01").cast("date"), (k % 200).cast("int")).cast("timestamp"))
    stamp = F.when(k % 11 == 3, "some day").when(k % 2 == 0, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    body = F.when(k % 3 == 0, "<description><![CDATA[<p>Body &amp; more</p>]]></description>").when(k % 3 == 1, "<content:encoded>x &lt; y</content:encoded>").otherwise("")
    tags = F.concat(F.lit("<category>Kind "), (k % 5).cast("string"), F.lit("</category><category> <![CDATA[all]]></category>"))
    item = F.concat(F.lit("<item><title>Show "), k.cast("string"), F.lit("</title>"), body, F.lit("<pubDate>"), stamp, F.lit("</pubDate><link>https://x.test/"), k.cast("string"), F.lit("</link>"), tags, F.lit("</item>"))
    rows = t(spark, d, "supplier").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    xml = rows.groupBy("n_nationkey").agg(F.concat(F.lit("<rss>"), F.array_join(F.collect_list(item), ""), F.lit("</rss>")).alias("xml"))
    return markup.routed(markup.feed_items(xml, "xml", ["n_nationkey"]), ["Kind 0", "Kind 2"]).select("n_nationkey", "message_id", "text", "permalink")


_TICKETS = "2024-01-10 12:00:00"


@query(f"""
WITH e AS (SELECT event_id, ts, event_id % 4 = 1 AS zoned, event_id % 9 AS k, event_id % 7 AS j FROM events),
s AS (SELECT *, CASE WHEN k = 4 THEN NULL ELSE date_trunc('second', ts) - CASE WHEN zoned THEN INTERVAL 0 HOUR ELSE INTERVAL 2 HOUR END END AS starts FROM e),
f AS (SELECT *, CASE WHEN j = 2 THEN starts + INTERVAL 200 DAY WHEN j = 3 THEN starts + INTERVAL 3 HOUR END AS ends FROM s)
SELECT event_id, CAST(epoch(starts) AS BIGINT) AS starts, CAST(epoch(ends) AS BIGINT) AS ends FROM f
WHERE k <> 5 AND k <> 6 AND starts IS NOT NULL AND starts >= TIMESTAMP '{_TICKETS}' - INTERVAL 1 DAY AND j <> 2
""")
def tickets_on_sale(spark, d):
    """Events as a ticket seller's feed has them: some without a title or a start, cancelled, half a year long or over."""
    k, j = F.col("event_id") % 9, F.col("event_id") % 7
    zone = F.when(F.col("event_id") % 4 == 1, "Z").otherwise("")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    end = F.when(j == 2, F.timestamp_add("DAY", F.lit(200), "ts")).when(j == 3, F.timestamp_add("HOUR", F.lit(3), "ts"))
    rows = t(spark, d, "events").select(F.col("event_id").alias("id"), F.when(k == 5, " ").otherwise("Gig").alias("title"), F.when(k != 4, F.concat(stamp("ts"), zone)).alias("starts_at"), F.concat(stamp(end), zone).alias("ends_at"), F.when(k == 6, "cancelled").when(k == 7, "").otherwise("scheduled").alias("event_status"))
    out = feeds.ticket_events(rows, F.lit(_TICKETS).cast("timestamp"))
    return out.select(F.col("id").alias("event_id"), F.unix_timestamp("starts_at").alias("starts"), F.unix_timestamp("ends_at").alias("ends"))


_KINDS = [("amenity", "pub", "bar"), ("shop", "books", "bookshop"), ("tourism", "museum", "museum"), ("amenity", "bank", None), ("amenity", "nightclub", "club")]
_NAMES = ["Õlu Pood", "Café Ä", "apollo Kino", "Apollonia", None, "  ", "Zoo & Co."]
_FOLDED = "trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""
WITH p AS (SELECT p_partkey AS id, {one_of_sql('p_partkey', _NAMES)} AS raw, {one_of_sql('p_partkey', [k for _, _, k in _KINDS])} AS kind, p_partkey % 3 AS m FROM part),
n AS (SELECT *, nullif(trim(CASE WHEN id % 4 = 2 THEN 'Museum ' || id ELSE raw END), '') AS name FROM p)
SELECT {_FOLDED.format(c="name")} || '-' || id AS slug, name, kind, CASE m WHEN 0 THEN 59.0 ELSE 60.0 END AS lat, CASE WHEN id % 2 = 0 THEN 'https://www.facebook.com/page' || id END AS facebook FROM n
WHERE name IS NOT NULL AND kind IS NOT NULL AND m < 2 AND NOT regexp_matches(name, '(?i)^(apollo|museum 2)\\b')
""")
def map_elements(spark, d):
    """Parts as elements of the open map: names in two languages, points and areas, kinds by tags, chains blocked."""
    k = F.col("p_partkey")
    tag = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v")))
    kind = [tag(key, F.when(k % len(_KINDS) == i, F.lit(v))) for i, (key, v, _) in enumerate(_KINDS)]
    tags = F.map_from_entries(F.array_compact(F.array(tag("name", one_of(k, _NAMES)), tag("name:en", F.when(k % 4 == 2, F.concat(F.lit("Museum "), k.cast("string")))), tag("contact:facebook", F.when(k % 2 == 0, F.concat(F.lit("@page"), k.cast("string")))), *kind)))
    at = lambda here, there: F.when(here, F.struct(F.lit(there).alias("lat"), F.lit(24.0).alias("lon")))
    rows = t(spark, d, "part").select(k.alias("id"), F.when(k % 3 == 0, 59.0).alias("lat"), F.when(k % 3 == 0, 24.5).alias("lon"), at(k % 3 == 1, 60.0).alias("center"), tags.alias("tags"))
    return match.not_blocked(feeds.map_places(rows, "t"), "name", ["apollo", "Museum 2"]).select(F.col("id").alias("slug"), "name", "kind", "lat", "facebook")


# --- texts -----------------------------------------------------------------------------------------------------------

_VENUE_NAMES = ["", " ", "TBA", "Various venues", "Online", "Hall", None, "various", "tba ", "Multiple locations"]


@query(f"SELECT c_custkey, v IS NULL OR trim(v) = '' OR regexp_matches(lower(trim(v)), '{text.NO_VENUE}') AS generic FROM (SELECT c_custkey, {one_of_sql('c_custkey', _VENUE_NAMES)} AS v FROM customer)")
def generic_venues(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.is_generic_venue(one_of(F.col("c_custkey"), _VENUE_NAMES)).alias("generic"))


_REPLIES = ['{{"n": {k}}}', 'Sure!\n```json\n{{"n": {k}}}\n```\nbye', 'so {{"n": {k}}} it is', "none at all", '```\n[{k}]\n```', '  [{k}] ']


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 3 THEN NULL WHEN 4 THEN '[' || c_custkey || ']' WHEN 5 THEN '[' || c_custkey || ']' ELSE '{\"n\":' || c_custkey || '}' END AS found FROM customer")
def tolerant_replies(spark, d):
    k = F.col("c_custkey")
    reply = functools.reduce(lambda c, ir: c.when(k % 6 == ir[0], F.concat(*(x for i, p in enumerate(ir[1].replace("{{", "{").replace("}}", "}").split("{k}")) for x in ([k.cast("string")] if i else []) + [F.lit(p)]))), enumerate(_REPLIES), F.when(F.lit(False), ""))
    return t(spark, d, "customer").select("c_custkey", F.to_json(text.tolerant_json(reply)).alias("found"))


_HOSTS = ["https://www.youtube.com/x", "http://m.facebook.com/a?b", "https://notfacebook.com/", "https://x.com/q", "https://en.wikipedia.org/wiki/A", "https://open.spotify.com/artist/1", "ftp://bandcamp.com", "no address", "https://name.bandcamp.com/album", "https://www.instagram.com/"]


@query(f"SELECT c_custkey, CASE {' '.join(f'WHEN regexp_matches(host, {chr(39)}(^|[.]){p}${chr(39)}) THEN {chr(39)}{name}{chr(39)}' for p, name in web.PLATFORMS)} END AS platform FROM (SELECT c_custkey, regexp_replace(lower(regexp_extract({one_of_sql('c_custkey', _HOSTS)}, '^[a-z]+://([^/:?#]*)', 1)), '^www[.]', '') AS host FROM customer)")
def platforms(spark, d):
    return t(spark, d, "customer").select("c_custkey", web.platform(one_of(F.col("c_custkey"), _HOSTS)).alias("platform"))


# Lines as listings write them, and the spans that they mean.
LISTED = [
    ("Monday: 12:00 – 10:00 PM", [(720, 1320)]), ("Tuesday: Closed", []), ("Wednesday: Open 24 hours", [(0, 1440)]), ("Thursday: 8 PM – 2:00 AM", [(1200, 1560)]),
    ("Friday: 9:30 AM – 12 PM, 1 – 5:15 PM", [(570, 720), (780, 1035)]), ("Saturday: 12 AM - 12 PM", [(0, 720)]), ("Sunday: by appointment", []), ("10 AM — 11", [(600, 660)]), ("Monday: 13:00 – 22:00", []), ("Monday: 9:75 AM – 5 PM, 6 – 7 PM", [(1080, 1140)]),
]


@query(f"""
WITH m(f, n, o, c) AS (VALUES {', '.join(f'({i}, {j}, {o}, {c})' for i, (_, spans) in enumerate(LISTED) for j, (o, c) in enumerate(spans))}), days AS (SELECT s_suppkey, CAST(i AS INTEGER) AS day, (s_suppkey + i * 3) % {len(LISTED)} AS f FROM supplier, range(7) r(i) WHERE s_suppkey % 6 <> 5)
SELECT s_suppkey, day, o AS open, c AS close FROM days JOIN m ON m.f = days.f
""")
def listed_hours_read(spark, d):
    """Lists of seven lines, an eighth that counts for nothing, and texts that are no list."""
    k = F.col("s_suppkey")
    lines = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get(F.array(*(F.lit(x) for x, _ in LISTED)), ((k + i * 3) % len(LISTED)).cast("int")))
    raw = F.when(k % 6 == 5, "[not json").otherwise(F.to_json(lines))
    rows = t(spark, d, "supplier").select("s_suppkey", F.posexplode(H.listed_hours(raw)["week"]).alias("day", "spans"))
    return rows.select("s_suppkey", "day", F.explode("spans").alias("s")).select("s_suppkey", "day", "s.open", "s.close")


# --- composites ------------------------------------------------------------------------------------------------------


def _of(kind, rows):
    """rows with the columns that a schema has besides, all null."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))


_DAYS = ["Sat", "Tonight", None, "Mon", "Fri"]


@query(f"""
WITH p AS (SELECT c_custkey AS k, 'Supplier#' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') AS venue, {one_of_sql('c_custkey', _DAYS)} AS day, CASE WHEN c_custkey % 4 = 0 THEN 59.4 END AS lat, c_custkey % 6 = 1 AS tonight, c_custkey % 6 = 2 AS week FROM customer WHERE c_custkey % 3 <> 2 AND c_custkey % 10 <> 9 AND c_custkey % 13 <> 5),
q AS (SELECT * FROM p WHERE NOT (k % 7 = 0 AND day IS NULL)),
v AS (SELECT s_suppkey, s_name, s_suppkey % 5 = 0 AS closed, 59 + s_suppkey / 1000 AS lat FROM supplier WHERE s_suppkey % 3 <> 2),
j AS (SELECT q.*, v.lat AS vlat, coalesce(v.closed, false) AS is_closed, CASE day WHEN 'Tonight' THEN DATE '2024-01-20' WHEN 'Sat' THEN DATE '2024-01-20' WHEN 'Mon' THEN DATE '2024-01-22' WHEN 'Fri' THEN DATE '2024-01-26' END AS date FROM q LEFT JOIN v ON lower(s_name) = lower(venue)),
f AS (SELECT *, tonight OR coalesce(date = DATE '2024-01-20', false) AS ton FROM j)
SELECT CAST(k AS VARCHAR) AS id, date, ton AS tonight, ton OR week OR date IS NOT NULL AS this_week, is_closed, round(CASE WHEN lat IS NOT NULL THEN lat ELSE vlat END, 6) AS lat, upper(substr(venue, 1, 2)) AS initials FROM f
""")
def catalogue_shown(spark, d):
    """Customers as picks and suppliers as venues, two of three in the city: positions and closures by the venue's name, dates
    and flags stamped; archived, discovered and undated food picks left out."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    city = lambda n: F.when(n % 3 == 2, "b").otherwise("a")
    venue = F.concat(F.lit("Supplier#"), F.lpad((k % 150).cast("string"), 9, "0"))
    lat = F.when(k % 4 == 0, 59.4)
    picks = t(spark, d, "customer").select(k.cast("string").alias("id"), city(k).alias("city"), F.col("c_name").alias("title"), F.when(k % 2 == 0, F.upper(venue)).otherwise(venue).alias("venue"), one_of(k, _DAYS).alias("day"), lat.alias("lat"), lat.alias("lng"), F.when(k % 7 == 0, "bar").otherwise("gig").alias("kind"), F.when(k % 10 == 9, F.lit("2024-01-01")).cast("timestamp").alias("archived_at"), F.when(k % 13 == 5, "@discovery").alias("handle"), F.when(k % 6 == 1, True).alias("tonight"), F.when(k % 6 == 2, True).alias("this_week"))
    venues = t(spark, d, "supplier").select(s.cast("string").alias("id"), city(s).alias("city"), F.col("s_name").alias("name"), F.lit("club").alias("kind"), F.when(s % 5 == 0, "closed").otherwise("active").alias("status"), (59 + s / 1000).alias("lat"), F.lit(24.0).alias("lng"))
    shown, _ = catalogue.assembled(_of(PICKS, picks), _of(VENUES, venues), "a", F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return shown.select("id", "date", "tonight", "this_week", "is_closed", F.round("lat", 6).alias("lat"), F.col("thumb_initials").alias("initials"))


_TIMES = ["19:30", None, "9.15", "late"]


@query(f"""
WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, {one_of_sql('c_custkey', _DAYS)} AS day, CASE c_custkey % 4 WHEN 0 THEN INTERVAL 1170 MINUTE WHEN 2 THEN INTERVAL 555 MINUTE ELSE INTERVAL 1140 MINUTE END AS clock FROM customer WHERE c_custkey % 6 <> 1),
s AS (SELECT *, CAST(CASE day WHEN 'Mon' THEN DATE '2024-01-22' WHEN 'Fri' THEN DATE '2024-01-26' ELSE DATE '2024-01-20' END AS TIMESTAMP) + clock AS start FROM p WHERE day IS NOT NULL)
SELECT id, array_to_string(['BEGIN:VEVENT', 'UID:' || id, 'DTSTART:' || strftime(start, '%Y%m%dT%H%M%S'), 'DTEND:' || strftime(start + INTERVAL 2 HOUR, '%Y%m%dT%H%M%S'), 'SUMMARY:' || c_name || '\\, live\\; now', 'LOCATION:Hall\\, Old Town', 'DESCRIPTION:https://x.test/' || id, 'URL:https://x.test/' || id, 'END:VEVENT'], chr(13) || chr(10)) AS event FROM s
""")
def calendar_events(spark, d):
    """Customers as dated picks in the calendar's notation; undated ones and those under review are left out."""
    k = F.col("c_custkey")
    picks = t(spark, d, "customer").select(k.cast("string").alias("id"), F.concat("c_name", F.lit(", live; now")).alias("title"), F.lit("Hall").alias("venue"), F.lit("Old Town").alias("neighborhood"), one_of(k, _DAYS).alias("day"), one_of(k, _TIMES).alias("time"), (k % 6 == 1).alias("pending_review"), F.lit("gig").alias("kind"))
    return catalogue.calendar(_of(PICKS, picks), F.lit("2024-01-20").cast("date"), "https://x.test/").select("id", "event")


@query("""
WITH o AS (SELECT o_custkey AS route, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CASE WHEN o_orderkey % 9 <> 4 THEN 59.4 + o_orderkey % 50 / 1000 END AS lat, o_orderkey % 3 AS f FROM orders),
l AS (SELECT *, lag(lat) OVER w AS before FROM o WINDOW w AS (PARTITION BY route ORDER BY pos)),
m AS (SELECT *, CASE WHEN lat IS NOT NULL AND before IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(power(sin(radians(lat - before) / 2), 2))) END AS metres FROM l),
a AS (SELECT *, CASE WHEN pos = 1 THEN 0 ELSE 15 + CASE WHEN metres IS NULL THEN 8 ELSE greatest(1, round(metres / 80)) END END AS step FROM m),
b AS (SELECT *, 17 * 60 + sum(step) OVER (PARTITION BY route ORDER BY pos) AS arrive FROM a),
c AS (SELECT *, f <> 2 AS known, CASE f WHEN 0 THEN 540 <= arrive % 1440 AND arrive % 1440 < 1080 WHEN 1 THEN true END AS open FROM b)
SELECT route, min(pos) FILTER (WHERE known AND NOT open) AS first_shut, bool_or(NOT known) AS any_unknown, CAST(max(arrive) - 17 * 60 AS INTEGER) AS minutes FROM c GROUP BY 1
""")
def route_schedule(spark, d):
    """A customer's orders as stops of a walk from 17:00 on: the first door found shut, and whether any hours are unknown."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    filed = F.when(k % 3 == 0, "Mo-Su 09:00-18:00").when(k % 3 == 1, "24/7")
    stops = t(spark, d, "orders").select(F.col("o_custkey").alias("route"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), F.when(k % 9 != 4, 59.4 + k % 50 / 1000).alias("lat"), F.lit(24.0).alias("lng"), H.parse_hours(filed).alias("hours"))
    return routes.summary(routes.schedule(routes.legs(stops, "route", "pos"), "route", "pos", F.lit(17 * 60), F.lit(2)), "route", "pos")
