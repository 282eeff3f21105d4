"""The catalogue's scalar functions and its editing plans bound to the test tables, each with the same query in SQL.

As in `bindings`, every query runs over its whole tables. Values that the tables lack (clocks, names of days, places)
are made from keys, on both sides alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo, text, web, when
from ..functions import hours as H
from ..operators import facets, match, rank, routes
from ..sources import feeds
from . import editing
from .bindings import HAVERSINE, PLACED, SQL, placed, query, t

TODAY = "2024-01-20"  # a Saturday


def one_of(key: Column, values: list[str | None]) -> Column:
    return F.get(F.array(*(F.lit(v).cast("string") for v in values)), (key % len(values)).cast("int"))


def one_of_sql(key: str, values: list[str | None]) -> str:
    shown = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{shown}], CAST({key} % {len(values)} + 1 AS BIGINT))"


def today() -> Column:
    return F.lit(TODAY).cast("date")


# --- time ------------------------------------------------------------------------------------------------------------

NAMED = ["Mon", "tuesday", " Wed ", "Thu", "Fri", "SAT", "Sun", "Tonight", None, "someday"]
_INDEX = "list_position(['mon', 'tue', 'wed', 'thu', 'fri', 'sat', 'sun'], lower(substr(trim(day), 1, 3))) - 1"


@query(f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ts END AS ts, {one_of_sql('event_id', NAMED)} AS day FROM events),
d AS (SELECT event_id, coalesce(CAST(ts + INTERVAL 2 HOUR AS DATE), CASE WHEN starts_with(lower(trim(day)), 'ton') THEN DATE '{TODAY}' END, CASE WHEN {_INDEX} >= 0 THEN CAST(DATE '{TODAY}' + CAST(({_INDEX} - 5 + 7) % 7 AS INTEGER) AS DATE) END) AS date FROM e),
f AS (SELECT d.event_id, date, coalesce(date = DATE '{TODAY}', false) OR d.event_id % 7 = 0 OR coalesce(starts_with(lower(trim(day)), 'ton'), false) AS tonight FROM d JOIN e ON e.event_id = d.event_id)
SELECT event_id, date, tonight, tonight OR event_id % 5 = 1 OR coalesce(date BETWEEN DATE '{TODAY}' AND DATE '2024-01-26', false) AS thisweek, coalesce(date IN (DATE '{TODAY}', DATE '2024-01-21'), false) AS weekend FROM f
""")
def day_projection(spark, d):
    k = F.col("event_id")
    date = when.resolve_date(F.when(k % 4 == 0, F.col("ts").cast("timestamp")), one_of(k, NAMED), today())
    stated = [F.when(k % 7 < 2, k % 7 == 0).alias("tonight"), F.when(k % 5 < 3, k % 5 == 1).alias("this_week")]
    rows = when.stamped(t(spark, d, "events").select("event_id", one_of(k, NAMED).alias("day"), date.alias("date"), *stated), F.col("date"), today())
    return rows.select("event_id", "date", *(when.matches_window(w, F.col("date"), today(), F.col("tonight"), F.col("this_week")).alias(w) for w in ("tonight", "thisweek", "weekend")))


CLOCKS = ["19:30", "9.15 pm", "doors 8", "00:00", None, " 7:05 sharp"]


@query(f"""
WITH e AS (SELECT event_id, {one_of_sql('event_id', CLOCKS)} AS c FROM events), m AS (SELECT event_id, TRY_CAST(regexp_extract(c, '^\\s*(\\d{{1,2}})[:.](\\d{{2}})', 1) AS INTEGER) * 60 + TRY_CAST(regexp_extract(c, '^\\s*(\\d{{1,2}})[:.](\\d{{2}})', 2) AS INTEGER) AS minutes FROM e)
SELECT event_id, CAST(nullif(minutes, 0) AS INTEGER) AS minutes, coalesce(nullif(minutes, 0) >= 1140, false) AS evening, coalesce(nullif(minutes, 0) >= 1165, false) AS ahead FROM m
""")
def stated_clock(spark, d):
    m = when.stated_minutes(F.lit(None).cast("timestamp"), one_of(F.col("event_id"), CLOCKS))
    rows = t(spark, d, "events").select("event_id", m.alias("minutes"))
    return rows.select("event_id", "minutes", when.doors_ok(F.col("minutes"), F.lit(1165), "19:00").alias("evening"), when.doors_ok(F.col("minutes"), F.lit(1165), "now").alias("ahead"))


@query(f"""
WITH e AS (SELECT event_id, ts, {one_of_sql('event_id', NAMED)} AS day FROM events)
SELECT event_id, strftime(ts + CASE WHEN starts_with(lower(trim(day)), 'ton') THEN INTERVAL 36 HOUR WHEN coalesce(trim(day), '') <> '' THEN INTERVAL 8 DAY ELSE INTERVAL 90 DAY END, '%Y-%m-%d %H:%M:%S') AS valid_until FROM e
""")
def valid_until(spark, d):
    until = when.valid_until(one_of(F.col("event_id"), NAMED), F.col("ts"))
    return t(spark, d, "events").select("event_id", F.date_format(until, "yyyy-MM-dd HH:mm:ss").alias("valid_until"))


def _rolled(month: str, day: str, past: int) -> str:
    made = lambda y: f"TRY_CAST(printf('{y}-%02d-%02d', CAST({month} AS INTEGER), CAST({day} AS INTEGER)) AS DATE)"
    return f"CASE WHEN DATE '{TODAY}' - {made(2024)} > {past} THEN {made(2025)} ELSE {made(2024)} END"


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


@query(f"""
WITH e AS (SELECT event_id, event_id % 12 + 1 AS m, event_id % 31 + 1 AS dd FROM events)
SELECT event_id, {_rolled('m', 'dd', 31)} AS dotted, {_rolled('m', 'dd', 7)} AS named FROM e
""")
def listing_dates(spark, d):
    k = F.col("event_id")
    dotted = F.concat((k % 31 + 1).cast("string"), F.lit("."), (k % 12 + 1).cast("string"), F.lit("."))
    named = F.concat(F.lit("on "), (k % 31 + 1).cast("string"), F.lit(". "), one_of(k, list(MONTHS)))
    return t(spark, d, "events").select("event_id", when.dotted_date(dotted, today()).alias("dotted"), when.month_name_date(named, today()).alias("named"))


def _holiday_sql() -> str:
    fixed = ", ".join(f"('{c}', '{md}')" for c, days in H.FIXED_HOLIDAYS.items() for md in days)
    moving = ", ".join(f"('{c}', {n})" for c, days in H.EASTER_HOLIDAYS.items() for n in days)
    floating = ", ".join(f"('{c}', '{m:02d}-{dd:02d}', {w})" for c, days in H.FLOATING_HOLIDAYS.items() for m, dd, w in days)
    easter = SQL["easter"].replace("\n", " ").strip()
    return f"""
WITH e AS (SELECT * FROM ({easter}) WHERE year BETWEEN 1990 AND 2000), f AS (SELECT c, CAST(year || '-' || md AS DATE) AS start, w FROM e, (VALUES {floating}) v(c, md, w))
SELECT country, h.date, count(*) AS orders FROM (SELECT c AS country, CAST(year || '-' || md AS DATE) AS date FROM e, (VALUES {fixed}) v(c, md)
UNION SELECT c, CAST(easter + CAST(n AS INTEGER) AS DATE) FROM e, (VALUES {moving}) v(c, n)
UNION SELECT c, CAST(start + CAST((w - (isodow(start) - 1) + 7) % 7 AS INTEGER) AS DATE) FROM f) h JOIN orders ON CAST(o_orderdate AS DATE) = h.date GROUP BY 1, 2
"""


SQL["holidays"] = _holiday_sql()


# --- places ----------------------------------------------------------------------------------------------------------

WITHIN = ["15", "250", " 8 min", "x", None, "99"]


@query(f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id * 37 % 5000 + 0.3 END AS m, {one_of_sql('event_id', WITHIN)} AS w FROM events),
n AS (SELECT *, coalesce(TRY_CAST(regexp_extract(trim(w), '^(\\d+)', 1) AS INTEGER), 0) AS n FROM e)
SELECT event_id, CASE WHEN m < 1000 THEN CAST(CAST(round(m / 10) * 10 AS BIGINT) AS VARCHAR) || ' m' WHEN m >= 1000 THEN printf('%.1f km', m / 1000) END AS label, CAST(CASE WHEN n >= 100 THEN n ELSE n * 80 END AS INTEGER) AS within FROM n
""")
def distance_labels(spark, d):
    k = F.col("event_id")
    m = F.when(k % 7 != 0, (k * 37 % 5000).cast("double") + 0.3)
    return t(spark, d, "events").select("event_id", geo.distance_label(m).alias("label"), geo.parse_within(one_of(k, WITHIN)).alias("within"))


AREAS = ["Kalamaja", "old town", "Pirita", None, "Elsewhere"]


def _jitter(axis: str, spread: int) -> str:
    return f"(CAST('0x' || substr(md5(s_name || '{axis}'), 1, 8) AS BIGINT) % {2 * spread + 1} - {spread})"


@query(f"""
WITH p AS (SELECT p.*, s.s_name, lower({one_of_sql('p.s_suppkey', AREAS)}) AS area FROM ({PLACED}) p JOIN supplier s USING (s_suppkey)),
c AS (SELECT p.*, v.x AS cx, v.y AS cy FROM p LEFT JOIN (VALUES {", ".join(f"('{n}', {x}, {y})" for n, (x, y) in geo.CENTROIDS.items())}) v(name, x, y) ON v.name = area)
SELECT s_suppkey, CAST(CASE WHEN cx IS NOT NULL THEN cx + {_jitter('x', 60)} WHEN lat IS NOT NULL THEN greatest(100, least(1700, round((lng - 24.65) / 0.22 * 1500 + 200))) ELSE 900 + {_jitter('x', 200)} END AS INTEGER) AS x,
CAST(CASE WHEN cx IS NOT NULL THEN cy + {_jitter('y', 60)} WHEN lat IS NOT NULL THEN greatest(100, least(1100, round((59.475 - lat) / 0.07 * 850 + 200))) ELSE 700 + {_jitter('y', 200)} END AS INTEGER) AS y FROM c
""")
def map_position(spark, d):
    rows = placed(spark, d).join(t(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    at = geo.map_position(one_of(F.col("s_suppkey"), AREAS), F.col("lat"), F.col("lng"), F.col("s_name"))
    return rows.select("s_suppkey", at["x"].alias("x"), at["y"].alias("y"))


@query(f"""
WITH p AS ({PLACED}), l AS (SELECT *, lag(lat) OVER w AS a_lat, lag(lng) OVER w AS a_lng, lag(s_suppkey) OVER w AS before FROM p WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
m AS (SELECT *, {HAVERSINE.format(a_lat='a_lat', a_lng='a_lng', b_lat='lat', b_lng='lng')} AS metres FROM l)
SELECT s_nationkey, round(sum(metres), 1) AS known_metres, CASE WHEN count(*) FILTER (WHERE before IS NOT NULL AND metres IS NULL) = 0 THEN round(coalesce(sum(metres), 0), 1) END AS metres FROM m GROUP BY 1
""")
def route_lengths(spark, d):
    out = routes.lengths(routes.legs(placed(spark, d), "s_nationkey", "s_suppkey"), "s_nationkey")
    return out.select("s_nationkey", *(F.round(c, 1).alias(c) for c in ("known_metres", "metres")))


@query(f"""
WITH p AS (SELECT *, round({HAVERSINE.format(a_lat='59.437', a_lng='24.7536', b_lat='lat', b_lng='lng')}, 2) AS metres FROM ({PLACED}))
SELECT s_suppkey, metres FROM p ORDER BY metres ASC NULLS LAST, s_suppkey LIMIT 12
""")
def nearest_shelf(spark, d):
    m = placed(spark, d).select("s_suppkey", F.round(geo.haversine(F.lit(59.437), F.lit(24.7536), F.col("lat"), F.col("lng")), 2).alias("metres"))
    return rank.top_k(m, [F.asc_nulls_last("metres"), F.asc("s_suppkey")], 12)


# --- text ------------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, p_name || ' & <b>"it''s"</b>; a, b\\c' || chr(10) || 'z' AS s FROM part)
SELECT p_partkey, replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, replace(replace(replace(replace(s, '\\', '\\\\'), ';', '\\;'), ',', '\\,'), chr(10), '\\n') AS ics,
CASE WHEN length(s) > 20 THEN rtrim(substr(s, 1, 19)) || '…' ELSE s END AS short FROM p
""")
def escapes(spark, d):
    s = F.concat(F.col("p_name"), F.lit(' & <b>"it\'s"</b>; a, b\\c\nz'))
    return t(spark, d, "part").select("p_partkey", text.escape_html(s).alias("html"), text.escape_ics(s).alias("ics"), text.truncated(s, 20).alias("short"))


SHOWN = ["Kumu Art", " f-hoone ", "", None, "One two three", "x"]
KINDS = ["gig", "Rave", "museum", None, "unheard of", "flea", " cafe "]


@query(f"""
WITH c AS (SELECT c_custkey, trim(coalesce({one_of_sql('c_custkey', SHOWN)}, '')) AS v, trim(lower(coalesce({one_of_sql('c_custkey', KINDS)}, ''))) AS k FROM customer),
w AS (SELECT *, list_filter(regexp_split_to_array(v, '\\s+'), lambda x: x <> '') AS w FROM c)
SELECT c_custkey, CASE len(w) WHEN 0 THEN '??' WHEN 1 THEN upper(substr(w[1], 1, 2)) ELSE upper(substr(w[1], 1, 1) || substr(w[2], 1, 1)) END AS initials, coalesce(m.mark, 'place') AS mark
FROM w LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in text.MARKS.items())}) m(kind, mark) ON m.kind = w.k
""")
def initials_and_marks(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select("c_custkey", text.initials(one_of(k, SHOWN)).alias("initials"), text.mark(one_of(k, KINDS)).alias("mark"))


@query(f"""
SELECT doc_id, array_to_string(list_distinct([]::VARCHAR[]) || list_filter([{", ".join("CASE WHEN regexp_matches(coalesce(text, ''), '(?i)" + p + f"') THEN '{k}' END" for p, k in text.PROMPT_KINDS)}], lambda x: x IS NOT NULL), ',') AS kinds,
regexp_matches(text, '[\\x{{0400}}-\\x{{04FF}}]') AS cyrillic FROM documents
""")
def prompt_kinds(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(text.kinds_of_prompt(F.col("text")), ",").alias("kinds"), text.is_cyrillic(F.col("text")).alias("cyrillic"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(trim(coalesce(url, '')), '(?i)^https?://') OR (NOT regexp_matches(trim(coalesce(url, '')), '^[a-zA-Z][a-zA-Z0-9+.-]*:') AND NOT starts_with(trim(coalesce(url, '')), '//')) THEN trim(coalesce(url, '')) ELSE '' END AS safe,
coalesce(regexp_matches(url, '(?i)^https?://') AND NOT regexp_matches(url, '(?i)//(www\\.)?t\\.me/|telegram'), false) AS permalink FROM pages
""")
def safe_urls(spark, d):
    return t(spark, d, "pages").select("page_id", web.safe_url(F.col("url")).alias("safe"), web.is_permalink(F.col("url")).alias("permalink"))


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '12') ORDER BY c_custkey LIMIT 10")
def admin_search(spark, d):
    c = t(spark, d, "customer")
    return rank.top_k(c.where(facets.contains_text("12", F.col("c_name"), F.col("c_mktsegment"))).select("c_custkey", "c_name"), [F.asc("c_custkey")], 10)


SQL["hash53"] = """
WITH u AS (SELECT page_id, url, list_transform(range(1, CAST(length(url) + 1 AS BIGINT)), lambda i: CAST(ascii(substr(url, i, 1)) AS HUGEINT)) AS u FROM pages WHERE url IS NOT NULL),
f AS (SELECT *, list_reduce(list_concat([14695981039346656037::HUGEINT], u), lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616::HUGEINT) AS fnv,
  list_reduce(list_concat([3735928559::HUGEINT], u), lambda h, x: (xor(h, x) * 2654435761) % 4294967296) AS a, list_reduce(list_concat([1103547991::HUGEINT], u), lambda h, x: (xor(h, x) * 1597334677) % 4294967296) AS b FROM u),
m AS (SELECT *, xor((xor(a, a // 65536) * 2246822507) % 4294967296, (xor(b, b // 8192) * 3266489909) % 4294967296) AS h1 FROM f),
n AS (SELECT *, xor((xor(b, b // 65536) * 2246822507) % 4294967296, (xor(h1, h1 // 8192) * 3266489909) % 4294967296) AS h2 FROM m)
SELECT p.page_id, CAST((h2 % 2097152) * 4294967296 + h1 AS BIGINT) AS cyrb53, CAST(fnv % 9007199254740992 AS BIGINT) AS fnv53 FROM pages p LEFT JOIN n ON n.page_id = p.page_id
"""


# --- plans -----------------------------------------------------------------------------------------------------------


@query("""
WITH r AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'no-name' WHEN contains(lower(text), 'license') THEN 'pattern:license' WHEN contains(lower(text), 'password') THEN 'pattern:password' END AS reason FROM documents)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1
""")
def reason_tally(spark, d):
    c = F.col("text")
    hit = text.first_keyword(c, ["license", "password"])
    reason = F.coalesce(F.when(c.isNull() | (F.trim(c) == ""), F.lit("no-name")), F.concat(F.lit("pattern:"), hit))
    return feeds.reason_tally(t(spark, d, "documents").select("text"), reason)


@query("""
WITH p AS (SELECT p_partkey, lower(p_type) AS k, p_brand, p_retailprice / 2000 AS confidence FROM part WHERE p_size <= 40 AND p_retailprice / 2000 >= 0.55),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, k ORDER BY confidence DESC NULLS LAST, p_partkey) AS rn FROM p)
SELECT p_partkey, p_brand FROM r WHERE rn = 1
""")
def bulk_places(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("city"), F.col("p_type").alias("name"), F.when(F.col("p_size") <= 40, "known").otherwise("other").alias("kind"), (F.col("p_retailprice") / 2000).alias("confidence"))
    return feeds.bulk_places(p, ["known"]).select(F.col("id").alias("p_partkey"), F.col("city").alias("p_brand"))


@query("SELECT page_id, CASE WHEN NOT regexp_matches(url, '[13579]$') THEN url END AS url FROM pages")
def heal_urls(spark, d):
    pages = t(spark, d, "pages").select("page_id", "url")
    return editing.heal(pages, "url", pages.where(F.col("url").rlike("[13579]$")).select("url"))


@query("SELECT url, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY 1 ORDER BY url LIMIT 40")
def urls_to_check(spark, d):
    return editing.to_check(t(spark, d, "pages"), "url", 40)


@query("""
WITH p AS (SELECT c_custkey AS id, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN 'кино' ELSE 'film' END AS quote, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS description FROM customer),
a AS (SELECT id, CASE id % 4 WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'et' END AS lang, CASE WHEN id % 5 = 0 THEN upper(title) WHEN id % 7 = 0 THEN 'да' ELSE 'New ' || title END AS t, CASE WHEN id % 3 <> 0 THEN 'cinema' END AS q, lower(description) AS d FROM p),
j AS (SELECT p.*, t, q, d, lang IS NOT NULL AND lang <> 'en' AS go FROM p JOIN a USING (id))
SELECT id, CASE WHEN go AND t <> 'да' AND lower(t) <> lower(trim(title)) THEN t ELSE title END AS title, CASE WHEN go AND t <> 'да' AND lower(t) <> lower(trim(title)) THEN title END AS title_original,
CASE WHEN go AND q IS NOT NULL AND quote = 'кино' THEN q ELSE quote END AS quote, CASE WHEN go AND description IS NOT NULL AND d <> description THEN d ELSE description END AS description FROM j
""")
def translate_guarded(spark, d):
    k = F.col("id")
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("title_original"), F.when(F.col("c_custkey") % 2 == 0, "кино").otherwise("film").alias("quote"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("description"))
    a = p.select("id", F.when(k % 4 == 0, "en").when(k % 4 != 1, "et").alias("lang"), F.when(k % 5 == 0, F.upper("title")).when(k % 7 == 0, "да").otherwise(F.concat(F.lit("New "), "title")).alias("title"), F.when(k % 3 != 0, "cinema").alias("quote"), F.lower("description").alias("description"))
    return editing.translated(p, a)


@query("""
WITH p AS (SELECT *, s_suppkey % 10 <> 0 AS live FROM supplier)
SELECT CAST(s_nationkey AS VARCHAR) AS city, count(*) AS picks, count(*) FILTER (WHERE s_suppkey % 9 = 0) AS unpinned, count(*) FILTER (WHERE s_suppkey % 4 = 0) AS pending_review, count(*) FILTER (WHERE s_suppkey % 3 <> 0) AS no_embedding FROM p WHERE live GROUP BY 1
""")
def city_stats(spark, d):
    k = F.col("s_suppkey")
    p = placed(spark, d).select(k.alias("id"), F.col("s_nationkey").cast("string").alias("city"), "lat", "lng", F.when(k % 4 == 0, "@discovery").otherwise("@desk").alias("handle"), F.when(k % 10 == 0, F.lit(0)).alias("archived_at"))
    return editing.city_stats(p, p.where("id % 3 = 0").select(F.col("id").alias("pick_id")))


@query("""
WITH n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n FROM events GROUP BY 1)
SELECT user_id, n || CASE WHEN n = 1 THEN ' gig' ELSE ' gigs' END || ' tonight' AS headline, CASE WHEN n > 0 THEN 'WITHIN 1.2 KM OF YOU (15 MIN) · SOONEST FIRST' ELSE '' END AS subline FROM n
""")
def headlines(spark, d):
    n = t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"))
    return n.select("user_id", editing.headline(F.col("n"), ["gig"], "tonight").alias("headline"), editing.subline(F.col("n"), 1200).alias("subline"))


@query(f"""
WITH p AS (SELECT s_nationkey AS city, s_suppkey AS id, s_name AS title, s_suppkey % 3 = 0 AS tonight, s_suppkey % 5 AS sort_order, {one_of_sql('s_suppkey', ['Fri', None, 'Tonight'])} AS day, CASE WHEN s_suppkey % 2 = 0 THEN '19:00' END AS time FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY tonight DESC, sort_order, id) AS rn FROM p),
b AS (SELECT city, rn, concat_ws(chr(10), CASE WHEN tonight THEN '[TONIGHT] ' ELSE '' END || title, 'gig' || coalesce(' · ' || CASE WHEN day IS NOT NULL AND day <> 'Tonight' THEN trim(day || ' ' || coalesce(time, '')) ELSE time END, ''), 'https://x.test/' || id) AS body FROM r WHERE rn <= 5)
SELECT CAST(city AS VARCHAR) AS city, string_agg(body, chr(10) || chr(10) ORDER BY rn) AS text FROM b GROUP BY 1
""")
def digest_text(spark, d):
    k, none = F.col("s_suppkey"), F.lit(None).cast("string")
    p = t(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("city"), k.alias("id"), F.col("s_name").alias("title"), (k % 3 == 0).alias("tonight"), (k % 5).alias("sort_order"), none.alias("created_at"), one_of(k, ["Fri", None, "Tonight"]).alias("day"), F.when(k % 2 == 0, "19:00").alias("time"), none.alias("neighborhood"), F.lit("gig").alias("kind"), none.alias("quote"), none.alias("handle"), none.alias("archived_at"))
    return editing.digest_text(p.withColumn("id", F.col("id").cast("string")).withColumn("created_at", F.lpad("id", 12, "0")), "https://x.test/")


@query("""
WITH w AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier WHERE s_suppkey % 4 <> 0),
n AS (SELECT n_nationkey AS route, unnest(range(8)) AS pos FROM nation), s AS (SELECT route, pos, route + pos * 25 AS id FROM n),
f AS (SELECT s.*, v.s_suppkey IS NOT NULL AS found FROM s LEFT JOIN w v ON v.s_suppkey = s.id), l AS (SELECT route, count(*) FILTER (WHERE NOT found) AS dropped FROM f GROUP BY 1)
SELECT f.route, CAST(f.pos AS INTEGER) AS pos, f.id, l.dropped FROM f JOIN l USING (route) WHERE found
""")
def route_stops(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((F.col("n_nationkey").cast("long") + i * 25).alias("id"), F.lit("").alias("note"))).alias("stops"))
    v = t(spark, d, "supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("id"))
    return match.ordered_stops(n, v, []).select("route", "pos", "id", "dropped")
