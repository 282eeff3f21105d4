"""Ranks by covers, paged sources, derived columns, versions, lookups, shelves and rounds bound to the test tables, with
their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, names, text
from ..operators import cover, derived, geocode, rank, rounds, shelves
from ..sources import feeds, pages, settled, versions
from .bindings import query, shared, t

# --- cover density ---------------------------------------------------------------------------------------------------

COVERS = 'of the -is or "of the" in or la le -un'
_ENTRIES = """
split AS (SELECT doc_id, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS whole FROM documents),
fields AS (SELECT doc_id, list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS a, list_filter(string_split_regex(lower(substr(whole, length(title) + 2)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS c FROM split),
listed AS (SELECT doc_id, ' ' || array_to_string(list_concat(a, c), ' ') || ' ' AS s, len(a) AS n_a, list_concat(a, c) AS w FROM fields),
held AS (SELECT * FROM listed WHERE (contains(s, ' of ') AND contains(s, ' the ') AND NOT contains(s, ' is ')) OR (contains(s, ' of the ') AND contains(s, ' in ')) OR (contains(s, ' la ') AND contains(s, ' le ') AND NOT contains(s, ' un '))),
placed AS (SELECT doc_id, n_a, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM held),
entries AS (SELECT doc_id, i, w, CASE WHEN i <= n_a THEN 1.0 ELSE 5.0 END AS inv, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM placed WHERE w IN ('of', 'the', 'in', 'la', 'le')),
seen AS (SELECT *, sum(inv) OVER x AS s, max(CASE WHEN w = 'of' THEN k END) OVER x AS p1, max(CASE WHEN w = 'the' THEN k END) OVER x AS p2, max(CASE WHEN w = 'in' THEN k END) OVER x AS p4, max(CASE WHEN w = 'la' THEN k END) OVER x AS p5, max(CASE WHEN w = 'le' THEN k END) OVER x AS p6,
  max(CASE WHEN w = 'the' AND (before).w = 'of' AND (before).i = i - 1 THEN k - 1 END) OVER x AS p3
  FROM (SELECT *, lag({'w': w, 'i': i}) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM entries) WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
begun AS (SELECT *, greatest(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN least(p1, p2) ELSE 0 END, CASE WHEN p3 IS NOT NULL AND p4 IS NOT NULL THEN least(p3, p4) ELSE 0 END, CASE WHEN p5 IS NOT NULL AND p6 IS NOT NULL THEN least(p5, p6) ELSE 0 END) AS p FROM seen),
covers AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY k), 0) AS q FROM begun)"""


@query(f"""
WITH {_ENTRIES},
each AS (SELECT c.doc_id, (c.k - c.p + 1) / (c.s - b.s + b.inv) / (1 + (c.i - b.i) - (c.k - c.p)) AS gain FROM covers c JOIN begun b ON b.doc_id = c.doc_id AND b.k = c.p WHERE c.p > c.q),
scores AS (SELECT doc_id, round(sum(gain), 6) AS score FROM each GROUP BY 1)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores ORDER BY score DESC, doc_id LIMIT 200
""")
def cover_density(spark, d):
    """First line as class A, the rest as class C."""
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    rest = F.substring(F.coalesce("text", F.lit("")), F.length(title) + 2, F.length("text"))
    return cover.cover_rank(t(spark, d, "documents"), "doc_id", [(title, "A"), (rest, "C")], COVERS, 200)


# --- pages -----------------------------------------------------------------------------------------------------------

SINCE, UNTIL = "2024-01-04T12:00:00", "2024-01-20T00:00:00"
_VENUES, _PATTERNS = ["hall 3"], ["secret"]
PAGE, TOGETHER = 200, 100


def _event_pages(spark, d):
    """Open-data events made of the events: status by type, names in three languages."""
    e = t(spark, d, "events")
    say = lambda c: F.struct(c.alias("en"), F.lit(None).cast("string").alias("fi"), F.lit("").alias("sv"))
    k = F.col("event_id") % 10
    name = F.struct(F.when(k < 5, F.concat(F.lit("Event "), F.col("event_id").cast("string"))).alias("en"), F.when(k.between(3, 7), F.lit("Tapahtuma")).alias("fi"), F.when(k == 8, F.lit("secret Händelse")).otherwise("").alias("sv"))
    items = e.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("start"), "event_id", F.when(F.col("event_type") == "error", "EventCancelled").otherwise("EventScheduled").alias("event_status"), F.when(F.col("event_type") == "click", "Course").otherwise("General").alias("type_id"), name.alias("name"), F.struct(say(F.concat(F.lit("Hall "), (F.col("user_id") % 7).cast("string"))).alias("name")).alias("location"), say(F.lit("")).alias("short_description"), say(F.lit("")).alias("description"))
    # A day's pages take its events in order of an hour's bucket, so that a page is bounded and its window narrow; up to TOGETHER
    # pages of a day share a folder.
    day, n = F.datediff(F.to_date("start"), F.lit("2024-01-01")), F.expr(f"event_id div {PAGE}")
    folder = shared(spark)
    pages.write_pages(items.withColumn("page", day * 1_000_000 + n), folder, "page", "start", TOGETHER)
    return folder


_NAME = "CASE WHEN event_id % 10 < 5 THEN 'Event ' || event_id WHEN event_id % 10 <= 7 THEN 'Tapahtuma' WHEN event_id % 10 = 8 THEN 'secret Händelse' ELSE '' END"


@query(f"""
WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'status:EventCancelled' WHEN event_type = 'click' THEN 'type:Course' WHEN {_NAME} = '' THEN 'no-name' WHEN user_id % 7 = 3 THEN 'venue:hall 3' WHEN {_NAME} LIKE '%secret%' THEN 'pattern:secret' ELSE 'kept' END AS reason FROM events WHERE date_trunc('second', ts) >= '{SINCE.replace("T", " ")}' AND date_trunc('second', ts) < '{UNTIL.replace("T", " ")}')
SELECT reason, count(*) AS n, min(event_id) AS first, max({_NAME}) AS name, (SELECT count(*) FROM events) AS total FROM e GROUP BY 1
""")
def paged_events(spark, d):
    """A window of a paged source: what is skipped and why, what is kept, and the total beside it."""
    folder = _event_pages(spark, d)
    kind = "event_id long, event_status string, type_id string, name struct<en string, fi string, sv string>, location struct<name struct<en string, fi string, sv string>>, short_description struct<en string, fi string, sv string>, description struct<en string, fi string, sv string>"
    rows = pages.read_pages(spark, folder, SINCE, UNTIL).select(F.from_json("item", kind).alias("x")).select("x.*")
    reason = F.coalesce(feeds.skip_reason(rows, _VENUES, _PATTERNS), F.lit("kept"))
    tally = rows.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max(feeds.localized(F.col("name"))).alias("name"))
    return tally.crossJoin(F.broadcast(pages.total(spark, folder)))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def browse_total(spark, d):
    rows = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return rank.page_with_total(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2)


# --- derived columns and versions ------------------------------------------------------------------------------------

def _search_columns():
    label = lambda c, k: F.transform(F.split(F.lower(c), " "), lambda w: F.concat(w, F.lit(k)))
    return {
        "search_text": derived.Derived(["p_name", "p_brand", "p_type"], F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))),
        "weights": derived.Derived(["p_name", "p_type"], F.array_join(F.concat(label("p_name", ":A"), label("p_type", ":C")), " ")),
    }


@query("""
WITH p AS (SELECT p_partkey, p_name, p_brand, p_retailprice + CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END AS p_retailprice, CASE WHEN p_partkey % 3 = 0 THEN p_type || ' NEW' ELSE p_type END AS p_type, p_partkey % 3 = 0 OR p_partkey % 11 = 5 AS fresh FROM part)
SELECT p_partkey, round(p_retailprice, 2) AS price, lower(p_name || ' ' || p_brand || ' ' || p_type) AS search_text, array_to_string(list_concat(list_transform(string_split(lower(p_name), ' '), lambda w: w || ':A'), list_transform(string_split(lower(p_type), ' '), lambda w: w || ':C')), ' ') AS weights,
CASE WHEN fresh THEN 2 ELSE 1 END AS derived_in FROM p
""")
def derived_columns(spark, d):
    """Two batches, the second repeated: parts of a new type, of a new price only, and new parts."""
    parts, table = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"), versions.Versions(spark, shared(spark))
    k = F.col("p_partkey") % 3
    second = parts.withColumns({"p_type": F.when(k == 0, F.concat("p_type", F.lit(" NEW"))).otherwise(F.col("p_type")), "p_retailprice": F.col("p_retailprice") + F.when(k == 1, 1).otherwise(0)}).where((k < 2) | (F.col("p_partkey") % 11 == 5))
    for batch, rows in ((1, parts.where("p_partkey % 11 <> 5")), (2, second), (2, second)):
        out = derived.write_batch(table, rows, "p_partkey", _search_columns(), batch)
    return out.select("p_partkey", F.round("p_retailprice", 2).alias("price"), "search_text", "weights", "derived_in")


@query("""
WITH v AS (SELECT 1 AS version, vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings
UNION ALL SELECT 2, vec_id, 0, NULL FROM embeddings
UNION ALL SELECT 3, vec_id, len(embedding) // 2, (CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)) / 2 FROM embeddings)
SELECT version, vec_id, dims, round(first, 6) AS first FROM v
""")
def retyped_vectors(spark, d):
    """A model changes: vectors are emptied and retyped, then filled by the new one, of half as many dimensions; a reader of each version keeps it."""
    table = versions.Versions(spark, shared(spark))
    table.write(t(spark, d, "embeddings").select("vec_id", "embedding"))
    old = table.read()
    versions.retyped(table, {"embedding": F.lit(None).cast("array<double>")})
    half = F.transform(F.sequence(F.lit(0), (F.size("embedding") / 2 - 1).cast("int")), lambda i: (F.get("embedding", (2 * i).cast("int")).cast("double") + F.get("embedding", (2 * i + 1).cast("int")).cast("double")) / 2)
    table.write(old.select("vec_id", half.alias("embedding")))
    shown = lambda n: table.read(n).select(F.lit(n).alias("version"), "vec_id", F.coalesce(F.size(F.col("embedding")), F.lit(0)).alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
    return shown(1).unionByName(shown(2).withColumn("dims", F.greatest("dims", F.lit(0)))).unionByName(shown(3))


# --- positions -------------------------------------------------------------------------------------------------------


@query("""
WITH s AS (SELECT s_suppkey, s_name AS venue, CASE WHEN s_suppkey % 5 > 0 THEN r_name END AS neighborhood, n_name AS city, s_suppkey % 4 AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
o AS (SELECT *, CASE WHEN k = 0 THEN 'hit' WHEN k = 2 THEN 'error' WHEN neighborhood IS NULL THEN 'none' WHEN k = 1 THEN 'hit' WHEN s_suppkey % 8 = 7 THEN 'error' ELSE 'none' END AS outcome, k IN (1, 3) AND neighborhood IS NOT NULL AS again FROM s)
SELECT s_suppkey, CASE WHEN again THEN venue || ', ' || neighborhood || ', ' || city ELSE venue || ', ' || city END AS query, outcome, CASE WHEN outcome = 'hit' THEN 50 + s_suppkey / 1000 END AS lat,
CASE WHEN outcome = 'hit' THEN CASE WHEN k = 0 THEN 'Street ' || s_suppkey || ', ' || city ELSE 'a, b,c' END END AS address, CASE WHEN outcome = 'error' THEN CASE WHEN k = 2 THEN 429 END END AS error, outcome = 'none' AS waits FROM o
""")
def geocode_outcomes(spark, d):
    """Suppliers' places against answers made by their numbers: hits, none at first, too many requests, and queries never sent."""
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    s = t(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey"))
    places = s.select("s_suppkey", F.col("s_name").alias("venue"), F.when(F.col("s_suppkey") % 5 > 0, F.col("r_name")).alias("neighborhood"), F.col("n_name").alias("city"))
    k = F.col("s_suppkey") % 4
    address = F.struct(F.when(k == 0, "Street").alias("road"), F.when(k == 0, F.col("s_suppkey").cast("string")).alias("house_number"), F.lit(None).cast("string").alias("postcode"), F.when(k == 0, F.col("city")).alias("city"))
    hit = F.array(F.struct((50 + F.col("s_suppkey") / 1000).cast("string").alias("lat"), F.lit("24.7").alias("lng"), address.alias("address"), F.lit("a, b,c, d").alias("display_name")))
    plain = places.select(F.concat_ws(", ", "venue", "city").alias("query"), F.when(k == 2, 429).otherwise(200).alias("status"), F.when(k == 0, hit).otherwise(F.slice(hit, 1, 0)).alias("rows"))
    more = places.where((k == 1) | ((k == 3) & (F.col("s_suppkey") % 8 != 7))).select(F.concat_ws(", ", "venue", "neighborhood", "city").alias("query"), F.lit(200).alias("status"), F.when(k == 1, hit).otherwise(F.slice(hit, 1, 0)).alias("rows"))
    more = more.join(plain.select("query"), "query", "left_anti")
    out = geocode.stamped(geocode.geocoded(places, plain.unionByName(more)), F.current_timestamp())
    return out.select("s_suppkey", "query", "outcome", "lat", "address", "error", F.col("geocode_failed_at").isNotNull().alias("waits"))


# --- shelves ---------------------------------------------------------------------------------------------------------

#: Minutes of the week: Monday 00:30, into which Sunday's hours run, and Friday 17:30.
MINUTES = {"night": 30, "evening": 4 * 1440 + 17 * 60 + 30}


def _placed(key, lat, lng):
    """Towns of 500 keys, some 13 by 14 km each."""
    town, k = F.floor(key / 500) % 600, key % 500
    return (-60 + town * 0.2 + (k * 79 % 500) / 500 * 0.12).cast("double").alias(lat), (F.when(key % 97 != 5, -179.95 + town * 0.6 + (k * 131 % 500) / 500 * 0.25)).cast("double").alias(lng)


_PLACED = "-60 + {k} // 500 % 600 * 0.2 + ({k} % 500 * 79 % 500) / 500 * 0.12 AS {lat}, CASE WHEN {k} % 97 <> 5 THEN -179.95 + {k} // 500 % 600 * 0.6 + ({k} % 500 * 131 % 500) / 500 * 0.25 END AS {lng}"
_OPENS, _CLOSES = "(7 + s_suppkey % 6) * 60", "(16 + s_suppkey % 11) * 60 % 1440"


@query(f"""
WITH c AS (SELECT c_custkey, {_PLACED.format(k="c_custkey", lat="a1", lng="o1")} FROM customer),
s AS (SELECT s_suppkey, {_PLACED.format(k="(s_suppkey * 15)", lat="a2", lng="o2")}, {_OPENS} AS o, {_CLOSES} AS e FROM supplier),
m AS (SELECT 'night' AS shelf, s_suppkey, a2, o2 FROM s WHERE s_suppkey % 7 <> 6 AND e <= o AND e > 30 UNION ALL SELECT 'evening', s_suppkey, a2, o2 FROM s WHERE s_suppkey % 7 <> 4 AND o <= 1050 AND (e > 1050 OR e <= o)),
p AS (SELECT shelf, c_custkey, s_suppkey, 2 * 6371000.0 * asin(sqrt(least(1, power(sin(radians(a2 - a1) / 2), 2) + cos(radians(a1)) * cos(radians(a2)) * power(sin(radians(o2 - o1) / 2), 2)))) AS metres FROM c, m WHERE o1 IS NOT NULL AND o2 IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY shelf, c_custkey ORDER BY metres, s_suppkey) AS rank FROM p WHERE metres <= 1600)
SELECT shelf, c_custkey, s_suppkey, round(metres, 3) AS metres, rank FROM r WHERE rank <= 10
""")
def open_shelves(spark, d):
    """Suppliers that are open within 20 minutes' walk of each customer, at two times."""
    s = t(spark, d, "supplier")
    readers = t(spark, d, "customer").select("c_custkey", *_placed(F.col("c_custkey"), "r_lat", "r_lng"))
    places = s.select("s_suppkey", *_placed(F.col("s_suppkey") * 15, "lat", "lng"))
    k = F.col("s_suppkey")
    hours = s.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day"), ((7 + k % 6) * 60).alias("opens"), ((16 + k % 11) * 60 % 1440).alias("closes")).where("s_suppkey % 7 <> day")
    spans = shelves.intervals(hours, "s_suppkey", "day", "opens", "closes")
    made = [shelves.shelf(readers, places, spans, "c_custkey", "s_suppkey", F.lit(m)).select(F.lit(name).alias("shelf"), "c_custkey", "s_suppkey", F.round("metres", 3).alias("metres"), "rank") for name, m in MINUTES.items()]
    return made[0].unionByName(made[1])


@query(f"""
WITH s AS (SELECT s_suppkey, s_name, {_PLACED.format(k="(s_suppkey * 15)", lat="a2", lng="o2")}, CASE s_suppkey % 4 WHEN 0 THEN 'Éclair ' WHEN 1 THEN 'eclair ' WHEN 2 THEN 'Zebra ' ELSE 'ångström ' END || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS name FROM supplier),
m AS (SELECT *, CASE WHEN s_suppkey % 3 = 0 THEN 2 * 6371000.0 * asin(sqrt(least(1, power(sin(radians(a2 + 60) / 2), 2) + cos(radians(-60)) * cos(radians(a2)) * power(sin(radians(o2 + 179.9) / 2), 2)))) END AS metres FROM s)
SELECT s_suppkey, round(metres, 2) AS metres, row_number() OVER (ORDER BY metres NULLS LAST, strip_accents(lower(name)), s_suppkey) AS rank FROM m QUALIFY rank <= 500
""")
def places_by_name(spark, d):
    """Places nearest first; those of unknown distance by name, in a locale's order: the first 500."""
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 4 == 0, "Éclair ").when(k % 4 == 1, "eclair ").when(k % 4 == 2, "Zebra ").otherwise("ångström "), F.lpad(k.cast("string"), 9, "0"))
    places = t(spark, d, "supplier").select("s_suppkey", *_placed(k * 15, "lat", "lng"), name.alias("name"))
    metres = F.when(k % 3 == 0, geo.haversine(F.lit(-60.0), F.lit(-179.9), F.col("lat"), F.col("lng")))
    top = shelves.by_distance_or_name(places, metres, "name", "s_suppkey").limit(500)
    return top.select("s_suppkey", F.round("metres", 2).alias("metres"), F.row_number().over(Window.orderBy(F.asc_nulls_last("metres"), F.collate("name", "UNICODE"), "s_suppkey")).alias("rank"))


# --- names -----------------------------------------------------------------------------------------------------------

_SHOWN = "CASE c_custkey % 6 WHEN 0 THEN 'Café ' || c_custkey WHEN 1 THEN 'cafe_' || c_custkey WHEN 2 THEN 'CAFÉ ' || c_custkey // 6 WHEN 3 THEN c_custkey || '% Åbo' WHEN 4 THEN 'Zoë\\' || c_custkey END"


def _shown():
    k = F.col("c_custkey")
    n, text = k % 6, k.cast("string")
    return F.when(n == 0, F.concat(F.lit("Café "), text)).when(n == 1, F.concat(F.lit("cafe_"), text)).when(n == 2, F.concat(F.lit("CAFÉ "), F.expr("string(c_custkey div 6)"))).when(n == 3, F.concat(text, F.lit("% Åbo"))).when(n == 4, F.concat(F.lit("Zoë\\"), text))


@query(f"""
WITH n AS (SELECT c_custkey, {_SHOWN} AS name FROM customer)
SELECT c_custkey, contains(lower(name), 'é 1') AS part, contains(name, '3% ') AS percent, contains(lower(name), 'e_1') AS under, contains(name, '\\2') AS slash, lower(name) = 'café 12' AS same, strip_accents(lower(name)) = 'cafe 12' AS alike FROM n
""")
def name_tests(spark, d):
    c = t(spark, d, "customer").select("c_custkey", _shown().alias("name"))
    n = F.col("name")
    return c.select("c_custkey", *(names.holds_term(n, term).alias(a) for a, term in (("part", "É 1"), ("percent", "3% "), ("under", "E_1"), ("slash", "\\2"))), names.same_name(n, "cAFÉ 12").alias("same"), names.alike_name(n, F.lit("Cafe 12")).alias("alike"))


@query(f"SELECT c_custkey, name FROM (SELECT c_custkey, {_SHOWN} AS name FROM customer) WHERE contains(lower(name), 'caf') AND contains(name, ' ') ORDER BY strip_accents(lower(name)), c_custkey LIMIT 8")
def venue_picker(spark, d):
    c = t(spark, d, "customer").select("c_custkey", _shown().alias("name")).where(F.contains("name", F.lit(" ")))
    return names.pick_list(c, "name", "c_custkey", "CAF", 8, "UNICODE_CI_AI")


# --- tags ------------------------------------------------------------------------------------------------------------

_MARKED = "coalesce(html, '') || ' Vivaldi&#039;s &#233;&#xE9;&#x20ac; &amp;lt;b&gt; &amp;#39; x<BR />y<br>z<> &nbsp; &quot;q&quot; '"


def _stripped_sql() -> str:
    out = []
    for way, (tag, entities, numbers, collapse, most) in text.STRIPPERS.items():
        s = _MARKED
        if way == "channel":
            s = f"regexp_replace({s}, '(?i)<br\\s*/?>', chr(10), 'g')"
        s = f"regexp_replace({s}, '{'<[^>]*>' if way == 'facts' else '<[^>]+>'}', '{tag}', 'g')"
        for e in entities:
            sign = text._ENTITIES[e].replace("'", "''")
            s = f"replace({s}, '{e}', '{sign}')"
        if numbers:
            s = f"list_reduce(list_concat([{s}], list_distinct(regexp_extract_all({s}, '&#[0-9]{{1,9}};'))), lambda a, m: replace(a, m, chr(CAST(regexp_extract(m, '[0-9]+') AS INTEGER))))"
            s = f"list_reduce(list_concat([{s}], list_distinct(regexp_extract_all({s}, '(?i)&#x[0-9a-f]{{1,8}};'))), lambda a, m: replace(a, m, chr(CAST('0x' || regexp_extract(m, '(?i)x([0-9a-f]+)', 1) AS INTEGER))))"
        s = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
        s = f"regexp_replace({s}, '\\s+', ' ', 'g')" if collapse else s
        s = f"substr({s}, 1, {most})" if most else s
        out.append(f"SELECT page_id, '{way}' AS way, md5({s}) AS digest, length({s}) AS n FROM pages")
    return " UNION ALL ".join(out)


@query(_stripped_sql())
def stripped_ways(spark, d):
    """Pages with some entities and breaks behind them, by each listing's way with tags."""
    marked = F.concat(F.coalesce("html", F.lit("")), F.lit(" Vivaldi&#039;s &#233;&#xE9;&#x20ac; &amp;lt;b&gt; &amp;#39; x<BR />y<br>z<> &nbsp; &quot;q&quot; "))
    ways = F.array(*(F.struct(F.lit(way).alias("way"), text.stripped(F.col("s"), way).alias("s")) for way in text.STRIPPERS))
    rows = t(spark, d, "pages").select("page_id", marked.alias("s")).select("page_id", F.explode(ways).alias("x"))
    return rows.select("page_id", "x.way", F.md5("x.s").alias("digest"), F.length("x.s").cast("long").alias("n"))


# --- sources that settle apart, rounds -------------------------------------------------------------------------------


@query("""
SELECT 'nation' AS source, false AS fell_back, count(*) AS n FROM nation UNION ALL SELECT 'customer', false, count(*) FROM customer
UNION ALL SELECT 'region', true, count(*) FROM region UNION ALL SELECT 'supplier', true, count(*) FROM supplier WHERE s_suppkey % 2 = 0
""")
def settled_sources(spark, d):
    """Of four sources one is missing and one breaks while it is read: their snapshots stand in."""
    live = lambda name: (lambda: t(spark, d, name))
    broken = lambda: t(spark, d, "supplier").withColumn("s_name", F.when(F.col("s_suppkey") == 7, F.raise_error(F.lit("cut off"))).otherwise(F.col("s_name")))
    sources = {"nation": settled.Source(live("nation"), live("nation")), "customer": settled.Source(live("customer"), live("customer")), "region": settled.Source(live("nowhere"), live("region")), "supplier": settled.Source(broken, lambda: t(spark, d, "supplier").where("s_suppkey % 2 = 0"))}
    tables, told = settled.settled(spark, sources, shared(spark), 600)
    counts = functools.reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n") for name, df in tables.items()))
    return told.join(counts, "source").select("source", "fell_back", "n")


FIRST, SECOND = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def _round_sql(until: str) -> str:
    return f"(SELECT pick_id, ts AS changed_at, event_type AS change FROM c WHERE ts < '{until}' QUALIFY row_number() OVER (PARTITION BY pick_id ORDER BY ts DESC, event_id DESC) = 1)"


@query(f"""
WITH c AS (SELECT event_id, ts, event_type, user_id, event_id % 50 AS pick_id FROM events), s AS (SELECT DISTINCT user_id, pick_id FROM c WHERE user_id % 3 > 0),
a AS (SELECT user_id, s.pick_id, changed_at, change FROM s JOIN {_round_sql(FIRST)} x ON x.pick_id = s.pick_id), b AS (SELECT user_id, s.pick_id, changed_at, change FROM s JOIN {_round_sql(SECOND)} x ON x.pick_id = s.pick_id)
SELECT 1 AS round, * FROM a UNION ALL SELECT 2, b.* FROM b LEFT JOIN a ON a.user_id = b.user_id AND a.pick_id = b.pick_id WHERE a.changed_at IS NULL OR b.changed_at > a.changed_at
""")
def digest_rounds(spark, d):
    """Two rounds of a digest over what users saved; the second, which is repeated, sends only what has changed since."""
    e = t(spark, d, "events").select("event_id", "ts", "event_type", "user_id", (F.col("event_id") % 50).alias("pick_id"))
    readers, saved = e.where("user_id % 3 > 0").select("user_id"), e.select("user_id", "pick_id")
    changes = lambda until: e.where(F.col("ts") < F.lit(until).cast("timestamp_ntz")).select("pick_id", F.col("event_id").alias("id"), F.col("ts").alias("changed_at"), F.col("event_type").alias("change"))
    state = versions.Versions(spark, shared(spark))
    sent = [rounds.digest_round(state, readers, saved, changes(until), note) for until, note in ((FIRST, "first"), (SECOND, "second"), (SECOND, "second"))]
    return sent[0].select(F.lit(1).alias("round"), "*").unionByName(sent[2].select(F.lit(2).alias("round"), "*"))


_TURNS = "(SELECT c_name AS id FROM p WHERE day IN ('Tonight', '{day}') AND c_name <> coalesce({held}, '') ORDER BY venue = 'Various venues', c_nationkey, created DESC, c_name LIMIT 1)"


@query(f"""
WITH p AS (SELECT *, {"list_extract(['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun', 'Tonight'], CAST(c_custkey % 8 + 1 AS BIGINT))"} AS day, CASE WHEN c_custkey % 3 = 0 THEN 'Various venues' ELSE c_mktsegment END AS venue, c_custkey % 20 AS created FROM customer WHERE c_custkey % 2 = 0),
a AS {_TURNS.format(day="Fri", held="NULL")}, b AS {_TURNS.format(day="Sun", held="(SELECT id FROM a)")}
SELECT 1 AS round, 'promoted' AS action, id FROM a UNION ALL SELECT 2, 'noop', id FROM a UNION ALL SELECT 3, 'promoted', id FROM b
""")
def rotation_rounds(spark, d):
    """Three rounds: one is promoted; it holds the place; after it is archived another one is."""
    k = F.col("c_custkey")
    day = F.get(F.array(*(F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun", "Tonight"))), (k % 8).cast("int"))
    created = F.timestamp_add("DAY", (k % 20).cast("int"), F.lit(FIRST).cast("timestamp"))
    picks = t(spark, d, "customer").select(F.col("c_name").alias("id"), F.lit(False).alias("tonight"), (k % 2 == 0).alias("this_week"), day.alias("day"), F.when(k % 3 == 0, "Various venues").otherwise(F.col("c_mktsegment")).alias("venue"), F.col("c_nationkey").alias("sort_order"), created.alias("created_at"), F.lit(None).cast("timestamp").alias("archived_at"), F.lit(False).alias("pending_review"))
    table = versions.Versions(spark, shared(spark))
    table.write(picks)
    first, again = rounds.rotate(table, "Fri", "1"), rounds.rotate(table, "Sun", "2")
    over = table.read()
    table.write(over.withColumn("archived_at", F.when(F.col("tonight"), F.lit(SECOND).cast("timestamp"))))
    third = rounds.rotate(table, "Sun", "3")
    parts = [x.select(F.lit(i).alias("round"), "action", "id") for i, x in enumerate((first, again, third), 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
