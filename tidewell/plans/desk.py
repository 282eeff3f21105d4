"""What editors do and readers see, bound to the test tables with SQL: flags handed over, forms and lists merged, finds
saved, letters as pages, panels, badges, words for ages.

As in `bindings`, every query runs over its whole tables; values that these lack are made from keys, on both sides alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, when
from ..operators import match, upsert
from ..schemas import PICKS
from ..sources import markup
from . import catalogue, editing
from .bindings import AS_OF, now, query, t
from .composites import _of
from .scalars import one_of, one_of_sql

# --- words -----------------------------------------------------------------------------------------------------------


@query(f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 <> 3 THEN ts - to_days(CAST(event_id % 200 AS INTEGER)) END AS then_ FROM events),
u AS (SELECT event_id, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(then_) AS u FROM e),
p AS (SELECT *, CAST(floor(u / 86400000000) AS BIGINT) AS d, CAST(floor(u / 60000000 + 0.5) AS BIGINT) AS m FROM u),
q AS (SELECT *, CAST(floor(m / 60 + 0.5) AS BIGINT) AS h FROM p),
r AS (SELECT *, CAST(floor(h / 24 + 0.5) AS BIGINT) AS n FROM q)
SELECT event_id,
CASE WHEN u IS NULL OR u < 0 THEN '' WHEN d < 1 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 14 THEN d || ' days ago' WHEN d < 60 THEN CAST(floor(d / 7 + 0.5) AS BIGINT) || ' weeks ago' ELSE CAST(floor(d / 30 + 0.5) AS BIGINT) || ' months ago' END AS spoken,
CASE WHEN u IS NULL OR u < 0 THEN '' WHEN m < 60 THEN m || ' minute' || CASE WHEN m = 1 THEN '' ELSE 's' END || ' ago' WHEN h < 24 THEN h || ' hour' || CASE WHEN h = 1 THEN '' ELSE 's' END || ' ago' ELSE n || ' day' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' ago' END AS rounded,
CASE WHEN u IS NULL OR u < 0 THEN '' WHEN m < 60 THEN m || ' min ago' WHEN h < 24 THEN h || ' hr ago' ELSE n || ' d ago' END AS short FROM r
""")
def ages_said(spark, d):
    """How long ago events were, in three vocabularies; some are yet to come, some have no time."""
    at = F.when(F.col("event_id") % 11 != 3, F.timestamp_add("DAY", -(F.col("event_id") % 200).cast("int"), "ts"))
    said = {"spoken": text.ago_spoken(at, now()), "rounded": text.ago_rounded(at, now()), "short": text.ago_rounded(at, now(), short=True)}
    return t(spark, d, "events").select("event_id", *(c.alias(n) for n, c in said.items()))


_CITIES = ["tallinn", "helsinki", "riga", "vilnius", "oslo", None]


@query(f"""
WITH e AS (SELECT event_id, event_id % 12 + 1 AS month, {one_of_sql('event_id', _CITIES)} AS city FROM events),
s AS (SELECT event_id, list_extract(CASE city {" ".join(f"WHEN '{c}' THEN {dusk}::DOUBLE[]" for c, (_, dusk) in when.SUN.items())} ELSE {when.SUN["tallinn"][1]}::DOUBLE[] END, month) AS dusk_at FROM e)
SELECT event_id, printf('%02d:%02d', CAST(least(floor(dusk_at), 23) AS INTEGER), CAST(floor((dusk_at - floor(dusk_at)) * 60 + 0.5) AS INTEGER) % 60) AS dusk FROM s
""")
def dusk_labels(spark, d):
    return t(spark, d, "events").select("event_id", when.dusk_label(F.col("event_id") % 12 + 1, one_of(F.col("event_id"), _CITIES)).alias("dusk"))


_HOURS = ["→02", None, "SHUT", "24H", ""]
_WEEK = ["Fri", None, "Tuesday", " ", "sun"]


@query(f"""
WITH e AS (SELECT event_id AS k, CASE WHEN event_id % 3 = 0 THEN CAST(event_id * 37 % 1440 AS INTEGER) END AS m, event_id % 4 = 1 AS ton, event_id % 7 = 2 AS place, event_id % 10 = 4 AS free, {one_of_sql('event_id // 5', _HOURS)} AS hours, {one_of_sql('event_id // 2', _WEEK)} AS day FROM events),
f AS (SELECT *, printf('%02d:%02d', m // 60, m % 60) AS clock, upper(substr(nullif(trim(day), ''), 1, 3)) AS dd FROM e),
b AS (SELECT *, CASE WHEN place THEN CASE WHEN k % 2 = 0 THEN 'Open' END WHEN free THEN 'Free' WHEN ton AND m <= 720 THEN 'Now' WHEN m IS NOT NULL THEN 'Doors ' || clock WHEN ton THEN 'Tonight' END AS badge FROM f)
SELECT k AS event_id, badge, CASE WHEN badge IS NOT NULL THEN badge IN ('Open', 'Now') END AS lit, coalesce(clock, CASE WHEN ton THEN 'TON' END, dd, 'OPEN') AS saved,
CASE WHEN place OR hours IS NOT NULL THEN coalesce(nullif(hours, ''), 'OPEN') ELSE coalesce(CASE WHEN ton THEN 'TON' END, dd, 'OPEN') END AS map,
coalesce(CASE WHEN m IS NOT NULL THEN CASE WHEN ton AND m <= 720 THEN 'NOW' ELSE clock END END, CASE WHEN ton THEN 'TON' END, dd, nullif(hours, ''), 'OPEN') AS rail FROM b
""")
def rails_and_badges(spark, d):
    """At noon: what stands beside and upon a row, of places and picks, timed, dated, free or none of these."""
    k = F.col("event_id")
    minutes, ton, place, free = F.when(k % 3 == 0, (k * 37 % 1440).cast("int")), k % 4 == 1, k % 7 == 2, k % 10 == 4
    hours, day = one_of(F.floor(k / 5), _HOURS), one_of(F.floor(k / 2), _WEEK)
    sign = catalogue.badge(place, k % 2 == 0, free, minutes, F.lit(720), ton)
    rows = t(spark, d, "events").select(k, sign.alias("sign"), catalogue.saved_rail(minutes, ton, day).alias("saved"), catalogue.place_rail(place, hours, ton, day).alias("map"), catalogue.rail_text(minutes, ton & (minutes <= 720), ton, day, hours).alias("rail"))
    return rows.select("event_id", F.col("sign.text").alias("badge"), F.col("sign.now").alias("lit"), "saved", "map", "rail")



@query(f"""
SELECT c_custkey, array_to_string(list_filter([c_name, CASE c_custkey % 3 WHEN 0 THEN 'Hall' WHEN 1 THEN '' END, CASE WHEN c_custkey % 2 = 0 THEN 'Old Town' END, c_mktsegment, CASE WHEN c_custkey % 5 > 0 THEN 'Said so.' END,
CASE c_custkey % 4 WHEN 0 THEN 'loud indoors' WHEN 1 THEN 'solo' END], lambda x: x <> ''), ' · ') AS said FROM customer
""")
def embedding_texts(spark, d):
    k = F.col("c_custkey")
    moods = F.when(k % 4 == 0, F.array(F.lit("loud"), F.lit("indoors"))).when(k % 4 == 1, F.array(F.lit("solo"))).when(k % 4 == 2, F.array().cast("array<string>"))
    parts = F.col("c_name"), F.when(k % 3 == 0, "Hall").when(k % 3 == 1, ""), F.when(k % 2 == 0, "Old Town"), F.col("c_mktsegment"), F.when(k % 5 > 0, "Said so."), moods
    return t(spark, d, "customer").select("c_custkey", text.embedding_text(*parts).alias("said"))


_FB = ["https://www.facebook.com/sharer?u=1 https://facebook.com/club.x/about", "http://m.facebook.com/TR/", '<a href="https://facebook.com/groups/abc">', "HTTPS://Facebook.com/Hall-7?ref=1", "https://facebook.com/a", "https://facebook.com/watch/?v=1 https://www.facebook.com/watchers", None]
_IG = ["https://instagram.com/p/Abc https://www.instagram.com/hall_7/", "https://www.instagram.com/reels/1", "https://instagram.com/explorers", "https://Instagram.com/page.of'", None]


def _profile_sql(network: str, page: str) -> str:
    host, handle, others = markup.PROFILES[network]
    found = f"regexp_extract_all({page}, '(?i)https?://{host}/[A-Za-z0-9._-]*[/?]?')"
    good = f"list_filter({found}, lambda x: regexp_matches(x, '(?i)^https?://{host}/{handle}') AND NOT regexp_matches(x, '(?i)^https?://{host}/({'|'.join(others)})'))"
    return f"regexp_extract(list_extract({good}, 1), '(?i)^https?://{host}/{handle}', 0)"


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') || coalesce({one_of_sql('page_id', _FB)}, '') || ' ' || coalesce({one_of_sql('page_id', _IG)}, '') AS page FROM pages)
SELECT page_id, nullif({_profile_sql('facebook', 'page')}, '') AS facebook, nullif({_profile_sql('instagram', 'page')}, '') AS instagram FROM p
""")
def profiles_found(spark, d):
    """Pages with addresses of two networks behind them: profiles are found, share buttons and posts are not."""
    k = F.col("page_id")
    none = lambda c: F.coalesce(c, F.lit(""))
    page = F.concat(none(F.col("html")), none(one_of(k, _FB)), F.lit(" "), none(one_of(k, _IG)))
    return t(spark, d, "pages").select(k, page.alias("page")).select("page_id", *(markup.profile_link(F.col("page"), n).alias(n) for n in markup.PROFILES))


# --- edits -----------------------------------------------------------------------------------------------------------


@query("""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS g, CASE WHEN c_custkey % 5 <> 1 THEN c_custkey % 17 = 0 END AS ton, c_custkey % 3 <> 0 AS week FROM customer),
c AS (SELECT g, min(k) AS chosen FROM (SELECT c_nationkey AS g, c_custkey AS k FROM customer WHERE c_custkey % 20 = 7 UNION ALL SELECT s_nationkey, s_suppkey * 5 FROM supplier) GROUP BY 1),
h AS (SELECT p.*, x.chosen FROM p LEFT JOIN (SELECT c.* FROM c JOIN p ON p.g = c.g AND p.k = c.chosen) x ON x.g = p.g),
s AS (SELECT k, g, CASE WHEN chosen IS NULL THEN ton ELSE k = chosen END AS tonight, week FROM h)
SELECT k, tonight, CASE WHEN g % 2 = 0 AND week AND tonight = false THEN false ELSE week END AS this_week FROM s
""")
def flags_settled(spark, d):
    """Customers' flags after editors chose one for some nations (some of whom aren't there), and after half of the nations
    had the week's flag reset."""
    k = F.col("c_custkey")
    picks = t(spark, d, "customer").select(k.alias("k"), F.col("c_nationkey").alias("g"), F.when(k % 5 != 1, k % 17 == 0).alias("tonight"), (k % 3 != 0).alias("this_week"))
    chosen = picks.where("k % 20 = 7").select("g", "k").unionByName(t(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), (F.col("s_suppkey") * 5).alias("k")))
    held = upsert.hand_over(picks, chosen, "g", "k", "tonight")
    return upsert.reset_flag(held, "this_week", "tonight", F.col("g") % 2 == 0).select("k", "tonight", "this_week")


@query("""
WITH b AS (SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'tel ' || s_suppkey END AS phone, s_acctbal AS lat, 'index' AS source FROM supplier),
f AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN c_name END AS name, CASE WHEN c_custkey % 4 = 1 THEN 'new' ELSE '' END AS phone, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal END AS lat, CASE WHEN c_custkey % 7 > 0 THEN 'manual' END AS source FROM customer WHERE c_custkey % 3 < 2)
SELECT coalesce(b.k, f.k) AS k, coalesce(nullif(trim(f.name), ''), b.name) AS name, coalesce(nullif(trim(f.phone), ''), b.phone) AS phone, coalesce(f.lat, b.lat) AS lat, CASE WHEN f.k IS NULL THEN b.source ELSE f.source END AS source FROM b FULL JOIN f ON f.k = b.k
""")
def details_merged(spark, d):
    """Suppliers as details of venues, customers as editors' forms: only filled fields are taken, but the source always."""
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    base = t(spark, d, "supplier").select(s.alias("k"), F.col("s_name").alias("name"), F.when(s % 2 == 0, F.concat(F.lit("tel "), s.cast("string"))).alias("phone"), F.col("s_acctbal").alias("lat"), F.lit("index").alias("source"))
    forms = t(spark, d, "customer").where("c_custkey % 3 < 2").select(k.alias("k"), F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("c_name")).alias("name"), F.when(k % 4 == 1, "new").otherwise("").alias("phone"), F.when(k % 5 == 0, F.col("c_acctbal")).alias("lat"), F.when(k % 7 > 0, "manual").alias("source"))
    return upsert.merge_filled(base, forms, ["k"], ["source"])


@query("""
WITH l AS (SELECT o_custkey AS id, 'List ' || o_custkey AS name, list(o_orderkey ORDER BY o_orderkey) AS items FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
c AS (SELECT o_custkey AS id, CASE WHEN o_custkey % 4 > 0 THEN 'Cloud ' || o_custkey END AS name, list(o_orderkey ORDER BY o_orderkey) AS items FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1)
SELECT coalesce(c.id, l.id) AS id, coalesce(c.name, l.name) AS name, array_to_string(list_concat(coalesce(l.items, []), list_filter(coalesce(c.items, []), lambda x: NOT list_contains(coalesce(l.items, []), x))), ',') AS items FROM l FULL JOIN c ON c.id = l.id
""")
def lists_merged(spark, d):
    """A customer's orders as a list that two devices keep in part: names of the cloud's, items of both."""
    side = lambda where, name: t(spark, d, "orders").where(where).groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("items")).select("id", name.alias("name"), "items")
    name = lambda word: F.concat(F.lit(word), F.col("id").cast("string"))
    both = match.merge_lists(side("o_orderkey % 3 <> 0", name("List ")), side("o_orderkey % 2 = 0", F.when(F.col("id") % 4 > 0, name("Cloud "))), "id", "items")
    return both.select("id", "name", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("""
SELECT 'list' AS what, o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL GROUP BY 2
UNION ALL SELECT 'item', o_custkey, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' OR o_orderstatus IS NULL GROUP BY 2
""")
def lists_deleted(spark, d):
    """Orders as lists and their lines as items: with a list its items go, and no others."""
    orders = t(spark, d, "orders")
    left, items = upsert.delete_with_parts(orders, t(spark, d, "lineitem"), orders.where("o_orderstatus = 'F'"), "o_orderkey", "l_orderkey")
    owned = items.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    count = lambda df, what: df.groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "o_custkey", "n")
    return count(left, "list").unionByName(count(owned, "item"))


# --- composites ------------------------------------------------------------------------------------------------------

_HALLS = ["Big Hall", "big hall ", "Café Ä", "TBA", None, "Online"]


@query(f"""
WITH p AS (SELECT c_custkey AS id, coalesce(trim({one_of_sql('c_custkey', _HALLS)} || CASE WHEN c_custkey % 6 < 3 THEN ' ' || c_nationkey % 7 ELSE '' END), '') AS venue, trim(CASE c_custkey % 3 WHEN 0 THEN 'Old Town' WHEN 1 THEN ' old town' ELSE '' END) AS hood, c_custkey % 4 > 0 AS placed FROM customer),
f AS (SELECT * FROM p WHERE venue <> '' AND venue <> 'TBA')
SELECT arg_min(venue, id) AS venue, arg_min(hood, id) AS neighborhood, CASE WHEN arg_min(placed, id) THEN 59 + min(id) / 1000 END AS lat, min(id) AS first_id, count(*) AS ids FROM f GROUP BY lower(venue), lower(hood)
""")
def venues_grouped(spark, d):
    """Customers' picks at venues of which spellings differ: the first pick's spelling and position, if it has one."""
    k = F.col("c_custkey")
    venue = F.concat(one_of(k, _HALLS), F.when(k % 6 < 3, F.concat(F.lit(" "), (F.col("c_nationkey") % 7).cast("string"))).otherwise(""))
    hood = F.when(k % 3 == 0, "Old Town").when(k % 3 == 1, " old town")
    picks = t(spark, d, "customer").select(k.alias("id"), venue.alias("venue"), hood.alias("neighborhood"), F.when(k % 4 > 0, 59 + k / 1000).alias("lat"), F.lit(24.0).alias("lng"))
    return catalogue.venue_groups(picks).drop("lng")


_LOCALITIES = ["Tallinn", "Kalamaja", None, " "]


@query(f"""
WITH h AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 9 <> 4 THEN 'Supplier#' || lpad(CAST(c_custkey % 200 AS VARCHAR), 9, '0') END AS name, {one_of_sql('c_custkey', _LOCALITIES)} AS loc, CASE WHEN c_custkey % 5 > 0 THEN 59 + c_custkey / 10000 END AS lat FROM customer),
f AS (SELECT *, 'discovery-' || replace(lower(name), '#', '-') || '-' || lpad(CAST(k % 1000 AS VARCHAR), 8, '0') AS id FROM h WHERE name IS NOT NULL),
g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1),
s AS (SELECT g.*, s_name FROM g LEFT JOIN supplier ON lower(s_name) = lower(name)),
p AS (SELECT 'discovery-supplier-' || lpad(CAST(s_suppkey % 200 AS VARCHAR), 9, '0') || '-' || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 8, '0') AS id, 'Kept' AS title, 'x' AS neighborhood, 1.5 AS lat, false AS pending FROM supplier WHERE s_suppkey < 200 UNION ALL SELECT 'own-' || s_suppkey, 'Own', 'y', NULL, NULL FROM supplier)
SELECT coalesce(s.id, p.id) AS id, CASE WHEN s.id IS NULL THEN p.title ELSE coalesce(s_name, name) || ' — pending review' END AS title, CASE WHEN s.id IS NULL THEN p.neighborhood WHEN loc = 'Kalamaja' THEN loc ELSE 'other' END AS neighborhood, CASE WHEN s.id IS NULL THEN p.lat ELSE s.lat END AS lat, CASE WHEN s.id IS NULL THEN p.pending ELSE true END AS pending_review,
(SELECT count(*) FROM h) AS places, (SELECT count(*) FROM f) AS inserted FROM p FULL JOIN s ON s.id = p.id
""")
def finds_saved(spark, d):
    """Customers as finds in an index of places, suppliers as known venues and as picks, some of which are found again."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    tail = lambda n: F.lpad((n % 1000).cast("string"), 8, "0")
    name = F.concat(F.lit("SUPPLIER#"), F.lpad((k % 200).cast("string"), 9, "0"))
    hits = t(spark, d, "customer").select(F.concat(F.lpad(k.cast("string"), 12, "0"), F.lit("-"), tail(k)).alias("id"), F.lit("tallinn").alias("city"), F.when(k % 9 != 4, F.when(k % 200 < 1, F.initcap(name)).otherwise(name)).alias("name"), F.lit("bar").alias("kind"), one_of(k, _LOCALITIES).alias("locality"), F.when(k % 5 > 0, 59 + k / 10000).alias("lat"), F.lit(24.0).alias("lng"))
    venues = t(spark, d, "supplier").select(F.lit("tallinn").alias("city"), F.col("s_name").alias("name"))
    number = F.concat(F.lit("discovery-supplier-"), F.lpad((s % 200).cast("string"), 9, "0"), F.lit("-"), tail(s))
    held = t(spark, d, "supplier").where("s_suppkey < 200").select(number.alias("id"), F.lit("Kept").alias("title"), F.lit("x").alias("neighborhood"), F.lit(1.5).alias("lat"), F.lit(False).alias("pending_review"))
    own = t(spark, d, "supplier").select(F.concat(F.lit("own-"), s.cast("string")).alias("id"), F.lit("Own").alias("title"), F.lit("y").alias("neighborhood"))
    picks, counts = catalogue.finds_saved(_of(PICKS, held.unionByName(own, allowMissingColumns=True)), hits, venues, "cosy bars", F.lit(AS_OF).cast("timestamp"))
    return picks.select("id", F.regexp_replace("title", "^SUPPLIER", "Supplier").alias("title"), "neighborhood", "lat", "pending_review").join(F.broadcast(counts.select("places", "inserted")))  # one row


_SITE = "https://x.test/?id="


@query(f"""
WITH p AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS id, n_name AS city, c_name || ' <live> & "more"' AS title, CASE WHEN c_custkey % 2 = 0 THEN 'Old Town' END AS hood, c_mktsegment AS kind, CASE c_custkey % 4 WHEN 0 THEN 'Fri' WHEN 1 THEN 'Tonight' END AS day, CASE WHEN c_custkey % 3 > 0 THEN '19:30' END AS time, CASE WHEN c_custkey % 5 > 0 THEN 'It''s on' END AS quote, '@h' || c_custkey % 7 AS handle, CASE WHEN c_custkey % 6 > 1 THEN c_custkey % 6 = 2 END AS ton, c_custkey % 9 AS so FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 8 <> 3),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ton DESC NULLS LAST, so, id) AS turn FROM p),
m AS (SELECT *, array_to_string(list_filter([hood, kind, CASE WHEN day = 'Fri' THEN trim(day || ' ' || coalesce(time, '')) ELSE time END], lambda x: x <> ''), ' · ') AS meta FROM r WHERE turn <= 5),
b AS (SELECT city, turn, '<tr><td><p class="title">' || CASE WHEN ton THEN '<b class="tonight">Tonight</b> ' ELSE '' END || '<a href="{_SITE}' || id || '">' || replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</a></p><p class="meta">' || meta || '</p><p class="quote">' || coalesce(replace(quote, '''', '&#39;'), '') || '</p><p class="by">via ' || handle || '</p></td></tr>' AS body FROM m)
SELECT city, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || city || '</title></head><body><h1>This week in ' || city || '</h1><p>A &lt;good&gt; week</p><table>' || string_agg(body, '' ORDER BY turn) || '</table></body></html>' AS html FROM b GROUP BY city
""")
def digest_pages(spark, d):
    """A letter a nation of its customers as picks: five of each, texts escaped, archived ones left out."""
    k = F.col("c_custkey")
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        k.cast("string").alias("id"), F.col("n_name").alias("city"), F.concat("c_name", F.lit(' <live> & "more"')).alias("title"), F.when(k % 2 == 0, "Old Town").alias("neighborhood"), F.col("c_mktsegment").alias("kind"), F.when(k % 4 == 0, "Fri").when(k % 4 == 1, "Tonight").alias("day"), F.when(k % 3 > 0, "19:30").alias("time"),
        F.when(k % 5 > 0, "It's on").alias("quote"), F.concat(F.lit("@h"), (k % 7).cast("string")).alias("handle"), F.when(k % 6 > 1, k % 6 == 2).alias("tonight"), (k % 9).cast("int").alias("sort_order"), F.when(k % 8 == 3, F.lit(AS_OF).cast("timestamp")).alias("archived_at"),
    )
    return editing.digest_html(_of(PICKS, rows), _SITE, F.lit("A <good> week"))


@query("""
WITH l AS (SELECT event_id, event_type || ' ' || CASE WHEN event_id % 3 = 0 THEN 'error' ELSE 'ok' END AS name, CASE WHEN event_id % 3 = 0 THEN 'no answer' ELSE event_id % 10 || ' in, ' || CASE WHEN event_id % 4 > 0 THEN user_id ELSE 0 END || ' rejected' END AS detail FROM events)
SELECT 'queue' AS part, CASE WHEN o_orderkey % 13 > 0 THEN o_orderstatus ELSE 'unknown' END AS name, count(*) AS n, NULL AS detail FROM orders GROUP BY 2
UNION ALL (SELECT 'run', name, event_id, detail FROM l ORDER BY event_id DESC LIMIT 5)
""")
def pipeline_shown(spark, d):
    """Orders as a queue of messages and events as a log of runs: counts by status, and the last five runs."""
    k = F.col("event_id")
    queue = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 13 > 0, F.col("o_orderstatus")).alias("status"))
    logs = t(spark, d, "events").select(k.alias("id"), F.col("event_type").alias("fn"), F.when(k % 3 == 0, "error").otherwise("ok").alias("status"), (k % 10).cast("int").alias("inserted"), F.when(k % 4 > 0, F.col("user_id")).alias("rejected"), F.when(k % 3 == 0, "no answer").otherwise("").alias("error"))
    return editing.pipeline_panel(queue, logs)
