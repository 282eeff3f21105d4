"""Parsers and state changes bound to the test tables, with their SQL.

Pages, feeds and elements are made of whole tables, so that SQL says from the tables what must be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, web
from ..operators import facets, lifecycle, upsert
from ..sources import feeds, markup
from . import catalogue, editing
from .bindings import AS_OF, now, query, t
from .scalars import one_of, one_of_sql


def _paged(rows: DataFrame, by: str, order: str, piece: Column, name: str = "page") -> DataFrame:
    """One made page for each value of `by`: its pieces in order."""
    made = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))), lambda x: x["p"]), "\n")
    return rows.groupBy(by).agg(made.alias(name))


def _s(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- pages and feeds -------------------------------------------------------------------------------------------------


@query(r"""
SELECT s_nationkey, CAST(epoch(TIMESTAMP '2024-01-20 00:00:00') AS BIGINT) + s_suppkey % 24 * 3600 AS message_id, s_name || ' & Co' || chr(10) || chr(10) || 'No ' || s_suppkey AS text,
  'https://x.test/' || s_suppkey AS permalink, 'c' || s_suppkey % 3 || ',all' AS categories FROM supplier WHERE s_suppkey % 10 > 0
""")
def feed_read(spark, d):
    k = F.col("s_suppkey")
    stamp = F.when(k % 10 > 0, F.format_string("<pubDate>Sat, 20 Jan 2024 %02d:00:00 +0000</pubDate>", k % 24)).otherwise("")
    item = _s("<item><title>", F.col("s_name"), " &amp; Co</title><link>https://x.test/", k, "</link><description><![CDATA[<p>No <b>", k, "</b></p>]]></description>", stamp, "<category>c", k % 3, "</category><category><![CDATA[all]]></category></item>")
    out = markup.feed_items(_paged(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", item), "page", ["s_nationkey"])
    return out.select("s_nationkey", "message_id", "text", "permalink", F.array_join("categories", ",").alias("categories"))


@query("SELECT s_nationkey, 'chan' || s_nationkey AS channel, s_suppkey AS message_id, 'Tonight' || chr(10) || s_name || ' <3' AS text FROM supplier WHERE s_suppkey % 7 > 0")
def channel_read(spark, d):
    k = F.col("s_suppkey")
    said = F.when(k % 7 > 0, _s("Tonight<br/><b>", F.col("s_name"), "</b> &lt;3")).otherwise("")
    post = _s('<div data-post="chan', F.col("s_nationkey"), "/", k, '"><div class="js message_text x" dir="auto">', said, '</div><time datetime="2024-01-20T10:00:00+00:00"></time></div>')
    return markup.channel_posts(_paged(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", post), "page", ["s_nationkey"]).select("s_nationkey", "channel", "message_id", "text")


@query("SELECT s_nationkey, 'T' || s_suppkey % 5 AS title, min_by(s_name, s_suppkey) AS venue FROM supplier WHERE s_suppkey % 5 > 0 GROUP BY ALL")
def cards_read(spark, d):
    k = F.col("s_suppkey")
    card = _s('<li class="card"><h3> ', F.when(k % 5 > 0, _s("<a>T", k % 5, "</a>")).otherwise(""), "</h3><i>", F.col("s_name"), "</i></li>")
    pages = _paged(t(spark, d, "supplier"), "s_nationkey", "s_suppkey", card)
    return markup.cards(pages, "page", ["s_nationkey"], '<li class="card">', {"title": ["<h2>(.*?)</h2>", "<h3>(.*?)</h3>"], "venue": ["<i>(.*?)</i>"]}, "title").select("s_nationkey", "title", "venue")


@query("""
WITH r AS (SELECT s_nationkey, s_suppkey % 3 AS d, 'T' || s_suppkey % 5 AS title, s_name, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 5 ORDER BY s_suppkey % 3, s_suppkey) AS rn FROM supplier)
SELECT s_nationkey, 'Day ' || d AS day, title, s_name AS venue FROM r WHERE rn = 1
""")
def days_read(spark, d):
    k = F.col("s_suppkey")
    s = t(spark, d, "supplier").withColumn("d", k % 3)
    item = _s("<li><b>T", k % 5, "</b><i>", F.col("s_name"), "</i></li>")
    parts = s.groupBy("s_nationkey", "d").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("o"), item.alias("p")))), lambda x: x["p"]), "").alias("items"))
    pages = _paged(parts, "s_nationkey", "d", _s("<h2>Day ", F.col("d"), "</h2>", F.col("items")))
    return markup.day_grouped(pages, "page", ["s_nationkey"], "<h2>(.*?)</h2>", "<li>", {"title": ["<b>(.*?)</b>"], "venue": ["<i>(.*?)</i>"]}, "title").select("s_nationkey", "day", "title", "venue")


@query(r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1, 'is') AS h, regexp_extract_all(html, '<a\s[^>]*href="[^"]*"[^>]*>([^<]*)</a>', 1, 'is') AS x FROM pages)
SELECT page_id, CAST(i AS INTEGER) AS pos, h[i + 1] AS href, trim(x[i + 1]) AS text FROM a, range(len(h)) r(i)
""")
def links_read(spark, d):
    return markup.page_links(t(spark, d, "pages"), "html", ["page_id"])


@query(r"""
SELECT page_id, coalesce(trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages
""")
def titles_read(spark, d):
    return t(spark, d, "pages").select("page_id", markup.title_text(F.col("html")).alias("title"))


@query("""
SELECT p_partkey, p_name AS name, round(p_retailprice, 2) AS price_min, CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) + 10 END AS price_max, 'EUR' AS currency,
  'https://x.test/' || p_partkey AS ticket_url, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS performers FROM part WHERE p_partkey % 5 > 0
""")
def linked_read(spark, d):
    k, price = F.col("p_partkey"), F.round("p_retailprice", 2)
    offer = lambda p: F.struct(p.alias("price"), F.lit("eur").alias("priceCurrency"), _s("https://x.test/", k).alias("url"))
    offers = F.when(k % 3 == 0, F.array(offer(price), offer(price + 10))).otherwise(F.array(offer(price)))
    who = F.when(k % 2 == 0, F.array(F.struct(F.col("p_brand").alias("name"))))
    node = F.struct(F.when(k % 5 > 0, "MusicEvent").otherwise("Place").alias("@type"), F.col("p_name").alias("name"), offers.alias("offers"), who.alias("performer"))
    page = _s('<html><script type="application/ld+json">', F.to_json(F.struct(F.array(node).alias("@graph"))), "</script></html>")
    out = markup.linked_data(t(spark, d, "part").select("p_partkey", page.alias("page")), "page", ["p_partkey"])
    return out.select("p_partkey", "name", F.round("price_min", 2).alias("price_min"), F.round("price_max", 2).alias("price_max"), "currency", "ticket_url", F.array_join("performers", ",").alias("performers"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name || ' & more' END AS title FROM part")
def open_graph_read(spark, d):
    k = F.col("p_partkey")
    head = F.when(k % 3 > 0, _s('<meta property="og:title" content="', F.col("p_name"), ' &#38; more">')).otherwise('<meta property="og:type" content="x">')
    return t(spark, d, "part").select("p_partkey", markup.open_graph(head, "title").alias("title"))


@query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS name, 'disused:shop' || CASE WHEN s_suppkey % 2 = 0 THEN ', abandoned:bar' ELSE '' END AS reason FROM supplier WHERE s_suppkey % 3 = 0
""")
def closed_read(spark, d):
    k = F.col("s_suppkey")
    tags = F.array(
        F.struct(F.when(k % 4 > 0, "name").alias("k"), F.col("s_name").alias("v")),
        F.struct(F.when(k % 3 == 0, "disused:shop").otherwise("shop").alias("k"), F.lit("yes").alias("v")),
        F.struct(F.when((k % 3 == 0) & (k % 2 == 0), "abandoned:bar").alias("k"), F.lit("yes").alias("v")),
    )
    made = t(spark, d, "supplier").select(k.alias("id"), F.map_from_entries(F.filter(tags, lambda x: x["k"].isNotNull())).alias("tags"))
    return feeds.closed_elements(made)


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'https://w.test/' || n_name || '/x' END AS site, CASE WHEN n_nationkey % 3 = 0 THEN '@' || n_name END AS handle FROM nation")
def claims_read(spark, d):
    k, name = F.col("n_nationkey"), F.array("n_name", F.lit("other"))
    pairs = F.array(F.struct(F.when(k % 2 == 0, "P1").alias("k"), name.alias("v")), F.struct(F.when(k % 3 == 0, "P2").alias("k"), name.alias("v")))
    made = t(spark, d, "nation").select("n_nationkey", F.map_from_entries(F.filter(pairs, lambda x: x["k"].isNotNull())).alias("claims"))
    return feeds.claims(made, "n_nationkey", {"P1": ("site", "https://w.test/{}/x"), "P2": ("handle", "@{}")})


# --- addresses and words ---------------------------------------------------------------------------------------------

LINKS = ["https://www.piletilevi.ee/x", "http://fienta.com/a", "https://club.test/a/b", "", None, "https://ra.co/events/1"]
HANDLES = ["@club", "/club", "club", "https://x.test/club", " ", None]
PHOTOS = ["https://lh3.googleusercontent.com/p/a=s1600-w400", "https://lh3.googleusercontent.com/p/a", "https://x.test/a=s16", None]
WAITS = ["try again in 20s", "retry after 1.5 s please", "no", None]


@query(f"""
SELECT s_suppkey, {one_of_sql("s_suppkey", ["The ticketing listing", "The ticketing listing", "The venue's own page", "Filed by our own desk", "Filed by our own desk", "The ticketing listing"])} AS origin,
  {one_of_sql("s_suppkey", ["https://f.test/club", "https://f.test/club", "https://f.test/club", "https://x.test/club", None, None])} AS social,
  {one_of_sql("s_suppkey", ["https://lh3.googleusercontent.com/p/a=w90", "https://lh3.googleusercontent.com/p/a", "https://x.test/a=s16", None])} AS photo,
  CAST({one_of_sql("s_suppkey", ["22", "4", "16", "16"])} AS BIGINT) AS wait FROM supplier
""")
def addresses(spark, d):
    k = F.col("s_suppkey")
    return t(spark, d, "supplier").select(
        "s_suppkey", web.provenance(one_of(k, LINKS)).alias("origin"), web.social_url(one_of(k, HANDLES), "https://f.test/").alias("social"), web.sized_photo(one_of(k, PHOTOS), 90).alias("photo"), text.retry_seconds(one_of(k, WAITS)).cast("long").alias("wait")
    )


@query(f"""
SELECT event_id, CASE WHEN n <= 0 THEN 'today' WHEN n = 1 THEN 'yesterday' ELSE n || ' days ago' END AS ago,
  CASE WHEN event_id % 13 > 10 THEN CAST(event_id % 13 AS VARCHAR) ELSE list_extract(['None', 'One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten'], event_id % 13 + 1) END AS word
FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), DATE '{AS_OF[:10]}') AS n FROM events)
""")
def words(spark, d):
    return t(spark, d, "events").select("event_id", text.ago(F.col("ts"), now()).alias("ago"), text.number_word(F.col("event_id") % 13).alias("word"))


@query("SELECT lower(split_part(p_name, ' ', 1)) AS key, min_by(split_part(p_name, ' ', 1), p_partkey) AS name FROM part GROUP BY 1")
def first_spelling(spark, d):
    return facets.first_spelling(t(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), "p_partkey"), "name", "p_partkey")


# --- state changes ---------------------------------------------------------------------------------------------------


@query(f"""
SELECT event_id AS id, user_id, 'in_progress' AS status FROM (SELECT *, CASE event_type WHEN 'click' THEN 'done' WHEN 'view' THEN 'in_progress' ELSE 'new' END AS s FROM events)
WHERE s = 'new' OR (s = 'in_progress' AND ts < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE) ORDER BY s <> 'new', event_id LIMIT 1
""")
def claimed(spark, d):
    status = F.when(F.col("event_type") == "click", "done").when(F.col("event_type") == "view", "in_progress").otherwise("new")
    q = t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", status.alias("status"), F.col("ts").alias("claimed_at"))
    return lifecycle.claim(q, now()).select("id", "user_id", "status")


@query(f"""
SELECT event_id AS id, ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY AS over, NOT (ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY OR ts < TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR) AND event_id % 2 = 0 AS tonight,
  CASE WHEN ts < TIMESTAMP '{AS_OF}' - INTERVAL 2 DAY THEN 'expired' END AS archive_reason FROM events
""")
def expired(spark, d):
    made = t(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.timestamp_add("DAY", F.lit(2), F.col("ts")).alias("valid_until"), (F.col("event_id") % 2 == 0).alias("tonight"), F.lit(None).cast("timestamp_ntz").alias("archived_at"), F.lit(None).cast("string").alias("archive_reason"))
    return lifecycle.expire(made, now()).select("id", F.col("archived_at").isNotNull().alias("over"), "tonight", "archive_reason")


@query("SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS hit FROM orders")
def cascaded(spark, d):
    """Orders of closed customers; all but those with status F were archived before."""
    before = F.when(F.col("o_orderstatus") != "F", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    made = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("c_custkey"), before.alias("archived_at"), F.lit(None).cast("string").alias("archive_reason"))
    out = lifecycle.cascade(made, t(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), ["c_custkey"], now())
    return out.select("o_orderkey", F.coalesce(F.col("archive_reason") == "venue closed", F.lit(False)).alias("hit"))


@query("SELECT n_regionkey AS city, n_name AS name FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_regionkey, lower(n_name) FROM nation WHERE n_nationkey % 2 > 0")
def got_or_created(spark, d):
    n = t(spark, d, "nation")
    wanted = n.select(F.col("n_regionkey").alias("city"), F.lower("n_name").alias("name"))
    return upsert.get_or_create(n.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("city"), F.col("n_name").alias("name")), wanted.unionAll(wanted), "city", "name")


@query("SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_name ELSE p_name || ' — Pending review' END AS title, p_size <= 25 AS pending_review FROM part")
def reviewed(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), _s(F.col("p_name"), " — Pending review").alias("title"), F.lit(True).alias("pending_review"), "p_size")
    return editing.approved(p, p.where("p_size > 25")).drop("p_size")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 > 0")
def opted_out(spark, d):
    """Of tokens made of customer ids every third is given back; wrong ones change nothing."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.format_string("00000000-0000-0000-0000-%012d", "c_custkey").alias("id"))
    tokens = c.select(F.when(F.col("n") % 3 == 0, F.upper("id")).otherwise(F.substring("id", 2, 35)).alias("token"))
    return editing.opt_out(c, tokens)[0].select(F.col("n").alias("id"))


@query("""
WITH r AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT id, rn > 1 AS archived FROM r
""")
def dedup_listing(spark, d):
    """Orders as listings: a customer's orders of one priority are copies of one listing."""
    o = t(spark, d, "orders")
    picks = o.select(F.col("o_orderkey").alias("id"), F.lit("c").alias("city"), F.col("o_custkey").cast("string").alias("venue"), F.col("o_orderpriority").alias("title"), F.lit("").alias("day"), F.lit("").alias("time"), F.when(F.col("o_orderstatus") == "F", "x").alias("image_url"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("archived_at"), F.lit(None).cast("string").alias("archive_reason"))
    out = catalogue.dedup_active(picks, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("pick_id")), now())
    return out.select("id", F.col("archived_at").isNotNull().alias("archived"))


# --- composites ------------------------------------------------------------------------------------------------------


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'Road ' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ' ' || s_suppkey ELSE '' END || ', 10111 Town' ELSE 'A, B, C' END AS address FROM supplier
""")
def addresses_made(spark, d):
    k = F.col("s_suppkey")
    parts = F.struct(F.when(k % 3 > 0, _s("Road ", F.col("s_nationkey"))).alias("road"), F.when(k % 2 == 0, k.cast("string")).alias("number"), F.lit("10111").alias("postcode"), F.lit("Town").alias("city"))
    return t(spark, d, "supplier").select("s_suppkey", text.address(parts, F.lit("A, B,C, D")).alias("address"))


@query("SELECT l_orderkey, bool_or(l_discount = 0) AS free, first(l_partkey ORDER BY l_linenumber, l_discount = 0, l_partkey) FILTER (WHERE l_returnflag = 'R') AS part FROM lineitem GROUP BY 1")
def nested_offers(spark, d):
    """An order's lines as nested offers: is any free, and the first returned one's part."""
    line = F.struct("l_linenumber", (F.col("l_discount") == 0).alias("is_free"), F.col("l_returnflag").alias("type"), "l_partkey")
    made = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("offers"))
    return made.select("l_orderkey", feeds.any_free(F.col("offers")).alias("free"), feeds.nested_of_type(F.col("offers"), "R", "l_partkey").alias("part"))


@query("""
WITH g AS (SELECT split_part(p_type, ' ', 1) AS city, p_brand AS venue, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS ids FROM part WHERE p_size > 10 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY venue) AS turn FROM g)
SELECT city, venue, ids FROM r ORDER BY turn, city LIMIT 12
""")
def geocode_turns(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("city"), F.col("p_brand").alias("venue"), F.lit("x").alias("neighborhood"), F.when(F.col("p_size") <= 10, 1.0).alias("lat"), F.lit(None).cast("timestamp").alias("archived_at"))
    return catalogue.geocode_queue(p, now(), 12).select("city", "venue", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'tags: disused:shop' ELSE 'name: ' || upper(c_name) END AS why, CASE WHEN c_custkey % 4 = 0 THEN 'id' ELSE 'name' END AS reason FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 6 = 3
""")
def closures_found(spark, d):
    """Every fourth customer is closed by id, some others by a name written otherwise."""
    k = F.col("c_custkey")
    c = t(spark, d, "customer")
    venues = c.select("c_custkey", k.alias("osm_id"), F.col("c_name").alias("name"))
    by_id = c.where(k % 4 == 0).select(k.alias("id"), F.lit(None).cast("string").alias("name"), F.lit("disused:shop").alias("reason"))
    by_name = c.where(k % 6 == 3).select((-k).alias("id"), F.upper("c_name").alias("name"), F.lit("x").alias("reason"))
    return catalogue.closures(venues, by_id.unionByName(by_name)).select("c_custkey", "why", "reason")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, o_orderdate FROM orders)
SELECT k AS pick_id, CASE m WHEN 3 THEN 'past' ELSE 'pick' END AS title, CASE WHEN m = 3 OR m = 1 THEN 'gone' WHEN m = 2 THEN 'anytime' WHEN CAST(o_orderdate AS DATE) >= DATE '1997-01-01' THEN 'dated' ELSE 'gone' END AS bucket FROM o
""")
def saved_read(spark, d):
    """Orders as saved ids: dated ones, archived ones, ones without a day, and ones only the past list knows."""
    o, m = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("at")), F.col("id") % 4
    picks = o.where(m < 3).select("id", F.lit("pick").alias("title"), F.when(m == 1, F.col("at")).alias("archived_at"), F.when(m != 2, F.timestamp_add("HOUR", F.lit(12), "at")).alias("starts_at"), F.lit(None).cast("string").alias("day"))
    venues = o.where("false").select("id", F.lit("v").alias("name"))
    past = o.where(m == 3).select("id", F.lit("past").alias("title"))
    return catalogue.saved_buckets(o.select(F.col("id").alias("pick_id")), picks, venues, past, F.lit("1997-01-01").cast("date")).select("pick_id", "title", "bucket")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '1-URGENT' UNION ALL SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'possibly_closed' ELSE o_orderstatus END FROM orders WHERE o_orderpriority = '1-URGENT'")
def venues_aged(spark, d):
    """Urgent open orders as venues not seen for a quarter."""
    seen = F.when(F.col("o_orderpriority") == "1-URGENT", F.timestamp_add("DAY", F.lit(-91), now())).otherwise(F.timestamp_add("DAY", F.lit(-89), now()))
    made = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise(F.col("o_orderstatus")).alias("status"), seen.alias("last_seen_at"))
    out = lifecycle.close_absent_venues(made, now())
    return out.select("id", F.when(F.col("status") == "active", "O").otherwise(F.col("status")).alias("status"))
