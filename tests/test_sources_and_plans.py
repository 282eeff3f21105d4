from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell import schemas
from tidewell.plans import bindings, catalogue, parsed
from tidewell.sources import feeds, markup
from tidewell.streaming import queue

NOW = TODAY = None


@pytest.fixture(autouse=True)
def present(spark):
    """The present; columns need a session."""
    global NOW, TODAY
    NOW = F.lit("2026-06-19 12:00:00").cast("timestamp")
    TODAY = F.to_date(NOW)


def page(spark, html):
    return spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")


def test_feeds_of_items_and_entries(spark):
    xml = """<rss><item><title>A &amp; b</title><description><![CDATA[<p>Text</p>]]></description><pubDate>Fri, 19 Jun 2026 10:00:00 GMT</pubDate><link>https://x/1</link><category>News</category></item>
    <item><title>No date</title></item></rss><entry><title>E</title><content>c</content><updated>2026-06-19T10:00:00Z</updated><link href="https://x/2"/></entry>"""
    got = {r.permalink: r for r in markup.feed_items(page(spark, xml), "html", ["id"]).collect()}
    assert set(got) == {"https://x/1", "https://x/2"}
    assert got["https://x/1"].text == "A & b\n\nText" and got["https://x/1"].message_id == got["https://x/2"].message_id == 1781863200
    assert markup.routed(markup.feed_items(page(spark, xml), "html", ["id"]), ["News"]).count() == 1


def test_channel_pages(spark):
    html = '<div class="wrap" data-post="ch/42"><div class="x_message_text y" dir="a">Hello<br/>you &amp; me</div><time datetime="2026-06-19T10:00:00+00:00"></time></div><div data-post="ch/43"><img></div>'
    got = markup.channel_posts(page(spark, html), "html", ["id"]).collect()
    assert [(r.channel, r.message_id, r.text, r.posted_at) for r in got] == [("ch", 42, "Hello\nyou & me", datetime(2026, 6, 19, 10))]


def test_listing_cards_and_days(spark):
    html = '<x><div class="card"><a href="/e/one">1</a><b>First</b><i>24.06.2026</i></div><div class="card"><a href="/e/one">1</a><b>Again</b></div><div class="card">none</div><div class="card"><a href="/e/two"></a><i>x</i></div>'
    fields = {"slug": [r'href="/e/([^"]+)"'], "title": [r"<b>(.*?)</b>", r'href="/e/([^"]+)"'], "date": [r"(\d{2}\.\d{2}\.\d{4})"]}
    got = markup.cards(page(spark, html), "html", ["id"], '<div class="card">', fields, "slug").orderBy("pos").collect()
    assert [(r.slug, r.title, r.date) for r in got] == [("one", "First", "24.06.2026"), ("two", "two", None)]
    days = '<p class="day">Fri 19.6.</p><div class="m"><a id="7"></a>20:00</div><div class="m"><a id="8"></a></div><p class="day">Sat 20.6.</p><div class="m"><a id="7"></a>21:00</div><div class="m"><a id="9"></a></div>'
    got = markup.day_grouped(page(spark, days), "html", ["id"], r'<p class="day">([^<]*)</p>', '<div class="m">', {"key": ['id="(\\d+)"'], "clock": [r"(\d{1,2}:\d{2})"]}, "key").orderBy("key").collect()
    assert [(r.key, r.day, r.clock) for r in got] == [("7", "Fri 19.6.", "20:00"), ("8", "Fri 19.6.", None), ("9", "Sat 20.6.", None)]


def test_linked_data(spark):
    html = """<script type="application/ld+json">{"@type":"WebPage"}</script><script type='application/ld+json'>{"@graph":[{"@type":"Place"},{"@type":["MusicEvent"],"name":"N","description":"<p>D</p>","startDate":"2026-06-19T18:00:00Z",
    "offers":[{"price":"5","priceCurrency":"eur","url":"https://t/1"},{"price":20}],"performer":["Ann",{"name":"Bob"}]}]}</script>"""
    got = markup.linked_data(page(spark, html), "html", ["id"]).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.name, r.description, r.starts_at, r.price_min, r.price_max, r.is_free, r.currency, r.ticket_url, r.performers) == ("N", "D", datetime(2026, 6, 19, 18), 5.0, 20.0, False, "EUR", "https://t/1", ["Ann", "Bob"])
    free = """<script type="application/ld+json">[{"@type":"Event","offers":{"price":0},"url":"/rel"}]</script>"""
    r = markup.linked_data(page(spark, free), "html", ["id"]).first()
    assert (r.price_min, r.price_max, r.is_free, r.ticket_url, r.performers) == (0.0, None, True, "/rel", [])
    assert markup.linked_data(page(spark, "<script type=\"application/ld+json\">{bad</script>"), "html", ["id"]).count() == 0


def test_json_sources(spark):
    e = spark.createDataFrame([("1", "T", "2026-06-19 20:00:00", None, None), ("2", "T", "2026-06-10 20:00:00", None, None), ("3", "T", "2026-06-20 20:00:00", "2027-06-20 20:00:00", None), ("4", "T", "2026-06-20 20:00:00", None, "cancelled"), ("5", None, "2026-06-20 20:00:00", None, None), ("6", "T", "soon", None, None)], "id string, title string, starts_at string, ends_at string, event_status string")
    assert [(r.id, r.starts_at) for r in feeds.ticket_events(e, NOW).collect()] == [("1", datetime(2026, 6, 19, 18))]
    loc = "struct<en:string,fi:string,sv:string>"
    o = spark.createDataFrame(
        [(1, "EventCancelled", None, ("a", None, None), None), (2, None, "Course", ("a", None, None), None), (3, None, None, (None, " ", None), None), (4, "EventScheduled", "General", (None, "f", None), (("Zoo", None, None),)), (5, "", None, ("bingo night", None, None), None), (6, None, None, (None, None, "s"), None)],
        f"id int, event_status string, type_id string, name {loc}, location struct<name:{loc}>",
    ).withColumns({"short_description": F.lit(None).cast(loc), "description": F.lit(None).cast(loc)})
    why = feeds.skip_reason(o, ["zoo"], ["bingo"])
    assert [r[0] for r in o.orderBy("id").select(why).collect()] == ["status:EventCancelled", "type:Course", "no-name", "venue:zoo", "pattern:bingo", None]
    assert feeds.reason_tally(o, why).count() == 5
    m = spark.createDataFrame([(7, 1.0, 2.0, None, {"name": "Õlu", "amenity": "pub", "contact:facebook": "@olu"}), (8, None, None, (3.0, 4.0), {"name": "X", "name:en": "Y", "shop": "books"}), (9, 1.0, 2.0, None, {"name": "Z"}), (10, None, None, None, {"name": "Q", "shop": "books", "disused:shop": "yes"})], "id long, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>")
    got = {r.id: r for r in feeds.map_places(m, "t").collect()}
    assert set(got) == {"olu-7", "y-8"} and got["olu-7"].facebook == "https://www.facebook.com/olu" and got["y-8"].lat == 3.0
    assert [(r.id, r.reason) for r in feeds.closed_elements(m).collect()] == [(10, "disused:shop")]
    k = spark.createDataFrame([("a", {"P1": ["x", "y"]}), ("b", {})], "id string, claims map<string,array<string>>")
    assert {r.id: r.site for r in feeds.claims(k, "id", {"P1": ("site", "https://s/{}")}).collect()} == {"a": "https://s/x", "b": None}
    cfg = spark.createDataFrame([("a", "1"), ("z", "9")], "key string, value string")
    assert feeds.with_defaults(cfg, {"a": "0", "b": "2"}) == {"a": "1", "b": "2"}
    assert feeds.read_table(spark, "/nowhere/at/all", schemas.PICKS).count() == 0


def picks(spark, rows):
    """Picks from dicts."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schemas.PICKS) for r in rows], schemas.PICKS)


def test_catalogue_and_main_list(spark):
    p = picks(spark, [
        {"id": "1", "city": "t", "title": "Gig", "venue": "Hall", "kind": "gig", "day": "Fri", "time": "20:00", "price_min": Decimal(0)},
        {"id": "2", "city": "t", "title": "Film", "venue": " hall ", "kind": "film", "day": "Tonight", "time": "19:00", "lat": 59.45, "lng": 24.75},
        {"id": "3", "city": "t", "title": "Bar", "venue": "Pub", "kind": "bar"},
        {"id": "4", "city": "t", "title": "Found", "venue": "Hall", "kind": "gig", "day": "Fri", "handle": "@discovery"},
        {"id": "5", "city": "t", "title": "Later", "venue": "Gone", "kind": "gig", "day": "Thu"},
        {"id": "6", "city": "r", "title": "Far", "venue": "Hall", "kind": "gig", "day": "Fri"},
    ])
    v = spark.createDataFrame([("v1", "t", "Hall", "club", 59.43, 24.75, "active"), ("v2", "t", "Gone", "club", None, None, "closed")], "id string, city string, name string, kind string, lat double, lng double, status string")
    shown, venues = catalogue.assembled(p, v, "t", NOW)
    shown = shown.cache()
    got = {r.id: r for r in shown.collect()}
    assert set(got) == {"1", "2", "5"} and got["1"].lat == 59.43 and got["2"].lat == 59.45 and got["5"].is_closed and not got["1"].is_closed
    assert got["1"].date == got["2"].date == date(2026, 6, 19) and got["5"].date == date(2026, 6, 25) and got["1"].thumb_initials == "HA"
    assert venues.count() == 2
    chain = catalogue.filters("tonight", TODAY, F.lit(900))
    assert [r.id for r in catalogue.tonight(shown, chain, (59.43, 24.75)).collect()] == ["2", "1"]
    assert [r.id for r in catalogue.tonight(shown, chain, (59.43, 24.75), nearest=True).collect()] == ["1", "2"]
    free = catalogue.filters("thisweek", TODAY, F.lit(900), free=True, doors="19:30", term="GIG")
    assert [r.id for r in catalogue.tonight(shown, free).collect()] == ["1"]
    e, one = catalogue.source_page(p, venue="HALL")
    assert one.first().n == 2 or one.first().n == 3
    ics = "\r\n".join(r.text for r in catalogue.calendar_feed(catalogue.calendar(p, TODAY, "https://s/?id="), "c").collect())
    assert ics.count("BEGIN:VEVENT") == 4 and "DTSTART:20260619T200000\r\nDTEND:20260619T220000" in ics


def test_dedup_keeps_what_people_saved(spark):
    at = datetime(2026, 6, 1)
    p = picks(spark, [{"id": i, "city": "T" if i == "b" else "t", "title": "x", "venue": None, "created_at": at, "image_url": "u" if i == "c" else None} for i in "abc"])
    saved = spark.createDataFrame([("a",), ("a",)], "pick_id string")
    got = {r.id: r.archive_reason for r in catalogue.dedup_active(p, saved, NOW).collect()}
    assert got == {"a": None, "b": "duplicate", "c": "duplicate"}
    again = catalogue.dedup_active(catalogue.dedup_active(p, saved, NOW), saved, NOW)
    assert again.where("archived_at is null").count() == 1


def test_staging_becomes_picks(spark):
    s = spark.createDataFrame(
        [(10, 1, "Ch", 5, "a gig", '{"description":" D ","price_min":5,"starts_at":"bad","entities":[{"name":" A "},{"name":""}]}', "https://x/1"), (11, 1, "Ch", 6, "SALE now", None, None), (12, 2, "Zz", 7, "none", None, "https://t.me/z"), (13, 1, "Ch", 8, "two", "{}", None)],
        "id long, source_id long, channel string, message_id long, text string, payload string, permalink string",
    )
    c = "array<struct<title:string,venue:string,kind:string,neighborhood:string,day:string,time:string,quote:string,thumb_initials:string,mood_tags:array<string>>>"
    full = ("T one", "Hall", "gig", "N", "Tonight", "20:00", "A singular evening of noise", None, ["LOUD", "odd"])
    x = spark.createDataFrame([(10, [full]), (11, [full]), (12, [("T", None, None, None, None, None, None, None, None)]), (13, [full, ("T two", *full[1:])])], f"id long, candidates {c}")
    src = spark.createDataFrame([(1, "@c", "t")], "id long, curator_handle string, city string")
    status, made = catalogue.staged_to_picks(s, x, src, NOW, ["sale"])
    assert {r.id: (r.status, r.rejection) for r in status.collect()} == {10: ("processed", None), 11: ("rejected", "skip_keyword: sale"), 12: ("rejected", "all picks missing required fields"), 13: ("processed", None)}
    got = {r.id: r for r in made.collect()}
    assert set(got) == {"ch-5", "ch-8-t-one", "ch-8-t-two"}
    r = got["ch-5"]
    assert (r.description, float(r.price_min), r.starts_at, r.mood_tags, r.tonight, r.source_url, r.thumb_initials) == ("D", 5.0, None, ["loud"], True, "https://x/1", "HA")
    assert [(e.name, e.role) for e in r.entities] == [("A", "artist")] and r.valid_until == datetime(2026, 6, 21)
    base = picks(spark, [{"id": "ch-5", "description": "old", "currency": "EUR", "title": "o", "archived_at": datetime(2026, 1, 1)}])
    merged = {r.id: r for r in catalogue.merge_picks(base, made).collect()}["ch-5"]
    assert (merged.description, merged.currency, merged.title, merged.archived_at) == ("D", "EUR", "T one", None)


def test_lifecycle_plans(spark):
    old, new = datetime(2026, 5, 1), datetime(2026, 6, 18)
    p = picks(spark, [{"id": "a", "source_message_id": 1, "last_seen_at": old}, {"id": "b", "source_message_id": 2, "last_seen_at": new}, {"id": "c", "source_message_id": 3, "last_seen_at": old}])
    staging = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, source_id long")
    src = spark.createDataFrame([(1, "one", True), (2, "two", False)], "id long, channel string, reconcile_absences boolean")
    report, dry = catalogue.reconcile(p, staging, src, NOW)
    assert [(r.source, r.absent, r.ids) for r in report.collect()] == [("one", 1, ["a"])] and dry.where("archived_at is not null").count() == 0
    done = catalogue.reconcile(p, staging, src, NOW, enforce=True)[1]
    assert [r.id for r in done.where("archived_at is not null").collect()] == ["a"]
    log = spark.createDataFrame([(i, fn, "ok", 0, d, datetime(2026, 6, 10 + i % 5)) for i, (fn, d) in enumerate([("ingest-a", None)] * 3 + [("ingest-b", '{"skipped":4}')] * 3 + [("ingest-health", None)] * 3)], "id int, fn string, status string, inserted int, detail string, finished_at timestamp")
    assert sorted(r.fn for r in catalogue.ingest_health(log, NOW).collect()) == ["ingest-a", "ingest-health"]
    assert [r.fn for r in catalogue.ingest_health(log, NOW, exclude_self=True).collect()] == ["ingest-a"]
    g = picks(spark, [{"id": str(i), "city": c, "venue": v} for i, (c, v) in enumerate([("A", "x"), ("A", "y"), ("A", "z"), ("B", "w"), ("A", "TBA"), ("A", "x")])])
    got = catalogue.geocode_queue(g, NOW, 3).collect()
    assert [(r.city, r.venue, r.ids) for r in got] == [("A", "x", ["0", "5"]), ("B", "w", ["3"]), ("A", "y", ["1"])]
    v = spark.createDataFrame([("v1", 7, "Hall"), ("v2", None, "Põhja"), ("v3", 9, "Open")], "id string, osm_id long, name string")
    el = spark.createDataFrame([(7, "Other", "disused:shop"), (1, "pohja", "abandoned:x")], "id long, name string, reason string")
    assert {r.id: r.why for r in catalogue.closures(v, el).collect()} == {"v1": "tags: disused:shop", "v2": "name: pohja"}
    links = picks(spark, [{"id": "p", "entities": [("Ann", "artist"), ("Bob", "artist")]}])
    hub = spark.createDataFrame([("bob", 95, "Bob", ["https://open.spotify.com/b", "https://x.bandcamp.com"]), ("ann", 100, "ANN", ["https://spotify.com/a"]), ("ann", 80, "Ann", ["https://imdb.com/a"])], "name string, score int, found_name string, links array<string>")
    assert catalogue.resolved_links(links, hub).first().links == {"spotify": "https://spotify.com/a", "bandcamp": "https://x.bandcamp.com"}


def test_people_plans(spark):
    p = picks(spark, [{"id": "a", "title": "A", "day": "Fri", "venue": "V"}, {"id": "b", "title": "B"}, {"id": "c", "title": "C", "archived_at": datetime(2026, 1, 1)}])
    saved = spark.createDataFrame([("a",), ("b",), ("c",), ("v",), ("o",), ("?",)], "pick_id string")
    v = spark.createDataFrame([("v", "Venue")], "id string, name string")
    past = spark.createDataFrame([("o", "Old")], "id string, title string")
    got = {r.pick_id: (r.bucket, r.title) for r in catalogue.saved_buckets(saved, p, v, past, TODAY).collect()}
    assert got == {"a": ("dated", "A"), "b": ("anytime", "B"), "c": ("gone", "C"), "v": ("anytime", "Venue"), "o": ("gone", "Old"), "?": ("gone", None)}
    changes = spark.createDataFrame([(1, "a", "Thu", "Fri", datetime(2026, 6, 18)), (2, "a", "Fri", "Sat", datetime(2026, 6, 19)), (3, "b", "x", "y", datetime(2026, 1, 1))], "id long, pick_id string, old_day string, new_day string, changed_at timestamp")
    d = catalogue.digest(spark.createDataFrame([("u", "e@x")], "user_id string, email string"), spark.createDataFrame([("u", "a"), ("u", "b")], "user_id string, pick_id string"), changes, p, F.timestamp_add("DAY", F.lit(-7), NOW)).collect()
    assert [(r.pick_id, r.new_day, r.title) for r in d] == [("a", "Sat", "A")]
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "pick_id string, embedding array<double>")
    h = catalogue.hybrid(p.withColumn("city", F.lit("t")), emb, "b", F.array(F.lit(1.0), F.lit(0.0)), "t").collect()
    assert {r.id for r in h} == {"a", "b"} and h[0].id == "b"
    places = spark.createDataFrame([("1", "t", "Vinyl shop", "records", "record store", 0.9), ("2", "t", "Bakery", "food", "cafe", 0.9)], "id string, city string, name string, category string, kind string, confidence double")
    got = catalogue.discover(places, spark.createDataFrame([("t", "vinyl SHOP ")], "city string, name string"), "vinyl")
    assert [(r.id, r.known) for r in got.collect()] == [("1", True)]


def test_streams(spark, tmp_path):
    rows = [(i % 40, i % 3, datetime(2026, 6, 1, i % 24), 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: queue.read_files(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    queue.run_once(queue.deduplicated(stream(), ["event_id"], "ts", "2 days"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    queue.upsert_batches(stream(), str(tmp_path / "state"), ["user_id"], [F.desc("ts"), F.desc("event_id")], str(tmp_path / "c2"))
    last = {r.user_id: r.ts for r in spark.read.parquet(str(tmp_path / "state" / "2")).collect()}
    assert set(last) == {0, 1, 2}
    marks = spark.createDataFrame([(0, 20), (1, 99)], "user_id long, mark long")
    fresh, new = queue.newer_than(df, "user_id", "event_id", marks)
    assert fresh.where("user_id = 0 and event_id <= 20").count() == 0 and fresh.where("user_id = 1").count() == 0
    assert {r.user_id: r.mark for r in new.collect()} == {0: max(r[0] for r in rows if r[1] == 0), 1: 99, 2: max(r[0] for r in rows if r[1] == 2)}


def test_titles_read_equal_their_sql(spark, tmp_path):
    """Entities that the SQL leaves, signs that look like tags, blanks of all kinds, several titles, none."""
    titles = ["a &quot;b&quot; &#39;c&apos; &nbsp;d", "x <b>y</b> < z", "&amp;lt; &lt;b&gt;", " \t\n a\u00a0 \r\f b\x0b\u2003", "\u00a0\u3000", "\x0bq\u0085", "", "&ampquot;", "a&lt;/title&gt;b"]
    html = [f"<html><title>{x}</title><title>2</title>" for x in titles] + ["<TITLE lang='x'>Up\n\nper</TiTle>", "<title>open", "", None, "<titles>s</title>"]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = sorted(duck.sql(bindings.SQL["titles_read"]).fetchall())
    assert sorted(tuple(r) for r in parsed.titles_read(spark, str(tmp_path)).collect()) == want and len(want) == len(html)
