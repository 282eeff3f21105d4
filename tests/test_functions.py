from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import geo, hours, text, web, when


def values(spark, expr, rows, schema):
    """The expression's value for each row, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[1] for r in df.select("i", expr).orderBy("i").collect()]


def state(spark, filed, day, minutes, holiday=False, before=False):
    df = spark.createDataFrame([(filed,)], "h string").select(hours.parse_hours("h").alias("h"))
    s = hours.state(F.col("h"), F.lit(day), F.lit(minutes), F.lit(holiday), F.lit(before))
    return df.select(s.alias("s"), hours.rail(s).alias("rail"), hours.label(s).alias("label")).first()


@pytest.mark.parametrize(
    ("filed", "day", "minutes", "known", "opened", "closes", "opens", "rail"),
    [
        ("Tu-Sa 12:00-19:00; Su,Mo off", 2, 780, True, True, 1140, None, "→19"),
        ("Tu-Sa 12:00-19:00; Su,Mo off", 2, 600, True, False, None, 720, "SHUT"),
        ("Tu-Sa 12:00-19:00; Su,Mo off", 0, 780, True, False, None, None, "SHUT"),
        ("Fr 20:00-04:00", 5, 90, True, True, 240, None, "→04"),
        ("24/7", 3, 5, True, True, None, None, "24H"),
        ("PH off", 3, 5, False, None, None, None, ""),
        ("Su-PH 10:00-12:00", 6, 620, False, None, None, None, ""),
        ("Mo-Fr 10:00-18:00; SH off", 1, 700, False, None, None, None, ""),
        ("Tu-Fr 15-19", 1, 960, True, True, 1140, None, "→19"),
        ("Mo 9-12, Tu 10-14", 0, 600, False, None, None, None, ""),
        (None, 0, 0, False, None, None, None, ""),
        ('["Monday: 12:00 – 10:00 PM", "Tuesday: Closed"]', 0, 800, True, True, 1320, None, "→22"),
        ("not hours", 0, 0, False, None, None, None, ""),
    ],
)
def test_opening_hours(spark, filed, day, minutes, known, opened, closes, opens, rail):
    r = state(spark, filed, day, minutes)
    assert (r.s.known, r.s.open, r.s.closes_at, r.s.opens_at, r.rail) == (known, opened, closes, opens, rail)


def test_hours_labels_and_holidays(spark):
    assert state(spark, "Tu-Sa 12:00-19:00", 0, 780).label == "Closed for the day"
    assert state(spark, None, 0, 0).label == "Hours not filed"
    assert state(spark, "24/7", 0, 0).label == "Open 24 hours"
    assert state(spark, "Mo 12:00-19:00", 0, 100).label == "Opens 12:00"
    assert state(spark, "Mo 12:00-19:00", 0, 800).label == "Open now · closes 19:00"
    assert state(spark, "Mo-Fr 10:00-18:00; PH off", 0, 700, holiday=True).rail == "SHUT"
    assert state(spark, "Mo-Fr 10:00-18:00", 0, 700, holiday=True).rail == "→18"
    assert state(spark, "Mo 10:00-12:00; PH,Su 12:00-23:00", 2, 800, holiday=True).rail == "→23"


def test_parsed_weeks():
    p = hours.parse_map_hours
    assert [len(d) for d in p("We,Th 12:00-23:00, Fr,Sa 12:00-01:00, Su 12:00-18:00")["week"]] == [0, 0, 1, 1, 1, 1, 1]
    assert [bool(d) for d in p("Mo,We,Fr 09:00-17:00")["week"]] == [True, False, True, False, True, False, False]
    assert p("Mo 10:00-12:00; Mo 14:00-16:00")["week"][0] == [(600, 720), (840, 960)]
    assert p("Mo 10:00-12:00,14:00-16:00")["week"][0] == [(600, 720), (840, 960)]
    assert p("Fr-Mo 10:00-12:00")["week"][1] == [] and p("Fr-Mo 10:00-12:00")["week"][6] == [(600, 720)]
    assert p("10:00-28:00")["week"][4] == [(600, 1680)]
    assert p("Mo 25:61-26:00") is None and p("Xx 10:00-12:00") is None
    assert p("PH off; Mo 10:00-12:00")["ph"] == [] and p("Mo 10:00-12:00")["ph"] is None


def test_listed_weeks(spark):
    raw = ['["Monday: 12:00 – 10:00 PM"]', '["x", "x", "x", "x", "Friday: 8:00 PM – 2:00 AM"]', '["Monday: Open 24 hours"]', '["a: 10-11-12 PM, 1 PM-2 PM, pm", null, 7, "b: 5 pm—5 pm"]', "[", "[]", '["Monday: Closed"]', '["Monday: Closed 1 PM - 2 PM"]', "{}", None]
    got = [None if h is None else [[tuple(s) for s in day] for day in h.week] for h in values(spark, hours.listed_hours(F.col("t")), raw, "t string")]
    none = [[]] * 7
    assert got[0] == [[(720, 1320)], *none[1:]] and got[1][4] == [(1200, 1560)] and got[2][0] == [(0, 1440)]
    assert got[3] == [[(780, 840)], [], [], [(1020, 2460)], *none[4:]] and got[4:] == [None] * 6
    both = [tuple(h) for h in values(spark, hours.parse_hours(F.col("t")), [raw[0], "Mo 10:00-12:00; PH off", " ", None], "t string")]
    assert both[0][1] is None and both[1][0][0][0].open == 600 and both[1][1] == [] and both[2:] == [(None, None)] * 2


def test_holidays(spark):
    days = {(r.country, r.date) for r in hours.holidays(spark, 2026, 2026).collect()}
    assert ("fi", date(2026, 6, 20)) in days and ("fi", date(2026, 6, 19)) in days and ("fi", date(2026, 10, 31)) in days
    assert ("ee", date(2026, 4, 5)) in days and ("lv", date(2026, 4, 6)) in days and ("ee", date(2026, 4, 6)) not in days
    assert spark.range(1).select(when.easter(F.lit(2026))).first()[0] == date(2026, 4, 5)


def test_geo(spark):
    assert values(spark, geo.distance_label(F.col("m")), [550.0, 994.0, 996.0, 1400.0, None], "m double") == ["550 m", "990 m", "1000 m", "1.4 km", None]
    assert values(spark, geo.walk_minutes(F.col("m")), [None, 30.0, 80.0, 1600.0], "m double") == [None, 1, 1, 20]
    assert values(spark, geo.parse_within(F.col("t")), ["20", "99", "100", "abc", "-5", None], "t string") == [1600, 7920, 100, 0, 0, 0]
    assert values(spark, geo.within(F.col("m"), F.lit(100)), [None, 50.0, 150.0], "m double") == [True, True, False]
    assert values(spark, geo.in_box(F.col("a"), F.col("b"), 0, 0, 1, 1), [(None, 0.5), (0.5, 0.5), (2.0, 0.5)], "a double, b double") == [False, True, False]
    d = values(spark, geo.haversine(F.lit(59.437), F.lit(24.7536), F.col("a"), F.col("b")), [(59.437, 24.7536), (60.1699, 24.9384), (None, 1.0)], "a double, b double")
    assert d[0] == 0 and 81_000 < d[1] < 84_000 and d[2] is None
    at = values(spark, geo.map_position(F.col("n"), F.col("a"), F.col("b"), F.lit("s")), [("Kalamaja", None, None), ("x", 59.44, 24.75), (None, None, None)], "n string, a double, b double")
    assert abs(at[0].x - 450) <= 60 and abs(at[0].y - 550) <= 60 and (at[1].x, at[1].y) == (882, 625) and abs(at[2].x - 900) <= 200


def test_calendar(spark):
    fri = F.lit("2026-06-19").cast("date")
    got = values(spark, when.resolve_date(F.col("s"), F.col("d"), fri), [(None, "Fri"), (None, "Thu"), (None, "Tonight"), (None, ""), (None, "xyz"), (datetime(2026, 6, 20, 22, 30), "Mon")], "s timestamp, d string")
    assert got == [date(2026, 6, 19), date(2026, 6, 25), date(2026, 6, 19), None, None, date(2026, 6, 21)]
    for day, want in (("2026-06-21", 1), ("2026-06-20", 2), ("2026-06-17", 3)):
        assert len(spark.range(1).select(when.weekend(F.lit(day).cast("date"))).first()[0]) == want
    stated = values(spark, when.stated_minutes(F.col("s"), F.col("t")), [(None, "open daily"), (None, "00:00"), (datetime(2026, 6, 20, 0, 0), "20:00"), (None, "19.30"), (datetime(2026, 6, 20, 16, 0), None)], "s timestamp, t string")
    assert stated == [None, None, None, 1170, 1140]
    until = values(spark, when.valid_until(F.col("d"), F.lit("2026-01-01 00:00:00").cast("timestamp")), ["Tonight", "Fri", None], "d string")
    assert until == [datetime(2026, 1, 2, 12), datetime(2026, 1, 9), datetime(2026, 4, 1)]
    assert values(spark, when.dotted_date(F.col("t"), F.lit("2026-12-20").cast("date")), ["24.12.", "3.1.", "01.02.2025", "x", "31.02."], "t string") == [date(2026, 12, 24), date(2027, 1, 3), date(2025, 2, 1), None, None]
    assert values(spark, when.month_name_date(F.col("t"), F.lit("2026-12-20").cast("date")), ["24 December", "2. January", "x"], "t string") == [date(2026, 12, 24), date(2027, 1, 2), None]
    assert values(spark, when.offset_timestamp(F.col("t")), ["2026-06-01 10:00:00", "2026-06-01T10:00:00Z", "x", None], "t string") == [datetime(2026, 6, 1, 8), datetime(2026, 6, 1, 10), None, None]
    assert values(spark, when.is_day(F.col("h"), F.lit(6)), [2.5, 12.0, 23.9], "h double") == [False, True, False]
    utc = values(spark, when.local_minutes(F.col("t")), [datetime(2026, 3, 29, 0, 30), datetime(2026, 3, 29, 1, 30), datetime(2026, 10, 25, 0, 30), datetime(2026, 10, 25, 1, 30)], "t timestamp")
    assert utc == [150, 270, 210, 210]  # summer time begins and ends


def test_prices_and_links(spark):
    prices = values(spark, web.parse_price(F.col("t")), ["15 EUR", "10-15 EUR", "Bezmaksas", "no 10 €", "12,50 €", "", "ask", None], "t string")
    assert [(p.is_free, p.price_min, p.price_max, p.currency) for p in prices] == [(False, 15, None, "EUR"), (False, 10, 15, "EUR"), (True, None, None, None), (False, 10, None, "EUR"), (False, 12.5, None, "EUR"), (None,) * 4, (None,) * 4, (None,) * 4]
    labels = values(spark, web.price_label(F.col("f"), F.col("a"), F.col("b"), F.col("c")), [(True, None, None, None), (False, 12.0, None, None), (None, 24.0, 75.0, "EUR"), (None, 12.5, 12.5, "EUR"), (None, None, 3.0, "EUR"), (None, 5.0, None, "SEK")], "f boolean, a double, b double, c string")
    assert labels == ["Free", "12", "€24–75", "€12.50", "", "SEK 5"]
    hosts = values(spark, web.platform(F.col("u")), [f"https://{h}/x" for h in ("open.spotify.com", "x.bandcamp.com", "ra.co", "example.org", "www.youtube.com", "notra.co")] + [None, "no url"], "u string")
    assert hosts == ["spotify", "bandcamp", "residentadvisor", None, "youtube", None, None, None]
    assert values(spark, web.safe_url(F.col("u")), ["https://a", "/rel", "javascript:x", "//evil", None], "u string") == ["https://a", "/rel", "", "", ""]
    assert values(spark, web.social_url(F.col("u"), "https://i/"), ["@a", "/a", "http://x/a", " ", None], "u string") == ["https://i/a", "https://i/a", "http://x/a", None, None]


def test_text(spark):
    assert values(spark, text.slug(F.col("t")), ["Speksijuhannus Midsummer Festival", "--A b--", None], "t string") == ["speksijuhannus-midsummer-festi", "a-b", ""]
    assert values(spark, text.slug_folded(F.col("t")), ["Põhja Õlu"], "t string") == ["pohja-olu"]
    said = values(spark, text.says_something(F.col("t"), F.col("title")), [("Jazz music and wine", "Jazz at Veino"), ("short text", "x"), ("n/a", "x"), ("Джаз и вино сегодня вечером", "x"), ("Jazz at Veino tonight", "Jazz at Veino tonight"), (None, None)], "t string, title string")
    assert said == ["Jazz music and wine", "", "", "", "", ""]
    assert values(spark, text.is_generic_venue(F.col("v")), ["TBA...", " Various venues ", "Hall", None], "v string") == [True, True, False, True]
    assert values(spark, text.initials(F.col("v")), ["Big hall", "Bar", "", None], "v string") == ["BH", "BA", "??", "??"]
    assert values(spark, text.mark(F.col("k")), ["Vinyl", "gig", "moon", None], "k string") == ["records", "gig", "place", "place"]
    assert values(spark, text.kinds_of_prompt(F.col("p")), ["vinyl and books", None], "p string") == [["record store", "bookshop"], []]
    assert values(spark, text.strip_tags(F.col("h")), ["<p>a&nbsp;&amp; b</p>\n<b>c</b>", None, "&amp;lt;"], "h string") == ["a & b c", "", "&lt;"]
    assert values(spark, text.unescape_html(F.col("h")), ["&#233;&eacute;", None], "h string") == ["éé", None]
    assert values(spark, text.trigram_similarity(F.col("a"), F.col("b")), [("word", "word"), ("word", "two words"), ("", "")], "a string, b string") == [1.0, pytest.approx(4 / 11), 0.0]
    assert values(spark, text.escape_ics(F.col("t")), ["a,b;c\\d\ne"], "t string") == ["a\\,b\\;c\\\\d\\ne"]
    assert values(spark, text.escape_html(F.col("t")), ["<a href=\"x\">&'"], "t string") == ["&lt;a href=&quot;x&quot;&gt;&amp;&#39;"]
    assert values(spark, text.retry_seconds(F.col("t")), ["retry in 7.2s", "later", None], "t string") == [10, 16, 16]
    js = values(spark, text.tolerant_json(F.col("t")).cast("string"), ['{"a":1}', '```json\n{"a":1}\n```', 'see {"a":1} ok', "none"], "t string")
    assert js == ['{"a":1}'] * 3 + [None]
    tags = spark.createDataFrame([({"amenity": "pub"},), ({"shop": "x"},)], T.StructType([T.StructField("t", T.MapType(T.StringType(), T.StringType()))]))
    assert [r[0] for r in tags.select(text.kind_of_tags(F.col("t"))).collect()] == ["bar", None]
    assert values(spark, text.truncated(F.col("t"), 5), ["abcdef", "abc"], "t string") == ["abcd…", "abc"]
    assert values(spark, text.first_keyword(F.col("t"), ["B", "a"]), ["xab", "A", "z", None], "t string") == ["B", "a", None, None]


def test_hashes(spark):
    # Published examples of the two functions.
    assert values(spark, text.cyrb53(F.col("t")), ["a", "b", "revenge", "revenue", None], "t string") == [7929297801672961, 8684336938537663, 4051478007546757, 8309097637345594, None]
    assert values(spark, text.fnv53(F.col("t")), ["", "a"], "t string") == [0xCBF29CE484222325 & (2**53 - 1), 0xAF63DC4C8601EC8C & (2**53 - 1)]
