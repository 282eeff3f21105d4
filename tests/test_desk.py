"""Flags, merges, finds, letters and words of the editors' desk: odd inputs, on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text, when
from tidewell.operators import match, upsert
from tidewell.plans import catalogue, editing
from tidewell.schemas import INGEST_LOG, PICKS, PLACES_INDEX
from tidewell.sources import markup


def rows_of(spark, schema, *rows):
    return spark.createDataFrame([tuple(r.get(f) for f in schema.names) for r in rows], schema)


@pytest.mark.parametrize(
    ("minutes", "spoken", "rounded", "short"),
    [
        (-1, "", "", ""), (0, "today", "0 minutes ago", "0 min ago"), (1, "today", "1 minute ago", "1 min ago"), (59.5, "today", "1 hour ago", "1 hr ago"), (89, "today", "1 hour ago", "1 hr ago"),
        (90, "today", "2 hours ago", "2 hr ago"), (1439, "today", "1 day ago", "1 d ago"), (1440, "yesterday", "1 day ago", "1 d ago"), (13.5 * 1440, "13 days ago", "14 days ago", "14 d ago"),
        (17 * 1440, "2 weeks ago", "17 days ago", "17 d ago"), (18 * 1440, "3 weeks ago", "18 days ago", "18 d ago"), (75 * 1440, "3 months ago", "75 days ago", "75 d ago"), (None, "", "", ""),
    ],
)
def test_ages(spark, minutes, spoken, rounded, short):
    at = datetime.datetime(2024, 5, 1, 12)
    then = None if minutes is None else at - datetime.timedelta(minutes=minutes)
    df = spark.createDataFrame([(then, at)], "then timestamp, at timestamp")
    c = F.col("then"), F.col("at")
    assert tuple(df.select(text.ago_spoken(*c), text.ago_rounded(*c), text.ago_rounded(*c, short=True)).first()) == (spoken, rounded, short)


def test_dusk(spark):
    df = spark.createDataFrame([(1, "tallinn"), (6, "helsinki"), (13, "riga"), (None, "riga"), (1, None)], "m int, c string")
    assert [r[0] for r in df.select(when.dusk_label(F.col("m"), F.col("c"))).collect()][:2] == ["16:24", "23:54"]
    assert df.select(when.dusk_label(F.col("m"), F.col("c")).alias("d")).where("m = 1 and c is null").first()[0] == "16:24"
    assert df.select(when.dusk_label(F.col("m"), F.col("c")).alias("d")).where("m is null or m = 13").count() == 2


def test_profiles(spark):
    pages = ["", None, "x http://WWW.facebook.com/tr?id=1 https://facebook.com/profile.php?id=2 https://m.facebook.com/the-club/", "https://facebook.com/trains", "https://instagram.com/accounts/x https://instagram.com/a.b_c\"", "facebook.com/none"]
    df = spark.createDataFrame([(p,) for p in pages], "p string")
    got = [tuple(r) for r in df.select(markup.profile_link(F.col("p"), "facebook"), markup.profile_link(F.col("p"), "instagram")).collect()]
    assert got == [(None, None), (None, None), ("https://m.facebook.com/the-club", None), ("https://facebook.com/trains", None), (None, "https://instagram.com/a.b_c"), (None, None)]


def test_flags(spark):
    df = spark.createDataFrame([("a", 1, True, True), ("a", 2, False, True), ("a", 3, None, True), ("b", 4, True, None), ("c", 5, True, True), (None, 6, True, True)], "g string, k int, tonight boolean, week boolean")
    chosen = spark.createDataFrame([("a", 3), ("a", 2), ("b", 99), (None, 6)], "g string, k int")
    held = upsert.hand_over(df, chosen, "g", "k", "tonight")
    assert sorted((r.k, r.tonight) for r in held.collect()) == [(1, False), (2, True), (3, False), (4, True), (5, True), (6, True)]
    assert held.columns == df.columns and upsert.hand_over(df, chosen.limit(0), "g", "k", "tonight").exceptAll(df).count() == 0
    assert upsert.hand_over(df.limit(0), chosen, "g", "k", "tonight").count() == 0
    reset = upsert.reset_flag(df, "week", "tonight")
    assert sorted((r.k, r.week) for r in reset.collect()) == [(1, True), (2, False), (3, True), (4, None), (5, True), (6, True)]


def test_filled_fields(spark):
    base = spark.createDataFrame([(1, "a", 1.0, "index"), (2, "b", None, "index")], "k int, name string, lat double, source string")
    forms = spark.createDataFrame([(1, " ", None, "manual"), (2, " new ", 5.0, None), (3, None, 7.0, "manual")], "k int, name string, lat double, source string")
    got = sorted(tuple(r) for r in upsert.merge_filled(base, forms, ["k"], ["source"]).collect())
    assert got == [(1, "a", 1.0, "manual"), (2, "new", 5.0, None), (3, None, 7.0, "manual")]
    assert sorted(map(tuple, upsert.merge_filled(base, forms.limit(0), ["k"]).collect())) == sorted(map(tuple, base.collect()))


def test_lists(spark):
    kind = "id string, name string, items array<string>"
    local = spark.createDataFrame([("a", "mine", ["x", "y", "x"]), ("b", "kept", None), ("d", None, ["q"])], kind)
    cloud = spark.createDataFrame([("a", "theirs", ["z", "y"]), ("c", "new", ["w"]), ("d", None, None)], kind)
    got = {r.id: (r.name, r.items) for r in match.merge_lists(local, cloud, "id", "items").collect()}
    assert got == {"a": ("theirs", ["x", "y", "z"]), "b": ("kept", []), "c": ("new", ["w"]), "d": (None, ["q"])}
    parts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "list_id string, n int")
    left, rest = upsert.delete_with_parts(local, parts, local.where("id = 'a'"), "id", "list_id")
    assert {r.id for r in left.collect()} == {"b", "d"} and {r.n for r in rest.collect()} == {2, 3}


def test_finds(spark):
    now = F.lit("2024-01-01").cast("timestamp")
    picks = rows_of(spark, PICKS, {"id": "discovery-cafe-x-abcd1234", "title": "Old", "archived_at": datetime.datetime(2023, 1, 1), "tonight": True}, {"id": "p", "title": "Own"})
    place = {"city": "riga", "kind": "bar", "lat": 1.0, "lng": 2.0}
    hits = rows_of(spark, PLACES_INDEX, {**place, "id": "zz-abcd1234", "name": "CAFE x", "locality": "Riga"}, {**place, "id": "aa-abcd1234", "name": "cafe X", "locality": "Centrs"}, {**place, "id": "3", "name": " ", "lat": None}, {**place, "id": "short", "name": "B & C", "lat": None})
    venues = spark.createDataFrame([("riga", "Cafe X"), ("tallinn", "B & c"), ("riga", None)], "city string, name string")
    out, counts = catalogue.finds_saved(picks, hits, venues, "bars", now)
    got = {r.id: r for r in out.collect()}
    assert set(got) == {"discovery-cafe-x-abcd1234", "p", "discovery-b-c-short"} and tuple(counts.first()) == (4, 3, 1)
    first = got["discovery-cafe-x-abcd1234"]
    assert (first.title, first.venue, first.neighborhood, first.tonight, first.archived_at, first.coords_source, first.pending_review) == ("Cafe X — pending review", "Cafe X", "Centrs", False, None, "venue_join", True)
    assert got["discovery-b-c-short"].thumb_initials == "B&" and got["discovery-b-c-short"].coords_source is None and got["p"].title == "Own"
    none, zero = catalogue.finds_saved(picks, hits.limit(0), venues, "bars", now)
    assert none.count() == 2 and tuple(zero.first()) == (0, 0, 0)


def test_groups_and_badges(spark):
    picks = rows_of(spark, PICKS, {"id": "2", "venue": " Hall", "lat": 1.0, "lng": 2.0}, {"id": "1", "venue": "HALL ", "neighborhood": "", "lat": 1.0}, {"id": "3", "venue": "TBA"}, {"id": "4"})
    assert [tuple(r) for r in catalogue.venue_groups(picks).collect()] == [("HALL", "", None, None, "1", 2)]
    assert catalogue.venue_groups(picks.limit(0)).count() == 0
    kind = "place boolean, open boolean, free boolean, m int, ton boolean"
    cases = [((True, True, True, 5, True), ("Open", True)), ((True, None, True, 5, True), None), ((None, True, None, None, None), None), ((False, None, True, 5, True), ("Free", False)), ((None, None, None, 600, True), ("Now", True)), ((None, None, None, 601, True), ("Doors 10:01", False)), ((None, None, None, 5, None), ("Doors 00:05", False)), ((None, None, False, None, True), ("Tonight", False))]
    df = spark.createDataFrame([c for c, _ in cases], kind).coalesce(1)
    got = [r[0] and tuple(r[0]) for r in df.select(catalogue.badge(F.col("place"), F.col("open"), F.col("free"), F.col("m"), F.lit(600), F.col("ton"))).collect()]
    assert got == [want for _, want in cases]


def test_letters_and_panel(spark):
    picks = rows_of(spark, PICKS, {"id": "a/b", "city": "tartu", "title": "<b>", "handle": "'h"}, {"id": "n", "city": None, "title": None})
    got = {r.city: r.html for r in editing.digest_html(picks, "https://x.test/", F.lit("&")).collect()}
    assert '<a href="https://x.test/a%2Fb">&lt;b&gt;</a>' in got["tartu"] and "via &#39;h" in got["tartu"] and "<h1>This week in Tartu</h1><p>&amp;</p>" in got["tartu"] and "<b>" not in got["tartu"]
    logs = rows_of(spark, INGEST_LOG, {"id": 1, "fn": "f", "status": "ok"}, {"id": 2, "fn": "f", "status": "error", "error": "late"})
    panel = editing.pipeline_panel(spark.createDataFrame([("new",), (None,), ("new",)], "status string"), logs, 1)
    assert sorted((r.part, r.name, r.n, r.detail) for r in panel.collect()) == [("queue", "new", 2, None), ("queue", "unknown", 1, None), ("run", "f error", 2, "late")]
    assert editing.pipeline_panel(spark.createDataFrame([], "status string"), logs.limit(0)).count() == 0
