from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell.functions import hours
from tidewell.operators import facets, lifecycle, match, rank, routes, search, upsert

NOW = TODAY = None


@pytest.fixture(autouse=True)
def present(spark):
    """The present; columns need a session."""
    global NOW, TODAY
    NOW = F.lit("2026-06-01 12:00:00").cast("timestamp")
    TODAY = F.to_date(NOW)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), (None, 5)], "g string, v int")
    assert rows(rank.keep_best(df, ["g"], [F.desc("v")])) == rows(df.where("v in (3, 4, 5)"))
    assert [(r.g, r.v) for r in rank.round_robin(df.where("g is not null"), "g", [F.asc("v")], 3).collect()] == [("a", 1), ("b", 4), ("a", 2)]
    assert [r.v for r in rank.top_k(df, [F.desc("v")], 0).collect()] == [5]
    assert [r.v for r in rank.page(df, [F.asc("v")], 1, 2).collect()] == [3, 4]
    once = rank.mark_duplicates(df, ["g"], [F.desc("v")])
    again = rank.mark_duplicates(once.where("not archived").select("g", "v"), ["g"], [F.desc("v")])
    assert again.where("archived").count() == 0  # nothing is left to archive the second time


def test_fifo_moves_seen_keys_to_the_front(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 0)], "k string, at int")
    assert [r.k for r in rank.recent_distinct(df, ["k"], "at", 2).collect()] == ["x", "y"]


def test_upserts(spark):
    base = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id int, x string, y string")
    new = spark.createDataFrame([(2, None, None), (3, "c", "r")], "id int, x string, y string")
    assert rows(upsert.upsert(base, new, ["id"], {"y": F.col("y").isNotNull()})) == [(1, "a", "p"), (2, None, "q"), (3, "c", "r")]
    assert rows(upsert.upsert(base, new, ["id"], only=["x"])) == [(1, "a", "p"), (2, None, "q"), (3, "c", None)]
    fresh, counts = upsert.insert_ignore(base, new.unionAll(new), ["id"], [F.asc("x")])
    assert rows(fresh) == [(3, "c", "r")] and rows(counts) == [(1, 3)]
    assert rows(upsert.update_where(base, F.col("x") == "a", {"y": F.lit("z")})) == [(1, "a", "z"), (2, "b", "q")]
    assert rows(upsert.exclusive_flag(base, "id", F.lit(2), "on")) == [(1, "a", "p", False), (2, "b", "q", True)]
    assert rows(upsert.change_journal(base, new, "id", ["x"], F.lit(0))) == [(2, "b", None, 0)]
    lists = spark.createDataFrame([("t", "Mine")], "city string, name string")
    wanted = spark.createDataFrame([("t", " mine "), ("t", "New"), ("r", "Mine")], "city string, name string")
    assert rows(upsert.get_or_create(lists, wanted, "city", "name")) == [("r", "Mine"), ("t", "Mine"), ("t", "New")]
    log = upsert.run_log("f", "ok", counts, NOW).first()
    assert log.detail == '{"inserted":1,"skipped":3}'
    old = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, None), (3, datetime(2026, 5, 31))], "id int, at timestamp")
    assert [r[0] for r in rows(upsert.purge(old, "at", F.timestamp_add("DAY", F.lit(-90), NOW)))] == [2, 3]


def test_matches(spark):
    p = spark.createDataFrame([(1, " Hall ", None, None), (2, "bar", 1.0, 2.0), (3, None, None, None)], "id int, venue string, lat double, lng double").withColumn("key", match.name_key(F.col("venue")))
    v = spark.createDataFrame([("hall", 2, 7.0, 8.0), ("hall", 1, 5.0, 6.0)], "key string, vid int, lat double, lng double")
    got = {r.id: (r.lat, r.lng) for r in match.fallback(p, v, ["key"], [F.asc("vid")], ["lat", "lng"]).collect()}
    assert got == {1: (5.0, 6.0), 2: (1.0, 2.0), 3: (None, None)}
    names = spark.createDataFrame([("Apollo",), ("Apollo Kino",), ("Apollonia",), (None,)], "name string")
    assert rows(match.not_blocked(names, "name", ["apollo", " "])) == [("Apollonia",), (None,)]
    a = spark.createDataFrame([("A@x",)], "email string")
    b = spark.createDataFrame([("a@X",), ("b@x",)], "email string")
    assert rows(match.union_without(a, b, "email")) == [("A@x",), ("b@x",)]
    routes_ = spark.createDataFrame([("r", [("v1", "n"), ("gone", None), ("v2", None)])], "id string, stops array<struct<id:string,note:string>>")
    venues = spark.createDataFrame([("v1", 1.0), ("v2", 2.0)], "id string, lat double")
    stops = match.ordered_stops(routes_, venues, ["lat"]).collect()
    assert sorted((r.pos, r.id, r.dropped) for r in stops) == [(0, "v1", 1), (2, "v2", 1)]
    assert match.flagged(p.select("id"), spark.createDataFrame([(1,), (1,)], "id int"), "id", "hit").count() == 3


def test_facets_agree_with_the_result(spark):
    df = spark.createDataFrame([("gig", "t", True), ("gig", "r", False), ("film", "t", None), (None, "t", True)], "kind string, city string, free boolean")
    chain = {"kind": F.col("kind") == "gig", "city": F.col("city") == "t", "free": F.col("free")}
    got = {(r.facet, r.value): r.n for r in facets.facet_counts(df, ["kind", "city"], chain).collect()}
    assert got == {("kind", "gig"): 1, ("kind", "film"): 0, ("city", "t"): 1, ("city", "r"): 0}
    assert got["kind", "gig"] == df.where(facets.all_of(chain)).count()
    assert facets.looser_filter(df, {"free": F.col("free"), "city": F.col("city") == "r"}).collect()[0]["n"] >= 1
    assert rows(facets.mode(df, ["city"], "kind", "none", ["gig"])) == [("r", "none"), ("t", "film")]
    day = F.lit("2026-06-01").cast("date")
    strip = facets.strip(spark.createDataFrame([("2026-06-01",), ("2026-06-01",), ("2026-06-03",), ("2027-01-01",)], "d string").select(F.to_date("d").alias("d")), "d", day).orderBy("date").collect()
    assert [(r.n, r.height) for r in strip[:3]] == [(2, 34), (0, 0), (1, 17)] and len(strip) == 7
    assert facets.extent(spark.createDataFrame([(1.0, None), (2.0, 3.0)], "lat double, lng double"), "lat", "lng").first()[0] == 2.0


def test_lifecycle(spark):
    log = spark.createDataFrame([(i, f, datetime(2026, 5, 20 + i % 9), n) for i, (f, n) in enumerate([("a", 0)] * 3 + [("b", 0)] * 2 + [("c", 0), ("c", 1), ("c", 0)])], "id int, fn string, at timestamp, n int")
    assert [r.fn for r in lifecycle.zero_yield(log, "fn", "at", "id", F.col("n") == 0, F.timestamp_add("DAY", F.lit(-14), NOW)).collect()] == ["a"]
    q = spark.createDataFrame([(1, "in_progress", datetime(2026, 6, 1, 11)), (2, "new", None), (3, "in_progress", datetime(2026, 6, 1, 11, 59))], "id int, status string, claimed_at timestamp")
    assert lifecycle.claim(q, NOW).first().id == 2
    assert lifecycle.claim(q.where("id <> 2"), NOW).first().id == 1
    assert lifecycle.claim(q.where("id = 3"), NOW).count() == 0
    picks = spark.createDataFrame([(1, datetime(2026, 5, 1), True, datetime(2026, 5, 1)), (2, datetime(2026, 7, 1), True, datetime(2026, 5, 1)), (3, None, True, datetime(2026, 6, 1))], "id int, valid_until timestamp, tonight boolean, created_at timestamp").withColumns({"archived_at": F.lit(None).cast("timestamp"), "archive_reason": F.lit(None).cast("string")})
    got = {r.id: (r.archive_reason, r.tonight) for r in lifecycle.expire(picks, NOW).collect()}
    assert got == {1: ("expired", False), 2: (None, False), 3: (None, True)}
    venues = spark.createDataFrame([("v", "active", datetime(2026, 1, 1)), ("w", "active", datetime(2026, 5, 1)), ("x", "active", None)], "venue_id string, status string, last_seen_at timestamp")
    closed = lifecycle.close_absent_venues(venues, NOW)
    assert rows(closed.select("venue_id", "status")) == [("v", "possibly_closed"), ("w", "active"), ("x", "active")]
    hit = lifecycle.cascade(picks.withColumn("venue_id", F.when(F.col("id") == 1, "v")), closed.where("status <> 'active'"), ["venue_id"], NOW)
    assert rows(hit.where("archived_at is not null").select("id")) == [(1,)]


def test_search(spark):
    docs = spark.createDataFrame([(1, "jazz wine", "x"), (2, "jazz jazz wine", "jazz"), (3, "wine", "y"), (4, None, None)], "id int, title string, quote string")
    got = search.text_rank(docs, "id", [(F.col("title"), 1.0), (F.col("quote"), 0.2)], "Jazz, WINE", 10).collect()
    assert [r.id for r in got] == [2, 1] and [r["rank"] for r in got] == [1, 2]
    assert search.text_rank(docs, "id", [(F.col("title"), 1.0)], "", 10).count() == 0
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    near = search.nearest_vectors(vec, "id", "v", F.array(F.lit(1.0), F.lit(0.0)), 4).collect()
    assert [r.id for r in near] == [1, 3, 2, 4] and near[0].distance == 0 and near[3].distance is None
    a = spark.createDataFrame([(1, 1), (2, 50)], "id int, rank int")
    b = spark.createDataFrame([(1, 1), (3, 1)], "id int, rank int")
    fused = {r.id: r.score for r in search.fuse(a, b, "id", 10).collect()}
    assert fused == {1: pytest.approx(2 / 61), 3: pytest.approx(1 / 61), 2: pytest.approx(1 / 110)}
    assert fused == {r.id: r.score for r in search.fuse(b, a, "id", 10).collect()}


def test_routes(spark):
    stops = spark.createDataFrame([("r", 0, 59.43, 24.75, "10:00-18:00"), ("r", 1, 59.44, 24.75, "10:00-12:00"), ("q", 0, None, None, None), ("q", 1, 59.4, 24.7, "24/7")], "route string, pos int, lat double, lng double, h string")
    legs = routes.legs(stops, "route", "pos").withColumn("hours", hours.parse_hours("h"))
    got = {(r.route, r.pos): (r.metres, r.after) for r in legs.collect()}
    assert got["r", 0] == (None, 0) and 1100 < got["r", 1][0] < 1125 and got["r", 1][1] == 14 + 15 and got["q", 1] == (None, 23)
    length = {r.route: (r.known_metres, r.metres) for r in routes.lengths(legs, "route").collect()}
    assert length["q"] == (None, None) and length["r"][0] == length["r"][1]
    walked = {r.route: (r.first_shut, r.any_unknown) for r in routes.summary(routes.schedule(legs, "route", "pos", F.lit(11 * 60 + 40), F.lit(0)), "route", "pos").collect()}
    assert walked == {"r": (1, False), "q": (None, True)}
    leave = {r.route: r.leave_by for r in routes.leave_by(legs, "route", "pos", 600, 0).collect()}
    assert leave == {"r": 600 + 90, "q": None}
