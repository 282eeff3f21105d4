"""Covers, pages, versions, derived columns, lookups, shelves, names, tags, settled sources and rounds on small cases."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions import names, text, when
from tidewell.operators import cover, derived, geocode, rank, rounds, shelves
from tidewell.sources import pages, settled, versions


def covers(sequence, query):
    """Every stretch that satisfies a query and holds none that does."""
    alternatives = [yes for yes, _ in cover.parsed(query)]
    words = [w for w, _ in sequence]
    wanted = {w for yes in alternatives for p in yes for w in p}

    def fits(s, e):
        return any(all(any(words[i : i + len(p)] == list(p) for i in range(s, e - len(p) + 2)) for p in yes) for yes in alternatives)

    found = [(s, e) for s in range(len(words)) for e in range(s, len(words)) if fits(s, e)]
    least = [(s, e) for s, e in found if not any((a, b) != (s, e) and s <= a and b <= e for a, b in found)]
    score = 0.0
    for s, e in least:
        inside = [1 / cover.CLASSES[c] for w, c in sequence[s : e + 1] if w in wanted]
        score += len(inside) / sum(inside) / (1 + (e - s) - (len(inside) - 1))
    return score


@pytest.mark.parametrize("query", ["a b", 'a "b c"', "a or b", '"a b a" or c d', 'a -d "c a"', '"a a"', "a"])
def test_covers_match_all_stretches(spark, query):
    rnd = random.Random(query)
    rows = [(i, " ".join(rnd.choices("abcdxyz", k=rnd.randint(0, 5))), " ".join(rnd.choices("abcdx", k=rnd.randint(0, 20)))) for i in range(60)] + [(60, None, None)]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    got = {r.id: r.score for r in cover.cover_rank(df, "id", [(F.col("title"), "A"), (F.col("body"), "C")], query, 1000).collect()}
    want = {}
    for i, a, b in rows:
        sequence = [(w, "A") for w in (a or "").split()] + [(w, "C") for w in (b or "").split()]
        said = f" {' '.join(w for w, _ in sequence)} "
        if any(all(f" {' '.join(p)} " in said for p in yes) and not any(f" {' '.join(p)} " in said for p in no) for yes, no in cover.parsed(query)):
            want[i] = covers(sequence, query)
    assert got == pytest.approx(want, abs=1e-6) and got


def test_query_language(spark):
    assert cover.parsed('Fish "and chips" -peas or -"mushy peas" or Pie-crust fish fish') == [([("fish",), ("and", "chips")], [("peas",)]), ([("pie", "crust"), ("fish",)], [])]
    df = spark.createDataFrame([(1, "fish")], "id long, t string")
    assert cover.parsed('- "" or') == [] and cover.cover_rank(df, "id", [(F.col("t"), "A")], "-fish", 5).count() == 0


@pytest.fixture()
def folder(tmp_path):
    return f"file://{tmp_path}"


def test_pages_outside_the_window_are_not_read(spark, folder):
    rows = spark.createDataFrame([(i // 10, f"2024-01-{i // 10 + 1:02}T{i % 10:02}:00", i, "é\n") for i in range(200)], "page int, start string, id long, name string")
    pages.write_pages(rows, f"{folder}/p", "page", "start")
    for gone in (0, 1, 15):  # pages that must not be read can't be
        (p,) = [x for x in __import__("pathlib").Path(folder[7:]).glob(f"p/page={gone}/part*")]
        p.write_text("{broken")
    got = pages.read_pages(spark, f"{folder}/p", "2024-01-03T05:00", "2024-01-06T00:00").select("page", F.from_json("item", "id long, name string").alias("x")).select("page", "x.*").collect()
    assert sorted(r.id for r in got) == list(range(25, 50)) and {r.name for r in got} == {"é\n"}
    assert pages.total(spark, f"{folder}/p").first().total == 200
    assert pages.read_pages(spark, f"{folder}/p", since="2030").count() == 0
    assert {r.page for r in pages.read_pages(spark, f"{folder}/p", "2024-01-05", most=2).collect()} == {4, 5}
    read = pages.read_pages(spark, f"{folder}/p", "2024-01-03T05:00", "2024-01-06T00:00")
    assert read.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="mount"):
        pages.read_pages(spark, "hdfs://x/y").count()


def test_tasks_grow_with_items_not_with_pages(spark, folder):
    """3,000 pages of few items: a window needs few folders and few tasks, and gives the rows of its pages only."""
    start = F.date_format(F.timestamp_seconds(F.col("id") * 60), "yyyy-MM-dd'T'HH:mm:ss")
    rows = spark.range(9000, numPartitions=6).select((F.col("id") / 3).cast("int").alias("page"), start.alias("start"), "id")
    pages.write_pages(rows, f"{folder}/p", "page", "start", 100)
    path = __import__("pathlib").Path(folder[7:])
    assert sorted(int(x.name[5:]) for x in path.glob("p/page=*")) == list(range(0, 3000, 100)) and len(list(path.glob("p/page=*/part*"))) == 30
    for gone in (0, 2900):
        (p,) = path.glob(f"p/page={gone}/part*")
        p.write_text("{broken")
    got = pages.read_pages(spark, f"{folder}/p", "1970-01-01T10:30:00", "1970-01-06T00:00:00")
    assert got.rdd.getNumPartitions() <= 30
    kept = got.select("page", "position", F.from_json("item", "id long")["id"].alias("id")).collect()
    assert sorted((r.id, r.page, r.position) for r in kept) == [(i, i // 3, i % 3) for i in range(630, 7200)]
    assert {r.page for r in pages.read_pages(spark, f"{folder}/p", "1970-01-01T10:30:00", most=150).collect()} == set(range(210, 360))
    assert pages.total(spark, f"{folder}/p").first().total == 9000


def test_page_with_total(spark):
    got = rank.page_with_total(spark.range(45), [F.asc("id")], 2).collect()
    assert [tuple(r) for r in got] == [(i, 45) for i in range(40, 45)]


def test_a_failed_rewrite_leaves_the_old_version(spark, folder):
    table = versions.Versions(spark, f"{folder}/t")
    assert table.latest() == 0
    with pytest.raises(ValueError):
        table.read()
    assert table.write(spark.range(3).withColumn("v", F.array(F.lit(1.0).cast("float")))) == 1
    reader = table.read()
    with pytest.raises(Exception, match="boom"):
        table.write(spark.range(9).select("id", F.raise_error(F.lit("boom")).alias("v")))
    assert table.latest() == 1 and table.read().count() == 3
    assert versions.retyped(table, {"v": F.lit(None).cast("array<double>")}, "model b") == 2
    assert versions.retyped(table, {"v": F.lit(None).cast("array<int>")}, "model b") == 2  # that note is written
    assert table.read().dtypes[1] == ("v", "array<double>") and table.read().where("v IS NOT NULL").count() == 0
    assert [list(r.v) for r in reader.collect()] == [[1.0]] * 3 == [list(r.v) for r in table.read(1).collect()]


def test_only_stale_columns_are_derived(spark, folder):
    columns = {"low": derived.Derived(["a"], F.lower("a")), "both": derived.Derived(["a", "b"], F.concat_ws("-", "a", "b"))}
    make = lambda rows: spark.createDataFrame(rows, "k long, a string, b string, c string")
    table = versions.Versions(spark, f"{folder}/d")
    derived.write_batch(table, make([(1, "A", "x", "p"), (2, "B", None, "p"), (3, "C", "z", "p")]), "k", columns, 1)
    spy = {**columns, "low": derived.Derived(["a"], F.concat(F.lower("a"), F.lit("!")))}
    change = make([(1, "A", "x", "q"), (2, "B", "y", "p"), (4, None, None, None)])
    for _ in range(2):  # a batch may come again
        out = {r.k: r for r in derived.write_batch(table, change, "k", spy, 2).collect()}
    assert {k: (r.low, r.both, r.c, r.derived_in) for k, r in out.items()} == {1: ("a", "A-x", "q", 1), 2: ("b", "B-y", "p", 2), 3: ("c", "C-z", "p", 1), 4: (None, "", None, 2)}
    assert table.latest() == 2


def test_only_none_is_asked_again(spark):
    places = spark.createDataFrame([(1, "a", "n", "c"), (2, "b", "n", "c"), (3, "d", None, "c"), (4, "e", "n", "c"), (5, "f", "n", "c")], "id long, venue string, neighborhood string, city string")
    kind = "query string, status int, rows array<struct<lat: string, lng: string, address: struct<road: string, house_number: string, postcode: string, city: string>, display_name: string>>"
    hit = [("1.5", "2.5", ("r", None, "9", ""), "x, y")]
    answers = spark.createDataFrame([("a, c", 200, hit), ("b, c", 200, []), ("b, n, c", 200, [("3", "4", None, "p,q,r,s")]), ("d, c", 200, None), ("e, c", 503, hit), ("e, n, c", 200, hit), ("f, c", 200, [])], kind)
    got = {r.id: r for r in geocode.stamped(geocode.geocoded(places, answers), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert {k: (r.outcome, r.lat, r.address, r.error, r.query, r.geocode_failed_at is not None) for k, r in got.items()} == {
        1: ("hit", 1.5, "r, 9", None, "a, c", False), 2: ("hit", 3.0, "p,q,r", None, "b, n, c", False), 3: ("none", None, None, None, "d, c", True), 4: ("error", None, None, 503, "e, c", False), 5: ("error", None, None, None, "f, n, c", False)}


def test_neighbours_match_all_pairs(spark):
    rnd = random.Random(7)
    spot = lambda: (rnd.choice([89.999, 89.9, -89.99, 0.0, 60.0]) + rnd.uniform(-0.05, 0.05), rnd.choice([180, -180, 0, 24.7]) + rnd.uniform(-0.1, 0.1))
    clip = lambda p: (max(-90.0, min(90.0, p[0])), (p[1] + 180) % 360 - 180)
    a, b = [clip(spot()) for _ in range(150)], [clip(spot()) for _ in range(150)] + [(None, 1.0)]
    readers = spark.createDataFrame([(i, *p) for i, p in enumerate(a)], "r long, r_lat double, r_lng double")
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(b)], "p long, lat double, lng double")

    def metres(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))

    for limit in (500, 5000, 40_000):
        got = [(r.r, r.p) for r in shelves.near(readers, places, limit).collect()]
        assert sorted(got) == [(i, j) for i, p in enumerate(a) for j, q in enumerate(b[:-1]) if metres(p, q) <= limit]
    plan = shelves.near(readers, places, 500)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_hours_as_minutes_of_the_week(spark):
    hours = spark.createDataFrame([(1, 6, 1200, 120), (1, 0, 600, 600), (2, 3, 540, 1020), (3, 2, None, 5)], "p long, day int, opens int, closes int")
    spans = shelves.intervals(hours, "p", "day", "opens", "closes")
    assert sorted(tuple(r) for r in spans.collect()) == [(1, 0, 120), (1, 600, 2040), (1, 9840, 10080), (2, 4860, 5340)]
    places = spark.createDataFrame([(1,), (2,), (3,)], "p long")
    assert [[r.p for r in shelves.open_now(places, spans, "p", F.lit(m)).collect()] for m in (0, 119, 120, 4860, 5340)] == [[1], [1], [], [2], []]


def test_names(spark):
    df = spark.createDataFrame([(1, "Éclair"), (2, "eclair"), (3, "50% off"), (4, "500 off"), (5, "a_b"), (6, "aXb"), (7, None), (8, "zoo"), (9, "Ärger")], "id long, name string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    n = F.col("name")
    assert ids(names.holds_term(n, "0% O")) == [3] and ids(names.holds_term(n, "A_B")) == [5] and ids(names.holds_term(n, "")) == [1, 2, 3, 4, 5, 6, 8, 9]
    assert ids(names.same_name(n, "ÉCLAIR")) == [1] and ids(names.same_name(n, "a%b")) == [] and ids(names.alike_name(n, F.lit("ECLAIR"))) == [1, 2]
    assert [r.id for r in names.pick_list(df, "name", "id", "r", 9).collect()] == [9, 2, 1]
    listed = shelves.by_distance_or_name(df, F.when(F.col("id") == 8, 5.0), "name", "id")
    assert [r.id for r in listed.collect()] == [8, 7, 3, 4, 5, 9, 6, 2, 1]


def test_tags_by_each_way(spark):
    s = " <p class='x'>A&amp;lt;b</p>&#039;&#x41;&#X20AC;&#65601;&#1234567890; <br/>c<BR>d <> &nbsp;&#39; "
    got = {way: spark.range(1).select(text.stripped(F.lit(s), way)).first()[0] for way in text.STRIPPERS}
    numbers = "'A€A&#1234567890;"
    assert got == {"cinema": f"A<b {numbers} c d <> '", "channel": "A&lt;b&#039;&#x41;&#X20AC;&#65601;&#1234567890; \nc\nd <>  '".replace("&lt;", "<"), "tickets": "A<b &#039;&#x41;&#X20AC;&#65601;&#1234567890; c d <> '", "feed": "A<b &#039;&#x41;&#X20AC;&#65601;&#1234567890; c d <> '", "facts": "A&amp;lt;b &#039;&#x41;&#X20AC;&#65601;&#1234567890; c d &#39;"}
    assert [spark.range(1).select(text.stripped(F.lit(x).cast("string"), "facts")).first()[0] for x in (None, " <i></i>")] == [None, None]
    assert len(spark.range(1).select(text.stripped(F.lit("x" * 9000), "facts")).first()[0]) == 4000


def test_late_and_broken_sources_fall_back_alone(spark, folder):
    slow = F.udf(lambda x: (time.sleep(60), x)[1], "long")
    broken = F.when(F.col("id") == 2, F.raise_error(F.lit("cut"))).otherwise(F.col("id"))
    live = lambda n: (lambda: spark.range(n))
    made = {"fine": settled.Source(live(5), live(1)), "late": settled.Source(lambda: spark.range(2).select(slow("id").alias("id")), live(7)), "broken": settled.Source(lambda: spark.range(4).select(broken.alias("id")), live(8)), "missing": settled.Source(lambda: spark.read.parquet(f"{folder}/none"), live(9))}
    start = time.time()
    tables, told = settled.settled(spark, made, f"{folder}/s", 15)
    assert time.time() - start < 40
    assert {k: df.count() for k, df in tables.items()} == {"fine": 5, "late": 7, "broken": 8, "missing": 9}
    assert {r.source: (r.fell_back, r.reason == "late") for r in told.collect()} == {"fine": (False, False), "late": (True, True), "broken": (True, False), "missing": (True, False)}


def test_rotation_keeps_its_holder(spark, folder):
    kind = "id string, tonight boolean, this_week boolean, day string, venue string, sort_order int, created_at timestamp, archived_at timestamp, pending_review boolean"
    rows = [("a", None, True, "Sat", "Various venues", 1, None, None, None), ("b", False, True, "Sat", "Hall", 2, None, None, False), ("c", False, False, "Sat", "Hall", 0, None, None, False), ("d", False, True, "Fri", "Hall", 0, None, None, False)]
    table = versions.Versions(spark, f"{folder}/r")
    table.write(spark.createDataFrame(rows, kind))
    assert [tuple(rounds.rotate(table, "Sat", f"n{i}").first()) for i in range(2)] == [("promoted", "b"), ("noop", "b")]
    assert table.latest() == 2 and [r.id for r in table.read().where("tonight").collect()] == ["b"]
    assert tuple(rounds.rotated(spark.createDataFrame(rows[:1], kind), "Mon")[1].first()) == ("noop", None)


def test_a_repeated_round_sends_the_same(spark, folder):
    readers = spark.createDataFrame([("u",), ("v",), ("u",)], "user_id string")
    saved = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1), ("w", 1), ("u", 1)], "user_id string, pick_id long")
    make = lambda rows: spark.createDataFrame(rows, "pick_id long, id long, changed_at long, change string")
    first, second = make([(1, 1, 10, "a"), (1, 2, 20, "b"), (3, 3, 30, "c")]), make([(1, 1, 10, "a"), (1, 2, 20, "b"), (2, 4, 15, "d"), (3, 3, 30, "c")])
    state = versions.Versions(spark, f"{folder}/g")
    send = lambda changes, note: sorted((r.user_id, r.pick_id, r.change) for r in rounds.digest_round(state, readers, saved, changes, note).collect())
    assert send(first, "1") == [("u", 1, "b"), ("v", 1, "b")] == send(second, "1")
    assert send(second, "2") == [("u", 2, "d")] and send(second, "3") == [] and send(second, "2") == [("u", 2, "d")]


def test_stated_flags_stay(spark):
    today = F.lit("2024-01-20").cast("date")
    rows = [(1, True, None, None, None), (2, None, None, "Tonight", "2024-02-01"), (3, None, True, None, "2024-03-01"), (4, None, None, None, "2024-01-20"), (5, False, False, "Fri", "2024-01-26"), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id long, tonight boolean, this_week boolean, day string, date string").withColumn("date", F.col("date").cast("date"))
    got = {r.id: (r.tonight, r.this_week) for r in when.stamped(df, F.col("date"), today).collect()}
    assert got == {1: (True, True), 2: (True, True), 3: (False, True), 4: (True, True), 5: (False, True), 6: (False, False)}
